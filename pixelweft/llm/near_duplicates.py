"""Problem 1: near-duplicate fingerprints, as pairs and as groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import compare_single, f32, kept_blocks
from ..operators import pairwise
from ..schema import FORMAT_VERSION, N_BLOCKS, HashAlgorithm, MultiHashConfig
from ..session import Scratch
from . import banding
from .components import components

#: Code of a record kind within the operator.
KINDS = {"single": 0, "multi": 1}
#: Records that share a band value by chance.
MATES = 64
#: Rows of a hot group that are compared with one another in one go.
BLOCK = 4096


def comparable(df: DataFrame, kind: str, space: Column, hashes: Column) -> DataFrame:
    """Rows that may be compared, as (kind, space, id, exact, g, blocks): current format version, an id, a global hash
    and exactly 16 non-null blocks. All others (null hashes, short or long lists) take no part. Rows of a repeated id
    count once, see ``near_duplicate_pairs``."""
    h = df.select(F.col("id"), F.col("exact"), space.alias("space"), hashes["global_hash"].alias("g"), hashes["block_hashes"].alias("blocks"), F.col("format_version"))
    ok = (F.col("format_version") == FORMAT_VERSION) & F.col("id").isNotNull() & F.col("space").isNotNull() & F.col("g").isNotNull() & (F.size("blocks") == N_BLOCKS)
    return h.where(ok & F.forall("blocks", lambda b: b.isNotNull())).select(F.lit(KINDS[kind]).cast("tinyint").alias("kind"), "space", "id", "exact", "g", "blocks")


def fingerprint_records(fingerprints: DataFrame | None = None, multi: DataFrame | None = None) -> DataFrame:
    """Comparable rows of both tables; multi fingerprints are taken by their PHash."""
    parts = []
    if fingerprints is not None:
        parts.append(comparable(fingerprints, "single", F.col("algorithm"), F.struct("global_hash", "block_hashes")))
    if multi is not None:
        parts.append(comparable(multi, "multi", F.lit(HashAlgorithm.PHASH.value), F.col("phash")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _banded(classes: DataFrame, global_bands: int, block_bands: int, rows: int, seed: int) -> DataFrame:
    """Band rows (key, slot, kind, id, value) of classes, whose ``place`` is a hash of kind and space; slot 0 is the global
    hash, the blocks follow."""
    hashes = [(F.col("g"), global_bands), *((F.col("blocks")[i], block_bands) for i in range(N_BLOCKS))]
    made = classes.select(F.posexplode(banding.band_keys(F.col("place"), hashes, rows, seed)).alias("pos", "key"), "kind", F.col("cid").alias("id"), F.col("g").alias("value"))
    return made.withColumn("slot", F.when(F.col("pos") < global_bands, 0).otherwise(((F.col("pos") - global_bands) / block_bands).cast("int") + 1))


def _coded(bands: DataFrame) -> DataFrame:
    """With kind and slot in one small number, kind + 2 * slot."""
    return bands.select("key", (F.col("kind") + F.col("slot") * 2).cast("tinyint").alias("kind"), "id", "value")


def near_duplicate_pairs(records: DataFrame, score: float = 0.883, min_blocks: int = 8, block_threshold: int = 32, target_recall: float = 0.99, crowd: float = 16, copies: int | None = 1000) -> DataFrame:
    """Pairs (kind, id_a < id_b) of ``fingerprint_records`` rows of one space whose similarity is at least ``score`` and
    that have at least ``min_blocks`` block positions within ``block_threshold``.

    Rows of equal content are one class (its smallest id stands for it), so copies aren't banded again. Classes meet in
    min-wise bands (``banding``); a band row carries the global hash, and since the blocks can add at most their weight,
    only pairs with a global distance that can reach the score leave the bands. A group of one band value that would give
    more than ``crowd`` candidates a row (flat pictures share hash values), or that is large, is compared whole, in blocks of
    fixed size and by the full score, so no pair that meets in a band is dropped. Candidates are verified on the full hashes.
    Records of equal exact hash have the score 1 and meet by it. Finally classes are expanded to rows; of more than
    ``copies`` exact copies (equal content) each is paired with the one of the smallest id only, which also stands for them in
    pairs with others, since all pairs of a crowd of copies say no more than that. Of more than ``copies`` rows of equal
    bytes the smallest id of each content stands for it. ``copies=None`` gives all pairs whatever the crowd.

    Null, empty or malformed hashes: see ``comparable``. Repeated rows of one id, with equal values, count once. Empty
    tables give an empty result. Extra columns are ignored.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "neardup")
    copies = (1 << 62) if copies is None else copies
    content = ["kind", "space", "g", "blocks"]
    classes = scratch.table(records.groupBy(*content).agg(F.min("id").alias("cid")).withColumn("place", F.xxhash64("kind", "space")), "classes")
    n = classes.count()
    plan = banding.plan_bands(n, target_recall, n_blocks=min_blocks, mates=MATES)
    limit = int((1.0 - score) * 64 / 0.4 + 1e-6)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
    kind = F.pmod("kind", F.lit(2)).cast("tinyint").alias("kind")
    banded = _coded(_banded(classes, plan.global_bands, plan.block_bands, plan.rows, 1))
    met = scratch.table(banding.band_pairs(banded, partitions, limit, BLOCK, crowd), "met")
    pairs = met.where("not hot").select(kind, "a", "b")
    if not (hot := met.where("hot")).isEmpty():
        # all pairs of a hot group, by full score; groups of the same rows (crowds sharing several bands) once
        rows = scratch.table(hot.select("key", kind, F.col("a").alias("cid")).distinct(), "hot")
        groups = rows.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.bit_xor(F.xxhash64("cid")).alias("x"))
        once = groups.groupBy("kind", "n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "kind")
        hashed = classes.select("kind", "cid", pairwise.packed(F.struct(F.col("g").alias("global_hash"), F.col("blocks").alias("block_hashes"))).alias("h"))
        crowded = rows.join(once, ["key", "kind"], "left_semi").join(hashed, ["kind", "cid"]).select("key", "kind", F.col("cid").alias("id"), "h")
        config = MultiHashConfig(block_distance_threshold=block_threshold)
        close = pairwise.close_pairs(crowded, score, [1.0], config, keys=("key", "kind"), block=BLOCK)
        pairs = pairs.unionByName(close.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    hashes = classes.select("kind", "cid", F.struct("g", "blocks").alias("h"))
    full = lambda side: F.struct(F.lit(None).cast("binary").alias("exact"), F.col(side)["g"].alias("global_hash"), F.col(side)["blocks"].alias("block_hashes"))
    verified = (
        pairs.distinct()
        .join(hashes.select("kind", F.col("cid").alias("a"), F.col("h").alias("ha")), ["kind", "a"])
        .join(hashes.select("kind", F.col("cid").alias("b"), F.col("h").alias("hb")), ["kind", "b"])
        .where(compare_single(full("ha"), full("hb"), block_threshold)["score"] >= f32(score))
        .where(kept_blocks(F.col("ha")["blocks"], F.col("hb")["blocks"], block_threshold) >= min_blocks)
        .select("kind", F.col("a").alias("cid_a"), F.col("b").alias("cid_b"))
    )
    members = records.join(classes, content).select("kind", "space", "id", "exact", "cid").distinct()
    sizes = members.groupBy("kind", "cid").agg(F.count(F.lit(1)).alias("n"))
    members = scratch.table(members.join(sizes, ["kind", "cid"]), "members")
    # of a crowd of copies only the representative stands for it
    shown = members.where((F.col("n") <= copies) | (F.col("id") == F.col("cid")))
    of = lambda s: shown.select("kind", F.col("cid").alias(f"cid_{s}"), F.col("id").alias(f"id_{s}"))
    across = verified.join(of("a"), ["kind", "cid_a"]).join(of("b"), ["kind", "cid_b"]).select("kind", "id_a", "id_b")
    several = members.where((F.col("n") > 1) & (F.col("n") <= copies))
    within = several.select("kind", "cid", F.col("id").alias("id_a")).join(several.select("kind", "cid", F.col("id").alias("id_b")), ["kind", "cid"]).where("id_a < id_b").select("kind", "id_a", "id_b")
    crowds = members.where((F.col("n") > copies) & (F.col("id") != F.col("cid"))).select("kind", F.col("cid").alias("id_a"), F.col("id").alias("id_b"))

    same = ["kind", "space", "exact"]
    mixed = members.where("exact is not null").groupBy(*same).agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).alias("twins")).where("lo < hi").select(*same, "twins")
    # of a crowd of equal bytes the smallest id of each class stands for it; the class holds the others
    leads = members.where("exact is not null").groupBy(*same, "cid").agg(F.min("id").alias("lead"))
    twins = members.join(mixed, same).join(leads, [*same, "cid"]).where((F.col("twins") <= copies) | (F.col("id") == F.col("lead"))).join(hashes, ["kind", "cid"]).select(*same, "id", "cid", "h")
    left, right = (twins.select(*same, *(F.col(c).alias(f"{c}_{s}") for c in ("id", "cid", "h"))) for s in "ab")
    equal = (
        left.join(right, same)
        .where("id_a < id_b and cid_a <> cid_b")
        .where(kept_blocks(F.col("h_a")["blocks"], F.col("h_b")["blocks"], block_threshold) >= min_blocks)
        .select("kind", "id_a", "id_b")
    )
    found = across.unionByName(within).unionByName(crowds).unionByName(equal).where("id_a <> id_b")
    return found.select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_duplicate_groups(records: DataFrame, **limits: float) -> DataFrame:
    """(kind, id, group_id) of each comparable record of ``fingerprint_records``: group_id is the smallest id of its kind
    linked to it by pairs of ``near_duplicate_pairs`` (same ``limits``), directly or through others; its own if none is."""
    pairs = Scratch(records.sparkSession, "neargroups").table(near_duplicate_pairs(records, **limits), "pairs")
    every = records.select("kind", "id").distinct()
    parts = []
    for kind in KINDS.values():
        groups = components(pairs.where(F.col("kind") == kind), "id_a", "id_b")
        parts.append(every.where(F.col("kind") == kind).join(groups, "id", "left").select("kind", "id", F.coalesce("group_id", "id").alias("group_id")))
    return parts[0].unionByName(parts[1])


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    groups = near_duplicate_groups(fingerprint_records(read("fingerprints"), read("multi_fingerprints")))
    kind = F.when(F.col("kind") == KINDS["single"], "single").otherwise("multi")
    return groups.select(kind.alias("record_kind"), "id", "group_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pairs = near_duplicate_pairs(fingerprint_records(read("fingerprints"), read("multi_fingerprints")))
    kind = F.when(F.col("kind") == KINDS["single"], "single").otherwise("multi")
    return pairs.select(kind.alias("record_kind"), "id_a", "id_b")


_COMPLETE = "len({0}block_hashes) = 16 AND {0}global_hash IS NOT NULL AND len(list_filter({0}block_hashes, lambda x: x IS NULL)) = 0 AND format_version = 1 AND id IS NOT NULL"
#: All pairs, for small tables.
P1_FOUND_SQL = f"""
WITH r AS (
  SELECT DISTINCT ON (id) 'single' AS record_kind, id, exact, algorithm AS space, global_hash AS g, block_hashes AS b FROM fingerprints
  WHERE {_COMPLETE.format("")} AND algorithm IS NOT NULL
  UNION ALL
  SELECT DISTINCT ON (id) 'multi', id, exact, 'PHash', phash.global_hash, phash.block_hashes FROM multi_fingerprints WHERE {_COMPLETE.format("phash.")}
), p AS (
  SELECT x.record_kind, x.id AS id_a, y.id AS id_b, coalesce(x.exact = y.exact, false) AS same, bit_count(xor(x.g, y.g)) AS d,
    list_filter(list_transform(range(1, 17), lambda i: bit_count(xor(x.b[i], y.b[i]))), lambda k: k <= 32) AS kept
  FROM r x JOIN r y ON x.record_kind = y.record_kind AND x.space = y.space AND x.id < y.id
)
SELECT record_kind, id_a, id_b FROM p WHERE len(kept) >= 8 AND (same OR
  (0.4::FLOAT * (1::FLOAT - (d::FLOAT / 64::FLOAT)::FLOAT)::FLOAT + 0.6::FLOAT * ((list_sum(list_transform(kept, lambda k: 64 - k))::FLOAT / 64::FLOAT)::FLOAT / len(kept)::FLOAT)::FLOAT)::FLOAT >= 0.883::FLOAT)
"""

P1_GROUPS_SQL = f"""
WITH RECURSIVE f AS ({P1_FOUND_SQL}),
n AS (SELECT record_kind, id_a AS a, id_b AS b FROM f UNION ALL SELECT record_kind, id_b, id_a FROM f),
reach AS (SELECT record_kind, a AS id, a AS other FROM n UNION SELECT r.record_kind, r.id, n.b FROM reach r JOIN n ON n.record_kind = r.record_kind AND n.a = r.other),
least AS (SELECT record_kind, id, min(other) AS group_id FROM reach GROUP BY ALL),
every AS (SELECT DISTINCT 'single' AS record_kind, id FROM fingerprints WHERE {_COMPLETE.format("")} AND algorithm IS NOT NULL
  UNION ALL SELECT DISTINCT 'multi', id FROM multi_fingerprints WHERE {_COMPLETE.format("phash.")})
SELECT record_kind, id, coalesce(group_id, id) AS group_id FROM every LEFT JOIN least USING (record_kind, id)
"""
