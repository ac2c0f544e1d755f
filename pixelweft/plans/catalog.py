"""Queries of the core operators, each over whole tables, and the SQL that must give the same rows.

Hashes leave as hex text, because SQL engines differ in unsigned types; 32-bit scores are rounded to six places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import formatting, hashing
from ..functions import similarity as S
from ..functions.u64 import coarse_key, hamming, hex64, pick
from ..operators import search
from ..operators.fingerprint import fingerprint, single
from ..schema import N_BLOCKS, HashAlgorithm, MultiHashConfig, PreprocessConfig
from ..session import Scratch, read_spread
from ..sources import files, store
from . import rasters

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/{table}.parquet")


def _six(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def _six_of_score(x: Column) -> Column:
    """``_six`` of a 32-bit score in 0..1 without the decimals of Java that ``round`` goes by: a DOUBLE holds the
    product with 10^6 exactly."""
    return F.floor(x.cast("double") * 1e6 + 0.5) / 1e6


# ---------------------------------------------------------------- fingerprints of the tables

_WHOLE = "len({0}.block_hashes) = 16 AND {0}.global_hash IS NOT NULL AND len(list_filter({0}.block_hashes, lambda x: x IS NULL)) = 0"


def _whole(h: Column) -> Column:
    return h["global_hash"].isNotNull() & (F.size(h["block_hashes"]) == N_BLOCKS) & F.forall(h["block_hashes"], lambda b: b.isNotNull())


def _singles(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(id, fp) of complete rows, ``once`` each."""
    rows = _read(spark, sf_dir, "fingerprints").where(_whole(F.struct("global_hash", "block_hashes")))
    return (rows.dropDuplicates(["id"]) if once else rows).select("id", F.struct("exact", "global_hash", "block_hashes").alias("fp"))


def _multis(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    rows = _read(spark, sf_dir, "multi_fingerprints")
    for a in HashAlgorithm:
        rows = rows.where(F.col(a.field).isNotNull() & _whole(F.col(a.field)))
    return (rows.dropDuplicates(["id"]) if once else rows).select("id", "exact", *(a.field for a in HashAlgorithm))


def _single_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the one of the next id. A repeated row gives a repeated pair: what comes of it is small, and is made
    distinct without sorting whole fingerprints."""
    rows = _singles(spark, sf_dir, once=False)
    return rows.select("id", F.col("fp").alias("a")).join(rows.select((F.col("id") - 1).alias("id"), F.col("fp").alias("b")), "id")


def _multi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _multis(spark, sf_dir, once=False).select("id", search.multi().alias("fp"))
    return rows.select("id", F.col("fp").alias("a")).join(rows.select((F.col("id") - 1).alias("id"), F.col("fp").alias("b")), "id")


_SINGLES = f"SELECT DISTINCT ON (id) id, exact, global_hash AS g, block_hashes AS b FROM fingerprints t WHERE {_WHOLE.format('t')}"
_S_PAIRS = f"WITH s AS ({_SINGLES}), p AS (SELECT x.id, x.exact AS xe, x.g AS xg, x.b AS xb, y.exact AS ye, y.g AS yg, y.b AS yb FROM s x JOIN s y ON y.id = x.id + 1)"
_ALL_THREE = " AND ".join(_WHOLE.format(a.field) for a in HashAlgorithm)
_MULTIS = f"SELECT DISTINCT ON (id) id, exact, ahash, phash, dhash FROM multi_fingerprints WHERE {_ALL_THREE}"
_M_PAIRS = f"WITH m AS ({_MULTIS}), p AS (SELECT x.id, x.exact AS xe, y.exact AS ye, " + ", ".join(f"{s}.{a.field}.global_hash AS {s}g{a.field[0]}, {s}.{a.field}.block_hashes AS {s}b{a.field[0]}" for s in "xy" for a in HashAlgorithm) + " FROM m x JOIN m y ON y.id = x.id + 1)"


def _sql_hash_sim(d: str) -> str:
    return f"(1::FLOAT - (({d})::FLOAT / 64::FLOAT)::FLOAT)::FLOAT"


def _sql_block_sim(x: str, y: str, threshold: int) -> str:
    kept = f"list_filter(list_transform(range(1, 17), lambda i: bit_count(xor({x}[i], {y}[i]))), lambda d: d <= {threshold})"
    total = f"coalesce(list_sum(list_transform({kept}, lambda d: 64 - d)), 0)"
    return f"CASE WHEN len({kept}) = 0 THEN 0::FLOAT ELSE (({total}::FLOAT / 64::FLOAT)::FLOAT / len({kept})::FLOAT)::FLOAT END"


def _sql_score(x: str, y: str, bx: str, by: str, threshold: int = 32, gw: float = 0.4, bw: float = 0.6) -> str:
    return f"greatest(0::FLOAT, least(1::FLOAT, ({gw}::FLOAT * {_sql_hash_sim(f'bit_count(xor({x}, {y}))')} + {bw}::FLOAT * ({_sql_block_sim(bx, by, threshold)}))::FLOAT))"


def _sql_single(threshold: int = 32, gw: float = 0.4, bw: float = 0.6) -> str:
    same = "coalesce(xe = ye, false)"
    return f"""{_S_PAIRS} SELECT id, round((CASE WHEN {same} THEN 1::FLOAT ELSE {_sql_score('xg', 'yg', 'xb', 'yb', threshold, gw, bw)} END)::DOUBLE, 6) AS score,
        {same} AS exact_match, (CASE WHEN {same} THEN 0 ELSE bit_count(xor(xg, yg)) END)::INTEGER AS perceptual_distance FROM p"""


def _sql_multi(c: MultiHashConfig) -> str:
    same = "coalesce(xe = ye, false)"
    one = [(a.field[0], c.weight(a)) for a in HashAlgorithm]
    scores = " + ".join(f"({w}::FLOAT * {_sql_score(f'xg{k}', f'yg{k}', f'xb{k}', f'yb{k}', c.block_distance_threshold, c.global_weight, c.block_weight)})::FLOAT" for k, w in one)
    distances = " + ".join(f"({w}::FLOAT * bit_count(xor(xg{k}, yg{k}))::FLOAT)::FLOAT" for k, w in one)
    weights = "(" + " + ".join(f"{w}::FLOAT" for _, w in one) + ")"
    distance = f"CASE WHEN {weights} > 0 THEN trunc((({distances}) / {weights})::FLOAT) ELSE 0 END"
    return f"""{_M_PAIRS} SELECT id, round((CASE WHEN {same} THEN 1::FLOAT ELSE greatest(0::FLOAT, least(1::FLOAT, {scores})) END)::DOUBLE, 6) AS score,
        {same} AS exact_match, (CASE WHEN {same} THEN 0 ELSE {distance} END)::INTEGER AS perceptual_distance FROM p"""


def _flat(df: DataFrame, similarity: Column) -> DataFrame:
    out = df.select("id", similarity.alias("s"))
    return out.select("id", _six(F.col("s.score")).alias("score"), F.col("s.exact_match").alias("exact_match"), F.col("s.perceptual_distance").alias("perceptual_distance")).distinct()


@_query("hamming", f"{_S_PAIRS} SELECT id, bit_count(xor(xg, yg))::INTEGER AS distance FROM p")
def _hamming(spark: SparkSession, d: str) -> DataFrame:
    return _single_pairs(spark, d).select("id", hamming(F.col("a.global_hash"), F.col("b.global_hash")).alias("distance")).distinct()


@_query("hash_similarity", f"{_S_PAIRS} SELECT id, round({_sql_hash_sim('bit_count(xor(xg, yg))')}::DOUBLE, 6) AS similarity FROM p")
def _hash_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _single_pairs(spark, d).select("id", _six(S.hash_similarity(hamming(F.col("a.global_hash"), F.col("b.global_hash")))).alias("similarity")).distinct()


def _block_query(name: str, threshold: int) -> None:
    @_query(name, f"{_S_PAIRS} SELECT id, round(({_sql_block_sim('xb', 'yb', threshold)})::DOUBLE, 6) AS similarity FROM p")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _single_pairs(spark, d).select("id", _six(S.block_similarity(F.col("a.block_hashes"), F.col("b.block_hashes"), threshold)).alias("similarity")).distinct()


for _name, _t in (("block_similarity", 32), ("block_similarity_t28", 28)):
    _block_query(_name, _t)


def _single_query(name: str, **kw: float) -> None:
    sql = {"threshold": "threshold", "global_weight": "gw", "block_weight": "bw"}

    @_query(name, _sql_single(**{sql[k]: v for k, v in kw.items()}))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(_single_pairs(spark, d), S.compare_single(F.col("a"), F.col("b"), **kw))


_single_query("compare_single")
_single_query("compare_single_threshold", threshold=28)
_single_query("compare_single_weights", global_weight=0.7, block_weight=0.3)


def _multi_query(name: str, config: MultiHashConfig) -> None:
    @_query(name, _sql_multi(config))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(_multi_pairs(spark, d), S.compare_multi(F.col("a"), F.col("b"), config))


for _name, _c in {
    "compare_multi": MultiHashConfig(),
    "compare_multi_threshold": MultiHashConfig(block_distance_threshold=28),
    "compare_multi_config": MultiHashConfig(0.2, 0.5, 0.3, 0.5, 0.5, 30),
    "compare_multi_phash_only": MultiHashConfig(0.0, 1.0, 0.0),
    "compare_multi_zero_weights": MultiHashConfig(0.0, 0.0, 0.0),
    "compare_multi_inflated": MultiHashConfig(1.0, 2.0, 1.5),
}.items():
    _multi_query(_name, _c)


@_query("is_similar", f"SELECT id, score >= 0.52::FLOAT AS similar FROM ({_sql_multi(MultiHashConfig()).replace(')::DOUBLE, 6) AS score', ')::DOUBLE, 9)::FLOAT AS score')})")
def _is_similar(spark: SparkSession, d: str) -> DataFrame:
    pairs = _multi_pairs(spark, d).select("id", S.compare_multi(F.col("a"), F.col("b")).alias("s"))
    return pairs.select("id", S.is_similar(F.col("s"), 0.52).alias("similar")).distinct()


@_query("similarity_band", f"SELECT CASE WHEN score > 0.8 THEN 'very similar' WHEN score > 0.5 THEN 'somewhat similar' ELSE 'different' END AS band, count(*) AS pairs FROM ({_sql_multi(MultiHashConfig())}) GROUP BY 1")
def _similarity_band(spark: SparkSession, d: str) -> DataFrame:
    pairs = _multi_pairs(spark, d).select("id", S.compare_multi(F.col("a"), F.col("b"))["score"].alias("score")).distinct()
    return pairs.groupBy(S.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("pairs"))


def _coarse_query(bits: int) -> None:
    whole = f"SELECT DISTINCT ON (id) id, to_hex(global_hash::BIGINT) AS h FROM fingerprints t WHERE {_WHOLE.format('t')}"
    padded = "lpad(lower(h), 16, '0')"
    if bits % 4 == 0:
        key = f"lpad(substr({padded}, 1, {bits // 4}), 16, '0')" if bits else "'0000000000000000'"
    else:
        key = f"lpad(lower(to_hex((('0x' || substr({padded}, 1, 1))::BIGINT >> {4 - bits}))), 16, '0')"

    @_query(f"coarse_key_{bits}", f"SELECT id, {key} AS coarse_key FROM ({whole})")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _singles(spark, d).select("id", hex64(coarse_key(F.col("fp.global_hash"), bits)).alias("coarse_key"))


for _bits in (0, 1, 8, 16, 64):
    _coarse_query(_bits)


@_query("coarse_bucket_index", f"SELECT substr(lpad(lower(to_hex(phash.global_hash)), 16, '0'), 1, 4) AS coarse_key, count(*) AS members, min(id) AS first_id FROM ({_MULTIS}) GROUP BY 1")
def _coarse_bucket_index(spark: SparkSession, d: str) -> DataFrame:
    index = search.bucket_index(_multis(spark, d), "id", HashAlgorithm.PHASH, 16)
    return index.select(F.substring(hex64("coarse_key"), 13, 4).alias("coarse_key"), "members", "first_id")


_NEAR = f"""WITH m AS ({_MULTIS}), k AS (SELECT *, substr(lpad(to_hex(phash.global_hash), 16, '0'), 1, 4) AS k FROM m {{where}}),
 p AS (SELECT x.id AS id, y.id AS id_b, x.exact AS xe, y.exact AS ye, {", ".join(f"{s}.{a.field}.global_hash AS {s}g{a.field[0]}, {s}.{a.field}.block_hashes AS {s}b{a.field[0]}" for s in "xy" for a in HashAlgorithm)}
 FROM k x JOIN k y ON {{on}} x.id < y.id)"""


def _sql_near(where: str, score: float, on: str = "") -> str:
    body = _sql_multi(MultiHashConfig()).partition(" SELECT id, round(")[2]
    return f"{_NEAR.format(where=where, on=on)} SELECT id AS id_a, id_b, score, exact_match, perceptual_distance FROM (SELECT id, id_b, round({body}) WHERE score >= {score}"


def _shown_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("id_a", "id_b", _six(F.col("similarity.score")).alias("score"), F.col("similarity.exact_match").alias("exact_match"), F.col("similarity.perceptual_distance").alias("perceptual_distance"))


@_query("coarse_bucket_join", _sql_near("", 0.9, "x.k = y.k AND"))
def _coarse_bucket_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within buckets: lossy by contract, and so is its SQL. The queries below compare all pairs."""
    return _shown_pairs(search.near_duplicates_in_buckets(_multis(spark, d), "id", 0.9))


@_query("near_duplicates_singletons", _sql_near("WHERE exact IN (SELECT exact FROM m GROUP BY exact HAVING count(*) = 1)", 0.9))
def _near_singletons(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the pictures whose bytes came once."""
    return _shown_pairs(search.near_duplicates(search.singletons(_multis(spark, d).where("exact is not null")), "id", 0.9))


@_query("near_duplicates_representative", _sql_near("WHERE (exact, id) IN (SELECT (exact, min(id)) FROM m WHERE exact IS NOT NULL GROUP BY exact)", 0.9))
def _near_representative(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the first pictures of all groups of equal bytes."""
    return _shown_pairs(search.near_duplicates(search.representatives(_multis(spark, d, once=False).where("exact is not null"), "id"), "id", 0.9))


@_query("exact_duplicates", "SELECT lower(hex(exact)) AS exact, count(*) AS members, min(id) AS first_id FROM (SELECT DISTINCT id, exact FROM fingerprints WHERE exact IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def _exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "fingerprints").select("id", "exact").distinct()
    return search.exact_duplicates(rows, "id").select(formatting.exact_hex(F.col("exact")).alias("exact"), "members", "first_id")


@_query("duplicate_members", "WITH f AS (SELECT DISTINCT id, exact FROM fingerprints WHERE exact IS NOT NULL), g AS (SELECT exact, min(id) AS first_id FROM f GROUP BY exact HAVING count(*) > 1) SELECT id, first_id FROM f JOIN g USING (exact)")
def _duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return search.duplicate_members(_read(spark, d, "fingerprints").select("id", "exact").distinct(), "id")


@_query("full_fingerprint_groups", f"SELECT lower(hex(exact)) AS exact, lpad(lower(to_hex(g)), 16, '0') AS global_hash, count(*) AS members FROM ({_SINGLES}) GROUP BY exact, g, b HAVING count(*) > 1")
def _full_groups(spark: SparkSession, d: str) -> DataFrame:
    return search.full_duplicates(_singles(spark, d)).select(formatting.exact_hex(F.col("fp.exact")).alias("exact"), hex64(F.col("fp.global_hash")).alias("global_hash"), "members")


_SEARCH = f"WITH m AS ({_MULTIS}), q AS (SELECT * FROM m ORDER BY id LIMIT 1), p AS (SELECT x.id, x.exact AS xe, y.exact AS ye, " + ", ".join(f"{s}.{a.field}.global_hash AS {s}g{a.field[0]}, {s}.{a.field}.block_hashes AS {s}b{a.field[0]}" for s in "xy" for a in HashAlgorithm) + " FROM m x CROSS JOIN q y)"


@_query("similarity_search", f"SELECT id, score, exact_match, perceptual_distance FROM ({_SEARCH} SELECT id, round({_sql_multi(MultiHashConfig()).partition(' SELECT id, round(')[2]}) WHERE score >= 0.54")
def _similarity_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _multis(spark, d, once=False)
    found = search.similarity_search(rows, rows.orderBy("id").limit(1), "id", 0.53)
    return found.select("id", _six(F.col("score")).alias("score"), "exact_match", "perceptual_distance").where("score >= 0.54").distinct()


_SEARCH_ALL = _SEARCH.replace("FROM m ORDER BY id LIMIT 1", "FROM m WHERE id % 50 = 0").replace("p AS (SELECT x.id,", "p AS (SELECT y.id AS query_id, x.id,")


@_query("similarity_search_all", f"SELECT query_id, id, score, exact_match, perceptual_distance FROM ({_SEARCH_ALL} SELECT query_id, id, round({_sql_multi(MultiHashConfig()).partition(' SELECT id, round(')[2]}) WHERE score >= 0.54")
def _similarity_search_all(spark: SparkSession, d: str) -> DataFrame:
    """As queries all rows whose id is divisible by 50."""
    rows = Scratch(spark, "search").table(_multis(spark, d), "rows")
    found = search.similarity_blocks(rows, rows.where("id % 50 = 0"), "id", 0.53)
    return found.select("query_id", "id", _six_of_score(F.col("score")).alias("score"), "exact_match", "perceptual_distance").where("score >= 0.54")


# ---------------------------------------------------------------- texts, JSON, records

_HEX_BLOCKS = "array_to_string(list_transform(b, lambda x: lpad(lower(to_hex(x)), 16, '0')), ',')"


@_query("exact_hash", "SELECT doc_id, sha256(text) AS exact FROM documents WHERE text IS NOT NULL")
def _exact_hash(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").where("text is not null").select("doc_id", formatting.exact_hex(hashing.exact_sha256(F.encode("text", "utf-8"))).alias("exact"))


@_query("format_single", f"SELECT id, lower(hex(exact)) || ':' || lpad(lower(to_hex(g)), 16, '0') || ':' || {_HEX_BLOCKS} AS text FROM ({_SINGLES}) WHERE exact IS NOT NULL")
def _format_single(spark: SparkSession, d: str) -> DataFrame:
    return _singles(spark, d).where("fp.exact is not null").select("id", formatting.format_single(F.col("fp")).alias("text"))


@_query("format_multi", f"SELECT id, lower(hex(exact)) || '|' || lpad(lower(to_hex(ahash.global_hash)), 16, '0') || '|' || lpad(lower(to_hex(phash.global_hash)), 16, '0') || '|' || lpad(lower(to_hex(dhash.global_hash)), 16, '0') AS text FROM ({_MULTIS}) WHERE exact IS NOT NULL")
def _format_multi(spark: SparkSession, d: str) -> DataFrame:
    return _multis(spark, d).where("exact is not null").select("id", formatting.format_multi(search.multi()).alias("text"))


@_query("json_export", f"SELECT id::VARCHAR AS filename, lower(hex(exact)) AS exact_hash, lpad(lower(to_hex(phash.global_hash)), 16, '0') AS global_hash, lpad(lower(to_hex(dhash.global_hash)), 16, '0') AS global_dhash FROM ({_MULTIS}) WHERE exact IS NOT NULL")
def _json_export(spark: SparkSession, d: str) -> DataFrame:
    rows = _multis(spark, d).where("exact is not null")
    return rows.select(formatting.export_row(F.col("id").cast("string"), search.multi()).alias("x")).select("x.*")


_ROUND_TRIP = f"SELECT id, lower(hex(exact)) AS exact, lpad(lower(to_hex(g)), 16, '0') AS global_hash, {_HEX_BLOCKS} AS blocks FROM ({_SINGLES}) WHERE octet_length(exact) = 32"


def _shown(df: DataFrame, fp: Column) -> DataFrame:
    out = df.select("id", fp.alias("y"))
    return out.select("id", formatting.exact_hex(F.col("y.exact")).alias("exact"), hex64(F.col("y.global_hash")).alias("global_hash"), F.array_join(F.transform("y.block_hashes", hex64), ",").alias("blocks"))


@_query("json_roundtrip", _ROUND_TRIP)
def _json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _singles(spark, d).where(F.octet_length("fp.exact") == 32).select("id", formatting.json_single(F.col("fp")).alias("j"))
    return _shown(rows, formatting.parse_json_single(F.col("j")))


@_query("pod_roundtrip", _ROUND_TRIP)
def _pod_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _singles(spark, d).where(F.octet_length("fp.exact") == 32).select("id", formatting.pack_single(F.col("fp.exact"), F.col("fp")).alias("r"))
    return _shown(rows, formatting.unpack_single(F.col("r")))


_ROUND_TRIP_MULTI = " UNION ALL ".join(
    f"SELECT id, '{a.value}' AS algorithm, lower(hex(exact)) AS exact, lpad(lower(to_hex({a.field}.global_hash)), 16, '0') AS global_hash, array_to_string(list_transform({a.field}.block_hashes, lambda x: lpad(lower(to_hex(x)), 16, '0')), ',') AS blocks FROM ({_MULTIS}) WHERE octet_length(exact) = 32"
    for a in HashAlgorithm
)


def _shown_multi(back: DataFrame) -> DataFrame:
    """Rows (id, m) with the hashes of all three algorithms."""
    each = F.explode(F.array(*(F.struct(F.lit(a.value).alias("algorithm"), F.col("m.exact").alias("exact"), F.col(f"m.{a.field}.global_hash").alias("global_hash"), F.col(f"m.{a.field}.block_hashes").alias("block_hashes")) for a in HashAlgorithm)))
    return back.select("id", each.alias("y")).select("id", F.col("y.algorithm").alias("algorithm"), formatting.exact_hex(F.col("y.exact")).alias("exact"), hex64(F.col("y.global_hash")).alias("global_hash"), F.array_join(F.transform("y.block_hashes", hex64), ",").alias("blocks"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _multis(spark, d).where(F.octet_length("exact") == 32)


@_query("pod_multi_roundtrip", _ROUND_TRIP_MULTI)
def _pod_multi_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("id", formatting.pack_multi(search.multi()).alias("r"))
    return _shown_multi(rows.select("id", formatting.unpack_multi(F.col("r")).alias("m")))


@_query("json_multi_roundtrip", _ROUND_TRIP_MULTI)
def _json_multi_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("id", formatting.json_multi(search.multi()).alias("j"))
    return _shown_multi(rows.select("id", formatting.parse_json_multi(F.col("j")).alias("m")))


def _sql_little(h: str) -> str:
    """Hex of the 8 bytes of a hash, the least significant first."""
    digits = f"lpad(lower(to_hex({h})), 16, '0')"
    return "(" + " || ".join(f"substr({digits}, {i}, 2)" for i in range(15, 0, -2)) + ")"


def _sql_record(g: str, b: str) -> str:
    return f"lower(hex(exact)) || {_sql_little(g)} || array_to_string(list_transform({b}, lambda x: {_sql_little('x')}), '')"


def _sql_json(g: str, b: str) -> str:
    unsigned = lambda x: f"(CASE WHEN {x} < 0 THEN {x}::HUGEINT + 18446744073709551616 ELSE {x}::HUGEINT END)::VARCHAR"
    return f"""'{{"exact":' || {_SQL_BYTES} || ',"global_hash":' || {unsigned(g)} || ',"block_hashes":[' || array_to_string(list_transform({b}, lambda x: {unsigned('x')}), ',') || ']}}'"""


_SQL_BYTES = "'[' || array_to_string(list_transform(range(32), lambda i: ('0x' || substr(hex(exact), 2 * i + 1, 2))::INTEGER::VARCHAR), ',') || ']'"


@_query("pod_bytes", f"SELECT id, {_sql_record('g', 'b')} AS record FROM ({_SINGLES}) WHERE octet_length(exact) = 32")
def _pod_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The 168 bytes themselves, as hex text."""
    rows = _singles(spark, d).where(F.octet_length("fp.exact") == 32)
    return rows.select("id", F.lower(F.hex(formatting.pack_single(F.col("fp.exact"), F.col("fp")))).alias("record"))


@_query("pod_multi_bytes", f"SELECT id, lower(hex(exact)) || {' || '.join(_sql_record(f'{a.field}.global_hash', f'{a.field}.block_hashes') for a in HashAlgorithm)} AS record FROM ({_MULTIS}) WHERE octet_length(exact) = 32")
def _pod_multi_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", F.lower(F.hex(formatting.pack_multi(search.multi()))).alias("record"))


@_query("json_text", f"SELECT id, {_sql_json('g', 'b')} AS text FROM ({_SINGLES}) WHERE octet_length(exact) = 32")
def _json_text(spark: SparkSession, d: str) -> DataFrame:
    """The JSON text itself."""
    rows = _singles(spark, d).where(F.octet_length("fp.exact") == 32)
    return rows.select("id", formatting.json_single(F.col("fp")).alias("text"))


@_query("json_multi_text", "SELECT id, '{\"exact\":' || " + _SQL_BYTES + " || " + " || ".join(f"""',"{a.field}":' || {_sql_json(f'{a.field}.global_hash', f'{a.field}.block_hashes')}""" for a in HashAlgorithm) + f" || '}}' AS text FROM ({_MULTIS}) WHERE octet_length(exact) = 32")
def _json_multi_text(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", formatting.json_multi(search.multi()).alias("text"))


@_query("bincode_roundtrip", _ROUND_TRIP)
def _bincode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _singles(spark, d).where(F.octet_length("fp.exact") == 32).select("id", formatting.bincode_single(F.col("fp.exact"), F.col("fp")).alias("r"))
    return _shown(rows, formatting.from_bincode_single(F.col("r")))


_SQL_SCORE_TEXT = "CASE WHEN exact_match IS NULL THEN 'null' WHEN exact_match THEN 'true' ELSE 'false' END"


@_query("json_similarity", f"""SELECT left_id, right_id, '{{"score":' || coalesce(round(score::DOUBLE, 6)::VARCHAR, 'null') || ',"exact_match":' || {_SQL_SCORE_TEXT} || ',"perceptual_distance":' || coalesce(perceptual_distance::VARCHAR, 'null') || '}}' AS text FROM similarities WHERE score IS NULL OR (score >= 0.001::FLOAT AND score <= 1::FLOAT)""")
def _json_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "similarities").where("score is null or (score >= cast(0.001 as float) and score <= cast(1 as float))")
    s = F.struct(_six(F.col("score")).alias("score"), "exact_match", "perceptual_distance")
    return rows.select("left_id", "right_id", formatting.json_similarity(s).alias("text"))


@_query("json_embedding_roundtrip", "SELECT DISTINCT id, model_id, len(vector)::INTEGER AS dimension, list_transform(vector, lambda x: x::DOUBLE) AS vector FROM embeddings_in WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")
def _json_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings to JSON text and back, all values."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = _read(spark, d, "embeddings_in").where((F.size("vector") > 0) & finite)
    back = rows.select("id", formatting.parse_json_embedding(formatting.json_embedding(F.struct("vector", "model_id"))).alias("e"))
    return back.select("id", F.col("e.model_id").alias("model_id"), F.size("e.vector").alias("dimension"), F.transform("e.vector", lambda x: x.cast("double")).alias("vector")).distinct()


@_query("pick_algorithm", f"SELECT id, lpad(lower(to_hex(CASE id % 3 WHEN 0 THEN ahash.global_hash WHEN 1 THEN phash.global_hash ELSE dhash.global_hash END)), 16, '0') AS global_hash FROM ({_MULTIS})")
def _pick_algorithm(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of an algorithm that differs by row."""
    which = F.element_at(F.array(*(F.lit(a.value) for a in HashAlgorithm)), (F.col("id") % 3).cast("int") + 1)
    return _multis(spark, d).select("id", hex64(pick(search.multi(), which)["global_hash"]).alias("global_hash"))


@_query("single_algorithms", f"SELECT id, a AS algorithm, lpad(lower(to_hex(CASE a WHEN 'AHash' THEN ahash.global_hash WHEN 'PHash' THEN phash.global_hash ELSE dhash.global_hash END)), 16, '0') AS global_hash FROM ({_MULTIS}), (SELECT unnest(['AHash', 'PHash', 'DHash']) AS a)")
def _single_algorithms(spark: SparkSession, d: str) -> DataFrame:
    """Multi fingerprints as three single ones."""
    rows = _multis(spark, d)
    parts = [single(rows, a).select("id", "algorithm", hex64("global_hash").alias("global_hash")) for a in HashAlgorithm]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("version_gate", "SELECT format_version, count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT id, format_version FROM fingerprints WHERE format_version IS DISTINCT FROM 1)) AS refused FROM (SELECT DISTINCT id, format_version FROM fingerprints) WHERE format_version = 1 GROUP BY 1")
def _version_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the gate of stored fingerprints lets through, and how many rows it refuses."""
    every = _read(spark, d, "fingerprints").select("id", "format_version").distinct()
    let = store.load(spark, f"{d}/fingerprints.parquet", strict=False).select("id", "format_version").distinct()
    refused = every.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(let.agg(F.count(F.lit(1)).alias("m")))).select((F.col("n") - F.col("m")).alias("refused"))
    return let.groupBy("format_version").agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(refused))


# ---------------------------------------------------------------- pictures


@_query("ext_filter", "SELECT image_id, lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) AS extension FROM images WHERE lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) IN ('jpg','jpeg','png','gif','webp','bmp')")
def _ext_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "images").where(files.has_picture_ending(F.col("name")))
    return rows.select("image_id", files.extension(F.col("name")).alias("extension"))


@_query(
    "image_format",
    """SELECT image_id, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'PNG' WHEN starts_with(h, 'FFD8FF') THEN 'JPEG'
    WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'GIF' WHEN starts_with(h, '424D') THEN 'BMP'
    WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'WebP' END AS format
    FROM (SELECT image_id, upper(hex(content)) AS h FROM images WHERE content IS NOT NULL)""",
)
def _image_format(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "images").where("content is not null").select("image_id", files.format_of(F.col("content")).alias("format"))


@_query("byte_guard", "SELECT image_id, CASE WHEN octet_length(content) = 0 THEN 'InvalidImage' END AS kind FROM images WHERE content IS NOT NULL")
def _byte_guard(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "images").where("content is not null").select("image_id", files.byte_guard(F.col("content"))["kind"].alias("kind"))


_LIMITS = PreprocessConfig(max_input_bytes=2200, max_dimension=50, min_dimension=36)


@_query("byte_guard_capped", "SELECT image_id, CASE WHEN octet_length(content) = 0 OR octet_length(content) > 2200 THEN 'InvalidImage' END AS kind FROM images WHERE content IS NOT NULL")
def _byte_guard_capped(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "images").where("content is not null").select("image_id", files.byte_guard(F.col("content"), _LIMITS)["kind"].alias("kind"))


@_query("byte_guard_config", "SELECT image_id, 'InvalidImage' AS kind FROM images WHERE content IS NOT NULL")
def _byte_guard_config(spark: SparkSession, d: str) -> DataFrame:
    """Limits that contradict one another are an error of each row."""
    guard = files.byte_guard(F.col("content"), PreprocessConfig(max_dimension=40, min_dimension=50))
    return _read(spark, d, "images").where("content is not null").select("image_id", guard["kind"].alias("kind"))


@_query(
    "decode_guards",
    """WITH h AS (SELECT DISTINCT image_id, expected_error, octet_length(content) AS n, upper(hex(content)) AS h FROM images WHERE content IS NOT NULL),
    s AS (SELECT *, starts_with(h, '89504E470D0A1A0A') AS png, CASE WHEN starts_with(h, '89504E470D0A1A0A') AND n >= 24 AND substr(h, 25, 8) = '49484452' THEN ('0x' || substr(h, 33, 8))::INTEGER END AS w,
          CASE WHEN starts_with(h, '89504E470D0A1A0A') AND n >= 24 AND substr(h, 25, 8) = '49484452' THEN ('0x' || substr(h, 41, 8))::INTEGER END AS t FROM h)
    SELECT image_id, CASE WHEN n = 0 OR n > 2200 THEN 'InvalidImage' WHEN w > 50 OR t > 50 THEN 'InvalidImage' WHEN w < 36 OR t < 36 THEN 'ImageTooSmall'
        WHEN NOT png THEN 'UnsupportedFormat' WHEN expected_error = 'DecodeError' THEN 'DecodeError' END AS kind FROM s""",
)
def _decode_guards(spark: SparkSession, d: str) -> DataFrame:
    """Narrow limits: bytes, then the size by the header, too large before too small, then the format, then the pixels."""
    rows = fingerprint(_spread(spark, d, "images").where("content is not null").select("image_id", "content"), algorithms=(HashAlgorithm.AHASH,), config=_LIMITS)
    kind = F.when(F.col("error").isNull() & F.col("ahash").isNull(), "no hashes").otherwise(F.col("error.kind"))
    return rows.select("image_id", kind.alias("kind")).distinct()


# The first 16 bytes of published hashes of 0, 1, ... 250, 0, ... by the length of the input.
_BLAKE3 = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673", 1023: "10108970eeda3eb932baac1428c7a216", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 2048: "e776b6028c7cd22a4d0ba182a8bf6220", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3", 3072: "b98cb0ff3623be03326b373de6b90952", 31744: "62b6960e1a44bcc1eb1a611a8d6235b6"}


@_query("blake3_vectors", f"SELECT * FROM (VALUES {', '.join(f'({n}, {h!r})' for n, h in _BLAKE3.items())}) AS v(n, start)")
def _blake3_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The other exact hash, by the fingerprint operator, of inputs whose hashes are published."""
    sizes = spark.createDataFrame([(n,) for n in _BLAKE3], "n int")
    digits = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1), lambda i: F.lpad(F.hex(i % 251), 2, "0"))
    content = F.unhex(F.when(F.col("n") > 0, F.array_join(digits, "")).otherwise(""))
    found = fingerprint(sizes.select("n", content.alias("content")), algorithms=(HashAlgorithm.AHASH,), exact="blake3")
    return found.select("n", F.substring(formatting.exact_hex(F.col("exact")), 1, 32).alias("start"))


@_query("fingerprint_errors", "SELECT DISTINCT image_id, sha256(content) AS exact, expected_error AS kind FROM images WHERE content IS NOT NULL")
def _fingerprint_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every kept picture decoded and hashed: the kind of error must be the one the table names, for all others there are hashes."""
    rows = fingerprint(_spread(spark, d, "images").where("content is not null").select("image_id", "content"))
    kind = F.when(F.col("error").isNull() & (F.col("phash").isNull() | F.col("ahash").isNull() | F.col("dhash").isNull()), "no hashes").otherwise(F.col("error.kind"))
    return rows.select("image_id", formatting.exact_hex(F.col("exact")).alias("exact"), kind.alias("kind")).distinct()


@_query("error_kinds", "SELECT coalesce(expected_error, 'ok') AS kind, count(*) AS n_rows FROM images WHERE content IS NOT NULL GROUP BY 1")
def _error_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = fingerprint(_spread(spark, d, "images").where("content is not null").select("image_id", "content"), algorithms=(HashAlgorithm.AHASH,))
    return rows.groupBy(F.coalesce("error.kind", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))


@_query("image_fingerprints")
def _image_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = fingerprint(_spread(spark, d, "images").where("content is not null").select("image_id", "content"))
    return rows.select("image_id", formatting.exact_hex(F.col("exact")).alias("exact"), *(hex64(F.col(f"{a.field}.global_hash")).alias(a.field) for a in HashAlgorithm), F.col("error.kind").alias("kind"))


def _written(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The kept pictures written as files, under their ids and the endings of their names; the folder, and the rows."""
    rows = _spread(spark, d, "images").where("content is not null").select("image_id", files.extension(F.col("name")).alias("ending"), "content")
    folder = Scratch(spark, "pictures").path("files")
    files.write_files(rows.select(F.concat(F.col("image_id").cast("string"), F.lit("."), F.coalesce("ending", F.lit(""))).alias("name"), "content"), folder).agg(F.sum("length")).collect()
    return folder, rows


_ENDING = "lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) IN ('jpg','jpeg','png','gif','webp','bmp')"


@_query("file_scan", f"SELECT DISTINCT image_id, octet_length(content)::BIGINT AS length, sha256(content) AS exact, expected_error AS kind FROM images WHERE content IS NOT NULL AND {_ENDING}")
def _file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Picture files of a folder, listed by their endings, read and fingerprinted."""
    folder, _ = _written(spark, d)
    found = files.fingerprint_files(spark, folder, algorithms=(HashAlgorithm.AHASH,))
    return found.select(F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("bigint").alias("image_id"), "length", formatting.exact_hex(F.col("exact")).alias("exact"), F.col("error.kind").alias("kind"))


@_query("scan_to_json", f"SELECT DISTINCT image_id, sha256(content) AS exact_hash, true AS hashed FROM images WHERE content IS NOT NULL AND expected_error IS NULL AND {_ENDING}")
def _scan_to_json(spark: SparkSession, d: str) -> DataFrame:
    """The folder scanned, exported as lines of JSON and read again; pictures with an error are left out."""
    folder, _ = _written(spark, d)
    out = Scratch(spark, "export").path("json")
    store.export_json(files.fingerprint_files(spark, folder), out)
    back = spark.read.schema("filename string, exact_hash string, global_hash string, global_dhash string").json(out)
    hashed = F.col("global_hash").rlike("^[0-9a-f]{16}$") & F.col("global_dhash").rlike("^[0-9a-f]{16}$")
    return back.select(F.regexp_extract("filename", r"(\d+)\.[^./]+$", 1).cast("bigint").alias("image_id"), "exact_hash", hashed.alias("hashed"))


@_query("listed_files", "SELECT DISTINCT image_id, octet_length(content)::BIGINT AS length, CASE WHEN octet_length(content) > 2200 THEN 'IoError' ELSE expected_error END AS kind FROM images WHERE content IS NOT NULL UNION ALL SELECT -1, NULL, 'IoError'")
def _listed_files(spark: SparkSession, d: str) -> DataFrame:
    """Listed files, whatever their endings, and one that isn't there; large ones aren't read."""
    folder, rows = _written(spark, d)
    path = F.concat(F.lit(f"{folder}/"), F.col("image_id").cast("string"), F.lit("."), F.coalesce("ending", F.lit("")))
    listed = rows.select(path.alias("path")).distinct().unionByName(spark.createDataFrame([(f"{folder}/missing",)], "path string"))
    found = files.fingerprint_paths(spark, listed, PreprocessConfig(max_input_bytes=2200), algorithms=(HashAlgorithm.AHASH,))
    ident = F.coalesce(F.regexp_extract("path", r"/(\d+)\.[^./]*$", 1).try_cast("bigint"), F.lit(-1))
    return found.select(ident.alias("image_id"), "length", F.col("error.kind").alias("kind"))


# ---------------------------------------------------------------- hash stages on synthetic pictures


def _bits(h: Column) -> Column:
    return F.lpad(F.bin(h), 64, "0")


_MEAN_BITS = "array_to_string(list_transform(v, lambda x: CASE WHEN x >= (list_reduce(v, lambda a, z: (a + z)::FLOAT) / 64::FLOAT)::FLOAT THEN '1' ELSE '0' END), '')"
_GRADIENT_BITS = "array_to_string(list_transform(range(64), lambda i: CASE WHEN v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2] THEN '1' ELSE '0' END), '')"
_BLOCKS = f"(SELECT doc_id, p, q, k::INTEGER AS block FROM {rasters.SQL_DOCUMENTS}, (SELECT unnest(range(16)) AS k))"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return rasters.documents(spark, d).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(15))))


def _list(r: str, c: str, n: int) -> str:
    return f"list_transform(range({n}), lambda i: {rasters.sql_pixel(r, c)})"


@_query("luma", "SELECT p_partkey, ((77 * (p_partkey % 256) + 150 * (p_size * 5 % 256) + 29 * (p_partkey // 256 % 256)) // 256)::INTEGER AS grey FROM part")
def _luma(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.floor(F.col("p_partkey") / 256) % 256
    return _read(spark, d, "part").select("p_partkey", hashing.luma(r, g, b).alias("grey"))


_SUMS = "list_sum(v)::BIGINT AS total, list_min(v)::BIGINT AS least, list_max(v)::BIGINT AS most, list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * (i + 1)))::BIGINT AS placed"


@_query("global_region", f"SELECT doc_id, {_SUMS} FROM (SELECT doc_id, list_transform(range(1024), lambda i: {rasters.sql_grey('112 + i // 32', '112 + i % 32')}) AS v FROM {rasters.SQL_DOCUMENTS})")
def _global_region(spark: SparkSession, d: str) -> DataFrame:
    """The 1,024 pixels that the kernel cuts out: sum, extremes, and the sum weighted by place."""
    return rasters.regions(spark, d, blocks=False).drop("block")


@_query("block_grid", f"SELECT doc_id, block, {_SUMS} FROM (SELECT doc_id, block, list_transform(range(4096), lambda i: {rasters.sql_grey('block // 4 * 64 + i // 64', 'block % 4 * 64 + i % 64')}) AS v FROM {_BLOCKS})")
def _block_grid(spark: SparkSession, d: str) -> DataFrame:
    """Likewise all 4,096 pixels of each of the 16 blocks."""
    return rasters.regions(spark, d, blocks=True)


@_query("ahash_global", f"SELECT doc_id, {_MEAN_BITS} AS bits FROM (SELECT doc_id, {_list('112 + i // 8 * 4', '112 + i % 8 * 4', 64)} AS v FROM {rasters.SQL_DOCUMENTS})")
def _ahash_global(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(*hashing.bilinear(lambda y, x: rasters.pixel(y + 112, x + 112), 32, 8, 8))
    return rasters.documents(spark, d).select("doc_id", v.alias("v")).select("doc_id", _bits(hashing.mean_threshold(F.col("v"))).alias("bits"))


@_query("ahash_blocks", f"SELECT doc_id, block, {_MEAN_BITS} AS bits FROM (SELECT doc_id, block, {_list('block // 4 * 64 + i // 8 * 8', 'block % 4 * 64 + i % 8 * 8', 64)} AS v FROM {_BLOCKS})")
def _ahash_blocks(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(*hashing.bilinear(lambda y, x: rasters.pixel(F.col("r0") + y, F.col("c0") + x), 64, 8, 8))
    rows = _blocks(spark, d).withColumns({"r0": F.floor(F.col("block") / 4) * 64, "c0": F.col("block") % 4 * 64})
    return rows.select("doc_id", "block", v.alias("v")).select("doc_id", "block", _bits(hashing.mean_threshold(F.col("v"))).alias("bits"))


@_query("dhash_global", f"SELECT doc_id, {_GRADIENT_BITS} AS bits FROM (SELECT doc_id, [{', '.join(rasters.sql_bilinear('112', '112', 32, 9, 8))}] AS v FROM {rasters.SQL_DOCUMENTS})")
def _dhash_global(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(*hashing.bilinear(lambda y, x: rasters.pixel(y + 112, x + 112), 32, 9, 8))
    return rasters.documents(spark, d).select("doc_id", v.alias("v")).select("doc_id", _bits(hashing.gradient(F.col("v"))).alias("bits"))


@_query("dhash_blocks", f"SELECT doc_id, block, {_GRADIENT_BITS} AS bits FROM (SELECT doc_id, block, [{', '.join(rasters.sql_bilinear('block // 4 * 64', 'block % 4 * 64', 64, 9, 8))}] AS v FROM {_BLOCKS})")
def _dhash_blocks(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(*hashing.bilinear(lambda y, x: rasters.pixel(F.col("r0") + y, F.col("c0") + x), 64, 9, 8))
    rows = _blocks(spark, d).withColumns({"r0": F.floor(F.col("block") / 4) * 64, "c0": F.col("block") % 4 * 64})
    return rows.select("doc_id", "block", v.alias("v")).select("doc_id", "block", _bits(hashing.gradient(F.col("v"))).alias("bits"))


@_query("bilinear_resample", f"SELECT doc_id, list_transform(v, lambda x: round(x::DOUBLE, 5)) AS v FROM (SELECT doc_id, [{', '.join(rasters.sql_bilinear('112', '112', 32, 9, 8))}] AS v FROM {rasters.SQL_DOCUMENTS})")
def _bilinear(spark: SparkSession, d: str) -> DataFrame:
    v = F.array(*hashing.bilinear(lambda y, x: rasters.pixel(y + 112, x + 112), 32, 9, 8))
    return rasters.documents(spark, d).select("doc_id", F.transform(v, lambda x: F.round(x.cast("double"), 5)).alias("v"))


_HALF = "(k // 32 * 2) * 64 + k % 32 * 2"
_BOX = f"round(((((v[{_HALF} + 1] + v[{_HALF} + 2])::FLOAT + v[{_HALF} + 65])::FLOAT + v[{_HALF} + 66])::FLOAT * 0.25::FLOAT)::DOUBLE * 1020)"


@_query("box_downsample", f"SELECT doc_id, block, list_sum(h)::BIGINT AS total, list_sum(list_transform(range(1024), lambda i: h[i + 1] * (i + 1)))::BIGINT AS placed FROM (SELECT doc_id, block, list_transform(range(1024), lambda k: {_BOX}) AS h FROM (SELECT doc_id, block, {_list('block // 4 * 64 + i // 64', 'block % 4 * 64 + i % 64', 4096)} AS v FROM {_BLOCKS}))")
def _box(spark: SparkSession, d: str) -> DataFrame:
    """All 16 blocks halved: the sum of the means, in quarters of a grey level, and the sum weighted by place."""
    return rasters.halves(spark, d)


def _sql_frequency(source: str, keys: str, values: str) -> str:
    """Bits of the frequency hash of ``x``, 1,024 values; null where the median, in DOUBLE, is a toss-up in 32 bits."""
    basis = "[" + ", ".join(repr(math.cos((2 * c + 1) * k * math.pi / 64)) for k in range(8) for c in range(32)) + "]::DOUBLE[]"
    return f"""WITH x AS (SELECT {keys}, {values} AS x FROM {source}), b AS (SELECT {basis} AS b),
    t AS (SELECT {keys}, b, list_transform(range(256), lambda k: list_inner_product(x[(k // 8) * 32 + 1:(k // 8) * 32 + 32], b[(k % 8) * 32 + 1:(k % 8) * 32 + 32])) AS t FROM x, b),
    f AS (SELECT {keys}, list_transform(range(64), lambda k: list_inner_product(list_transform(range(32), lambda r: t[r * 8 + k % 8 + 1]), b[(k // 8) * 32 + 1:(k // 8) * 32 + 32]) / 256) AS c FROM t),
    m AS (SELECT {keys}, c, list_sort(c) AS s FROM f)
    SELECT {keys}, CASE WHEN least(s[33] - s[32], s[34] - s[33]) >= 1e-6 THEN array_to_string(list_transform(c, lambda v: CASE WHEN v >= s[33] THEN '1' ELSE '0' END), '') END AS bits FROM m"""


def _frequency_bits(spark: SparkSession, d: str, where: str) -> DataFrame:
    bits = F.when(F.col("gap") >= 1e-6, _bits(F.col("phash")))
    return rasters.kernel_hashes(spark, d).where(where).select("doc_id", "block", bits.alias("bits"))


@_query("phash_global", _sql_frequency(rasters.SQL_DOCUMENTS, "doc_id", f"list_transform({_list('112 + i // 32', '112 + i % 32', 1024)}, lambda y: y::DOUBLE)"))
def _phash_global(spark: SparkSession, d: str) -> DataFrame:
    """Frequency hashes of all pictures; null where the median is a toss-up in 32 bits."""
    return _frequency_bits(spark, d, "block < 0").drop("block")


_QUAD = "v[(i // 32 * 2) * 64 + i % 32 * 2 + {0}]::DOUBLE"


@_query("phash_blocks", _sql_frequency(f"(SELECT doc_id, block, {_list('block // 4 * 64 + i // 64', 'block % 4 * 64 + i % 64', 4096)} AS v FROM {_BLOCKS})", "doc_id, block", f"list_transform(range(1024), lambda i: ({' + '.join(_QUAD.format(k) for k in (1, 2, 65, 66))}) / 4)"))
def _phash_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Likewise of all blocks, which are halved first."""
    return _frequency_bits(spark, d, "block >= 0")


def _kernel_query(name: str, algorithm: HashAlgorithm, blocks: bool) -> None:
    """The kernel must give the bits of the native stages."""

    @_query(name, _SQL[f"{algorithm.field}_{'blocks' if blocks else 'global'}"])
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = rasters.kernel_hashes(spark, d).where("block >= 0" if blocks else "block < 0").select("doc_id", "block", _bits(F.col(algorithm.field)).alias("bits"))
        return found if blocks else found.drop("block")


for _a in (HashAlgorithm.AHASH, HashAlgorithm.DHASH):
    _kernel_query(f"kernel_{_a.field}", _a, False)
    _kernel_query(f"kernel_{_a.field}_blocks", _a, True)


def _sql_three(keys: str, part: str) -> str:
    """The SQL of all three algorithms side by side, of the centres or of the blocks."""
    of = lambda a: f"(SELECT {keys}, bits AS {a} FROM ({_SQL[f'{a}_{part}']}))"
    return f"SELECT * FROM {of('ahash')} JOIN {of('phash')} USING ({keys}) JOIN {of('dhash')} USING ({keys})"


def _three_bits(hashes: DataFrame, gap: str = "gap") -> DataFrame:
    """Bits of the three algorithms; null for the frequency hash where its median is a toss-up."""
    return hashes.withColumns({"ahash": _bits(F.col("ahash")), "dhash": _bits(F.col("dhash")), "phash": F.when(F.col(gap) >= 1e-6, _bits(F.col("phash")))})


@_query("phash_rasters", _sql_three("doc_id", "global"))
def _phash_rasters(spark: SparkSession, d: str) -> DataFrame:
    return _three_bits(rasters.kernel_hashes(spark, d).where("block < 0")).select("doc_id", *(a.field for a in HashAlgorithm))


def _encoded_fingerprints(spark: SparkSession, d: str, turned: bool = False) -> DataFrame:
    """(doc_id, block, ahash, phash, dhash): fingerprints of the pictures as BMP and PNG files, by the whole operator:
    decoding, grey levels, regions, hashes. Block -1 is the centre."""
    found = fingerprint(rasters.encoded(spark, d, turned), keep=("doc_id",))
    places = F.explode(F.sequence(F.lit(-1), F.lit(N_BLOCKS - 1)))
    of = lambda a: F.when(F.col("block") < 0, F.col(f"{a}.global_hash")).otherwise(F.get(F.col(f"{a}.block_hashes"), F.col("block"))).alias(a)
    rows = found.select("doc_id", *(a.field for a in HashAlgorithm), places.alias("block")).select("doc_id", "block", *(of(a.field) for a in HashAlgorithm))
    return _three_bits(rows.join(rasters.kernel_hashes(spark, d).select("doc_id", "block", "gap"), ["doc_id", "block"])).drop("gap")


@_query("encoded_fingerprints", _sql_three("doc_id", "global"))
def _encoded_centres(spark: SparkSession, d: str) -> DataFrame:
    return _encoded_fingerprints(spark, d).where("block < 0").drop("block")


@_query("oriented_fingerprints", _sql_three("doc_id", "global"))
def _oriented(spark: SparkSession, d: str) -> DataFrame:
    """Pictures stored in the eight orientations come out upright."""
    return _encoded_fingerprints(spark, d, True).where("block < 0").drop("block")


@_query("encoded_fingerprints_blocks", _sql_three("doc_id, block", "blocks"))
def _encoded_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _encoded_fingerprints(spark, d).where("block >= 0")


# ---------------------------------------------------------------- embeddings

_FINITE = "len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x)))"
_EMBEDDING_ERROR = f"CASE WHEN vector IS NULL OR len(vector) = 0 THEN 'vector is empty' WHEN len(vector) > 65536 THEN 'dimension is too large' WHEN {_FINITE.format('vector')} > 0 THEN 'value is not finite' WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'all values are zero' END"


@_query("embedding_validate", f"SELECT id, {_EMBEDDING_ERROR} AS error FROM embeddings_in")
def _embedding_validate(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings_in").select("id", E.embedding_error(F.col("vector")).alias("error"))


@_query("embedding_dimension", "SELECT id, model_id, len(vector)::INTEGER AS dimension FROM embeddings_in")
def _embedding_dimension(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings_in").select("id", "model_id", E.dimension(F.col("vector")).alias("dimension"))


@_query(
    "cosine_errors",
    f"""WITH e AS (SELECT DISTINCT ON (id) id, vector, model_id FROM embeddings_in WHERE {_EMBEDDING_ERROR.replace('CASE', '(CASE', 1)}) IS NULL)
    SELECT CASE WHEN a.model_id <> b.model_id THEN 'InvalidEmbedding' WHEN len(a.vector) <> len(b.vector) THEN 'EmbeddingDimensionMismatch' ELSE 'ok' END AS kind, count(*) AS pairs
    FROM e a JOIN e b ON b.id = a.id + 1 GROUP BY 1""",
)
def _cosine_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "embeddings_in").where(E.usable(F.col("vector"))).dropDuplicates(["id"]).select("id", F.struct("vector", "model_id").alias("e"))
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("e").alias("f")), "id")
    return pairs.groupBy(F.coalesce(E.cosine_error(F.col("e"), F.col("f")), F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("pairs"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.struct(F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("model_id")).alias("embedding"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.where("id % 50 = 0")


@_query("cosine_pairs", "SELECT query_id, id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0) WHERE score >= 0.2")
def _cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return search.cosine_blocks(*_asked(spark, d), floor=0.2)


_TO_FIRST = "SELECT b.vec_id AS id, round(list_cosine_similarity(a.embedding, b.embedding)::DOUBLE, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 0"


def _to_first(spark: SparkSession, d: str, score: float | None) -> DataFrame:
    rows = _vectors(spark, d)
    return search.semantic_search(rows, rows.where("id = 0"), score)


@_query("semantic_search", f"SELECT id, score FROM ({_TO_FIRST}) WHERE score >= 0.25")
def _semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """The vectors most similar to vector 0, best first."""
    found = _to_first(spark, d, 0.2).select("id", F.round(F.col("score").cast("double"), 4).alias("score")).where("score >= 0.25")
    return search.best_first(found)


@_query("semantic_search_085", f"SELECT id, score FROM ({_TO_FIRST}) WHERE score >= 0.85")
def _semantic_search_085(spark: SparkSession, d: str) -> DataFrame:
    return _to_first(spark, d, 0.85).select("id", F.round(F.col("score").cast("double"), 4).alias("score"))


@_query("semantic_topk", f"SELECT id, score FROM ({_TO_FIRST}) ORDER BY score DESC, id LIMIT 10")
def _semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _to_first(spark, d, None).select("id", F.round(F.col("score").cast("double"), 4).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@_query("semantic_topk_all", "SELECT query_id, id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE k <= 5")
def _semantic_topk_all(spark: SparkSession, d: str) -> DataFrame:
    return search.cosine_blocks(*_asked(spark, d), k=5, others=True)


@_query("semantic_bar", f"SELECT id, repeat('█', s) || repeat('░', 10 - s) AS bar, CASE WHEN score >= 0.95 THEN '★' ELSE '' END AS star FROM (SELECT id, score, greatest(0, least(10, trunc(score * 10)))::BIGINT AS s FROM ({_TO_FIRST}))")
def _semantic_bar(spark: SparkSession, d: str) -> DataFrame:
    rows = _to_first(spark, d, None).select("id", F.round(F.col("score").cast("double"), 4).alias("score"))
    return rows.select("id", E.similarity_bar(F.col("score")).alias("bar"), E.star(F.col("score")).alias("star"))


@_query(
    "l2_normalize",
    """WITH w AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * 3::FLOAT)::FLOAT) AS w FROM embeddings),
    n AS (SELECT id, w, sqrt(list_reduce(list_transform(w, lambda y: (y * y)::FLOAT), lambda a, z: (a + z)::FLOAT)::DOUBLE)::FLOAT AS norm FROM w)
    SELECT id, list_transform(w, lambda x: (x / norm)::FLOAT::DOUBLE) AS v, 1.0::DOUBLE AS length FROM n""",
)
def _l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """All values, bit by bit, of vectors three times as long."""
    tripled = F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float"))
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), E.l2_normalize(tripled).alias("v"))
    return rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.round(F.sqrt(E.dot64(F.col("v"), F.col("v"))), 4).alias("length"))


@_query("median_threshold_dirty", "SELECT id, CASE WHEN isnan(m) THEN repeat('0', 64) ELSE array_to_string(list_transform(vector, lambda x: CASE WHEN NOT isnan(x) AND x >= m THEN '1' ELSE '0' END), '') END AS bits FROM (SELECT DISTINCT id, vector, list_sort(vector)[33] AS m FROM embeddings_in WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL)) = 0)")
def _median_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients that aren't all finite: NaN sorts last and reaches no median, a NaN median gives 0."""
    rows = _read(spark, d, "embeddings_in").where((F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull()))
    return rows.select("id", _bits(hashing.median_threshold(F.col("vector"))).alias("bits")).distinct()


@_query("mean_threshold_hash", f"SELECT id, {_MEAN_BITS} AS bits FROM (SELECT vec_id AS id, embedding AS v FROM embeddings)")
def _mean_hash(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _bits(hashing.mean_threshold(F.col("embedding"))).alias("bits"))


@_query("median_threshold_hash", "SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= list_sort(embedding)[33] THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def _median_hash(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _bits(hashing.median_threshold(F.col("embedding"))).alias("bits"))
