"""Problem 3: new batches against everything accepted before."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import hamming
from ..schema import FORMAT_VERSION
from ..session import Scratch, delete
from . import banding


def chunk_masks(n: int, radius: int) -> list[int]:
    """Bands that miss no pair within ``radius`` bits: the 64 positions are cut into m runs, and each band takes all but
    ``radius`` of them (a pair differs in at most ``radius`` runs, so one band agrees). m is the smallest number for
    which a band value is expected at most four times among ``n`` hashes."""
    for m in range(radius + 1, radius + 7):
        cuts = [round(i * 64 / m) for i in range(m + 1)]
        runs = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(m)]
        keep = m - radius
        if (keep * 64 // m) >= 62 or 4 << (keep * 64 // m) >= n or m == radius + 6:
            found = [sum(runs[i] for i in c) for c in combinations(range(m), keep)]
            return [x - (1 << 64) if x >= 1 << 63 else x for x in found]
    raise AssertionError


def band_keys(h: Column, masks: list[int]) -> Column:
    return F.array(*(F.xxhash64(F.lit(i), h.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))


class HistoryIndex:
    """Band keys with signatures of everything accepted, as a table partitioned by a hash of the key, and the accepted
    exact hashes, partitioned likewise.

    ``near`` and ``exact`` are asked once for all batches that wait: the partitions those touch are collected (at most
    ``parts`` numbers) and stand as a static filter in the scan, so no other file is opened. ``append`` adds what was
    accepted. Neither ever reads the accepted records themselves.
    """

    BANDS = "global_hash bigint, key bigint, part int"
    EXACT = "exact binary, batch_no int, arrival_id bigint, part int"
    #: Rows of a partition; of more than four times as many on average, ``compact`` makes smaller ones.
    PER_PART = 1_000_000

    def __init__(self, spark: SparkSession, path: str, masks: list[int], parts: int, radius: int = 3):
        self.spark, self.path, self.masks, self.parts, self.radius = spark, path, masks, parts, radius

    @classmethod
    def kept(cls, spark: SparkSession, path: str, n: int, radius: int = 3, parts: int | None = None) -> HistoryIndex:
        """The index at ``path``, with the bands and partitions it was made with, or else a new one for about ``n`` hashes
        (its bands are those of 2^32, as they can't change later)."""
        masks = chunk_masks(1 << 32, radius)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/made")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            made = spark.read.parquet(f"{path}/made").first()
            if made["radius"] != radius:
                raise ValueError(f"the index at {path} is for a radius of {made['radius']}")
            return cls(spark, f"{path}/{made['version']}", masks, made["parts"], radius)
        index = cls(spark, path, masks, parts or cls.parts_for(n * len(masks)), radius)
        index._made(path, "v0")
        return index

    @classmethod
    def parts_for(cls, rows: int) -> int:
        return max(4, min(8192, rows // cls.PER_PART))

    def _made(self, root: str, version: str) -> None:
        made = self.spark.createDataFrame([(version, self.parts, self.radius)], "version string, parts int, radius int")
        made.coalesce(1).write.mode("overwrite").parquet(f"{root}/made")
        self.path = f"{root}/{version}"

    def compact(self, root: str) -> None:
        """Rewrites the index of ``root`` into one file or a few for each partition, with as many partitions as its size asks
        for. Needed now and then: after many appends, or when partitions have grown."""
        bands, exact = self._read("bands", self.BANDS), self._read("exact", self.EXACT)
        old, version = self.path, "v" + str(int(self.path.rpartition("/v")[2]) + 1)
        self.parts = self.parts_for(bands.count())
        self.path = f"{root}/{version}"
        self._write("bands", bands.withColumn("part", self._part(F.col("key"))), "key")
        self._write("exact", exact.withColumn("part", self._part(F.xxhash64("exact"))), "exact")
        self._made(root, version)
        delete(self.spark, old)

    def _part(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.parts)).cast("int")

    def keys(self, hashes: DataFrame) -> DataFrame:
        """(global_hash, key, part) of distinct non-null hashes."""
        exploded = hashes.select("global_hash", F.explode(band_keys(F.col("global_hash"), self.masks)).alias("key"))
        return exploded.select("global_hash", "key", self._part(F.col("key")).alias("part"))

    def _write(self, name: str, rows: DataFrame, order: str) -> None:
        # a partition is written by up to four tasks, so that no crowded one holds up the job
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.parts if self.parts > 64 else 0)
        salted = rows.repartition(tasks, "part", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "part")), F.lit(4)))
        salted.sortWithinPartitions("part", order).write.mode("append").partitionBy("part").parquet(f"{self.path}/{name}")

    def append(self, accepted: DataFrame) -> None:
        """Index accepted (batch_no, arrival_id, exact, global_hash) rows; either hash may be null."""
        self._write("bands", self.keys(accepted.where("global_hash is not null").select("global_hash").distinct()), "key")
        first = accepted.where("exact is not null").groupBy("exact").agg(F.min(F.struct("batch_no", "arrival_id")).alias("at"))
        self._write("exact", first.select("exact", "at.batch_no", "at.arrival_id", self._part(F.xxhash64("exact")).alias("part")), "exact")

    def _read(self, name: str, schema: str, asked: DataFrame | None = None, n: int = 0) -> DataFrame:
        """A table of the index; of it only the partitions of the ``part`` column of ``asked``. Where ``asked`` is known to
        hold ``n`` keys, eight times as many as there are partitions, it touches (nearly) all and isn't looked through."""
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        if asked is None or n >= 8 * self.parts:
            return rows
        touched = sorted(r["part"] for r in asked.select("part").distinct().collect())
        return rows if len(touched) == self.parts else rows.where(F.col("part").isin(touched))

    def exact(self, wanted: DataFrame, n: int = 0) -> DataFrame:
        """(exact, at) of the accepted ones among the (at least ``n``, if known) ``exact`` hashes of ``wanted``, with the
        order of the first row that has it."""
        asked = wanted.where("exact is not null").select("exact", self._part(F.xxhash64("exact")).alias("part")).distinct()
        return self._read("exact", self.EXACT, asked, n).join(asked, ["part", "exact"]).groupBy("exact").agg(F.min(F.struct("batch_no", "arrival_id")).alias("at"))

    def near(self, hashes: DataFrame, n: int = 0) -> DataFrame:
        """Those of distinct ``global_hash`` rows (at least ``n``, if known) that lie within the radius of an accepted hash."""
        asked = self.keys(hashes)
        index = self._read("bands", self.BANDS, asked, n * len(self.masks)).withColumnRenamed("global_hash", "other")
        met = asked.join(index, ["part", "key"])
        return met.where(hamming("global_hash", "other") <= self.radius).select("global_hash").distinct()


def arrivals(batches: DataFrame) -> DataFrame:
    """Rows that count, once each, as (arrival_id, batch_no, exact, global_hash): current format version, and a 32-byte
    exact or a global hash. An exact of another length counts as missing."""
    exact = F.when(F.octet_length("exact") == 32, F.col("exact"))
    rows = batches.where(F.col("format_version") == FORMAT_VERSION).select("arrival_id", "batch_no", exact.alias("exact"), "global_hash")
    ok = F.col("arrival_id").isNotNull() & F.col("batch_no").isNotNull() & (F.col("exact").isNotNull() | F.col("global_hash").isNotNull())
    return rows.where(ok).dropDuplicates(["arrival_id"])


def judge(batches: DataFrame, radius: int = 3, parts: int | None = None, most: int = 4096, index_path: str | None = None) -> DataFrame:
    """Verdicts (arrival_id, batch_no, verdict) on every counted row of batches 1 and later: ``accepted``; ``exact``, if
    its exact equals one accepted before; else ``near``, if its global hash lies within ``radius`` bits of one accepted
    before. Rows come in order of (batch_no, arrival_id); all of batch 0 is accepted; cases never are.

    Rows of equal (exact, global_hash) are one class, of which only the first can be accepted, so a picture sent very
    often costs one row. What the history index doesn't already decide is settled in rounds: an undecided class with the
    smallest order among its exact and among all hashes near its own is accepted, and those it blocks are cases. The
    minima are taken per exact and per hash, so no group is ever expanded to pairs of its rows. At last the accepted rows
    are appended to the index. All waiting batches are judged together, so the index is read once for them. ``index_path``
    keeps it for later calls, whose tables then hold new batches only, of higher batch numbers.

    Null or malformed hashes: see ``arrivals``. Repeated rows of an id count once, extra columns are ignored, empty
    tables give no rows.
    """
    spark = batches.sparkSession
    scratch = Scratch(spark, "history")
    rows = scratch.table(arrivals(batches), "rows")
    n = rows.count()
    if index_path:
        index = HistoryIndex.kept(spark, index_path, n, radius, parts)
    else:
        masks = chunk_masks(n, radius)
        index = HistoryIndex(spark, scratch.path("index"), masks, parts or HistoryIndex.parts_for(n * len(masks)), radius)
    index.append(rows.where("batch_no = 0"))
    order = F.struct("batch_no", "arrival_id")
    new = rows.where("batch_no > 0")
    classes = scratch.table(new.groupBy("exact", "global_hash").agg(F.min(order).alias("ord")), "classes")
    hashes = classes.where("global_hash is not null").select("global_hash").distinct()
    different = classes.agg(F.approx_count_distinct("exact").alias("e"), F.approx_count_distinct("global_hash").alias("h")).first()
    open_rows = classes.join(index.exact(classes, different["e"]).select("exact"), "exact", "left_anti").join(index.near(hashes, different["h"]), "global_hash", "left_anti").select("exact", "global_hash", "ord")
    undecided = scratch.table(open_rows, "undecided")

    values = undecided.where("global_hash is not null").select("global_hash").distinct()
    banded = values.select(F.explode(band_keys(F.col("global_hash"), index.masks)).alias("key"), F.lit(0).cast("tinyint").alias("kind"), F.col("global_hash").alias("id"), F.col("global_hash").alias("value"))
    met = scratch.table(banding.band_pairs(banded, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 200_000), radius, most), "met")
    pairs = met.where("not hot").select("a", "b")
    if not (hot := met.where("hot")).isEmpty():
        pairs = pairs.unionByName(banding.blocked_pairs(hot.select("key", "kind", F.col("a").alias("id"), F.col("b").alias("value")), radius, most).select("a", "b"))
    # every hash is its own neighbour
    around = pairs.distinct()
    around = around.unionByName(around.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(values.select(F.col("global_hash").alias("a"), F.col("global_hash").alias("b")))
    around = scratch.table(around, "around")

    settled: list[str] = []
    while not settled or not undecided.isEmpty():
        by_exact = undecided.where("exact is not null").groupBy("exact").agg(F.min("ord").alias("eo"))
        by_hash = undecided.where("global_hash is not null").groupBy("global_hash").agg(F.min("ord").alias("ho"))
        near = around.join(by_hash.withColumnRenamed("global_hash", "b"), "b").groupBy("a").agg(F.min("ho").alias("no")).withColumnRenamed("a", "global_hash")
        first = (F.col("exact").isNull() | (F.col("ord") == F.col("eo"))) & (F.col("global_hash").isNull() | (F.col("ord") == F.col("no")))
        settled.append(scratch.path("accepted"))
        undecided.join(by_exact, "exact", "left").join(near, "global_hash", "left").where(first).select("exact", "global_hash", "ord").write.parquet(settled[-1])
        now = spark.read.schema(undecided.schema).parquet(settled[-1])
        blocked = around.join(now.where("global_hash is not null").select(F.col("global_hash").alias("a")), "a", "left_semi").select(F.col("b").alias("global_hash")).distinct()
        rest = undecided.join(now.select("exact").where("exact is not null"), "exact", "left_anti").join(blocked, "global_hash", "left_anti")
        # an accepted class of null hashes blocks by neither key
        rest = rest.join(now.select("ord"), "ord", "left_anti").select("exact", "global_hash", "ord")
        left = scratch.table(rest, "undecided")
        scratch.drop(undecided)
        undecided = left
    # one scan of all rounds
    accepted = spark.read.schema(undecided.schema).parquet(*settled)
    index.append(accepted.select("ord.*", "exact", "global_hash"))
    known = index.exact(new, different["e"])
    same = (F.col("at.batch_no") == F.col("batch_no")) & F.col("at.arrival_id").eqNullSafe(F.col("arrival_id"))
    # of an exact at most one new row is accepted, and none if batch 0 has it
    judged = new.join(known, "exact", "left").join(accepted.select(F.col("ord.arrival_id").alias("arrival_id"), F.lit(True).alias("in")), "arrival_id", "left")
    verdict = F.when(F.col("in"), "accepted").when(F.col("at").isNotNull() & ~same & (F.col("at") < order), "exact").otherwise("near")
    return judged.select("arrival_id", "batch_no", verdict.alias("verdict"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/ingest_batches.parquet")).where("verdict <> 'accepted'").select("arrival_id", "verdict")


#: Row by row, as the statement says it; for small tables.
P3_FOUND_SQL = """
WITH RECURSIVE r AS (
  SELECT DISTINCT ON (arrival_id) arrival_id, batch_no, CASE WHEN octet_length(exact) = 32 THEN hex(exact) END AS e, global_hash AS g
  FROM ingest_batches WHERE format_version = 1 AND arrival_id IS NOT NULL AND batch_no IS NOT NULL AND (octet_length(exact) = 32 OR global_hash IS NOT NULL)
), h AS (SELECT coalesce(list(DISTINCT e) FILTER (e IS NOT NULL), []) AS es, coalesce(list(DISTINCT g) FILTER (g IS NOT NULL), []) AS gs FROM r WHERE batch_no = 0
), o AS (SELECT *, row_number() OVER (ORDER BY batch_no, arrival_id) AS n FROM r WHERE batch_no > 0
), s AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS arrival_id, 'none' AS verdict, es, gs FROM h
  UNION ALL
  SELECT n, arrival_id, verdict, CASE WHEN verdict = 'accepted' AND e IS NOT NULL THEN list_append(es, e) ELSE es END, CASE WHEN verdict = 'accepted' AND g IS NOT NULL THEN list_append(gs, g) ELSE gs END
  FROM (SELECT o.n, o.arrival_id, o.e, o.g, s.es, s.gs, CASE WHEN coalesce(list_contains(s.es, o.e), false) THEN 'exact'
          WHEN o.g IS NOT NULL AND len(list_filter(s.gs, lambda x: bit_count(xor(x, o.g)) <= 3)) > 0 THEN 'near' ELSE 'accepted' END AS verdict
        FROM s JOIN o ON o.n = s.n + 1)
)
SELECT arrival_id, verdict FROM s WHERE verdict IN ('exact', 'near')
"""
