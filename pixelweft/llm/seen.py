"""Problem 5: has this key been seen before? Elias-Fano sets per hash partition."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import from_hex
from ..session import Scratch, delete

#: For each byte and k, where its k-th zero bit lies (least significant bit first).
_ZERO_AT = np.array([([b for b in range(8) if not v >> b & 1] + [8] * 8)[:8] for v in range(256)], dtype=np.int64)
_ZEROS = np.array([8 - int(v).bit_count() for v in range(256)], dtype=np.int64)


class EliasFano:
    """A sorted set of numbers below 2**width in about 2 + log2(2**width / n) bits each.

    The high bits are a unary bit string (for each value of the high part: one 1 per member, then a 0), the low bits are
    packed. A probe selects the zeros around its high part and searches the few members between them.
    """

    def __init__(self, n: int, width: int, low_bits: int, high: bytes, low: bytes):
        self.n, self.width, self.low_bits, self.high, self.low = n, width, low_bits, high, low
        bits = np.frombuffer(high, np.uint8)
        self._bytes = bits
        self._zeros_before = np.concatenate([[0], np.cumsum(_ZEROS[bits])])
        self._low = np.concatenate([np.frombuffer(low, np.uint8), np.zeros(8, np.uint8)])

    @classmethod
    def encode(cls, values: np.ndarray, width: int) -> EliasFano:
        """``values``: sorted, distinct int64 in 0..2**width - 1."""
        n = len(values)
        low_bits = min(56, max(0, width - math.ceil(math.log2(n))) if n else 0)
        high = values >> low_bits
        top = int(high[-1]) + 1 if n else 1
        unary = np.zeros(n + top, np.uint8)
        unary[high + np.arange(n)] = 1
        # the padding of the last byte is ones, so that it holds no zero that counts
        padded = np.concatenate([unary, np.ones(-len(unary) % 8, np.uint8)])
        rest = values & ((1 << low_bits) - 1)
        packed = np.packbits(((rest[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, width, low_bits, np.packbits(padded, bitorder="little").tobytes(), packed.tobytes())

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the unary string."""
        byte = np.searchsorted(self._zeros_before, k, side="right") - 1
        return byte * 8 + _ZERO_AT[self._bytes[byte], k - self._zeros_before[byte]]

    def _low_of(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        word = np.zeros(len(i), np.uint64)
        for k in range(8):
            word |= self._low[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """For each probe, whether it is a member: the search for its successor ends at an equal value."""
        found = np.zeros(len(probes), bool)
        zeros = int(self._zeros_before[-1])
        high = probes >> self.low_bits
        live = np.flatnonzero(high < zeros) if self.n else np.empty(0, np.int64)
        if not len(live):
            return found
        h, x = high[live], probes[live] & ((1 << self.low_bits) - 1)
        at = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)  # members with a smaller high part
        end = self._select0(h) - h
        while len(live):
            go = at < end
            live, x, at, end = live[go], x[go], at[go], end[go]
            if not len(live):
                break
            low = self._low_of(at)
            found[live[low == x]] = True
            go = low < x
            live, x, at, end = live[go], x[go], at[go] + 1, end[go]
        return found

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._bytes, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(np.int64) << self.low_bits) | self._low_of(i)

    def merged(self, values: np.ndarray) -> EliasFano:
        """With more members (sorted, distinct): one sequential merge of both sides."""
        old = self.decode()
        values = values[~self.contains(values)]
        both = np.empty(len(old) + len(values), np.int64)
        new_at = np.searchsorted(old, values) + np.arange(len(values))
        is_old = np.ones(len(both), bool)
        is_old[new_at] = False
        both[new_at], both[is_old] = values, old
        return EliasFano.encode(both, self.width)


SET_SCHEMA = "bucket bigint, n bigint, width int, low_bits int, high binary, low binary"
_SET = ["n", "width", "low_bits", "high", "low"]


def _load(pdf: pd.DataFrame, width: int) -> EliasFano:
    if not len(pdf):
        return EliasFano.encode(np.empty(0, np.int64), width)
    r = pdf.iloc[0]
    return EliasFano(int(r["n"]), int(r["width"]), int(r["low_bits"]), bytes(r["high"]), bytes(r["low"]))


def _row(bucket: int, s: EliasFano) -> dict[str, object]:
    return {"bucket": bucket, "n": s.n, "width": s.width, "low_bits": s.low_bits, "high": s.high, "low": s.low}


class SeenKeys:
    """A set of keys as Elias-Fano sequences of 64-bit key hashes, one for each of 2**bucket_bits hash partitions.

    A key that isn't in the set is answered "seen" only if its hash equals that of a member: with n members at most
    n / 2**hash_bits of such answers are wrong. "Not seen" is never wrong. ``leading`` takes the first bits of the key
    itself for its hash: for keys that are digests already, and so that other engines can follow the answers.
    """

    def __init__(self, bucket_bits: int, hash_bits: int = 64, leading: bool = False):
        if not 1 <= bucket_bits < hash_bits <= 64:
            raise ValueError("1 <= bucket_bits < hash_bits <= 64")
        self.bucket_bits, self.hash_bits, self.width, self.leading = bucket_bits, hash_bits, hash_bits - bucket_bits, leading

    @classmethod
    def sized(cls, n: int, per_bucket: int = 32768, hash_bits: int = 64, leading: bool = False) -> SeenKeys:
        """Buckets for about ``per_bucket`` of ``n`` keys."""
        return cls(min(hash_bits - 1, max(1, math.ceil(math.log2(max(1, n) / per_bucket)) if n > per_bucket else 1)), hash_bits, leading)

    def place(self, key: Column) -> tuple[Column, Column]:
        """Bucket and value within it, of a key."""
        h = from_hex(F.hex(F.substring(key, 1, 8))) if self.leading else F.xxhash64(key)
        h = F.shiftrightunsigned(h, 64 - self.hash_bits) if self.hash_bits < 64 else h
        return F.shiftrightunsigned(h, self.width), h.bitwiseAND(F.lit((1 << self.width) - 1))

    def encode(self, keys: DataFrame, key: str) -> DataFrame:
        """The sets of the distinct non-null keys of a table."""
        width = self.width
        bucket, value = self.place(F.col(key))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_row(int(pdf["bucket"].iloc[0]), EliasFano.encode(np.sort(pdf["value"].to_numpy(np.int64)), width))])

        return keys.where(F.col(key).isNotNull()).select(bucket.alias("bucket"), value.alias("value")).distinct().groupBy("bucket").applyInPandas(build, SET_SCHEMA)

    def admit(self, sets: DataFrame, arrivals: DataFrame) -> DataFrame:
        """Probe and add ``arrivals`` (bucket, value, batch, first): the smallest arrival number of each hash in each batch.

        Each hash partition goes through its batches in order: it probes the set, keeps what is new and merges that into
        the set before the next batch. Gives a row (bucket, first) for each arrival that was new, and for each partition
        a row with ``first`` null and the set as it then stands.
        """
        width = self.width

        def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            seen = _load(old, width)
            new = new.sort_values(["batch", "first"], kind="stable")
            batch, value, first = (new[c].to_numpy(np.int64) for c in ("batch", "value", "first"))
            fresh: list[np.ndarray] = []
            cuts = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1), len(batch)] if len(batch) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                v, at = np.unique(value[lo:hi], return_index=True)
                ok = ~seen.contains(v)
                if ok.any():
                    fresh.append(first[lo:hi][at[ok]])
                    seen = seen.merged(v[ok])
            ids = np.concatenate(fresh) if fresh else np.empty(0, np.int64)
            state = _row(key[0], seen)
            blank = [None] * len(ids)
            out = {"bucket": [key[0]] * (len(ids) + 1), "first": pd.array([*ids.tolist(), None], "Int64"), **{c: [*blank, state[c]] for c in _SET}}
            return pd.DataFrame(out).astype({c: "Int64" for c in ("n", "width", "low_bits")})

        cols = arrivals.select("bucket", "value", "batch", "first")
        return sets.groupBy("bucket").cogroup(cols.groupBy("bucket")).applyInPandas(run, SET_SCHEMA.replace("bucket bigint", "bucket bigint, first bigint"))


def keyed(sightings: DataFrame, key_bytes: int = 32) -> DataFrame:
    """Rows with a sighting_id and a key of ``key_bytes`` bytes, as (sighting_id, exact). All others are ignored."""
    return sightings.where(F.col("sighting_id").isNotNull() & (F.octet_length("exact") == key_bytes)).select("sighting_id", "exact")


def first_arrivals(rows: DataFrame, keys: SeenKeys, batches: int, lo: int, hi: int) -> DataFrame:
    """(bucket, value, batch, first): ids lo..hi are cut into ``batches`` ranges in order of arrival; of each hash in each range
    the smallest id stays, combined before the shuffle, so a key of a third of all rows is a few rows per task."""
    span = (hi - lo) // batches + 1
    bucket, value = keys.place(F.col("exact"))
    placed = rows.select(bucket.alias("bucket"), value.alias("value"), F.floor((F.col("sighting_id") - F.lit(lo)) / span).cast("bigint").alias("batch"), "sighting_id")
    return placed.groupBy("bucket", "value", "batch").agg(F.min("sighting_id").alias("first"))


def seen_before(sightings: DataFrame, known: DataFrame, batches: int = 16, hash_bits: int = 64, per_bucket: int = 32768, kept: str | None = None, expected: int = 0, leading: bool = False) -> DataFrame:
    """The ids of sightings whose key stands in ``known`` or came with a smaller sighting_id, once each.

    Keys of another length than 32 bytes, null keys and null ids take no part. A repeated id counts once. Empty tables
    give no rows; extra columns are ignored. See ``SeenKeys`` for the rate of wrong answers and for ``leading``. ``kept``
    names a folder for the sets: a later call with it takes up where this one ended, reads no earlier key, and ``known``
    counts in the first call only; ``expected`` keys then decide the number of partitions.
    """
    spark = sightings.sparkSession
    scratch = Scratch(spark, "seen")
    rows = keyed(sightings)
    listed = known.where(F.octet_length("exact") == 32).select("exact")
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("sighting_id"), F.max("sighting_id")).first()
    made = _made(spark, kept) if kept else None
    if made is not None:
        keys = SeenKeys(made["bucket_bits"], made["hash_bits"], made["leading"])
        before = spark.read.schema(SET_SCHEMA).parquet(f"{kept}/{made['version']}")
    else:
        keys = SeenKeys.sized(max(expected, n + listed.count()), per_bucket, hash_bits, leading)
        before = keys.encode(listed, "exact")
    arrivals = first_arrivals(rows, keys, batches, lo or 0, hi or 0)
    admitted = scratch.table(keys.admit(before, arrivals), "sets")
    if kept:
        version = f"v{int(made['version'][1:]) + 1 if made is not None else 0}"
        admitted.where("first is null").select("bucket", *_SET).write.parquet(f"{kept}/{version}")
        row = (version, keys.bucket_bits, keys.hash_bits, keys.leading)
        spark.createDataFrame([row], "version string, bucket_bits int, hash_bits int, leading boolean").coalesce(1).write.mode("overwrite").parquet(f"{kept}/made")
        if made is not None:
            delete(spark, f"{kept}/{made['version']}")
    fresh = admitted.where("first is not null").select(F.col("first").alias("sighting_id"))
    # a row for each new key, but few bytes of a compressed file beside the sets: by its size Spark would broadcast it
    return rows.select("sighting_id").distinct().join(fresh.hint("merge"), "sighting_id", "left_anti")


def _made(spark: SparkSession, kept: str) -> Row | None:
    """How the kept sets were made; None if there are none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{kept}/made")
    return spark.read.parquet(f"{kept}/made").first() if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return seen_before(read("sightings"), read("known_exact"))


def error_rate(sightings: DataFrame, known: DataFrame, hash_bits: int = 64, leading: bool = False) -> DataFrame:
    """One row: answers given, answers "seen", wrong ones among them, measured against the keys themselves, and the
    expected bound on the share of wrong answers, members / 2**hash_bits."""
    rows = keyed(sightings).distinct()
    answered = seen_before(sightings, known, hash_bits=hash_bits, leading=leading).select("sighting_id", F.lit(True).alias("seen"))
    listed = known.where(F.octet_length("exact") == 32).select("exact").distinct()
    # only the first sighting of a key can be answered wrongly: all later ones were seen
    firsts = rows.groupBy("exact").agg(F.min("sighting_id").alias("sighting_id")).join(listed.hint("merge"), "exact", "left_anti").select("sighting_id")
    wrong = firsts.join(answered.hint("merge"), "sighting_id", "left")
    named = lambda df, name, value: df.agg(value.alias("v")).select(F.lit(name).alias("k"), "v")
    every = F.count(F.lit(1))
    figures = named(rows, "answers", every).unionByName(named(answered, "seen_answers", every)).unionByName(named(listed, "known_keys", every))
    figures = figures.unionByName(named(wrong, "wrong_answers", F.count_if(F.col("seen")))).unionByName(named(wrong, "new_keys", every))
    of = lambda name: F.max(F.when(F.col("k") == name, F.col("v")))
    out = figures.agg(*(of(name).alias(name) for name in ("answers", "seen_answers", "wrong_answers", "new_keys", "known_keys")))
    return out.select("answers", "seen_answers", "wrong_answers", (F.col("wrong_answers") / F.greatest(F.col("answers"), F.lit(1))).alias("wrong_rate"), ((F.col("new_keys") + F.col("known_keys")) / F.lit(2.0**hash_bits)).alias("expected_rate"))


def p5_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return error_rate(read("sightings"), read("known_exact"))


def p5_error_rate_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured rate with hashes of 24 bits, the leading ones of the keys: there are wrong answers to count."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return error_rate(read("sightings"), read("known_exact"), hash_bits=24, leading=True)


P5_FOUND_SQL = """
WITH s AS (SELECT DISTINCT sighting_id, exact FROM sightings WHERE octet_length(exact) = 32 AND sighting_id IS NOT NULL),
f AS (SELECT exact, min(sighting_id) AS first_id FROM s GROUP BY exact)
SELECT s.sighting_id FROM s JOIN f USING (exact)
WHERE s.sighting_id > f.first_id OR s.exact IN (SELECT exact FROM known_exact WHERE exact IS NOT NULL)
"""

P5_ERROR_RATE_SQL = f"""
WITH s AS (SELECT DISTINCT sighting_id, exact FROM sightings WHERE octet_length(exact) = 32 AND sighting_id IS NOT NULL),
k AS (SELECT DISTINCT exact FROM known_exact WHERE octet_length(exact) = 32)
SELECT (SELECT count(*) FROM s) AS answers, (SELECT count(*) FROM ({P5_FOUND_SQL})) AS seen_answers, 0::BIGINT AS wrong_answers, 0.0::DOUBLE AS wrong_rate,
  ((SELECT count(DISTINCT exact) FROM s WHERE exact NOT IN (SELECT exact FROM k)) + (SELECT count(*) FROM k))::DOUBLE / 18446744073709551616.0::DOUBLE AS expected_rate
"""

#: Wrong answers by definition: a key seen for the first time whose first three bytes stand in ``known_exact`` or came before.
P5_ERROR_RATE_24_SQL = """
WITH s AS (SELECT DISTINCT sighting_id, hex(exact) AS e FROM sightings WHERE octet_length(exact) = 32 AND sighting_id IS NOT NULL),
k AS (SELECT DISTINCT hex(exact) AS e FROM known_exact WHERE octet_length(exact) = 32),
f AS (SELECT e, substr(e, 1, 6) AS p, min(sighting_id) AS first_id FROM s GROUP BY e),
n AS (SELECT * FROM f WHERE e NOT IN (SELECT e FROM k)),
earliest AS (SELECT p, min(first_id) AS since FROM (SELECT p, first_id FROM f UNION ALL SELECT substr(e, 1, 6), -1 FROM k) GROUP BY p),
w AS (SELECT count(*) AS wrong FROM n JOIN earliest USING (p) WHERE since < first_id)
SELECT (SELECT count(*) FROM s) AS answers, (SELECT count(*) FROM s) - (SELECT count(*) FROM n) + wrong AS seen_answers, wrong AS wrong_answers,
  wrong::DOUBLE / (SELECT greatest(1, count(*)) FROM s) AS wrong_rate, ((SELECT count(*) FROM n) + (SELECT count(*) FROM k))::DOUBLE / 16777216.0::DOUBLE AS expected_rate
FROM w
"""
