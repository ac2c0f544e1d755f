"""Duplicates and similarity search over fingerprints and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions.similarity import compare_multi, f32, prefilter_bound
from ..functions.u64 import coarse_key, hamming
from ..schema import HashAlgorithm, MultiHashConfig, checked_threshold
from ..session import Scratch
from . import pairwise


def multi(prefix: str = "") -> Column:
    """The multi fingerprint of a row as one struct."""
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("exact", *(a.field for a in HashAlgorithm))))


def exact_duplicates(df: DataFrame, ident: str, key: str = "exact") -> DataFrame:
    """(key, members, first_id) of keys that stand in two rows or more. Members are counted, not collected: a key may hold
    a third of all rows. ``duplicate_members`` lists them as rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.min(ident).alias("first_id"))
    return counts.where("members > 1")


def duplicate_members(df: DataFrame, ident: str, key: str = "exact") -> DataFrame:
    """(ident, first_id) of all rows in groups of equal keys."""
    return df.select(ident, key).join(exact_duplicates(df, ident, key).select(key, "first_id"), key).select(ident, "first_id")


def full_duplicates(df: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, members) of whole fingerprints, all hashes equal, that stand in two rows or more."""
    return df.groupBy(fp).agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def best_first(df: DataFrame, ident: str = "id", score: str = "score") -> DataFrame:
    """By falling score; ties by id, so that the order is the same on every run."""
    return df.orderBy(F.desc(score), ident)


def singletons(df: DataFrame, key: str = "exact") -> DataFrame:
    """Rows whose key stands in no other row."""
    alone = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key)
    return df.join(alone, key, "left_semi")


def representatives(df: DataFrame, ident: str, key: str = "exact") -> DataFrame:
    """The row of the smallest id of each key."""
    first = df.groupBy(key).agg(F.min(ident).alias(ident))
    return df.join(first, [key, ident], "left_semi").dropDuplicates([ident])


def bucket_index(df: DataFrame, ident: str, algorithm: HashAlgorithm, bits: int = 16) -> DataFrame:
    """(coarse_key, members, first_id) of the buckets of one algorithm's global hash."""
    keyed = df.select(ident, coarse_key(F.col(f"{algorithm.field}.global_hash"), bits).alias("coarse_key")).where("coarse_key is not null")
    return keyed.groupBy("coarse_key").agg(F.count(F.lit(1)).alias("members"), F.min(ident).alias("first_id"))


def near_duplicates_in_buckets(df: DataFrame, ident: str, score: float = 0.95, algorithm: HashAlgorithm = HashAlgorithm.PHASH, bits: int = 16, config: MultiHashConfig | None = None) -> DataFrame:
    """Pairs (id_a < id_b, similarity) with at least the score that share the top bits of a global hash. By contract pairs
    that differ in those bits aren't found. An equi-join on the bucket; global distances are checked before blocks."""
    config = config or MultiHashConfig()
    t = checked_threshold(score)
    side = lambda s: df.select(coarse_key(F.col(f"{algorithm.field}.global_hash"), bits).alias("_k"), F.col(ident).alias(f"id_{s}"), multi().alias(f"f{s}"))
    pairs = side("a").join(side("b"), "_k").where("id_a < id_b")
    return scored(pairs, t, config).select("id_a", "id_b", "similarity")


def _packed(df: DataFrame, ident: str, blocks: bool = True) -> DataFrame:
    return df.select(F.col(ident).alias("id"), pairwise.packed(*(F.col(a.field) for a in HashAlgorithm), blocks=blocks).alias("h"))


def near_duplicates(df: DataFrame, ident: str, score: float = 0.95, config: MultiHashConfig | None = None, block: int = 16384) -> DataFrame:
    """All pairs (id_a < id_b, similarity) with at least the score, as comparing each row with each other gives them. Rows
    are compared in blocks (``pairwise``), so the work grows as the square of the rows; rows of equal exact hash meet by
    it. A repeated id counts once."""
    config = config or MultiHashConfig()
    t = checked_threshold(score)
    rows = Scratch(df.sparkSession, "pairs").table(df.where(F.col(ident).isNotNull()).dropDuplicates([ident]).select(ident, "exact", *(a.field for a in HashAlgorithm)), "rows")
    # of unrelated pairs hardly any is below 20, so blocks needn't go along
    bound = prefilter_bound(config, t)
    close = pairwise.close_pairs(_packed(rows, ident, bound is None or bound > 20), t, pairwise.multi_weights(config), config, block=block)
    copies = rows.where(F.col("exact").isNotNull()).select("exact", F.col(ident).alias("a"))
    met = close.unionByName(copies.join(copies.withColumnRenamed("a", "b"), "exact").where("a < b").select("a", "b"))
    met = met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    side = lambda s: rows.select(F.col(ident).alias(f"id_{s}"), multi().alias(f"f{s}"))
    return scored(met.join(side("a"), "id_a").join(side("b"), "id_b"), t, config).select("id_a", "id_b", "similarity")


def scored(pairs: DataFrame, score: float, config: MultiHashConfig | None = None) -> DataFrame:
    """Adds similarity to pairs (fa, fb) and keeps those with at least the score. A pair whose global distances rule the
    score out isn't compared block by block."""
    config = config or MultiHashConfig()
    bound = prefilter_bound(config, score)
    if bound is not None:
        weighted = sum((F.lit(config.weight(a)) * hamming(F.col(f"fa.{a.field}.global_hash"), F.col(f"fb.{a.field}.global_hash")) for a in HashAlgorithm), F.lit(0.0))
        pairs = pairs.where((weighted <= bound) | (F.col("fa.exact") == F.col("fb.exact")))
    return pairs.withColumn("similarity", compare_multi(F.col("fa"), F.col("fb"), config)).where(F.col("similarity.score") >= f32(score))


def similarity_search(df: DataFrame, query: DataFrame, ident: str, score: float = 0.7, config: MultiHashConfig | None = None) -> DataFrame:
    """(query_id, id, score, exact_match, perceptual_distance) of all rows with at least the score to one of the query
    fingerprints. ``query``: up to 1000 rows are sent to all workers; more go by ``similarity_blocks``."""
    few = query.select(F.col(ident).alias("query_id"), multi().alias("fb")).limit(1001).collect()
    if len(few) > 1000:
        return similarity_blocks(df, query, ident, score, config)
    asked = F.broadcast(df.sparkSession.createDataFrame(few, query.select(F.col(ident).alias("query_id"), multi().alias("fb")).schema))
    pairs = df.select(F.col(ident).alias("id"), multi().alias("fa")).join(asked)
    return scored(pairs, score, config).select("query_id", "id", "similarity.*")


def similarity_blocks(df: DataFrame, query: DataFrame, ident: str, score: float = 0.7, config: MultiHashConfig | None = None, block: int = 16384) -> DataFrame:
    """``similarity_search`` for a query set of any size: blocks of rows against blocks of queries (``pairwise``), scored
    there. Ids must be unique within rows and within queries."""
    hashes = [F.col(a.field) for a in HashAlgorithm]
    side = lambda x: x.select(F.col(ident).alias("id"), "exact", pairwise.whole(*hashes).alias("whole"), pairwise.filled(*hashes).alias("h"))
    return pairwise.scored_pairs(side(df), side(query), score, config or MultiHashConfig(), block)


def semantic_search(df: DataFrame, query: DataFrame, score: float | None = 0.85, ident: str = "id") -> DataFrame:
    """(query_id, id, score, error) of an embedding STRUCT column against a few queries (at most 1000, checked). Rows that
    can't be compared carry the kind of error if ``score`` is None, else they are left out with those below it."""
    shape = query.select(F.col(ident).alias("query_id"), F.col("embedding").alias("q"))
    few = shape.limit(1001).collect()
    if len(few) > 1000:
        raise ValueError("semantic_search takes at most 1000 queries")
    asked = F.broadcast(df.sparkSession.createDataFrame(few, shape.schema))
    pairs = df.select(F.col(ident).alias("id"), F.col("embedding").alias("e")).join(asked)
    out = pairs.select("query_id", "id", E.cosine(F.col("q"), F.col("e")).alias("score"), E.cosine_error(F.col("q"), F.col("e")).alias("error"))
    return out if score is None else out.where(F.col("score") >= f32(score))


def cosine_blocks(rows: DataFrame, queries: DataFrame, floor: float = -1.0, k: int | None = None, block: int = 8192, others: bool = False) -> DataFrame:
    """(query_id, id, score) of a query set of any size against all rows, in blocks: both sides (id, vector array) are cut
    by a hash of their id into blocks of about ``block`` rows, and each pair of blocks is one matrix product. Cosines in
    DOUBLE, rounded to six places, of at least ``floor``; with ``k`` the best k of each query, ties to the smaller id. ``others`` leaves out the row of
    the query's own id. Null vectors, zero vectors and vectors of another length than the query have no score and give no row."""
    import math

    def counted(df: DataFrame) -> int:
        return max(1, math.ceil(df.count() / block))

    nr, nq = counted(rows), counted(queries)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    good = lambda df, ident: df.where(E.usable(F.col("vector"))).select(F.col(ident).alias("id"), "vector", F.size("vector").alias("dim"))
    left = good(rows, "id").select("dim", part(nr).alias("r"), every(nq).alias("q"), "id", "vector")
    right = good(queries, "id").select("dim", every(nr).alias("r"), part(nq).alias("q"), "id", "vector")
    right = right.toDF(*(f"_{c}" for c in right.columns)).toDF(*right.columns)
    keys = ["dim", "r", "q"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_product(round(floor * 1e6), k, others), "query_id bigint, id bigint, micro int")
    if k is not None and nr > 1:
        # the limit of the rank is applied before the shuffle, so a query's candidates of all blocks never meet in one list
        ranked = met.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("micro"), "id")))
        met = ranked.where(F.col("_k") <= k).drop("_k")
    return met.select("query_id", "id", (F.col("micro") / 1e6).alias("score"))


def _product(limit: int, k: int | None, others: bool = False):  # noqa: ANN202
    import numpy as np
    import pyarrow as pa

    def unit(t: pa.Table) -> np.ndarray:
        x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("micro", pa.int32())])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("id")
        ids, names = rows["id"].to_numpy(), asked["id"].to_numpy()
        x, y = unit(rows), unit(asked)
        found = []
        for at in range(0, len(y), 256):
            micro = np.rint((y[at : at + 256] @ x.T) * 1e6).astype(np.int64)
            ok = micro >= limit
            if others:
                ok &= names[at : at + 256, None] != ids[None]
            if k is not None and k < len(ids):
                rank = np.where(ok, (micro + 2_000_000) * len(ids) + np.arange(len(ids))[::-1], -1)
                keep = np.argpartition(-rank, k - 1, axis=1)[:, :k]
                only = np.zeros_like(ok)
                np.put_along_axis(only, keep, True, 1)
                ok &= only
            i, j = np.nonzero(ok)
            found.append((names[at + i], ids[j], micro[i, j].astype(np.int32)))
        return pa.table([np.concatenate(f) for f in zip(*found, strict=True)], schema=schema)

    return run
