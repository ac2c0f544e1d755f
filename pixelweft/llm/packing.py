"""Problem 9: filling containers of fixed capacity with texts."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read_spread
from . import tokens

SCHEMA = "container_type int, container_id bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"
#: Container types of one job; each is packed on its own.
MOST_TYPES = 1000
#: Pieces of a container that may go on to the next merge; one of more (thousands of empty texts) is closed as it is.
MOST_PIECES = 1024
_PIECE = ["doc_id", "piece_no", "token_start", "n_tokens"]


class OpenWindows:
    """Best fit into at most ``most`` open containers; the fullest closes when an item fits none of them."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (free tokens, container), sorted
        self.next = 0

    def place(self, size: int) -> int:
        """The container an item goes to."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, container = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                self.free.pop(0)
            room, container = self.capacity, self.next
            self.next += 1
        if room > size:
            insort(self.free, (room - size, container))
        return container


def _pieces(doc: np.ndarray, size: np.ndarray, capacity: int) -> pd.DataFrame:
    """Items of at most the capacity; longer texts give full pieces and a rest."""
    count = np.maximum(1, -(-size // capacity))
    piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    return pd.DataFrame({"doc_id": np.repeat(doc, count), "piece_no": piece, "token_start": start, "n_tokens": np.minimum(capacity, np.repeat(size, count) - start)})


def pack(sizes: DataFrame, capacities: DataFrame, open_windows: int = 256, per_group: int = 16384, fan_in: int = 16) -> DataFrame:
    """One row (container_type, container_id, doc_id, piece_no, token_start, n_tokens) for each piece of each text and each
    container type. ``sizes``: (doc_id, n_tokens); ``capacities``: (container_type, capacity_tokens).

    A text is one piece unless it exceeds the capacity; then it is cut into full pieces and a rest. Documents are spread
    over groups of about ``per_group`` by a hash of their id. Each group packs its pieces in order of doc_id into
    ``open_windows`` open containers (best fit; the fullest closes when none fits). What stays open at the end is taken
    apart and merged over ``fan_in`` groups at a time, largest pieces first, until one group is left; of each merge again
    only the ``open_windows`` emptiest containers stay open. So a merge never gets more than ``fan_in * open_windows``
    containers, of ``MOST_PIECES`` pieces at most, whatever the size of the corpus. Same input, same containers, on any
    number of executors.

    Texts of no tokens are pieces of size 0 and share a container with others. Null doc_ids are no texts and repeated rows
    of a doc_id count once (the largest size); null or non-positive capacities hold nothing and give no rows. Empty tables
    give no rows.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    table = scratch.table(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("n_tokens")), "sizes")
    n = table.count()
    groups = max(1, math.ceil(n / per_group))
    types = capacities.where("container_type is not null and capacity_tokens > 0").groupBy("container_type").agg(F.max("capacity_tokens").alias("capacity")).limit(MOST_TYPES + 1).collect()
    if len(types) > MOST_TYPES:
        raise ValueError(f"at most {MOST_TYPES} container types")
    kinds = F.array(*(F.struct(F.lit(t["container_type"]).cast("int").alias("container_type"), F.lit(t["capacity"]).cast("bigint").alias("capacity")) for t in types)).cast("array<struct<container_type:int,capacity:bigint>>")
    rows = table.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).withColumn("t", F.explode(kinds)).select("doc_id", "n_tokens", "grp", "t.*")
    schema = SCHEMA.replace("container_id bigint", "grp int, is_open boolean, container_id bigint, capacity bigint")

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, group, capacity = int(key[0]), int(key[1]), int(key[2])
        pdf = pdf.sort_values("doc_id")
        items = _pieces(pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), capacity)
        return _packed(items, kind, group, capacity, OpenWindows(capacity, open_windows), 0, open_windows)

    packed = scratch.table(rows.groupBy("container_type", "grp", "capacity").applyInPandas(first, schema), "packed")
    closed = packed.where("not is_open")
    level = 0
    while True:
        level += 1
        last = groups <= fan_in
        groups = math.ceil(groups / fan_in)
        opened = packed.where("is_open").withColumn("grp", (F.col("grp") / fan_in).cast("int"))
        packed = scratch.table(opened.groupBy("container_type", "grp", "capacity").applyInPandas(merger(level, 0 if last else open_windows), schema), "packed")
        closed = closed.unionByName(packed.where("not is_open"))
        if last:
            break
    return closed.select("container_type", "container_id", *_PIECE)


def merger(level: int, stay_open: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Repacks what other groups left open, a bounded number of containers; of the result at most ``stay_open`` stay open."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, group, capacity = int(key[0]), int(key[1]), int(key[2])
        items = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True])[_PIECE]
        return _packed(items, kind, group, capacity, OpenWindows(capacity, len(items) + 1), level, stay_open)

    return merge


def _packed(items: pd.DataFrame, kind: int, group: int, capacity: int, windows: OpenWindows, level: int, stay_open: int) -> pd.DataFrame:
    place = windows.place
    local = np.fromiter((place(s) for s in items["n_tokens"].tolist()), np.int64, len(items))
    pieces = np.bincount(local, minlength=windows.next)
    # nearly full containers and those of very many pieces need no merging; of the others the emptiest stay open
    room = [(free, c) for free, c in windows.free if (free > 0.02 * capacity or not level) and pieces[c] <= MOST_PIECES]
    still = np.isin(local, [c for _, c in room[len(room) - min(stay_open, len(room)) :]])
    return pd.DataFrame({"container_type": kind, "grp": group, "is_open": still, "container_id": (level << 56) | (group << 32) | local, "capacity": capacity, **{c: items[c].to_numpy() for c in _PIECE}})


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of each capacity."""
    sizes = tokens.count(read_spread(spark, f"{sf_dir}/documents.parquet"))
    return pack(sizes, spark.read.parquet(f"{sf_dir}/container_sizes.parquet"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each container type: containers, tokens held, and the share of their space that is used."""
    sizes = spark.read.parquet(f"{sf_dir}/container_sizes.parquet")
    used = p9_packed(spark, sf_dir).groupBy("container_type").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return used.join(sizes, "container_type").select("container_type", "containers", "tokens", share.alias("fill"))


def violations(packed: DataFrame, sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(rule, container_type, id, found, expected): what breaks the rules of ``pack``. ``capacity``: a container that holds
    more than its capacity; ``coverage``: a document whose pieces don't cover it exactly once; ``split``: a document in
    more pieces than its size asks for. No rows if all is well."""
    known = capacities.where("container_type is not null and capacity_tokens > 0").groupBy("container_type").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    held = packed.groupBy("container_type", "container_id").agg(F.sum("n_tokens").alias("found")).join(known, "container_type")
    over = held.where("found > capacity").select(F.lit("capacity").alias("rule"), "container_type", F.col("container_id").alias("id"), "found", F.col("capacity").alias("expected"))
    texts = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("size")).join(F.broadcast(known))
    # of gapless pieces the k-th starts where k full ones end
    straight = (F.col("token_start") == F.col("piece_no") * F.col("capacity")) & (F.col("n_tokens") <= F.col("capacity"))
    pieces = packed.join(known, "container_type").groupBy("container_type", "doc_id").agg(F.sum(F.when(straight, F.col("n_tokens")).otherwise(0)).alias("tokens"), F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("numbers"))
    both = texts.join(pieces, ["container_type", "doc_id"], "full")
    need = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))
    whole = F.coalesce((F.col("tokens") == F.col("size")) & (F.col("n") == F.col("numbers")), F.lit(False))
    torn = both.where(~whole).select(F.lit("coverage").alias("rule"), "container_type", F.col("doc_id").alias("id"), F.col("tokens").alias("found"), F.col("size").alias("expected"))
    split = both.where(F.col("n") != need).select(F.lit("split").alias("rule"), "container_type", F.col("doc_id").alias("id"), F.col("n").alias("found"), need.alias("expected"))
    return over.unionByName(torn).unionByName(split)


def p9_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of packing, checked on the whole corpus: no rows."""
    sizes = Scratch(spark, "violations").table(tokens.count(read_spread(spark, f"{sf_dir}/documents.parquet")), "sizes")
    capacities = spark.read.parquet(f"{sf_dir}/container_sizes.parquet")
    return violations(pack(sizes, capacities), sizes, capacities)


#: What must come out: nothing, with the columns of ``violations``.
P9_VIOLATIONS_SQL = "SELECT 'none' AS rule, container_type, 0::BIGINT AS id, 0::BIGINT AS found, 0::BIGINT AS expected FROM container_sizes WHERE false"
