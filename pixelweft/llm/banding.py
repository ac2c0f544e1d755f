"""Min-wise banding of 64-bit perceptual hashes.

A hash is a set of 64 grams (position, bit). A row of the min-wise signature ranks grams by a random order of their
*positions*; both sets hold one gram at every position, so the minimum of both lies at the same position and the row
agrees with probability (64 - d) / 64 for hashes at distance d. ``rows`` such rows are one band: the hash restricted to
``rows`` random bits. Bands are taken within one hash (the global one or one block), because the distances of blocks
differ much and the closest block decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


@dataclass(frozen=True)
class BandPlan:
    rows: int
    global_bands: int
    block_bands: int
    recall: float


def recall_of(rows: int, global_bands: int, block_bands: int, global_distance: int, block_distance: int, n_blocks: int = 16) -> float:
    """Share of pairs, of the given distances in the global hash and in each block, that meet in a band."""
    g, b = (1 - global_distance / BITS) ** rows, (1 - block_distance / BITS) ** rows
    return 1 - (1 - g) ** global_bands * (1 - b) ** (block_bands * n_blocks)


def plan_bands(n: int, target_recall: float = 0.99, global_distance: int = 4, block_distance: int = 9, n_blocks: int = 16, mates: int = 8) -> BandPlan:
    """Rows so that about ``mates`` of ``n`` records share a band value by chance (and not more in small tables), then the
    fewest bands that reach the target for the hardest profile: every block at ``block_distance``, none closer. A chance
    meeting costs one comparison of two numbers inside its band, about a hundredth of a band row, so that more mates and
    fewer bands are cheaper up to some hundred."""
    fewer = round(math.log2(mates))
    rows = max(19 - fewer, min(40, math.ceil(math.log2(max(n, 2))) - fewer))
    bands = 1
    while (r := recall_of(rows, 2 * bands, bands, global_distance, block_distance, n_blocks)) < target_recall:
        bands += 1
    return BandPlan(rows, 2 * bands, bands, r)


def masks(n: int, rows: int, seed: int) -> list[int]:
    """``n`` masks of ``rows`` random bits each, as signed 64-bit numbers; as few bits as possible repeat."""
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(BITS) for _ in range(math.ceil(n * rows / BITS) + 1)])
    out, at = [], 0
    for _ in range(n):
        bits: list[int] = []
        while len(bits) < rows:
            if int(order[at]) not in bits:
                bits.append(int(order[at]))
            at += 1
            if at == len(order):
                order, at = rng.permutation(BITS), 0
        value = sum(1 << b for b in bits)
        out.append(value - (1 << 64) if value >= 1 << 63 else value)
    return out


def band_keys(space: Column, hashes: list[tuple[Column, int]], rows: int, seed: int = 1) -> Column:
    """Array of 64-bit band keys; ``hashes`` are (hash, number of bands). Keys of different spaces, hashes and bands
    never stand for each other."""
    keys = []
    for i, (h, n) in enumerate(hashes):
        keys += [F.xxhash64(space, F.lit(i * 1000 + j), h.bitwiseAND(F.lit(m))) for j, m in enumerate(masks(n, rows, seed * 1000 + i))]
    return F.array(*keys)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of BIGINT hashes; numpy would count those of the absolute value of a signed number."""
    return np.bitwise_count(np.asarray(a ^ b).view(np.uint64))


PAIRS = pa.schema([("hot", pa.bool_()), ("key", pa.int64()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def _pairs_of(key: np.ndarray, kind: np.ndarray, ident: np.ndarray, value: np.ndarray, limit: int, most: int, crowd: float) -> Iterator[pa.RecordBatch]:
    """Pairs within runs of equal keys whose values differ in at most ``limit`` bits. Runs over ``most`` rows, and those
    with more than ``crowd`` such pairs a row, come out as rows."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    hot = sizes > most
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes[(sizes > 1) & ~hot]):
        at = np.flatnonzero(sizes == size)
        step = max(1, 2_000_000 // (size * size))
        i, j = np.triu_indices(size, 1)
        for k in range(0, len(at), step):
            runs = at[k : k + step]
            left, right = starts[runs, None] + i, starts[runs, None] + j
            ok = (distance(value[left], value[right]) <= limit) & (kind[left] == kind[right]) & (ident[left] != ident[right])
            if (size - 1) / 2 > crowd and (full := ok.sum(axis=1) > crowd * size).any():
                hot[runs[full]] = True
                ok[full] = False
            out.append((left[ok], right[ok]))
    if out and sum(len(x[0]) for x in out):
        left, right = (np.concatenate(x) for x in zip(*out, strict=True))
        got = pa.table({"kind": kind[left], "a": np.minimum(ident[left], ident[right]), "b": np.maximum(ident[left], ident[right])}).group_by(["kind", "a", "b"]).aggregate([])
        for piece in got.select(["kind", "a", "b"]).combine_chunks().to_batches():
            n = piece.num_rows
            yield pa.record_batch([pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), *piece.columns], schema=PAIRS)
    rows = np.repeat(hot, sizes)
    if rows.any():
        yield pa.record_batch([pa.array(np.ones(int(rows.sum()), bool)), pa.array(key[rows]), pa.array(kind[rows]), pa.array(ident[rows]), pa.array(value[rows])], schema=PAIRS)


def band_pairs(bands: DataFrame, partitions: int, limit: int, most: int = 4096, crowd: float = float("inf")) -> DataFrame:
    """Candidate pairs (kind, a < b) of rows ``(key, kind, id, value)`` that share a key and a kind and whose values differ
    in at most ``limit`` bits. One shuffle on the key; each partition is streamed in key order, so that no group is held
    whole: the rows of a key with more than ``most`` of them, or with more than ``crowd`` candidates for each row, come out
    with ``hot`` true, as (key, kind, id, value), for a finer pass."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, t) for t in (np.int64, np.int8, np.int64, np.int64)]
        spilled: int | None = None  # key whose run is already known to be hot
        for batch in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            done, rest = [c[:cut] for c in cols], [c[cut:] for c in cols]
            if spilled is not None and len(done[0]):
                head = done[0] == spilled
                if head.any():
                    yield _hot(done, head)
                    done = [c[~head] for c in done]
                spilled = None
            if len(done[0]):
                yield from _pairs_of(*done, limit, most, crowd)
            if len(rest[0]) > most or (spilled is not None and len(rest[0]) and rest[0][0] == spilled):
                spilled = int(rest[0][0])
                yield _hot(rest, np.ones(len(rest[0]), bool))
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            if spilled is not None and rest[0][0] == spilled:
                yield _hot(rest, np.ones(len(rest[0]), bool))
            else:
                yield from _pairs_of(*rest, limit, most, crowd)

    def _hot(cols: list[np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ones(int(rows.sum()), bool)), *(pa.array(c[rows]) for c in cols)], schema=PAIRS)

    ordered = bands.select("key", "kind", "id", "value").repartition(partitions, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(stream, "hot boolean, key bigint, kind tinyint, a bigint, b bigint")


def blocked_pairs(hot: DataFrame, limit: int, block: int = 4096) -> DataFrame:
    """All candidate pairs of hot rows ``(key, kind, id, value)``, exactly: each group is cut into blocks of about
    ``block`` rows by a hash of the id; every pair of blocks is one task-sized unit. The work of a group is that of its
    pairs, spread over all executors."""
    sizes = hot.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    rows = hot.join(sizes, "key").withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    # a row of block i goes to every unordered pair of blocks {i, j}
    units = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_p": F.least("_mine", "_other"), "_q": F.greatest("_mine", "_other")})

    def within(tables: Iterator[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(list(tables)) if not isinstance(tables, pa.Table) else tables
        ident, value, mine, kind = (t[c].to_numpy() for c in ("id", "value", "_mine", "kind"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo = mine == mine.min()
        left = np.flatnonzero(lo)
        right = np.flatnonzero(~lo) if not lo.all() else left
        for k in left:
            ok = right[(distance(value[right], value[k]) <= limit) & (ident[right] != ident[k]) & (kind[right] == kind[k])]
            found.append((np.full(len(ok), kind[k]), np.minimum(ident[ok], ident[k]), np.maximum(ident[ok], ident[k])))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table({"kind": pa.array(parts[0], pa.int8()), "a": pa.array(parts[1], pa.int64()), "b": pa.array(parts[2], pa.int64())})

    return units.select("key", "_p", "_q", "kind", "id", "value", "_mine").groupBy("key", "_p", "_q").applyInArrow(within, "kind tinyint, a bigint, b bigint").distinct()
