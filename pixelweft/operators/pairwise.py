"""All pairs of fingerprints that may reach a score, exactly, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import prefilter_bound
from ..schema import HASH_BITS, N_BLOCKS, HashAlgorithm, MultiHashConfig

#: Numbers of one algorithm in a packed row: global hash, blocks, mask of the blocks that aren't null.
WIDTH = N_BLOCKS + 2
#: What 32-bit scores may differ from ours; candidates are scored again by the column expressions.
SLACK = 1e-4
#: Pairs whose blocks are compared in one go.
PIECE = 50_000
#: Pairs that are scored in one go: what a step makes is written over and over, and stays in the cache of a core.
TILE = 32_768
#: Scored pairs that leave a task at once.
BATCH = 131_072
#: Rows that a block has at least, however many cores there are.
LEAST = 4096


def packed(*hashes: Column, blocks: bool = True) -> Column:
    """The numbers of ``struct<global_hash, block_hashes>`` of one or more algorithms as one array, without ``blocks`` the
    global hashes only; null where a global hash is null."""
    zero = F.lit(0).cast("bigint")
    parts = []
    for h in hashes:
        parts.append(h["global_hash"])
        if blocks:
            each = [F.get(h["block_hashes"], F.lit(i)) for i in range(N_BLOCKS)]
            mask = sum((F.when(b.isNotNull(), F.lit(1 << i)).otherwise(0) for i, b in enumerate(each)), F.lit(0)).cast("bigint")
            parts += [*(F.coalesce(b, zero) for b in each), mask]
    whole = F.lit(True)
    for h in hashes:
        whole &= F.coalesce(h["global_hash"].isNotNull(), F.lit(False))
    return F.when(whole, F.array(*parts))


def whole(*hashes: Column) -> Column:
    """Whether no global hash is null."""
    out = F.lit(True)
    for h in hashes:
        out &= F.coalesce(h["global_hash"].isNotNull(), F.lit(False))
    return out


def filled(*hashes: Column) -> Column:
    """``packed`` with zeros for global hashes that are null. Full lists of blocks are taken over as they are."""
    zero = F.lit(0).cast("bigint")
    parts = []
    for h in hashes:
        blocks = h["block_hashes"]
        full = (F.size(blocks) == N_BLOCKS) & ~F.exists(blocks, lambda b: b.isNull())
        each = [F.get(blocks, F.lit(i)) for i in range(N_BLOCKS)]
        mask = sum((F.when(b.isNotNull(), F.lit(1 << i)).otherwise(0) for i, b in enumerate(each)), F.lit(0)).cast("bigint")
        taken = F.concat(blocks, F.array(F.lit((1 << N_BLOCKS) - 1).cast("bigint")))
        parts += [F.array(F.coalesce(h["global_hash"], zero)), F.when(full, taken).otherwise(F.array(*(F.coalesce(b, zero) for b in each), mask))]
    return F.concat(*parts)


def _counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _close(x: np.ndarray, y: np.ndarray, same: bool, score: float, config: MultiHashConfig, weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of packed rows x and y, i < j if both are the ``same``, that may reach the score."""
    bound = None
    if min([*weights, config.global_weight, config.block_weight]) >= 0:
        bound = prefilter_bound(MultiHashConfig(*weights, *([0.0] * (3 - len(weights))), config.global_weight, config.block_weight), score)
    bits = np.arange(N_BLOCKS)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    # what a step makes is written over and over, and stays in the cache of a core
    step = max(1, 131_072 // max(1, len(y)))
    xs, ys = (np.ascontiguousarray(h[:, :, 0].T).view(np.uint64) for h in (x, y))
    unlike, bits_off = np.empty((step, len(y)), np.uint64), np.empty((step, len(y)), np.uint8)
    far, part = np.empty((step, len(y)), np.float32), np.empty((step, len(y)), np.float32)
    for at in range(0, len(x), step):
        n = len(x[at : at + step])
        if bound is None:
            ok = np.ones((n, len(y)), bool)
        else:
            for k, w in enumerate(weights):
                np.bitwise_count(np.bitwise_xor(xs[k, at : at + n, None], ys[k][None], out=unlike[:n]), out=bits_off[:n])
                np.multiply(bits_off[:n], np.float32(w), out=part[:n] if k else far[:n])
                if k:
                    far[:n] += part[:n]
            ok = far[:n] <= bound
        if same:
            ok &= np.arange(at, at + n)[:, None] < np.arange(len(y))
        left, right = np.divmod(np.flatnonzero(ok), max(1, len(y)))
        if x.shape[2] < WIDTH:
            found.append((left + at, right))
            continue
        for lo in range(0, len(left), PIECE):
            i, j = left[lo : lo + PIECE] + at, right[lo : lo + PIECE]
            total = np.zeros(len(i))
            for k, w in enumerate(weights):
                a, b = x[i, k], y[j, k]
                d = _counts(a[:, 1 : 1 + N_BLOCKS].copy(), b[:, 1 : 1 + N_BLOCKS].copy()).astype(np.int64)
                kept = (d <= config.block_distance_threshold) & (((a[:, -1] & b[:, -1])[:, None] >> bits) & 1).astype(bool)
                blocks = np.where(kept, HASH_BITS - d, 0).sum(axis=1) / HASH_BITS / np.maximum(kept.sum(axis=1), 1)
                whole = 1 - _counts(a[:, 0].copy(), b[:, 0].copy()) / HASH_BITS
                total += w * np.clip(config.global_weight * whole + config.block_weight * blocks, 0, 1)
            good = ~(np.clip(total, 0, 1) < score - SLACK)  # NaN stays, as Spark orders it above all numbers
            found.append((i[good], j[good]))
    left, right = (np.concatenate(f) for f in zip(*found, strict=True))
    return left, right


def close_pairs(rows: DataFrame, score: float, weights: list[float], config: MultiHashConfig | None = None, keys: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """(*keys, a, b): pairs of the ids of rows (*keys, id, h) with equal keys, ``h`` being ``packed``, that may reach the
    score (a little below counts too: score them again). Each unordered pair of two rows comes once.

    None is left out: each group is cut by a hash of the id into blocks of about ``block`` rows, and every pair of blocks is
    one unit of work. Weighted global distances are checked before blocks, and alone if ``h`` has no blocks."""
    config = config or MultiHashConfig()
    ident = rows.schema["id"].dataType
    good = lambda df: df.where(F.col("h").isNotNull()).select(*keys, "id", "h")
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    sizes = good(rows).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    cut = (good(rows).join(sizes, list(keys)) if keys else good(rows).join(F.broadcast(sizes))).where("_n > 0").withColumn("_mine", part(F.col("_n")))
    spread = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumns({"_p": F.least("_mine", "_other"), "_q": F.greatest("_mine", "_other")})
    shape = T.StructType([*(rows.schema[k] for k in keys), T.StructField("a", ident), T.StructField("b", ident)])

    def within(tables: pa.Table) -> pa.Table:
        own = tables.combine_chunks()
        h = own["h"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, len(weights), -1)
        mine = own["_mine"].to_numpy()
        first, second = (np.flatnonzero(mine == own[c][0].as_py()) for c in ("_p", "_q"))
        i, j = _close(h[first], h[second], own["_p"][0] == own["_q"][0], score, config, weights)
        names = own["id"]
        return pa.table({**{k: own[k].take(pa.array(first[i])) for k in keys}, "a": names.take(pa.array(first[i])), "b": names.take(pa.array(second[j]))})

    return spread.select(*keys, "_p", "_q", "_mine", "id", "h").groupBy(*keys, "_p", "_q").applyInArrow(within, shape)


def _scored(x: np.ndarray, y: np.ndarray, whole: tuple[np.ndarray, np.ndarray], keys: tuple[np.ndarray, np.ndarray], score: float, config: MultiHashConfig) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, score, same, distance) of the pairs of packed rows x and y, all three algorithms, that have at least the score
    or equal exact keys: in 32 bits and step by step what ``compare_multi`` gives. Rows that aren't ``whole`` meet by
    their keys only; no key below 0 stands in both."""
    one, weights = np.float32(1), [np.float32(w) for w in multi_weights(config)]
    far = max(-1, min(config.block_distance_threshold, HASH_BITS)) + 1  # of kept blocks the distance is below this
    fold = 255 // max(1, far)
    total, kept = np.arange(N_BLOCKS * far + 1)[:, None], np.arange(N_BLOCKS + 1)
    like = np.where(total > kept * far, 0, HASH_BITS * kept - total)
    with np.errstate(over="ignore", invalid="ignore"):
        of_blocks = (np.float32(config.block_weight) * (like.astype(np.float32) / np.float32(HASH_BITS) / np.maximum(kept, 1).astype(np.float32))).ravel()
        of_whole = np.float32(config.global_weight) * (one - np.arange(HASH_BITS + 1, dtype=np.float32) / np.float32(HASH_BITS))
        # where no sum can leave 0..1 there is nothing to clamp
        inside = min(*of_blocks, *of_whole) >= 0 and of_blocks.max() + of_whole.max() <= 1
        within = inside and min(weights) >= 0 and weights[0] + weights[1] + weights[2] <= 1
    finite = [bool(np.isfinite(v).all()) for v in ([config.global_weight, config.block_weight], [config.global_weight, config.block_weight, *weights])]

    def clamp(v: np.ndarray, known: bool) -> None:
        """NaN stays NaN where a weight isn't finite, and is the largest number elsewhere, as in Spark."""
        low, high = (np.fmax, np.fmin) if known else (np.maximum, np.minimum)
        low(high(v, one, out=v), np.float32(0), out=v)

    m, step = len(y), max(1, TILE // max(1, len(y)))
    xs, ys = (np.ascontiguousarray(h.transpose(1, 2, 0)).view(np.uint64) for h in (x, y))
    # (algorithm, block, row) of missing blocks
    gone = [((h[:, WIDTH - 1, None] >> np.arange(N_BLOCKS, dtype=np.uint64)[:, None]) & np.uint64(1)) == 0 for h in (xs, ys)]
    some = [g.any(axis=2) for g in gone]
    lone = [np.flatnonzero(~w) for w in whole]
    meet = bool(np.intersect1d(*keys).size)
    rows, columns = (np.ascontiguousarray(v).ravel() for v in np.broadcast_arrays(np.arange(step, dtype=np.int32)[:, None], np.arange(m, dtype=np.int32)))
    room = [np.empty((step, m), kind) for kind in (np.uint64, np.uint8, bool, np.uint8, np.uint8, np.uint16, np.float32, np.float32, np.float32, bool)]
    apart = np.empty((len(weights), step, m), np.uint8)
    for at in range(0, len(x), step):
        n = len(x[at : at + step])
        unlike, off, near, few, count, sums, part, blend, found, ok = (r[:n] for r in room)
        with np.errstate(over="ignore", invalid="ignore"):
            for k, w in enumerate(weights):
                for r in (count, few, sums):
                    r.fill(0)
                for b in range(N_BLOCKS):
                    np.bitwise_count(np.bitwise_xor(xs[k, b + 1, at : at + n, None], ys[k, b + 1], out=unlike), out=off)
                    if some[0][k, b]:
                        off[gone[0][k, b, at : at + n]] = 255
                    if some[1][k, b]:
                        off[:, gone[1][k, b]] = 255
                    np.less(off, np.uint8(far), out=near)
                    np.add(count, near.view(np.uint8), out=count)
                    np.multiply(off, near.view(np.uint8), out=off)
                    np.add(few, off, out=few)
                    if (b + 1) % fold == 0 or b + 1 == N_BLOCKS:
                        np.add(sums, few, out=sums)
                        few.fill(0)
                np.multiply(sums, np.uint16(N_BLOCKS + 1), out=sums)
                np.add(sums, count, out=sums)
                np.bitwise_count(np.bitwise_xor(xs[k, 0, at : at + n, None], ys[k, 0], out=unlike), out=apart[k, :n])
                np.take(of_whole, apart[k, :n], out=blend, mode="clip")
                blend += np.take(of_blocks, sums, out=part, mode="clip")
                if not inside:
                    clamp(blend, finite[0])
                np.multiply(blend, w, out=part if k else found)
                if k:
                    found += part
            if not within:
                clamp(found, finite[1])
            np.logical_not(np.less(found, np.float32(score), out=ok), out=ok)  # NaN stays, as Spark orders it above all numbers
        ok[lone[0][(lone[0] >= at) & (lone[0] < at + n)] - at] = False
        ok[:, lone[1]] = False
        if meet:
            equal = keys[0][at : at + n, None] == keys[1]
            ok |= equal
        i = np.flatnonzero(ok)
        value, gap = found.ravel().take(i), np.zeros(len(i), np.float32)
        same = equal.ravel().take(i) if meet else np.zeros(len(i), bool)
        if (divisor := weights[0] + weights[1] + weights[2]) > 0:
            d = [w * apart[k].ravel().take(i) for k, w in enumerate(weights)]
            gap = (d[0] + d[1] + d[2]) / divisor
        if not finite[1]:
            gap[~np.isfinite(gap)] = 0
        value[same], gap[same] = one, 0
        yield rows.take(i) + np.int32(at), columns.take(i), value, same, gap.astype(np.int32)


def scored_pairs(rows: DataFrame, queries: DataFrame, score: float, config: MultiHashConfig, block: int = 16384) -> DataFrame:
    """(query_id, id, score, exact_match, perceptual_distance) of the pairs of a row and a query (both id, exact, whole, h,
    ``h`` being ``filled`` of all three algorithms) with at least the score or equal exact hashes.

    Both sides are cut by a hash of the id into blocks of at most about ``block``, rows into more where there are cores for
    them; a block of rows against one of queries is one unit of work, and what it finds goes straight to the result."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held, nq = rows.count(), max(1, -(-queries.count() // block))
    nr = max(1, -(-held // block), min(-(-held // LEAST), -(-4 * cores // nq)))
    parts = min(nr * nq, 16 * cores)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    good = lambda df, asked: df.where("whole OR exact IS NOT NULL").select("id", "exact", "whole", "h", F.lit(asked).alias("_asked"))
    left = good(rows, False).select("*", part(nr).alias("_p"), every(nq).alias("_q"))
    right = good(queries, True).select("*", every(nr).alias("_p"), part(nq).alias("_q"))
    spread = left.unionByName(right).withColumn("_u", F.col("_p") * nq + F.col("_q")).drop("_p", "_q")
    ident = spread.schema["id"].dataType
    shape = T.StructType([T.StructField("query_id", ident), T.StructField("id", ident), T.StructField("score", T.FloatType()), T.StructField("exact_match", T.BooleanType()), T.StructField("perceptual_distance", T.IntegerType())])

    def unit(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(pieces).combine_chunks()
        asked = own["_asked"].to_numpy()
        sides = np.flatnonzero(~asked), np.flatnonzero(asked)
        if not min(map(len, sides)):
            return
        # the longer side comes second: numpy's inner loops run along it
        turned = len(sides[0]) > len(sides[1])
        first, second = sides[::-1] if turned else sides
        h = own["h"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, len(HashAlgorithm), WIDTH)
        hashed = own["whole"].to_numpy()
        key = own["exact"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        keys = key[first], np.where(key[second] < 0, -2, key[second])
        ids, names = (own["id"].combine_chunks().take(pa.array(s)) for s in sides)

        def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            i, j, value, same, gap = (np.concatenate(f) for f in zip(*found, strict=True))
            i, j = (j, i) if turned else (i, j)
            return pa.record_batch([names.take(pa.array(j)), ids.take(pa.array(i)), pa.array(value), pa.array(same), pa.array(gap)], names=shape.names)

        found, n = [], 0
        for piece in _scored(h[first], h[second], (hashed[first], hashed[second]), keys, score, config):
            found.append(piece)
            n += len(piece[0])
            if n >= BATCH:
                yield out(found)
                found, n = [], 0
        if n:
            yield out(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, at = [], None
        for batch in batches:
            units = batch.column("_u").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if pieces and units[lo] != at:
                    yield from unit(pieces)
                    pieces = []
                pieces.append(batch.slice(lo, hi - lo))
                at = units[lo]
        if pieces:
            yield from unit(pieces)

    return spread.repartitionById(parts, F.pmod("_u", F.lit(parts)).cast("int")).sortWithinPartitions("_u").mapInArrow(run, shape)


def multi_weights(config: MultiHashConfig) -> list[float]:
    return [config.weight(a) for a in HashAlgorithm]
