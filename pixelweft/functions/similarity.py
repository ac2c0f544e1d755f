"""Scores of fingerprint pairs as Column expressions.

Scores are 32-bit floats. Spark widens ``float / float`` and ``int * float`` to DOUBLE, so operands and quotients are
cast back. Block sums are multiples of 1/64 and thus exact; they are added as integers. For one algorithm the
16 block terms are written out instead of a higher-order function, so that the expression stays inside generated code.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_BLOCK_DISTANCE_THRESHOLD, DEFAULT_BLOCK_WEIGHT, DEFAULT_GLOBAL_WEIGHT, HASH_BITS, N_BLOCKS, HashAlgorithm, MultiHashConfig, checked_threshold
from .u64 import hamming


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def hash_similarity(distance: Column) -> Column:
    """1 - d / 64, and 0 from 64 on."""
    return F.when(distance >= HASH_BITS, f32(0.0)).otherwise(f32(f32(1.0) - f32(f32(distance) / f32(float(HASH_BITS)))))


def _kept(a: Column, b: Column, threshold: int, unrolled: bool = True) -> Column:
    """Count of the kept block positions times 65536, plus the sum of their 64 - d: one INT, so that both come from one
    pass over the blocks. A missing or null block is not kept. ``unrolled``: 16 terms in generated code, which three
    algorithms at once would push over the size a method may have."""
    term = lambda d: F.when(d <= threshold, F.lit(65536 + HASH_BITS) - d).otherwise(0)
    if unrolled:
        return reduce(add, (term(hamming(F.get(a, F.lit(i)), F.get(b, F.lit(i)))) for i in range(N_BLOCKS)))
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda s, d: s + term(d))


def kept_blocks(a: Column, b: Column, threshold: int = DEFAULT_BLOCK_DISTANCE_THRESHOLD) -> Column:
    """How many block positions are within the threshold."""
    return F.shiftright(_kept(a, b, threshold), 16)


def block_similarity(a: Column, b: Column, threshold: int = DEFAULT_BLOCK_DISTANCE_THRESHOLD, unrolled: bool = True) -> Column:
    """Mean of 1 - d / 64 over the positions with d <= threshold; the others leave the mean. 0 if none is left."""
    kept = _kept(a, b, threshold, unrolled)
    exact = f32(f32(kept.bitwiseAND(F.lit(65535))) / f32(float(HASH_BITS)))
    return f32(exact / f32(F.greatest(F.shiftright(kept, 16), F.lit(1))))


def clamp01(x: Column, weights: tuple[float, ...] = ()) -> Column:
    """To 0..1. NaN stays NaN; it can only come from a weight that isn't finite."""
    if all(math.isfinite(w) for w in weights):
        return F.greatest(f32(0.0), F.least(f32(1.0), x))
    return F.when(F.isnan(x), x).otherwise(F.greatest(f32(0.0), F.least(f32(1.0), x)))


def score_only(a: Column, b: Column, threshold: int = DEFAULT_BLOCK_DISTANCE_THRESHOLD, global_weight: float = DEFAULT_GLOBAL_WEIGHT, block_weight: float = DEFAULT_BLOCK_WEIGHT, unrolled: bool = True) -> Column:
    """Weighted global and block similarity of two ``struct<global_hash, block_hashes>``, clamped; null without a global hash."""
    g = hash_similarity(hamming(a["global_hash"], b["global_hash"]))
    blend = f32(global_weight) * g + f32(block_weight) * block_similarity(a["block_hashes"], b["block_hashes"], threshold, unrolled)
    return F.when(_hashed(a, b), clamp01(blend, (global_weight, block_weight)))


def _hashed(a: Column, b: Column) -> Column:
    return a["global_hash"].isNotNull() & b["global_hash"].isNotNull()


def _result(score: Column, exact: Column, distance: Column) -> Column:
    same = F.coalesce(exact, F.lit(False))
    return F.struct(F.when(same, f32(1.0)).otherwise(score).alias("score"), same.alias("exact_match"), F.when(same, F.lit(0)).otherwise(distance).cast("int").alias("perceptual_distance"))


def perfect() -> Column:
    """The similarity of equal bytes."""
    return F.struct(f32(1.0).alias("score"), F.lit(True).alias("exact_match"), F.lit(0).alias("perceptual_distance"))


def compare_single(a: Column, b: Column, threshold: int = DEFAULT_BLOCK_DISTANCE_THRESHOLD, global_weight: float = DEFAULT_GLOBAL_WEIGHT, block_weight: float = DEFAULT_BLOCK_WEIGHT) -> Column:
    """Similarity of two ``struct<exact, global_hash, block_hashes>``. Equal exact hashes win under any weights; a null
    exact hash equals nothing."""
    return _result(score_only(a, b, threshold, global_weight, block_weight), a["exact"] == b["exact"], hamming(a["global_hash"], b["global_hash"]))


def compare_multi(a: Column, b: Column, config: MultiHashConfig | None = None) -> Column:
    """Similarity of two ``struct<exact, ahash, phash, dhash>``: clamped weighted sum of the three scores, each clamped
    before; the distance is the weighted mean of the global distances, truncated, 0 where the weights add up to 0 or less.
    Score and distance are null where a global hash is missing, unless the exact hashes are equal."""
    c = config or MultiHashConfig()
    algorithms = (HashAlgorithm.AHASH, HashAlgorithm.PHASH, HashAlgorithm.DHASH)
    scores = [f32(c.weight(x)) * score_only(a[x.field], b[x.field], c.block_distance_threshold, c.global_weight, c.block_weight, False) for x in algorithms]
    distances = [f32(c.weight(x)) * f32(hamming(a[x.field]["global_hash"], b[x.field]["global_hash"])) for x in algorithms]
    weights = reduce(lambda x, y: f32(x + y), (f32(c.weight(x)) for x in algorithms))
    mean = f32(reduce(add, distances) / weights)
    distance = F.when(weights > f32(0.0), mean.cast("int")).otherwise(0)
    whole = reduce(lambda x, y: x & y, (_hashed(a[x.field], b[x.field]) for x in algorithms))
    score = F.when(whole, clamp01(reduce(add, scores), (c.ahash_weight, c.phash_weight, c.dhash_weight, c.global_weight, c.block_weight)))
    return _result(score, a["exact"] == b["exact"], distance)


def is_similar(similarity: Column, threshold: float, strict: bool = True) -> Column:
    """score >= threshold. Outside 0..1 the threshold raises, or with ``strict=False`` is clamped; NaN then matches nothing."""
    t = checked_threshold(threshold, strict)
    return F.lit(False) if t != t else similarity["score"] >= f32(t)


def band(score: Column, high: float = 0.8, low: float = 0.5) -> Column:
    """Wording for a score; both limits are exclusive."""
    return F.when(score > f32(high), "very similar").when(score > f32(low), "somewhat similar").otherwise("different")


def prefilter_bound(config: MultiHashConfig, score: float) -> float | None:
    """Largest weighted global distance that can still reach ``score``, from block similarity <= 1; one unit of slack for
    rounding. None where the bound doesn't hold (negative weights, or inner clamping)."""
    ws = [config.ahash_weight, config.phash_weight, config.dhash_weight]
    gw, bw = config.global_weight, config.block_weight
    if min([*ws, gw, bw]) < 0 or gw + bw > 1 + 1e-6 or gw == 0:
        return None
    return (sum(ws) * (gw + bw) - score) * HASH_BITS / gw + 1
