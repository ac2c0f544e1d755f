import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelweft.functions import similarity as S
from pixelweft.functions import u64
from pixelweft.schema import HashAlgorithm, MultiHashConfig, checked_threshold

HASHES = "struct<global_hash:bigint,block_hashes:array<bigint>>"
MULTI = f"struct<exact:binary,ahash:{HASHES},phash:{HASHES},dhash:{HASHES}>"
f32 = np.float32


def signed(x):
    return (x + 2**63) % 2**64 - 2**63


def dist(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def score(a, b, t=32, gw=0.4, bw=0.6):
    kept = [64 - d for d in map(dist, a[1], b[1]) if d <= t]
    block = f32(sum(kept) / 64) / f32(len(kept)) if kept else f32(0)
    d = dist(a[0], b[0])
    g = f32(0) if d >= 64 else f32(1) - f32(d) / f32(64)
    return min(f32(1), max(f32(0), f32(gw) * g + f32(bw) * block))


def multi_score(a, b, c):
    if a[0] is not None and a[0] == b[0]:
        return f32(1), True, 0
    ws = [f32(c.weight(x)) for x in HashAlgorithm]
    s = f32(0)
    for w, x, y in zip(ws, a[1:], b[1:], strict=True):
        s = s + w * score(x, y, c.block_distance_threshold, c.global_weight, c.block_weight)
    total = ws[0] + ws[1] + ws[2]
    d = f32(0)
    for w, x, y in zip(ws, a[1:], b[1:], strict=True):
        d = d + w * f32(dist(x[0], y[0]))
    return min(f32(1), max(f32(0), s)), False, int(d / total) if total > 0 else 0


def near(rng, h, most=40):
    for b in rng.choice(64, rng.integers(0, most), replace=False):
        h ^= 1 << int(b)
    return signed(h)


def pair(rng):
    one = lambda: (signed(int(rng.integers(0, 2**63)) * 2 + 1), [signed(int(rng.integers(0, 2**63)) * 2) for _ in range(16)])
    a = [one() for _ in range(3)]
    b = [(near(rng, g), [near(rng, x) for x in bs]) for g, bs in a]
    return a, b


def test_multi_and_single_equal_the_definition(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        a, b = pair(rng)
        same = rng.random() < 0.1
        rows.append((i, (b"a" * 32, *a), ((b"a" if same else b"b") * 32 if rng.random() < 0.9 else None, *b)))
    df = spark.createDataFrame(rows, f"i int, a {MULTI}, b {MULTI}")
    for c in (MultiHashConfig(), MultiHashConfig(0.0, 1.0, 0.0), MultiHashConfig(0, 0, 0), MultiHashConfig(3, 2, 1, 1.0, 1.0, 20), MultiHashConfig(0.2, 0.2, 0.2, 0.1, 0.9, 0)):
        for r in df.select("i", S.compare_multi(F.col("a"), F.col("b"), c).alias("s")).collect():
            want = multi_score(rows[r["i"]][1], rows[r["i"]][2], c)
            assert (f32(r["s"]["score"]), r["s"]["exact_match"], r["s"]["perceptual_distance"]) == want
    one = lambda x: F.struct(F.col(f"{x}.exact").alias("exact"), F.col(f"{x}.phash.global_hash").alias("global_hash"), F.col(f"{x}.phash.block_hashes").alias("block_hashes"))
    for r in df.select("i", S.compare_single(one("a"), one("b"), 24, 0.7, 0.5).alias("s")).collect():
        a, b = rows[r["i"]][1], rows[r["i"]][2]
        assert f32(r["s"]["score"]) == (f32(1) if a[0] == b[0] else score(a[2], b[2], 24, 0.7, 0.5))


def single(spark, a, b, t=32):
    df = spark.createDataFrame([((None, *a), (None, *b))], "a struct<exact:binary,global_hash:bigint,block_hashes:array<bigint>>, b struct<exact:binary,global_hash:bigint,block_hashes:array<bigint>>")
    return df.select(S.compare_single(F.col("a"), F.col("b"), t).alias("s"), S.kept_blocks(F.col("a.block_hashes"), F.col("b.block_hashes"), t).alias("k")).first()


def test_edges(spark):
    zero, ones = (0, [0] * 16), (-1, [-1] * 16)
    r = single(spark, zero, ones)
    assert r["s"]["score"] == 0 and r["s"]["perceptual_distance"] == 64 and r["k"] == 0
    r = single(spark, zero, (0, [-1] * 16))
    assert f32(r["s"]["score"]) == f32(0.4)  # all blocks dropped: only the global weight is left
    r = single(spark, zero, (0, [0] * 8 + [-1] * 8))
    assert r["s"]["score"] == 1 and r["k"] == 8  # dropped blocks leave the mean
    r = single(spark, zero, (0, [None] * 4 + [0] * 3))
    assert r["s"]["score"] == 1 and r["k"] == 3
    assert single(spark, zero, (None, [0] * 16))["s"]["score"] is None  # a missing global hash has no score


@pytest.mark.parametrize(("d", "want"), [(0, 1.0), (16, 0.75), (32, 0.5), (64, 0.0), (100, 0.0)])
def test_hash_similarity(spark, d, want):
    assert spark.range(1).select(S.hash_similarity(F.lit(d))).first()[0] == want


def test_u64(spark):
    rows = [(0, -1, 64), (-1, -1, 0), (0, 1, 1), (0, 255, 8), (0, 2**32 - 1, 32), (-(2**63), 2**63 - 1, 64), (None, 1, None)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, d int")
    assert all(r[0] == r[1] for r in df.select(u64.hamming("a", "b"), "d").collect())
    v = signed(0xDEADBEEFCAFEBABE)
    df = spark.createDataFrame([(v,), (None,)], "h bigint")
    got = df.select(*(u64.hex64(u64.coarse_key("h", b)).alias(f"k{b}") for b in (0, 1, 16, 64, 99)), u64.hex64("h").alias("x"), u64.unsigned_text("h").alias("n"), u64.from_hex(u64.hex64("h")).alias("h")).collect()
    assert tuple(got[0]) == ("0" * 16, "0" * 15 + "1", "000000000000dead", "deadbeefcafebabe", "deadbeefcafebabe", "deadbeefcafebabe", str(0xDEADBEEFCAFEBABE), v)
    assert tuple(got[1]) == (None,) * 8


def test_thresholds(spark):
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            checked_threshold(bad)
    assert checked_threshold(7, strict=False) == 1 and checked_threshold(-7, strict=False) == 0
    df = spark.createDataFrame([((0.5, False, 3),)], "s struct<score:float,exact_match:boolean,perceptual_distance:int>")
    ask = lambda t, **kw: df.select(S.is_similar(F.col("s"), t, **kw)).first()[0]
    assert ask(0.5) and not ask(0.51) and ask(-1, strict=False) and not ask(float("nan"), strict=False)
    bands = spark.createDataFrame([(0.81,), (0.8,), (0.5,)], "s float").select(S.band(F.col("s"))).collect()
    assert [b[0] for b in bands] == ["very similar", "somewhat similar", "different"]


@settings(max_examples=30, deadline=None)
@given(st.floats(0.5, 1), st.lists(st.floats(0, 1), min_size=3, max_size=3), st.integers(0, 2**31))
def test_prefilter_never_drops_a_hit(t, ws, seed):
    total = sum(ws) or 1
    c = MultiHashConfig(*(w / total for w in ws))
    bound = S.prefilter_bound(c, t)
    a, b = pair(np.random.default_rng(seed))
    b = [(g, x[1]) for (g, _), x in zip([(y[0] if i else b[0][0], 0) for i, y in enumerate(b)], a, strict=True)]  # equal blocks: the best case
    if multi_score((None, *a), (None, *b), c)[0] >= f32(t):
        assert sum(c.weight(x) * dist(p[0], q[0]) for x, p, q in zip(HashAlgorithm, a, b, strict=True)) <= bound


def test_prefilter_is_off_where_it_would_lie():
    assert S.prefilter_bound(MultiHashConfig(ahash_weight=-1), 0.9) is None
    assert S.prefilter_bound(MultiHashConfig(global_weight=0.7, block_weight=0.7), 0.9) is None
    assert S.prefilter_bound(MultiHashConfig(), 0.95) == pytest.approx(9)


def test_properties_of_random_pairs(spark):
    """Reflexive, symmetric, in range; equal bytes win; similarity to itself is perfect."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        a, b = pair(rng)
        rows.append((i, (bytes([i]) * 32, *a), (bytes([i if i % 7 == 0 else i + 1 & 255]) * 32, *b)))
    df = spark.createDataFrame(rows, f"i int, a {MULTI}, b {MULTI}")
    out = df.select("i", S.compare_multi(F.col("a"), F.col("b")).alias("ab"), S.compare_multi(F.col("b"), F.col("a")).alias("ba"), S.compare_multi(F.col("a"), F.col("a")).alias("aa"), S.perfect().alias("p")).collect()
    for r in out:
        assert r["ab"] == r["ba"] and r["aa"] == r["p"]
        assert 0 <= r["ab"]["score"] <= 1 and 0 <= r["ab"]["perceptual_distance"] <= 64
        assert r["ab"]["exact_match"] == (r["i"] % 7 == 0) and (not r["ab"]["exact_match"] or r["ab"] == r["p"])


def test_nulls_never_crash(spark):
    whole = (b"x" * 32, (1, [2] * 16), (1, [2] * 16), (1, [2] * 16))
    odd = [(None, None, None, None), (b"", (None, None), (1, []), (1, [None] * 16)), (b"x" * 32, None, (None, [1]), (3, None)), whole]
    df = spark.createDataFrame([(a, b) for a in odd for b in odd], f"a {MULTI}, b {MULTI}")
    for r in df.select("a", "b", S.compare_multi(F.col("a"), F.col("b")).alias("s")).collect():
        same = r["a"]["exact"] is not None and r["a"]["exact"] == r["b"]["exact"]
        assert r["s"]["exact_match"] == same
        full = all(x[f] is not None and x[f]["global_hash"] is not None for x in (r["a"], r["b"]) for f in ("ahash", "phash", "dhash"))
        assert (r["s"]["score"] is None) == (not same and not full)
