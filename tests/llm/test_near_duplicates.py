import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import banding
from pixelweft.llm import near_duplicates as nd

SCHEMA = "id bigint, exact binary, algorithm string, global_hash bigint, block_hashes array<bigint>, format_version int, cid string, kind string, key bigint"


def signed(x):
    return int(np.uint64(x).astype(np.int64))


def flip(rng, h, n):
    for b in rng.choice(64, n, replace=False):
        h ^= np.uint64(1) << np.uint64(b)
    return h


def row(i, g, blocks, exact=None, algorithm="PHash", version=1):
    return (i, exact, algorithm, None if g is None else signed(g), None if blocks is None else [None if b is None else signed(b) for b in blocks], version, "x", "y", 7)


def brute(rows):
    ok = {}
    for r in rows:
        if r[5] == 1 and r[3] is not None and r[4] is not None and len(r[4]) == 16 and None not in r[4]:
            ok[r[0]] = r
    out = set()
    items = sorted(ok.values())
    for i, x in enumerate(items):
        for y in items[i + 1 :]:
            if x[2] != y[2]:
                continue
            d = [((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x[4], y[4], strict=True)]
            kept = [v for v in d if v <= 32]
            if len(kept) < 8:
                continue
            g = ((x[3] ^ y[3]) & (2**64 - 1)).bit_count()
            f = np.float32
            score = f(0.4) * (f(1) - f(g) / f(64)) + f(0.6) * (f(sum(64 - v for v in kept) / 64) / f(len(kept)))
            if score >= f(0.883) or (x[1] is not None and x[1] == y[1]):
                out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return [(r["id_a"], r["id_b"]) for r in nd.near_duplicate_pairs(nd.fingerprint_records(df), **kw).collect()]


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for _ in range(60):
        g, blocks = rng.integers(0, 2**64, dtype=np.uint64), rng.integers(0, 2**64, 16, dtype=np.uint64)
        for _ in range(rng.integers(1, 5)):
            i += 1
            level = int(rng.integers(0, 7))
            rows.append(row(i, flip(rng, g, level), [flip(rng, b, level) for b in blocks], bytes([i % 256] * 32), rng.choice(["PHash", "AHash"])))
    return rows


def test_equals_brute_force(spark, pictures):
    got = found(spark, pictures)
    want = brute(pictures)
    assert len(got) == len(set(got))
    assert not set(got) - want
    assert len(set(got) & want) >= 0.97 * len(want) > 10  # many of these pairs lie at the limit


def test_groups(spark):
    g, b = np.uint64(3), [np.uint64(2**63 + k) for k in range(16)]
    step = lambda n: [x ^ np.uint64((1 << n) - 1) for x in b]
    # 1 - 2 - 3 is a chain whose ends are unlike; 4 is alone, 5 can't be compared, 6 and 7 are of the other algorithm
    rows = [row(1, g, step(0)), row(2, g, step(10)), row(3, g, step(20)), row(4, ~g, step(60)), row(5, g, b[:15]), row(6, g, step(0), algorithm="AHash"), row(7, g, step(0), algorithm="AHash")]
    assert brute(rows) == {(1, 2), (2, 3), (6, 7)}
    singles = nd.fingerprint_records(spark.createDataFrame(rows, SCHEMA))
    other = singles.withColumn("kind", F.lit(1).cast("tinyint")).where("id in (2, 3, 4)")
    got = nd.near_duplicate_groups(singles.unionByName(other)).collect()
    assert sorted((r["kind"], r["id"], r["group_id"]) for r in got) == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 4), (0, 6, 6), (0, 7, 6), (1, 2, 2), (1, 3, 2), (1, 4, 4)]


def test_dirt_takes_no_part(spark, pictures):
    g, b = np.uint64(3), [np.uint64(9)] * 16
    dirt = [row(9001, None, b), row(9002, g, None), row(9003, g, b[:15]), row(9004, g, [*b[:15], None]), row(9005, g, b, version=2), row(9006, g, []), (None, None, "PHash", 3, [9] * 16, 1, "", "", 0), row(9007, g, b, algorithm=None)]
    assert found(spark, dirt) == []
    assert found(spark, []) == []


def test_copies_repeats_and_equal_bytes(spark):
    g, b = np.uint64(3), [np.uint64(2**63 + k) for k in range(16)]
    other = [np.uint64(2**64 - 1) ^ x for x in b]
    half = [*b[:8], *other[8:]]
    rows = [row(1, g, b), row(2, g, b), row(2, g, b), row(3, g, b), row(4, np.uint64(2**64 - 1), half, b"e" * 32), row(5, g, b, b"e" * 32), row(6, g, other, b"e" * 32)]
    # 4 with 5 and with 6: equal bytes and eight near blocks; 5 and 6: equal bytes but no near block
    assert sorted(found(spark, rows)) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5), (4, 5), (4, 6)]


def test_crowds_of_copies_are_stars(spark):
    g, b = np.uint64(3), [np.uint64(2**63 + k) for k in range(16)]
    near = [b[0] ^ np.uint64(1), *b[1:]]
    rows = [row(i, g, b) for i in range(10, 40)] + [row(50, g, near), row(51, g, near)]
    got = found(spark, rows, copies=5)
    assert sorted(got) == sorted([(10, i) for i in range(11, 40)] + [(10, 50), (10, 51), (50, 51)])
    alike = [row(i, np.uint64(i), [x ^ np.uint64(2**i) for x in b], b"e" * 32) for i in range(12)]
    assert {(0, i) for i in range(1, 12)} <= set(found(spark, alike, copies=5))


def test_crowd_of_equal_bytes_keeps_links_between_contents(spark):
    rng = np.random.default_rng(10)
    b = rng.integers(0, 2**64, 16, dtype=np.uint64)
    # the smallest id is unlike all others, which have eight near blocks in common
    rows = [row(0, np.uint64(2**64 - 1), [np.uint64(2**64 - 1) ^ x for x in b], b"e" * 32)]
    rows += [row(i, rng.integers(0, 2**64, dtype=np.uint64), [*b[:8], *rng.integers(0, 2**64, 8, dtype=np.uint64)], b"e" * 32) for i in range(1, 9)]
    assert {p for p in brute(rows) if p[0] > 0} == {(i, j) for i in range(1, 9) for j in range(i + 1, 9)}
    assert set(found(spark, rows, copies=5)) == brute(rows)


def test_crowded_values_lose_nothing(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(0, 300, 2):  # flat pictures share the global hash; pairs of them are alike in their blocks
        blocks = rng.integers(0, 2**64, 16, dtype=np.uint64)
        rows += [row(i, np.uint64(0), blocks), row(i + 1, np.uint64(0), [flip(rng, b, 4) for b in blocks])]
    want = brute(rows)
    assert set(found(spark, rows, crowd=1)) == want
    assert len(want) >= 150


def test_crowd_of_one_global_hash_is_compared_whole(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(0, 800, 2):  # eight blocks are near, at the limit of the score; the others leave the mean
        blocks = rng.integers(0, 2**64, 16, dtype=np.uint64)
        rows += [row(i, np.uint64(0), blocks), row(i + 1, np.uint64(0), [*(flip(rng, b, 12) for b in blocks[:8]), *(np.uint64(2**64 - 1) ^ b for b in blocks[8:])])]
    want = brute(rows)
    assert set(found(spark, rows, crowd=1)) == want and len(want) == 400


def test_hot_groups_in_blocks(spark):
    rng = np.random.default_rng(7)
    values = rng.integers(0, 2**63, 50)
    rows = [(5, 0, int(i), int(values[i % 50]) ^ (1 << int(i % 3))) for i in range(300)]
    hot = spark.createDataFrame(rows, "key bigint, kind tinyint, id bigint, value bigint")
    got = {(r["a"], r["b"]) for r in banding.blocked_pairs(hot, 2, block=64).collect()}
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and (a[3] ^ b[3]).bit_count() <= 2}
    assert got == want
    # the streaming pass hands the whole group over when it is too large
    out = banding.band_pairs(hot, 2, 2, most=100).collect()
    assert all(r["hot"] for r in out) and sorted(r["a"] for r in out) == list(range(300))
    small = banding.band_pairs(hot, 2, 2, most=1000).collect()
    assert {(r["a"], r["b"]) for r in small} == want


def test_band_plan_reaches_target():
    for n in (100, 10**5, 10**9):
        plan = banding.plan_bands(n, 0.99)
        assert plan.recall >= 0.99 and 2 ** (plan.rows + 3) >= min(n, 2**40)
    masks = banding.masks(5, 20, 3)
    assert len(set(masks)) == 5 and all((m & (2**64 - 1)).bit_count() == 20 for m in masks)
