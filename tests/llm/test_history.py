import numpy as np

from pixelweft.llm import history

SCHEMA = "arrival_id bigint, batch_no int, exact binary, global_hash bigint, format_version int, part int, key bigint, verdict string"


def greedy(rows):
    """The definition, row by row."""
    accepted, out, seen = [], {}, set()
    for a, b, e, g, v, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[0])):
        e = e if e is not None and len(e) == 32 else None
        if v != 1 or (e is None and g is None) or a in seen:
            continue
        seen.add(a)
        if b > 0:
            if e is not None and any(x == e for x, _ in accepted):
                out[a] = "exact"
                continue
            if g is not None and any(y is not None and ((y ^ g) & (2**64 - 1)).bit_count() <= 3 for _, y in accepted):
                out[a] = "near"
                continue
            out[a] = "accepted"
        accepted.append((e, g))
    return out


def judged(spark, rows, **kw):
    out = history.judge(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(out) == len({r["arrival_id"] for r in out})
    return {r["arrival_id"]: r["verdict"] for r in out}


def random_rows(seed, n=500, start=0, batches=6):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63, 25)
    rows = []
    for i in range(n):
        g = int(base[rng.integers(0, 25)])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            g ^= 1 << int(b)
        g = (g + 2**63) % 2**64 - 2**63
        e = bytes([int(rng.integers(0, 60))] * 32)
        kind = rng.integers(0, 12)
        rows.append((start + i, int(rng.integers(0, batches)), None if kind == 0 else b"short" if kind == 1 else e, None if kind == 2 else g, 2 if kind == 3 else 1, 1, 2, "x"))
    return rows


def test_equals_the_definition(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        assert judged(spark, rows) == greedy(rows)


def test_crowd_of_one_picture_and_chains(spark):
    e = b"p" * 32
    rows = [(i, i % 4, e, 12345, 1, 0, 0, "") for i in range(300)]
    # a chain in which each is near the one before only
    g = 0
    for i in range(20):
        rows.append((1000 + i, 2, bytes([i]) * 32, g, 1, 0, 0, ""))
        g |= 0b11 << (2 * i)
    rows += [(2000 + i, 3, None, -1, 1, 0, 0, "") for i in range(50)]  # one hash, no exact
    assert judged(spark, rows) == greedy(rows)


def test_empty_null_repeated(spark):
    assert judged(spark, []) == {}
    rows = [(1, 1, None, None, 1, 0, 0, ""), (2, 1, b"", None, 1, 0, 0, ""), (None, 1, None, 5, 1, 0, 0, ""), (3, None, None, 5, 1, 0, 0, ""), (4, 1, None, 5, 1, 0, 0, ""), (4, 1, None, 5, 1, 0, 0, ""), (5, 1, None, 5, None, 0, 0, "")]
    assert judged(spark, rows) == {4: "accepted"}
    assert judged(spark, [r for r in random_rows(3, 60) if r[1] == 0]) == {}


def test_kept_index_gives_the_same(spark, tmp_path):
    rows = random_rows(4, 300)
    path = f"file://{tmp_path}/index"
    got = {}
    for low, high in ((0, 2), (3, 4), (5, 9)):
        got |= judged(spark, [r for r in rows if low <= r[1] <= high], index_path=path)
    assert got == greedy(rows)


def test_bands_miss_nothing():
    rng = np.random.default_rng(0)
    for n in (1000, 10**6, 10**9, 10**12):
        masks = history.chunk_masks(n, 3)
        for _ in range(200):
            flipped = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not m & flipped for m in masks)


def test_probe_opens_only_touched_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    old = random_rows(5, 200, batches=1)
    judged(spark, old, index_path=path, parts=64)
    index = history.HistoryIndex.kept(spark, path, 0)
    assert index.parts == 64
    e = next(r[2] for r in old if r[2] is not None and len(r[2]) == 32 and r[4] == 1)
    found = index.exact(spark.createDataFrame([(e,)], "exact binary"))
    assert "PartitionFilters: [isnotnull(part" in (plan := found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")) and " (part#" in plan.split("PartitionFilters")[1][:200]
    assert found.count() == 1
    hashes = spark.createDataFrame([(123456789,)], "global_hash bigint")
    asked = index.keys(hashes)
    parts = {r["part"] for r in asked.collect()}
    files = index._read("bands", index.BANDS, asked).inputFiles()
    read = index._read("bands", index.BANDS, asked)
    assert len(parts) < 64 and files  # inputFiles lists the table; the scan itself is filtered
    assert {r["part"] for r in read.select("part").distinct().collect()} <= parts


def test_compacting_changes_no_answer(spark, tmp_path, monkeypatch):
    rows = random_rows(6, 300)
    path = f"file://{tmp_path}/index"
    got = judged(spark, [r for r in rows if r[1] <= 2], index_path=path)
    monkeypatch.setattr(history.HistoryIndex, "PER_PART", 100)
    index = history.HistoryIndex.kept(spark, path, 0)
    before = index.parts
    index.compact(path)
    assert index.parts > before
    got |= judged(spark, [r for r in rows if r[1] > 2], index_path=path)
    assert got == greedy(rows)
