import numpy as np
import pytest

from pixelweft.llm import seen

SCHEMA = "sighting_id bigint, exact binary, client string, bucket bigint, first bigint, n int"


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
@pytest.mark.parametrize("width", [16, 40, 63])
def test_elias_fano(n, width):
    rng = np.random.default_rng(n + width)
    top = (1 << width) - 1
    values = np.unique(np.r_[rng.integers(0, top, n, dtype=np.int64), [0, top][: min(n, 2)]].astype(np.int64))
    s = seen.EliasFano.encode(values, width)
    assert (s.decode() == values).all() and s.n == len(values)
    probes = np.r_[values, rng.integers(0, top, 500, dtype=np.int64), values + 1, 0, top]
    probes = probes[(probes >= 0) & (probes <= top)]
    assert (s.contains(probes) == np.isin(probes, values)).all()
    more = np.unique(rng.integers(0, top, 50, dtype=np.int64))
    again = s.merged(more)
    assert (again.decode() == np.union1d(values, more)).all()
    if n == 5000:
        assert len(s.high) + len(s.low) <= len(values) * (width - np.log2(len(values)) + 4) / 8


def brute(rows, known):
    out, before = set(), {k for k in known if k is not None and len(k) == 32}
    for i, key, *_ in sorted({r[:2] for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 32}):
        if key in before:
            out.add(i)
        before.add(key)
    return out


def run(spark, rows, known, **kw):
    out = seen.seen_before(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, "o") for k in known], "exact binary, origin string"), **kw).collect()
    assert len(out) == len({r[0] for r in out})
    return {r[0] for r in out}


def rows_of(seed, n=3000):
    rng = np.random.default_rng(seed)
    key = lambda k: int(k).to_bytes(4, "big") * 8
    rows = [(i, key(0 if rng.random() < 0.33 else rng.integers(1, 1500)), "c", 1, 2, 3) for i in range(n)]
    rows += [rows[5], rows[17], (n, None, "c", 1, 2, 3), (n + 1, b"", None, 1, 2, 3), (n + 2, b"x" * 31, None, 1, 2, 3), (None, key(3), "c", 1, 2, 3)]
    return rows, [key(k) for k in range(10, 40)] + [None, b"short"]


def test_equals_brute_force(spark):
    rows, known = rows_of(1)
    assert run(spark, rows, known) == brute(rows, known)
    assert run(spark, rows, known, per_bucket=64, batches=5) == brute(rows, known)


def test_empty(spark):
    rows, known = rows_of(2, 100)
    assert run(spark, [], known) == set()
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], []) == set()


def test_short_hashes_err_one_way_and_are_measured(spark):
    rows, known = rows_of(3)
    df, listed = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k,) for k in known], "exact binary")
    said = run(spark, rows, known, hash_bits=12)
    truth = brute(rows, known)
    assert truth < said  # "not seen" is never wrong
    r = seen.error_rate(df, listed, hash_bits=12).first()
    assert r["wrong_answers"] == len(said - truth) > 0 and r["seen_answers"] == len(said) and r["answers"] == 3000
    assert 0.2 < r["wrong_answers"] / (0.5 * r["expected_rate"] * 1450) < 2
    assert seen.error_rate(df, listed).first()["wrong_answers"] == 0


def test_kept_sets_take_up_where_the_last_call_ended(spark, tmp_path):
    rows, known = rows_of(4, 1200)
    rows = [r for r in rows if r[0] is not None]
    kept = f"file://{tmp_path}/sets"
    got = run(spark, [r for r in rows if r[0] < 500], known, kept=kept, expected=100_000)
    got |= run(spark, [r for r in rows if 500 <= r[0] < 900], [], kept=kept)
    got |= run(spark, [r for r in rows if r[0] >= 900], [], kept=kept)
    assert got == brute(rows, known)


def test_no_table_that_grows_with_the_data_is_broadcast(spark):
    rows, known = rows_of(5, 500)
    df, listed = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k,) for k in known], "exact binary")
    for out in (seen.seen_before(df, listed), seen.error_rate(df, listed)):
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.collect()
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
