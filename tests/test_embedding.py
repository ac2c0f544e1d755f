import pytest
from pyspark.sql import functions as F

from pixelweft.functions import embedding as E
from pixelweft.operators import search

EMB = "struct<vector:array<float>,model_id:string>"


def test_validation_in_order(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0], None), ([], "vector is empty"), (None, "vector is empty"), ([nan, 0.0], "value is not finite"), ([inf], "value is not finite"), ([-inf], "value is not finite"), ([None, 1.0], "value is not finite"), ([0.0, 0.0], "all values are zero"), ([0.0] * 65537, "dimension is too large"), ([1.0] * 65536, None)]
    df = spark.createDataFrame(rows, "v array<float>, want string")
    assert all(r[0] == r[1] for r in df.select(E.embedding_error(F.col("v")), "want").collect())


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((1, 2), (-1, -2), -1), ((1, 0), (1, 1), 0.70711), ((1,) * 512, (1,) * 512, 1), ((3e-30, 4e-30), (3, 4), None)],
)
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(([float(x) for x in a], None), ([float(x) for x in b], "m"))], f"a {EMB}, b {EMB}")
    got = df.select(E.cosine(F.col("a"), F.col("b"))).first()[0]
    assert got is None if want is None else got == pytest.approx(want, abs=1e-5)


def test_what_cannot_be_compared(spark):
    rows = [(([1.0], "a"), ([1.0], "b"), "InvalidEmbedding"), (([1.0], "a"), ([1.0], "a"), None), (([1.0], None), ([1.0], "b"), None), (([1.0, 2.0], "a"), ([1.0], "a"), "EmbeddingDimensionMismatch"), (([1.0, 2.0], "a"), ([1.0], "b"), "InvalidEmbedding"), (([0.0], None), ([1.0], None), "InvalidEmbedding")]
    df = spark.createDataFrame(rows, f"a {EMB}, b {EMB}, want string")
    for r in df.select(E.cosine_error(F.col("a"), F.col("b")).alias("e"), E.cosine(F.col("a"), F.col("b")).alias("c"), "want").collect():
        assert r["e"] == r["want"] and (r["c"] is None) == (r["want"] is not None)


def test_normalise_bar_star(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [[round(x, 5) for x in r[0]] for r in df.select(E.l2_normalize(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    bars = spark.createDataFrame([(1.0,), (0.95,), (0.0,), (-0.4,)], "s float").select(E.similarity_bar(F.col("s")), E.star(F.col("s"))).collect()
    assert [tuple(b) for b in bars] == [("█" * 10, "★"), ("█" * 9 + "░", "★"), ("░" * 10, ""), ("░" * 10, "")]


def test_semantic_search(spark):
    rows = [(1, ([1.0, 0.0], "m")), (2, ([1.0, 0.1], None)), (3, ([0.0, 1.0], "m")), (4, ([1.0, 0.0], "other")), (5, ([1.0], "m"))]
    df = spark.createDataFrame(rows, f"id int, embedding {EMB}")
    assert {r["id"] for r in search.semantic_search(df, df.where("id = 1")).collect()} == {1, 2}
    every = {r["id"]: r["error"] for r in search.semantic_search(df, df.where("id = 1"), None).collect()}
    assert every == {1: None, 2: None, 3: None, 4: "InvalidEmbedding", 5: "EmbeddingDimensionMismatch"}
    many = spark.range(1001).select(F.col("id").cast("int"), F.lit(None).cast(EMB).alias("embedding"))
    with pytest.raises(ValueError):
        search.semantic_search(df, many)


def test_cosine_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8 if i % 5 else 6)]) for i in range(200)] + [(900, None), (901, [0.0] * 8), (902, [])]
    rows += [(1000 + i, rows[1][1]) for i in range(4)]  # ties
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    asked = df.where("id % 10 = 0 or id in (1, 900, 901)")
    good = {i: np.array(np.array(v, np.float32), float) for i, v in rows if v and np.any(v)}
    want = {(q, i): round(float(good[q] @ good[i] / np.linalg.norm(good[q]) / np.linalg.norm(good[i])), 6) for q in good if q % 10 == 0 or q == 1 for i in good if len(good[i]) == len(good[q])}
    for block in (16, 1000):
        got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in search.cosine_blocks(df, asked, floor=0.1, block=block).collect()}
        assert got == {p: c for p, c in want.items() if c >= 0.1}
        top = [(r["query_id"], r["id"]) for r in search.cosine_blocks(df, asked, k=3, block=block).collect()]
        assert sorted(top) == sorted(x for q in {q for q, _ in want} for x in sorted((p for p in want if p[0] == q), key=lambda p: (-want[p], p[1]))[:3])
    assert search.cosine_blocks(df.limit(0), asked).collect() == []
