"""Neighbours, clusters and subsets against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import clusters, neighbours, subset, vectors
from pixelweft.session import Scratch

SCHEMA = "id bigint, vector array<float>, model_id string, created_at string, cid string, label int, dim string"
MODELS = [("m", 16), ("k", 16), ("w", 24)]


def unit(rng, d):
    v = rng.standard_normal(d)
    return v / np.linalg.norm(v)


def make(seed, groups=14, noise=60):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(groups):
        model = ["m", "k", "w", None][rng.integers(0, 4)]
        d = 24 if model == "w" else 16
        centre = unit(rng, d)
        for _ in range(rng.integers(2, 14)):
            i += 1
            rows.append((i, [float(x) for x in (centre + 0.3 * unit(rng, d)) * rng.uniform(0.1, 50)], model))
    for _ in range(noise):
        i += 1
        model = ["m", "k", "w", None][rng.integers(0, 4)]
        rows.append((i, [float(x) for x in unit(rng, 24 if model == "w" else 16)], model))
    copies = [(1000 + k, rows[3][1], rows[3][2]) for k in range(12)]
    dirt = [(2001, None, "m"), (2002, [], "m"), (2003, [0.0] * 16, "m"), (2004, [float("nan")] * 16, "m"), (2005, [1.0] * 15, "m"), (2006, [1.0] * 16, "unknown"), (2007, [1.0] * 7, None), (2008, [None] * 16, "m"), (2009, [float("inf")] * 16, None), (None, rows[0][1], "m")]
    return [(*r, "t", "c", 1, "d") for r in rows + copies + dirt + rows[:4]]


def tables(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(MODELS, "model_id string, dimension int")


def usable(rows):
    size = dict(MODELS)
    good = {}
    for i, v, m, *_ in rows:
        if i is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        if len(v) == size.get(m) if m is not None else len(v) in size.values():
            good[i] = (np.array(np.array(v, np.float32), np.float64), m)
    return good


def cosines(good):
    ids = sorted(good)
    out = {}
    for i in ids:
        for j in ids:
            (x, m), (y, n) = good[i], good[j]
            if i != j and len(x) == len(y) and (m == n or m is None or n is None):
                out[i, j] = round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    return ids, out


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_equal_brute_force(spark, seed):
    rows = make(seed)
    ids, cos = cosines(usable(rows))
    want = set()
    for i in ids:
        for c, j in sorted((-c, j) for (a, j), c in cos.items() if a == i)[:5]:
            if -c >= 0.8:
                want.add((min(i, j), max(i, j)))
    e, m = tables(spark, rows)
    got = [(r["id_a"], r["id_b"]) for r in neighbours.nearest_pairs(e, m).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # small lists, chunks and queries: recall of at least 0.9, and nothing that isn't a neighbour at all
    tight = neighbours.Search(list_size=8, chunk=16, queries=16)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.nearest_pairs(e, m, tight).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert all(max(cos[p], cos[p[::-1]]) >= 0.8 for p in got)
    # several upper lists
    tight = neighbours.Search(list_size=8, sub_lists=4, chunk=16, queries=16)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.nearest_pairs(e, m, tight).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_neighbours_of_nothing(spark):
    e, m = tables(spark, [])
    assert neighbours.nearest_pairs(e, m).collect() == []
    e, m = tables(spark, make(1)[-14:-4])
    assert neighbours.nearest_pairs(e, m).collect() == []


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(0)
    centres = np.stack([unit(rng, 32) for _ in range(60)])
    c = np.stack([unit(rng, 32) * 0.5 + centres[i % 60] for i in range(1500)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, 1500, 300)] + 0.1 * rng.standard_normal((300, 32)) / 6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in (1, 2, 13, 1500):
        r, at, cosine = neighbours.CentroidGraph(c[:k]).search(x, 1.15)
        assert len(set(zip(r.tolist(), at.tolist(), strict=True))) == len(r) and set(r.tolist()) == set(range(300))
        assert np.allclose(cosine, (x[r] * c[at]).sum(axis=1))
        every = x @ c[:k].T
        best = {}
        for i, j, v in zip(r, at, cosine, strict=True):
            best[i] = max(best.get(i, (-2, 0)), (v, j))
        assert np.mean([best[i][1] == every[i].argmax() for i in range(300)]) > 0.95
        far = np.sqrt(np.maximum(0, 2 - 2 * every))
        wanted = int((far <= 1.15 * np.maximum(far.min(axis=1, keepdims=True), 1e-6)).sum())
        assert len(r) >= 0.95 * wanted


@pytest.mark.parametrize("seed", [3, 4])
def test_clusters_equal_brute_force(spark, seed):
    rows = make(seed)
    good = {i: v for i, v in usable(rows).items() if v[1] is not None}
    ids, cos = cosines(good)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in cos.items():
        if c >= 0.8:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    size = {}
    for i in ids:
        size[root(i)] = size.get(root(i), 0) + 1
    want = {(i, root(i)) for i in ids if size[root(i)] >= 5}
    e, m = tables(spark, rows)
    got = [(r["id"], r["cluster_id"]) for r in clusters.cluster(e, m).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    told = clusters.describe(e, m).collect()
    assert {(r["cluster_id"], r["size"]) for r in told} == {(c, size[c]) for _, c in want}
    assert all(set(r["typical"]) <= {i for i, c in want if c == r["cluster_id"]} and 1 <= len(r["typical"]) <= 5 for r in told)


def test_clusters_of_nothing(spark):
    e, m = tables(spark, [])
    assert clusters.cluster(e, m).collect() == []
    assert clusters.describe(e, m).collect() == []


def test_crowded_cells_in_blocks(spark):
    rng = np.random.default_rng(9)
    centre = unit(rng, 16)
    rows = [(i, [float(x) for x in centre + 0.3 * unit(rng, 16)], "m", "t", "c", 1, "d") for i in range(400)]
    e, m = tables(spark, rows)
    scratch = Scratch(spark, "test")
    _, distinct = clusters._prepared(e, m, scratch)
    labels = {r["label"] for r in clusters.grid_clusters(distinct, scratch, block=32).collect()}
    assert labels == {0}


def labelled(spark, x, **kw):
    rows = [(i, [float(v) for v in r], "m", "t", "c", 1, "d") for i, r in enumerate(x)]
    e, m = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("m", x.shape[1])], "model_id string, dimension int")
    scratch = Scratch(spark, "test")
    return {r["cid"]: r["label"] for r in clusters.grid_clusters(clusters._prepared(e, m, scratch)[1], scratch, **kw).collect()}


def test_crowds_joined_by_one_link(spark):
    rng = np.random.default_rng(2)
    crowds = []
    for _ in range(3):  # two crowds, 37 degrees apart but for the rows at 0 and 36 degrees
        angle = np.radians(rng.permutation(np.concatenate([rng.uniform(-20, -1, 1500), [0, 36], rng.uniform(37, 56, 1500)])))
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        crowds.append(np.cos(angle)[:, None] * a + np.sin(angle)[:, None] * b)
    got = labelled(spark, np.concatenate(crowds))
    assert got == {k: k // 3002 * 3002 for k in range(9006)}


def test_thousands_of_pairs_that_nothing_else_joins(spark):
    rng = np.random.default_rng(5)
    x = np.stack([unit(rng, 64) for _ in range(5000)])
    other = rng.standard_normal(x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    got = labelled(spark, np.concatenate([x, 0.82 * x + np.sqrt(1 - 0.82**2) * other]))
    assert sum(got[5000 + k] == got[k] for k in range(5000)) == 5000


def test_links_at_the_limit_in_many_dimensions(spark):
    rng = np.random.default_rng(3)
    x = np.stack([unit(rng, 768) for _ in range(40)])
    other = rng.standard_normal(x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    got = labelled(spark, np.concatenate([x, 0.8001 * x + np.sqrt(1 - 0.8001**2) * other, 0.7999 * x - np.sqrt(1 - 0.7999**2) * other]))
    assert all(got[k] == got[40 + k] == k for k in range(40)) and all(got[k] == k for k in range(80, 120))


def test_subsets(spark):
    rows = make(5)
    good = usable(rows)
    requests = [(1, "m", 10), (2, "w", 5), (3, "m", 10_000), (4, "none", 3), (5, None, 3), (6, "m", 0), (7, "k", None), (1, "m", 10)]
    e, m = tables(spark, rows)
    q = spark.createDataFrame(requests, "request_id int, model_id string, subset_size int")
    got = [(r["request_id"], r["id"]) for r in subset.choose(e, m, q).collect()]
    assert len(got) == len(set(got))
    of = {k: {i for r, i in got if r == k} for k in range(1, 8)}
    pool = {i for i, (_, n) in good.items() if n == "m"}
    assert len(of[1]) == 10 and of[1] <= pool and of[3] == pool and len(of[2]) == 5
    assert not of[4] and not of[5] and not of[6] and not of[7]
    assert sorted(got) == sorted((r["request_id"], r["id"]) for r in subset.choose(e.repartition(7), m, q).collect())
    empty = tables(spark, [])[0]
    assert subset.choose(empty, m, q).collect() == [] and subset.choose(e, m, q.limit(0)).collect() == []


def test_categories_are_fitted_on_all_vectors(spark):
    # vectors whose ids a sample of 20,000 by hash would leave out point the other way
    rare = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) >= 833_333
    side = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 2000 - 0.25
    e = spark.range(30_000).withColumn("rare", rare).select("id", "rare", F.array(F.when(F.col("rare"), -1.0).otherwise(1.0), side(1), side(2), side(3)).cast("array<float>").alias("vector"), F.lit("m").alias("model_id"))
    rows = e.withColumnRenamed("id", "cid")
    sets = subset.fit(rows)["m"]
    assert [c.shape for c in sets] == [(subset.KINDS, 4)] * 2 and all(5 < (c[:, 0] < 0).sum() < 40 for c in sets)
    assert all((a == b).all() for a, b in zip(sets, subset.fit(rows.repartition(7))["m"], strict=True))
    requests = spark.createDataFrame([(1, "m", 200)], "request_id int, model_id string, subset_size int")
    got = subset.choose(e, spark.createDataFrame([("m", 4)], "model_id string, dimension int"), requests).join(e, "id")
    assert got.count() == 200 and 10 < got.where("rare").count() < 90


def test_centroids_are_those_of_a_plain_kmeans(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([unit(rng, 8) + 0.1 * rng.standard_normal((60, 8)) for _ in range(6)]).astype(np.float32).astype(float)
    data = [(i, "m", v.tolist()) for i, v in enumerate(x)] + [(1000 + i, "n", [1.0, 0.0]) for i in range(5)]
    found = subset.fit(spark.createDataFrame(data, "cid bigint, model_id string, vector array<float>"))
    assert all(np.allclose(c, [[1.0, 0.0]]) for c in found["n"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for c in found["m"]:
        assert len(c) == subset.KINDS and len({(x @ v).argmax() for v in c}) > 60
        again = (x @ c.T).argmax(axis=1)
        means = {k: x[again == k].sum(axis=0) for k in set(again)}
        # settled after these rounds, or nearly so
        assert np.mean([(c[k] @ m) / np.linalg.norm(m) for k, m in means.items()]) > 0.999


def test_first_of_takes_the_first_in_order(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "m", int(rng.integers(0, 2)), 0, int(rng.integers(0, 3)), int(rng.integers(0, 2)), int(rng.integers(-(2**63), 2**63))) for i in range(3000)]
    quotas = [(1, "m", 0, 0, 700), (1, "m", 1, 0, 5), (2, "m", 0, 0, 31), (2, "m", 1, 0, 10_000)]
    ordered = spark.createDataFrame(rows, "cid bigint, model_id string, a int, b int, typical int, copy int, h bigint")
    got = subset._first_of(ordered, spark.createDataFrame(quotas, "request_id int, model_id string, a int, b int, quota int")).collect()
    want = set()
    for request, _, a, _, quota in quotas:
        own = sorted((r for r in rows if r[2] == a), key=lambda r: (r[5], -r[4], r[6], r[0]))
        want |= {(request, r[0]) for r in own[:quota]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_flow_is_balanced():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 30, (6, 7))
    counts[2] = 0
    counts[0, 0] = 5000  # a crowd
    for size in (0, 1, 12, 60, int(counts.sum()), 10**6):
        used = subset.flow_quotas(counts, size)
        assert used.sum() == min(size, counts.sum()) and (used >= 0).all() and (used <= counts).all()
    used = subset.flow_quotas(counts, 60)
    assert used[0, 0] <= 8
    rows = used.sum(axis=1)[counts.sum(axis=1) > 0]
    assert rows.max() - rows.min() <= 2
    lots = subset.flow_quotas(np.full((3, 3), 100_000), 90_000)
    assert lots.sum() == 90_000 and lots.max() - lots.min() <= 100


def test_flow_of_lots_takes_rare_combinations():
    rng = np.random.default_rng(6)
    for shape, rare, size in (((12, 12), 1, 8192), ((10, 14), 23, 100_000)):
        counts = np.where(rng.random(shape) < 0.3, rare, rng.integers(20_000, 90_000, shape))
        counts[rng.random(shape) < 0.1] = 0
        used = subset.flow_quotas(counts, size)
        assert used.sum() == size and (used >= 0).all() and (used <= counts).all()
        assert (used[counts == rare] == rare).all()
        # no single unit is better placed elsewhere
        t = [size / np.count_nonzero(counts.sum(axis=1 - k)) for k in (0, 1)]
        each = size / np.count_nonzero(counts)
        bonus = np.log1p(counts) / np.log1p(counts.max()) / each
        more = (2 * used.sum(axis=1)[:, None] + 1) / t[0] + (2 * used.sum(axis=0) + 1) / t[1] + (2 * used + 1) / each - bonus
        less = more - 2 / t[0] - 2 / t[1] - 2 / each
        room, some = used < counts, used > 0
        for a, b in zip(*np.nonzero(some), strict=True):
            change = more - less[a, b]
            change[a] -= 2 / t[0]
            change[:, b] -= 2 / t[1]
            change[a, b] = 0
            assert change[room].min() >= -1e-6


def test_flow_is_cheapest():
    import itertools

    def cost(used, counts, size):
        t = [size / np.count_nonzero(counts.sum(axis=1 - k)) for k in (0, 1)]
        each = size / np.count_nonzero(counts)
        bonus = np.log1p(counts) / np.log1p(counts.max()) / each
        return (used.sum(axis=1) ** 2).sum() / t[0] + (used.sum(axis=0) ** 2).sum() / t[1] + (used**2).sum() / each - (used * bonus).sum()

    rng = np.random.default_rng(4)
    for _ in range(12):
        counts = rng.integers(0, 4, (2, 3))
        if counts.sum() < 3:
            continue
        size = int(rng.integers(1, counts.sum() + 1))
        best = min(cost(u, counts, size) for x in itertools.product(*(range(c + 1) for c in counts.ravel())) if (u := np.array(x).reshape(2, 3)).sum() == size)
        assert cost(subset.flow_quotas(counts, size), counts, size) == pytest.approx(best)


def test_typical_members_follow_the_definition(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [(10 - k, v(9, 2 + 0.01 * k, 0, 0), "m", "t", "c", 1, "d") for k in range(7)] + [(20 + k, v(9, -2 - 0.01 * k, 0, 0), "m", "t", "c", 1, "d") for k in range(3)]
    e, m = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("m", 4)], "model_id string, dimension int")
    (row,) = clusters.describe(e, m).collect()
    assert tuple(row) == (4, "m", 10, 7, [4, 5, 6, 7, 8])


def test_classes(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], None), (4, [1.0, 2.0], None), (4, [1.0, 2.0], None), (5, [2.0, 1.0], "a")]
    df = spark.createDataFrame([(*r, 2) for r in rows], "id bigint, vector array<float>, model_id string, dim int")
    assert sorted((r["id"], r["cid"]) for r in vectors.classes(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
