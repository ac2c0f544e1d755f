import random

from pixelweft.llm import components


def groups(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def run(spark, edges):
    out = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert len(out) == len({r["id"] for r in out})
    return {r["id"]: r["group_id"] for r in out}


def test_random_graphs(spark):
    for seed, n in ((1, 60), (2, 400)):
        rnd = random.Random(seed)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n * 2 // 3)]
        assert run(spark, edges) == groups(edges)


def test_chain_star_and_dirt(spark):
    names = list(range(500))
    random.Random(3).shuffle(names)
    chain = [(names[i], names[i + 1]) for i in range(120)]
    star = [(-5, 1000 + i) for i in range(200)]
    dirt = [(7, 7), (None, 3), (4, None), (1000, -5), (1000, -5), (2**62, -(2**62))]
    assert run(spark, chain + star + dirt) == groups(chain + star + dirt)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (None, None)]) == {}


def test_links(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 2, 0.95, False, 5), (2, 1, 0.95, False, 5), (3, 4, 0.9, None, 10), (5, 6, 0.95, False, 11), (7, 8, nan, False, 0), (9, 10, inf, False, 0), (11, 12, 1.5, False, 0),
        (13, 14, None, True, None), (15, 15, 1.0, True, 0), (None, 16, 1.0, True, 0), (17, 18, 0.95, False, None), (19, 20, None, None, None), (21, 22, nan, True, 99), (23, 24, 0.8999, False, 0),
    ]
    df = spark.createDataFrame(rows, "left_id bigint, right_id bigint, score float, exact_match boolean, perceptual_distance int")
    assert {(r["u"], r["v"]) for r in components.links(df).collect()} == {(1, 2), (3, 4), (13, 14), (21, 22)}
