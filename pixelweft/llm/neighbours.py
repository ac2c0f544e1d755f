"""Problem 6: the most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import vectors

#: Vectors that the centroids of one fit are drawn from at most, in order of a hash of the id.
SAMPLE = 20_000
#: Upper lists of a dimension at most, which bounds what is sent to all workers. With the default sizes they are that many
#: from 8.6 thousand million vectors of a dimension on.
MOST_LISTS = 16_384
#: Angles, in degrees, that cut a list into a core, a middle and a rim.
RINGS = (28.0, 50.0)


class CentroidGraph:
    """Centroids in memory, searched by a graph of two layers: every centroid is linked to those next to it, and groups of
    near centroids have an entry point. A search starts at the groups of the nearest entry points and walks on, along the
    links of all centroids that are near enough to be wanted, until that brings no new group. Rows that visit a group are
    compared with its centroids by one matrix product. The same for any number of centroids; no table of rows by
    centroids is made."""

    def __init__(self, centroids: np.ndarray, degree: int = 12, seed: int = 7):
        self.centroids = c = centroids.astype(np.float64)
        entries = kmeans(c, max(1, round(2 * math.sqrt(len(c)))), 4, seed)
        home = (c @ entries.T).argmax(axis=1)
        used, home = np.unique(home, return_inverse=True)
        self.entries = entries[used]
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(len(used) + 1))
        self.groups = [order[starts[g] : starts[g + 1]] for g in range(len(used))]
        # of each centroid, the groups of the ones next to it
        degree = min(degree, len(c) - 1)
        self.links = np.empty((len(c), degree), np.int64)
        for at in range(0, len(c), 1024):
            near = c[at : at + 1024] @ c.T
            near[np.arange(len(near)), at + np.arange(len(near))] = -2
            self.links[at : at + 1024] = home[np.argpartition(-near, max(0, degree - 1), axis=1)[:, :degree]]

    def search(self, x: np.ndarray, ratio: float, least: float = 1e-6, entries: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, cosine) of the centroids met that are at most ``ratio`` times as far as the nearest one met; a
        distance of that under ``least`` counts as ``least``."""
        n, k = len(x), len(self.entries)
        first = np.argpartition(-(x @ self.entries.T), min(entries, k) - 1, axis=1)[:, : min(entries, k)]
        visited = np.zeros((n, k), bool)
        best = np.full(n, -2.0)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        row, group = np.repeat(np.arange(n), first.shape[1]), first.ravel()
        while len(row):
            visited[row, group] = True
            order = np.argsort(group, kind="stable")
            row, group = row[order], group[order]
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            near = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows, members = row[lo:hi], self.groups[group[lo]]
                cosine = x[rows] @ self.centroids[members].T
                best[rows] = np.maximum(best[rows], cosine.max(axis=1))
                i, j = np.nonzero(_far(cosine) <= ratio * np.maximum(_far(best[rows]), least)[:, None])
                near.append((rows[i], members[j], cosine[i, j]))
            r, c, cosine = (np.concatenate(m) for m in zip(*near, strict=True))
            good = _far(cosine) <= ratio * np.maximum(_far(best[r]), least)
            r, c, cosine = r[good], c[good], cosine[good]
            met.append((r, c, cosine))
            onward = np.zeros((n, k), bool)
            for lo in range(0, len(r), 65536):
                onward[r[lo : lo + 65536, None], self.links[c[lo : lo + 65536]]] = True
            row, group = np.nonzero(onward & ~visited)
        r, c, cosine = (np.concatenate(m) for m in zip(*met, strict=True))
        good = _far(cosine) <= ratio * np.maximum(_far(best[r]), least)
        return r[good], c[good], cosine[good]


def _far(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids; empty ones are drawn anew."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(len(c)))
        filled = np.diff(np.r_[starts, len(x)]) > 0
        sums = np.zeros_like(c)
        sums[filled] = np.add.reduceat(x[order], starts[filled], axis=0)
        sums[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


@dataclass(frozen=True)
class Search:
    """Parameters. ``floor``: cosines below it aren't looked for. Vectors are put into upper lists of about ``sub_lists``
    lists, of about ``list_size`` vectors each. ``route_ratio``: a vector goes to the upper lists whose centroid is up to
    this factor farther than the nearest. Of the lists in them, ``replica_ratio`` and ``probe_ratio`` in the same way say
    which hold the vector (two at most), and which are searched for it. Inside a crowd that fills several lists the nearest
    centroid is so close that a factor means nothing; for routes and probes a distance under ``least_far`` counts as that.
    ``bundle`` lists next to one another are searched in one place, so that a vector goes there once for all of them, at
    most ``chunk`` members and ``queries`` queries at a time."""

    k: int = 5
    floor: float = 0.80
    list_size: int = 512
    sub_lists: int = 1024
    route_ratio: float = 1.15
    replica_ratio: float = 1.05
    probe_ratio: float = 1.15
    least_far: float = 0.5
    bundle: int = 16
    chunk: int = 16384
    queries: int = 8192


def _upper(rows: DataFrame, search: Search) -> dict[int, CentroidGraph]:
    """Centroids of the upper lists of each dimension, fitted on a bounded sample; their number follows that of the vectors."""
    graphs = {}
    for dim, n in rows.groupBy("dim").agg(F.count(F.lit(1))).collect():
        k = max(1, min(MOST_LISTS, math.ceil(n / (search.list_size * search.sub_lists))))
        drawn = rows.where(F.col("dim") == dim).where(_drawn(F.lit(min(1.0, 1.25 * SAMPLE / n)))).select("cid", "vector").limit(2 * SAMPLE).toArrow()
        if not len(drawn):
            drawn = rows.where(F.col("dim") == dim).select("cid", "vector").limit(SAMPLE).toArrow()
        graphs[dim] = CentroidGraph(kmeans(vectors.matrix(drawn.sort_by("cid")["vector"])[:SAMPLE], k, 6, dim))
    return graphs


def _drawn(share: Column) -> Column:
    """Whether a row belongs to a sample of a share, by a hash of its id."""
    return F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < share * 1_000_000


def _routed(rows: DataFrame, shared: object, search: Search) -> DataFrame:
    """(dim, list, home, cid): the upper lists a vector goes to; ``home`` is the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims):
                graph = shared.value[int(dim)]
                for own in table.filter(pa.array(dims == dim)).to_batches(max_chunksize=max(256, min(4096, 2_000_000 // len(graph.centroids)))):
                    yield route(int(dim), graph, own)

    def route(dim: int, graph: CentroidGraph, own: pa.RecordBatch) -> pa.RecordBatch:
        x, cid = vectors.matrix(own.column("vector")), own.column("cid").to_numpy()
        r, c, cosine = graph.search(x, search.route_ratio, search.least_far)
        best = np.full(len(x), -2.0)
        np.maximum.at(best, r, cosine)
        return pa.record_batch([pa.array(np.full(len(r), dim, np.int32)), pa.array(c.astype(np.int32)), pa.array(cosine >= best[r]), pa.array(cid[r])], names=["dim", "list", "home", "cid"])

    return rows.select("cid", "dim", "vector").mapInArrow(run, "dim int, list int, home boolean, cid bigint")


def _sub_fit(search: Search):  # noqa: ANN202
    """Centroids of the lists inside one upper list, from a bounded sample of it."""

    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("cid")
        dim, upper, k = (sample[c][0].as_py() for c in ("dim", "list", "k"))
        c = kmeans(vectors.matrix(sample["vector"])[:SAMPLE], k, 6, upper)
        # near ones get near numbers: a bundle is a range of them
        c = c[np.argsort((c @ kmeans(c, max(1, round(len(c) / search.bundle)), 4, upper).T).argmax(axis=1), kind="stable")]
        n = len(c)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c.shape[1], pa.int32()), pa.array(c.astype(np.float32).ravel()))
        return pa.table({"dim": pa.array(np.full(n, dim, np.int32)), "list": pa.array(np.full(n, upper, np.int32)), "sub": pa.array(np.arange(n, dtype=np.int32)), "centroid": flat})

    return run


def _sub_search(search: Search):  # noqa: ANN202
    """Of the vectors of one upper list (or a part of them), the lists that the graph finds near."""
    schema = pa.schema([("dim", pa.int32()), ("list", pa.int32()), ("sub", pa.int32()), ("cid", pa.int64()), ("cosine", pa.float64())])

    def run(rows: pa.Table, centroids: pa.Table) -> pa.Table:
        if not rows.num_rows or not centroids.num_rows:
            return schema.empty_table()
        graph = CentroidGraph(vectors.matrix(centroids.sort_by("sub")["centroid"]))
        found = []
        for part in rows.to_batches(max_chunksize=max(256, min(4096, 2_000_000 // len(graph.centroids)))):
            r, c, cosine = graph.search(vectors.matrix(part.column("vector")), search.probe_ratio, search.least_far)
            found.append((c.astype(np.int32), part.column("cid").to_numpy()[r], cosine))
        sub, cid, cosine = (np.concatenate(f) for f in zip(*found, strict=True))
        n = len(sub)
        return pa.table([np.full(n, rows["dim"][0].as_py(), np.int32), np.full(n, rows["list"][0].as_py(), np.int32), sub, cid, cosine], schema=schema)

    return run


def _placed(rows: DataFrame, scratch: Scratch, search: Search) -> DataFrame:
    """Of each (cid, dim, model_id, vector): where it is stored, and what is searched for it, as (side, dim, list, sub, ring,
    cid): with ``side`` 0 the ring it lies in, with 1 the rings to be searched, as bits. A ring is searched only if the floor
    can be reached in it: angles are a metric, so members of a ring are no nearer than the difference of the angles to the
    centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(_upper(rows, search))
    routed = scratch.table(_routed(rows, shared, search), "routed")
    upper = ["dim", "list"]
    sizes = routed.groupBy(*upper).agg(F.count_if("home").alias("members"), F.count(F.lit(1)).alias("all")).where("members > 0")
    sizes = scratch.table(sizes.select(*upper, "members", F.ceil(F.col("members") / search.list_size).cast("int").alias("k"), F.ceil(F.col("all") / 16384).cast("int").alias("parts")), "sizes")
    data = rows.select("cid", "vector")
    # the share drawn leaves a sample of about SAMPLE, and the whole list where that is smaller
    sample = routed.where("home").join(sizes, upper).where(_drawn(F.lit(1.25 * SAMPLE) / F.col("members"))).join(data, "cid")
    centroids = scratch.table(sample.select(*upper, "k", "cid", "vector").groupBy(*upper).applyInArrow(_sub_fit(search), "dim int, list int, sub int, centroid array<float>"), "centroids")
    left = routed.join(sizes, upper).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).join(data, "cid").select(*upper, "part", "cid", "vector")
    right = centroids.join(sizes, upper).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*upper, "part", "sub", "centroid")
    right = right.toDF(*(f"_{c}" for c in right.columns)).toDF(*right.columns)
    keys = [*upper, "part"]
    met = scratch.table(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_sub_search(search), "dim int, list int, sub int, cid bigint, cosine double"), "met")
    # of all upper lists together: the nearest list, and those that are not much farther
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine")))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))))
    by = Window.partitionBy("cid").orderBy(F.desc("cosine"), "list", "sub")
    ranked = met.select(*upper, "sub", "cid", far.alias("far"), angle.alias("angle"), F.row_number().over(by).alias("rank"), F.first(far).over(by).alias("least"))
    near = F.greatest("least", F.lit(1e-6))
    edges = [0.0, *RINGS, 180.0]
    reach = math.degrees(math.acos(search.floor))
    ring = sum(((F.col("angle") >= e).cast("int") for e in RINGS), F.lit(0))
    held = (F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("far") <= search.replica_ratio * near))
    reached = sum((F.when((F.col("angle") - reach <= edges[i + 1]) & (F.col("angle") + reach >= edges[i]), 1 << i).otherwise(0) for i in range(len(RINGS) + 1)), F.lit(0))
    asked = F.when(F.col("far") <= search.probe_ratio * F.greatest("least", F.lit(search.least_far)), reached).otherwise(0)
    sides = F.filter(F.array(F.when(held, F.struct(F.lit(0).alias("side"), ring.alias("ring"))), F.when(asked > 0, F.struct(F.lit(1).alias("side"), asked.alias("ring")))), lambda x: x.isNotNull())
    return ranked.select(*upper, "sub", "cid", F.explode(sides).alias("x")).select(F.col("x.side").cast("tinyint").alias("side"), *upper, "sub", F.col("x.ring").cast("tinyint").alias("ring"), "cid")


def _search_list(search: Search):  # noqa: ANN202
    limit = round(search.floor * 1e6)
    schema = pa.schema([("cid", pa.int64()), ("other", pa.int64()), ("micro", pa.int32())])

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, asked = members["cid"].to_numpy(), queries["cid"].to_numpy()
        x, y = vectors.matrix(members["vector"]), vectors.matrix(queries["vector"])
        names = {None: 0}
        code = lambda t: np.array([names.setdefault(m, len(names)) for m in t["model_id"].to_pylist()])
        mx, my = code(members), code(queries)
        several = len(names) > 2 or (mx != mx[0]).any() or (my != mx[0]).any()
        # single precision finds candidates, with room for its rounding; DOUBLE decides
        slack = np.float32(max(1e-4, 1.2e-7 * x.shape[1]))
        rough, rough_y = x.astype(np.float32), y.astype(np.float32)
        # members by list and ring, questions by list
        place = members["sub"].to_numpy().astype(np.int64) * 4 + members["ring"].to_numpy()
        sorted_members = np.argsort(place, kind="stable")
        probes = queries["probes"].combine_chunks()
        sizes = pc.list_value_length(probes).to_numpy()
        probe = probes.flatten().to_numpy()
        sorted_probes = np.argsort(probe >> 3, kind="stable")
        who, wanted, at_list = np.repeat(np.arange(len(y)), sizes)[sorted_probes], probe[sorted_probes] & 7, probe[sorted_probes] >> 3
        found = []
        for cell in np.unique(place):
            inside = sorted_members[slice(*np.searchsorted(place[sorted_members], [cell, cell + 1]))]
            mine = slice(*np.searchsorted(at_list, [cell >> 2, (cell >> 2) + 1]))
            asking = who[mine][(wanted[mine] >> (cell & 3) & 1).astype(bool)]
            for at in range(0, len(asking), 512):
                rows = asking[at : at + 512]
                near = rough_y[rows] @ rough[inside].T
                near[asked[rows, None] == ids[inside][None]] = -2
                if several:
                    mq, mi = my[rows][:, None], mx[inside][None]
                    near[~((mi == mq) | (mi == 0) | (mq == 0))] = -2
                least = np.full(len(near), np.float32(search.floor) - slack)
                full = np.flatnonzero((near >= least[:, None]).sum(axis=1) > search.k)
                if len(full):  # nothing below the k-th best of a ring counts
                    least[full] = np.maximum(least[full], -np.partition(-near[full], search.k - 1, axis=1)[:, search.k - 1] - 2 * slack)
                i, j = np.nonzero(near >= least[:, None])
                for lo in range(0, len(i), 16384):
                    a, b = rows[i[lo : lo + 16384]], inside[j[lo : lo + 16384]]
                    micro = np.rint(np.einsum("ij,ij->i", y[a], x[b]) * 1e6).astype(np.int32)
                    ok = micro >= limit
                    found.append((asked[a[ok]], ids[b[ok]], micro[ok]))
        if not found:
            return schema.empty_table()
        q, other, micro = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((other, -micro, q))
        q, other, micro = q[order], other[order], micro[order]
        # a boundary vector may be met in both of its lists
        new = np.r_[True, (q[1:] != q[:-1]) | (other[1:] != other[:-1])]
        q, other, micro = q[new], other[new], micro[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return pa.table([c[rank < search.k] for c in (q, other, micro)], schema=schema)

    return run


def nearest(rows: DataFrame, search: Search | None = None) -> DataFrame:
    """(cid, other, micro): of each of the distinct vectors ``rows`` (cid, model_id, dim, vector) up to k most similar
    comparable others with a cosine of at least the floor; micro is the cosine in millionths, rounded. Comparable are
    vectors of equal length whose model_ids are equal or one is missing. Ties go to the smaller cid.

    Lists come in two levels: upper lists, whose centroids all workers hold, and in each of them lists whose centroids are
    fitted and searched where the upper list is, so the number of lists follows that of the vectors. Every vector is
    stored in the list of its nearest centroid, on a boundary also in the next, and cut by its angle to the centroid into
    rings. Lists whose centroid is at most ``probe_ratio`` farther than the nearest are searched, all of them. Lists and
    their queries are cut into chunks of fixed size by hashes, so that no task grows with a crowded region.
    """
    search = search or Search()
    scratch = Scratch(rows.sparkSession, "nearest")
    placed = scratch.table(_placed(rows, scratch, search).withColumn("bundle", F.floor(F.col("sub") / search.bundle).cast("int")), "placed")
    place = ["dim", "list", "bundle"]
    probes = F.collect_list((F.col("sub") * 8 + F.col("ring")).cast("int")).alias("probes")
    asking = scratch.table(placed.where("side = 1").groupBy(*place, "cid").agg(probes), "asking")
    stored = placed.where("side = 0")
    count = lambda df, name: df.groupBy(*place).agg(F.count(F.lit(1)).alias(name))
    most = F.greatest(F.lit(512), F.least(F.lit(search.chunk), F.floor(F.lit(8_388_608) / F.col("dim")))) if search.chunk > 512 else F.lit(search.chunk)
    sizes = count(stored, "members").join(count(asking, "asked"), place)
    cuts = scratch.table(sizes.select(*place, F.ceil(F.col("members") / most).cast("int").alias("mc"), F.ceil(F.col("asked") / search.queries).cast("int").alias("qc")), "cuts")
    data = rows.select("cid", "model_id", "vector")
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = [*place, "m", "q"]
    members = stored.join(cuts, place).withColumn("m", part("mc")).withColumn("q", every("qc")).join(data, "cid").select(*keys, "sub", "ring", "cid", "model_id", "vector")
    asked = asking.join(cuts, place).withColumn("q", part("qc")).withColumn("m", every("mc")).join(data, "cid").select(*keys, "probes", "cid", "model_id", "vector")
    # both sides come from one table: new names for the columns of one of them keep the cogroup unambiguous
    asked = asked.toDF(*(f"_{c}" for c in asked.columns)).toDF(*asked.columns)
    met = members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_list(search), "cid bigint, other bigint, micro int")
    best = Window.partitionBy("cid").orderBy(F.desc("micro"), "other")
    return met.distinct().withColumn("k", F.row_number().over(best)).where(F.col("k") <= search.k).select("cid", "other", "micro")


def nearest_pairs(embeddings: DataFrame, models: DataFrame, search: Search | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of usable vectors of which one is among the k most similar of the other, with a cosine of at
    least the floor. Equal vectors of a model are searched once; each of them then takes its k from the k smallest ids of
    its own class and of the classes found.

    Null, empty, cut-short, non-finite and all-zero vectors aren't usable, see ``vectors.usable``. A repeated id counts
    once. Empty tables give no rows.
    """
    search = search or Search()
    scratch = Scratch(embeddings.sparkSession, "nearest")
    rows = scratch.table(vectors.usable(embeddings, models), "rows")
    members = scratch.table(vectors.classes(rows), "members")
    distinct_rows = scratch.table(rows.join(members.where("id = cid").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "cid"), "distinct")
    found = nearest(distinct_rows, search)
    own = members.select("cid", F.col("cid").alias("other"), F.lit(1_000_000).alias("micro")).distinct()
    ranked = members.withColumn("_n", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("_n") <= search.k + 1)
    first = ranked.groupBy("cid").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumnRenamed("cid", "other")
    offered = found.unionByName(own).join(first, "other").select("cid", F.explode("ids").alias("id_b"), "micro")
    lists = offered.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("micro")).alias("less"), "id_b"))).alias("offers"))
    mine = members.join(lists, "cid").select("id", F.explode(F.slice(F.filter("offers", lambda x: x["id_b"] != F.col("id")), 1, search.k)).alias("x"))
    return mine.select(F.least("id", "x.id_b").alias("id_a"), F.greatest("id", "x.id_b").alias("id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return nearest_pairs(read("embeddings_in"), read("embedding_models"))


P6_FOUND_SQL = """
WITH e AS (SELECT DISTINCT id, model_id, len(vector) AS dim, vector::DOUBLE[] AS v FROM embeddings_in
           WHERE id IS NOT NULL AND len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT * FROM e WHERE (model_id IS NULL AND dim IN (SELECT dimension FROM embedding_models))
      OR EXISTS (SELECT 1 FROM embedding_models m WHERE m.model_id = e.model_id AND m.dimension = e.dim)),
p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b
      ON a.id <> b.id AND a.dim = b.dim AND (a.model_id = b.model_id OR a.model_id IS NULL OR b.model_id IS NULL)),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 5 AND c >= 0.8
"""
