"""Problem 7: similarity clusters, by density of grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import vectors

#: Rotations of one grid; a cell is the nearest signed axis in each of them.
AXES = 3
#: Grids that are laid over the vectors.
GRIDS = 8
#: Vectors at home in a cell that make it dense.
DENSE = 2


def cells(rows: DataFrame, grids: int) -> DataFrame:
    """(grid, dim, model_id, cell, cid, home, depth): cells of ``grids`` grids of each row (cid, model_id, dim, vector).

    A grid turns the unit vectors by ``AXES`` random rotations and quantises each to its nearest signed axis. The adjacent
    cells of a row, across its nearest border in one of the rotations, are given with ``home`` false. ``depth`` says how far
    inside its cell a vector lies, in millionths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims):
                dim = int(dim)
                if dim not in turns:
                    turns[dim] = [[vectors.rotation(dim, 1000 * g + a) for a in range(AXES)] for g in range(grids)]
                own = table.filter(pa.array(dims == dim))
                x = vectors.matrix(own["vector"])
                n = len(x)
                model, cid = own["model_id"].combine_chunks(), own["cid"].combine_chunks()
                for g, rotations in enumerate(turns[dim]):
                    turned = [x @ r for r in rotations]
                    codes = [vectors.axis_codes(t) for t in turned]
                    depth = np.rint(sum(np.abs(t).max(axis=1) for t in turned) * 1e6).astype(np.int32)
                    for change in range(-1, AXES):
                        cell = np.zeros(n, np.int64)
                        for a, (best, second) in enumerate(codes):
                            cell = cell * (2 * dim + 1) + (second if a == change else best)
                        yield pa.record_batch(
                            [pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, dim, np.int32)), model, pa.array(cell), cid, pa.array(np.full(n, change < 0)), pa.array(depth)],
                            names=["grid", "dim", "model_id", "cell", "cid", "home", "depth"],
                        )

    return rows.select("cid", "model_id", "dim", "vector").mapInArrow(run, "grid int, dim int, model_id string, cell bigint, cid bigint, home boolean, depth int")


def dense_links(rows: DataFrame, scratch: Scratch, similarity: float, grids: int) -> DataFrame:
    """(u, v) links through dense cells. Cells are counted, and each dense one (``DENSE`` vectors at home in it) is led by
    the vector that lies deepest inside. A vector is linked to the leaders of its own cell and of the dense cells next to
    it that are as similar as asked for; so a vector near a border joins adjacent dense cells. Per vector and grid there
    are at most ``AXES`` + 1 leaders, so a crowded cell costs no more than its rows, and the count of a cell is combined
    before the shuffle."""
    # a cell goes by a hash; should two cells share one, the model is compared again below, and all links are verified
    place = F.xxhash64("grid", "dim", "model_id", "cell").alias("place")
    quantised = scratch.table(cells(rows, grids).select(place, "cid", "home", "depth"), "cells")
    # one number orders by depth, then by a hash of the id: aggregates of numbers don't sort
    order = F.shiftleft(F.col("depth").cast("bigint"), 40) + F.shiftrightunsigned(F.xxhash64("cid"), 24)
    counted = quantised.groupBy("place").agg(F.count_if("home").alias("n"), F.max_by("cid", F.when(F.col("home"), order)).alias("leader"))
    near = quantised.select("place", "cid").join(counted.where(F.col("n") >= DENSE).select("place", "leader"), "place").where("cid <> leader").select("cid", "leader").distinct()
    end = lambda cid, vector, model: rows.select(F.col("cid").alias(cid), F.col("vector").alias(vector), F.col("model_id").alias(model))
    paired = near.join(end("cid", "x", "mx"), "cid").join(end("leader", "y", "my"), "leader").where("mx = my and size(x) = size(y)")
    limit = round(similarity * 1e6)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = pa.Table.from_batches([batch]).filter(pa.array(sizes == dim))
                ok = np.rint(np.einsum("ij,ij->i", vectors.matrix(own["x"]), vectors.matrix(own["y"])) * 1e6) >= limit
                u, v = own["cid"].to_numpy()[ok], own["leader"].to_numpy()[ok]
                yield pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    links = scratch.table(paired.select("cid", "leader", "x", "y").mapInArrow(verify, "u bigint, v bigint").distinct(), "links")
    scratch.drop(quantised)
    return links


def _across(limit: int):  # noqa: ANN202
    """Of the rows of two blocks, the pairs of unlike labels that a similar pair of rows joins."""

    def within(own: pa.Table) -> pa.Table:
        x, label, name = vectors.matrix(own["vector"]), own["label"].to_numpy(), np.array(own["name"].to_pylist())
        first, second = (np.flatnonzero(name == own[c][0].as_py()) for c in ("p", "q"))
        rough = x.astype(np.float32)
        # single precision finds candidates, with room for its rounding; DOUBLE decides
        least = np.float32((limit - 0.5) / 1e6 - max(1e-4, 1.2e-7 * x.shape[1]))
        found = [np.empty((0, 2), np.int64)]
        for at in range(0, len(first), 512):
            rows = first[at : at + 512]
            i, j = np.nonzero(rough[rows] @ rough[second].T >= least)
            i, j = rows[i], second[j]
            unlike = label[i] != label[j]
            i, j = i[unlike], j[unlike]
            for lo in range(0, len(i), 16384):
                a, b = i[lo : lo + 16384], j[lo : lo + 16384]
                ok = np.rint(np.einsum("ij,ij->i", x[a], x[b]) * 1e6) >= limit
                ends = np.stack([label[a[ok]], label[b[ok]]], axis=1)
                found.append(np.unique(np.sort(ends, axis=1), axis=0))
        ends = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": ends[:, 1], "v": ends[:, 0]})

    return within


def unlike_links(rows: DataFrame, labels: DataFrame, scratch: Scratch, similarity: float, block: int = 8192) -> DataFrame:
    """(u, v) of all labels (cid, label) that two similar rows (cid, model_id, dim, vector) join, exactly: the rows of a
    model are cut into blocks, of at most ``block`` rows and about 32 MB on average, and each pair of blocks is one unit of
    work. A label with enough rows has blocks of its own, so that pairs of blocks of one label are left out."""
    space = ["model_id", "dim"]
    most = F.greatest(F.lit(256), F.least(F.lit(block), F.floor(F.lit(8_388_608) / F.col("dim")))) if block > 256 else F.lit(block)
    known = rows.select("cid", *space).join(labels, "cid")
    sizes = known.groupBy(*space, "label").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.when(F.col("n") >= most, F.col("label").cast("string")).otherwise("-"))
    sizes = scratch.table(sizes, "sizes")
    blocks = sizes.groupBy(*space, "own").agg(F.ceil(F.sum("n") / F.first(most)).cast("int").alias("blocks"))
    own = known.join(sizes.drop("n"), [*space, "label"]).join(blocks, [*space, "own"])
    placed = scratch.table(own.select("cid", *space, "label", F.concat("own", F.lit("/"), F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("string")).alias("name")), "placed")
    names = scratch.table(placed.groupBy(*space, "name").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "names")
    end = lambda s: names.select(*space, F.col("name").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    units = end("p").join(end("q"), space).where("p <= q and least(lo_p, lo_q) < greatest(hi_p, hi_q)").select(*space, "p", "q")
    units = scratch.table(units, "units")
    of = units.select(*space, F.explode(F.array_distinct(F.array("p", "q"))).alias("name"), "p", "q")
    spread = placed.join(rows.select("cid", "vector"), "cid").join(of, [*space, "name"])
    met = spread.select(*space, "p", "q", "name", "label", "vector").groupBy(*space, "p", "q").applyInArrow(_across(round(similarity * 1e6)), "u bigint, v bigint")
    return scratch.table(met.distinct(), "links")


def propagate(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of each node of edges (u, v): the smallest node it is linked to, directly or through others. Labels
    are the smallest of the neighbours' and then of the label's own label, again and again, until none changes."""
    both = scratch.table(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        offered = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("least")).withColumnRenamed("u", "node")
        stepped = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels, changed = _replaced(scratch, labels, stepped.join(above, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        if not changed:
            return labels.select("node", "label")


def _replaced(scratch: Scratch, before: DataFrame, after: DataFrame) -> tuple[DataFrame, int]:
    moved, changed = scratch.counted(after, F.col("label") != F.col("old"), "labels")
    scratch.drop(before)
    return moved, changed


def grid_clusters(rows: DataFrame, scratch: Scratch, similarity: float = 0.80, grids: int = GRIDS, block: int = 8192) -> DataFrame:
    """(cid, label) of distinct vectors (cid, model_id, dim, vector): vectors of one model with a cosine of at least
    ``similarity`` share a label, directly or through others.

    Dense cells of several grids and those adjacent to them are joined by verified links (``dense_links``), and the least
    label is propagated to convergence. That leaves few labels in dense regions; links that no cell shows are found by
    an exact check of all pairs of rows whose labels differ (``unlike_links``), and propagated in turn.
    """

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        renamed = propagate(links, scratch).select(F.col("node").alias("label"), F.col("label").alias("least"))
        after = scratch.table(labels.join(renamed, "label", "left").select("cid", F.coalesce("least", "label").alias("label")), "label")
        scratch.drop(labels)
        return after

    labels = joined(scratch.table(rows.select("cid", F.col("cid").alias("label")), "label"), dense_links(rows, scratch, similarity, grids))
    links = unlike_links(rows, labels, scratch, similarity, block)
    return labels if links.isEmpty() else joined(labels, links)


def _prepared(embeddings: DataFrame, models: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    usable = scratch.table(vectors.usable(embeddings, models).where("model_id is not null"), "rows")
    members = scratch.table(vectors.classes(usable), "members")
    rows = scratch.table(usable.join(members.where("id = cid").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "cid"), "distinct")
    return members, rows


def _clustered(members: DataFrame, labels: DataFrame, smallest: int) -> DataFrame:
    """(id, cid, label, size) of every member of a cluster of at least ``smallest`` vectors."""
    rows = members.join(labels, "cid")
    sizes = rows.groupBy("label").agg(F.count_distinct("id").alias("size")).where(F.col("size") >= smallest)
    return rows.join(sizes, "label")


def cluster(embeddings: DataFrame, models: DataFrame, similarity: float = 0.80, smallest: int = 5) -> DataFrame:
    """(id, cluster_id) of every usable vector with a model_id in a cluster of ``smallest`` or more; cluster_id is the
    smallest id of the cluster. Equal vectors of a model are one point, but each counts for the size.

    Null, empty, cut-short, non-finite and all-zero vectors aren't usable, see ``vectors.usable``. A repeated id counts
    once. Empty tables give no rows; extra columns are ignored.
    """
    scratch = Scratch(embeddings.sparkSession, "clusters")
    members, rows = _prepared(embeddings, models, scratch)
    return _clustered(members, grid_clusters(rows, scratch, similarity), smallest).select("id", F.col("label").alias("cluster_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return cluster(read("embeddings_in"), read("embedding_models"))


def axis_cell(vector: Column) -> Column:
    """Cell of a vector in the grid of its own axes: its nearest signed axis and the next nearest, as one number."""
    size = F.transform(vector, lambda x: F.abs(x.cast("double")))
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    first = best(size)
    second = best(F.transform(size, lambda x, i: F.when(i == first - 1, F.lit(-1.0)).otherwise(x)))
    code = lambda at: (at - 1) * 2 + (F.element_at(vector, at) < 0).cast("int")
    return (code(first).cast("bigint") * (2 * F.size(vector) + 1) + code(second)).cast("bigint")


def describe(embeddings: DataFrame, models: DataFrame, similarity: float = 0.80, smallest: int = 5, typical: int = 5) -> DataFrame:
    """(cluster_id, model_id, size, cell_members, typical): of each cluster its size, and of its densest cell
    (``axis_cell``) the number of its members and the ``typical`` smallest ids among them. Of equally dense cells the
    smallest counts. Null, unusable and repeated rows: see ``cluster``."""
    scratch = Scratch(embeddings.sparkSession, "clusters")
    members, rows = _prepared(embeddings, models, scratch)
    found = scratch.table(_clustered(members, grid_clusters(rows, scratch, similarity), smallest), "found")
    placed = scratch.table(found.join(rows.select("cid", "model_id", axis_cell(F.col("vector")).alias("cell")), "cid").select("label", "model_id", "size", "cell", "id").distinct(), "placed")
    counts = placed.groupBy("label", "model_id", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    densest = counts.groupBy("label", "model_id", "size").agg(F.max(F.struct("n", (-F.col("cell")).alias("c"))).alias("d"))
    best = densest.select("label", "model_id", "size", F.col("d.n").alias("cell_members"), (-F.col("d.c")).alias("cell"))
    inside = placed.select("label", "cell", "id").join(best.select("label", "cell"), ["label", "cell"], "left_semi")
    first = inside.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("k") <= typical)
    names = first.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("typical"))
    return best.join(names, "label").select(F.col("label").alias("cluster_id"), "model_id", "size", "cell_members", "typical")


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return describe(read("embeddings_in"), read("embedding_models"))


P7_FOUND_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT id, model_id, len(vector) AS dim, vector::DOUBLE[] AS v FROM embeddings_in
           WHERE id IS NOT NULL AND len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT e.* FROM e JOIN embedding_models m ON m.model_id = e.model_id AND m.dimension = e.dim),
n AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND a.model_id = b.model_id
      AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.8),
reach AS (SELECT a AS id, a AS other FROM n UNION SELECT r.id, n.b FROM reach r JOIN n ON n.a = r.other),
g AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)
SELECT id, cluster_id FROM g WHERE cluster_id IN (SELECT cluster_id FROM g GROUP BY cluster_id HAVING count(*) >= 5)
"""

_SIZES = "list_transform(v, lambda x: abs(x))"
_FIRST = f"list_position({_SIZES}, list_max({_SIZES}))"
P7_CLUSTERS_SQL = (
    P7_FOUND_SQL.replace("\nSELECT id, cluster_id FROM g", ",\nfound AS (SELECT id, cluster_id FROM g", 1).rstrip()
    + f"""),
a AS (SELECT f.id, f.cluster_id, u.model_id, u.dim, u.v, {_FIRST.replace("(v,", "(u.v,")} AS i FROM found f JOIN u USING (id)),
b AS (SELECT *, list_transform(range(1, dim + 1), lambda k: CASE WHEN k = i THEN -1.0 ELSE abs(v[k]) END) AS w FROM a),
c AS (SELECT *, list_position(w, list_max(w)) AS j FROM b),
d AS (SELECT id, cluster_id, model_id, ((i - 1) * 2 + (v[i] < 0)::INTEGER)::BIGINT * (2 * dim + 1) + (j - 1) * 2 + (v[j] < 0)::INTEGER AS cell FROM c),
cells AS (SELECT cluster_id, model_id, cell, count(*) AS members, list_sort(list(id))[1:5] AS typical FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY members DESC, cell) AS k, sum(members) OVER (PARTITION BY cluster_id) AS size FROM cells)
SELECT cluster_id, model_id, size::BIGINT AS size, members AS cell_members, typical FROM r WHERE k = 1
"""
)
