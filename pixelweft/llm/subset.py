"""Problem 2: a varied subset of given size, by minimum-cost flow quotas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import vectors

#: Requests of one job; each costs the driver one flow.
MOST_REQUESTS = 1000
#: Categories of either kind.
KINDS = 96
#: Rounds in which the centroids move, at most.
ROUNDS = 8
#: Steps from 0 to 1 in which coordinates of unit vectors are summed: whole numbers give the same sums in any order of rows.
STEPS = 1 << 24
#: Models that are fitted in one pass, which bounds what a task and the driver hold of them.
TOGETHER = 16


def fit(rows: DataFrame, seed: int = 11) -> dict[str, list[np.ndarray]]:
    """For each model two independent sets of at most ``KINDS`` centroids, by k-means over all rows (cid, model_id, vector).

    A set starts from the distinct vectors whose ids have the least hashes. In each round every vector goes to its nearest
    centroid, and the centroid to the sum of its vectors; one without vectors goes to a vector that lies farthest from its
    own. The driver sees the sums only."""
    models = sorted(r["model_id"] for r in rows.select("model_id").distinct().collect())
    centroids = {}
    for at in range(0, len(models), TOGETHER):
        centroids |= _fitted(rows.where(F.col("model_id").isin(models[at : at + TOGETHER])), seed)
    return centroids


def _fitted(rows: DataFrame, seed: int) -> dict[str, list[np.ndarray]]:
    spark = rows.sparkSession
    distinct = rows.groupBy("model_id", F.xxhash64("vector").alias("v")).agg(F.min("cid").alias("cid"))
    order = Window.partitionBy("model_id", "kind").orderBy(F.xxhash64(F.col("kind") + seed, "cid"), "cid")
    drawn = distinct.select("model_id", "cid", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= KINDS)
    starts = _units(rows, drawn.select("model_id", (F.col("kind") * KINDS + F.col("k") - 1).alias("slot"), "cid"))
    centroids = {m: [np.array([of[s] for s in sorted(of) if s // KINDS == kind]) for kind in (0, 1)] for m, of in starts.items()}
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(centroids)
        found = _sums(rows, sent).toArrow()
        sent.destroy()
        moved = {m: [c.copy() for c in sets] for m, sets in centroids.items()}
        empty = {(m, kind): set(range(len(c))) for m, sets in moved.items() for kind, c in enumerate(sets)}
        far: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for (m, slot), total, last in _rows_of(found):
            kind, home = divmod(slot, KINDS)
            if norm := np.linalg.norm(total):
                moved[m][kind][home] = total / norm
            empty[m, kind].discard(home)
            far.setdefault((m, kind), []).append(last)
        refill = [(m, kind * KINDS + home, cid) for (m, kind), homes in empty.items() for home, (_, cid) in zip(sorted(homes), sorted(far[m, kind]), strict=False)]
        if refill:
            for m, of in _units(rows, spark.createDataFrame(refill, "model_id string, slot int, cid bigint")).items():
                for slot, x in of.items():
                    moved[m][slot // KINDS][slot % KINDS] = x
        same = all(np.array_equal(a, b) for m in moved for a, b in zip(moved[m], centroids[m], strict=True))
        centroids = moved
        if same:
            break
    return centroids


def _units(rows: DataFrame, picked: DataFrame) -> dict[str, dict[int, np.ndarray]]:
    """By model and slot, the unit vectors of ``picked`` (model_id, slot, cid): at most two sets of each model."""
    table = rows.select("model_id", "cid", "vector").join(F.broadcast(picked), ["model_id", "cid"]).select("model_id", "slot", "vector").toArrow()
    models = np.array(table["model_id"].to_pylist())
    found = {}
    for model in sorted(set(models.tolist())):
        own = table.filter(pa.array(models == model))
        found[model] = dict(zip(own["slot"].to_pylist(), vectors.matrix(own["vector"]), strict=True))
    return found


def _rows_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray, tuple[int, int]]]:
    model, slot, least, cid = (table[c].to_pylist() for c in ("model_id", "slot", "least", "cid"))
    for i, total in enumerate(table["total"]):
        yield (model[i], slot[i]), total.values.to_numpy(), (least[i], cid[i])


_SUMS = "model_id string, slot int, total array<bigint>, least bigint, cid bigint"


def _sums(rows: DataFrame, centroids: object) -> DataFrame:
    """(model_id, slot, total, least, cid) of each centroid with vectors: their sum in ``STEPS``, and the least cosine with
    the id that has it. A slot is the number of the set times ``KINDS`` and that of the centroid."""

    def batch_of(held: dict) -> pa.RecordBatch:
        cols = zip(*((m, slot, total, *last) for (m, slot), (total, last) in held.items()), strict=True)
        types = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["model_id", "slot", "total", "least", "cid"])

    def add(held: dict, key: tuple[str, int], total: np.ndarray, last: tuple[int, int]) -> None:
        if key in held:
            before, least = held[key]
            total, last = before + total, min(least, last)
        held[key] = (total, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            models = np.array(table["model_id"].to_pylist())
            for model in np.unique(models):
                own = table.filter(pa.array(models == model))
                x = vectors.matrix(own["vector"])
                whole = np.rint(x * STEPS).astype(np.int64)
                cid = own["cid"].to_numpy()
                for kind, c in enumerate(centroids.value[str(model)]):
                    cosine = x @ c.T
                    home = cosine.argmax(axis=1)
                    least = np.rint(cosine[np.arange(len(x)), home] * 1_000_000).astype(np.int64)
                    order = np.lexsort((cid, least, home))
                    at = np.flatnonzero(np.diff(home[order], prepend=-1))
                    for i, total in zip(order[at], np.add.reduceat(whole[order], at, axis=0), strict=True):
                        add(held, (str(model), kind * KINDS + int(home[i])), total, (int(least[i]), int(cid[i])))
        if held:
            yield batch_of(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in _rows_of(batch):
                add(held, *row)
        if held:
            yield batch_of(held)

    return rows.select("cid", "model_id", "vector").mapInArrow(run, _SUMS).repartition("model_id", "slot").mapInArrow(merge, _SUMS)


def categories(rows: DataFrame, centroids: object) -> DataFrame:
    """(cid, model_id, a, b, typical): two independent categories of each vector, its nearest centroid in either set, and
    the sum of the two cosines in thousandths. Similar vectors share categories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            models = np.array(table["model_id"].to_pylist())
            for model in np.unique(models):
                own = table.filter(pa.array(models == model))
                x = vectors.matrix(own["vector"])
                found = [x @ c.T for c in centroids.value[str(model)]]
                a, b = (f.argmax(axis=1).astype(np.int32) for f in found)
                typical = np.rint(sum(f.max(axis=1) for f in found) * 1000).astype(np.int32)
                yield pa.record_batch([own["cid"].combine_chunks(), own["model_id"].combine_chunks(), pa.array(a), pa.array(b), pa.array(typical)], names=["cid", "model_id", "a", "b", "typical"])

    return rows.select("cid", "model_id", "vector").mapInArrow(run, "cid bigint, model_id string, a int, b int, typical int")


def flow_quotas(counts: np.ndarray, size: int) -> np.ndarray:
    """How many of each combination to take: whole numbers of at most ``counts`` that add up to ``size`` (or to all).

    A flow of ``size`` units from a source through a first category, a combination and a second category to a sink. Using
    a category or a combination once more costs more each time (the k-th unit 2k - 1), so the cheapest flow is the most
    balanced one that the counts allow. Units go one by one along cheapest paths, taking back earlier ones where that pays
    (successive shortest paths). Very large sizes go in lots first, about 4096 of them, each to one combination, which
    takes what room it has up to a lot; then cycles that make the flow cheaper are cancelled, in halved lots down to single units (``_cheapened``).
    """
    left = int(min(size, counts.sum()))
    used = np.zeros_like(counts, dtype=np.int64)
    lot = max(1, left // 4096)
    targets = [max(1e-9, left / max(1, np.count_nonzero(counts.sum(axis=1 - k)))) for k in (0, 1)]
    target = max(1e-9, left / max(1, np.count_nonzero(counts)))
    # of combinations used alike, one that stands for more records is cheaper, but never as much as a further use costs
    bonus = np.log1p(counts) / max(1e-9, float(np.log1p(counts.max(initial=0)))) / target
    while left > 0:
        step = min(lot, left)
        ua, ub = used.sum(axis=1), used.sum(axis=0)
        # the price of the next lot, in units of the balanced share, and what taking one back returns
        price = lambda u, t: (2 * u + step) / t
        forward = np.where(counts > used, price(used, target) - bonus, np.inf)
        backward = np.where((used > 0) & (lot == 1), bonus - price(used - step, target), np.inf)
        da, db = price(ua, targets[0]), np.full(counts.shape[1], np.inf)
        from_a, from_b = np.full(counts.shape[1], -1), np.full(counts.shape[0], -1)
        for _ in range(counts.shape[0] + counts.shape[1]):
            via = da[:, None] + forward
            best = via.argmin(axis=0)
            better = via[best, np.arange(len(db))] < db - 1e-9
            db[better], from_a[better] = via[best, np.arange(len(db))][better], best[better]
            back = db[None] + backward
            best = back.argmin(axis=1)
            turned = back[np.arange(len(da)), best] < da - 1e-9
            da[turned], from_b[turned] = back[np.arange(len(da)), best][turned], best[turned]
            if not better.any() and not turned.any():
                break
        total = db + price(ub, targets[1])
        b = int(total.argmin())
        if not np.isfinite(total[b]):
            break
        path: list[tuple[int, int, int]] = []
        for _ in range(2 * (counts.shape[0] + counts.shape[1])):
            a = int(from_a[b])
            path.append((a, b, 1))
            if from_b[a] < 0:
                break
            b = int(from_b[a])
            path.append((a, b, -1))
        step = min(step, *(int(counts[a, b] - used[a, b] if way > 0 else used[a, b]) for a, b, way in path))
        for a, b, way in path:
            used[a, b] += way * step
        left -= step
    return used if lot == 1 else _cheapened(used, counts, bonus, targets, target, lot)


def _cheapened(used: np.ndarray, counts: np.ndarray, bonus: np.ndarray, targets: list[float], target: float, lot: int) -> np.ndarray:
    """The cheapest flow of the same size: cycles of negative cost are cancelled, in lots that are halved, until no cycle of
    single units is left. Nodes are the first categories, the second ones, source and sink."""
    na, nb = counts.shape
    n = na + nb + 2
    used = used.copy()
    while True:
        # cost of moving one lot along each arc
        ua, ub = used.sum(axis=1), used.sum(axis=0)
        more = lambda u, t, lot=lot: lot * (2 * u + lot) / t
        less = lambda u, t, lot=lot: np.where(u >= lot, -lot * (2 * u - lot) / t, np.inf)
        arc = np.full((n, n), np.inf)
        arc[:na, na : na + nb] = np.where(counts - used >= lot, more(used, target) - lot * bonus, np.inf)
        arc[na : na + nb, :na] = (less(used, target) + lot * bonus).T
        arc[-2, :na], arc[:na, -2] = more(ua, targets[0]), less(ua, targets[0])
        arc[na : na + nb, -1], arc[-1, na : na + nb] = more(ub, targets[1]), less(ub, targets[1])
        cycle = _negative_cycle(arc)
        if cycle is None:
            if lot == 1:
                return used
            lot //= 2
            continue
        for u, v in cycle:
            if u < na <= v < n - 2:
                used[u, v - na] += lot
            elif v < na <= u < n - 2:
                used[v, u - na] -= lot


def _negative_cycle(arc: np.ndarray) -> list[tuple[int, int]] | None:
    """Arcs of a cycle of negative cost, by Bellman-Ford; a cycle of predecessors is one."""
    n = len(arc)
    far, before = np.zeros(n), np.full(n, -1)
    least_gain = 1e-9 + 1e-12 * float(np.abs(arc[np.isfinite(arc)]).max(initial=0))  # above what rounding makes up
    for k in range(n + 1):
        via = far[:, None] + arc
        best = via.argmin(axis=0)
        least = via[best, np.arange(n)]
        better = least < far - least_gain
        if not better.any():
            return None
        far[better], before[better] = least[better], best[better]
        if k % 4 and k < n:
            continue
        seen = np.zeros(n, np.int64)
        for start in range(n):
            at = start
            while at >= 0 and not seen[at]:
                seen[at] = start + 1
                at = int(before[at])
            if at >= 0 and seen[at] == start + 1:
                arcs, end = [], at
                while not arcs or at != end:
                    arcs.append((int(before[at]), at))
                    at = int(before[at])
                if sum(arc[x] for x in arcs) < -least_gain:
                    return arcs
    return None


def choose(embeddings: DataFrame, models: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id): for each request subset_size ids of usable vectors of its model, all if there are fewer.

    Records are aggregated into combinations of categories; each request's quotas come from a flow (``flow_quotas``) over
    the table of combinations, at most ``KINDS``² numbers whatever the data. Within a combination distinct vectors come
    before copies, then those nearest to their centroids, then the order of a hash of the id decides. Requests with a null model or size, or a size below 1,
    choose nothing; a repeated request_id counts once. Null, empty, cut-short, non-finite and all-zero vectors and repeated
    ids: see ``vectors.usable``. Empty tables give no rows; extra columns are ignored.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "subset")
    wanted = requests.where("request_id is not null and model_id is not null and subset_size > 0").dropDuplicates(["request_id"]).select("request_id", "model_id", "subset_size").limit(MOST_REQUESTS + 1).collect()
    if len(wanted) > MOST_REQUESTS:
        raise ValueError(f"at most {MOST_REQUESTS} requests in one job")
    asked = spark.createDataFrame([(m,) for m in sorted({r["model_id"] for r in wanted})], "model_id string")
    rows = scratch.table(vectors.usable(embeddings, models).join(asked, "model_id", "left_semi").withColumnRenamed("id", "cid").dropDuplicates(["cid"]), "rows")
    centroids = spark.sparkContext.broadcast(fit(rows))
    placed = scratch.table(categories(rows, centroids), "placed")
    table = placed.groupBy("model_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    quotas = []
    for r in wanted:
        own = table[table["model_id"] == r["model_id"]]
        if not len(own):
            continue
        a, b = own["a"].to_numpy(), own["b"].to_numpy()
        names_a, names_b = np.unique(a), np.unique(b)
        counts = np.zeros((len(names_a), len(names_b)), np.int64)
        counts[np.searchsorted(names_a, a), np.searchsorted(names_b, b)] = own["n"].to_numpy()
        used = flow_quotas(counts, r["subset_size"])
        i, j = np.nonzero(used)
        quotas += [(r["request_id"], r["model_id"], int(names_a[x]), int(names_b[y]), int(used[x, y])) for x, y in zip(i, j, strict=True)]
    quota = spark.createDataFrame(quotas, "request_id int, model_id string, a int, b int, quota int")
    # copies of a vector wait until all distinct ones of the combination are taken
    first = vectors.classes(rows.select(F.col("cid").alias("id"), "model_id", "vector")).where("id = cid").select("cid", F.lit(0).alias("copy"))
    ordered = placed.join(first, "cid", "left").withColumns({"copy": F.coalesce("copy", F.lit(1)), "h": F.xxhash64("cid")})
    return _first_of(scratch.table(ordered, "ordered"), F.broadcast(quota)).select("request_id", F.col("cid").alias("id"))


def _first_of(ordered: DataFrame, quota: DataFrame) -> DataFrame:
    """(request_id, cid): of each combination the first ``quota`` rows, in order of (copy, falling typical, h, cid).

    No combination is ranked as a whole, as one may hold a third of all rows: it is cut into slices of equal (copy, typical),
    which are counted with map-side combine. Slices inside a quota are taken whole; only the slice at its end is ranked,
    cut in turn by the leading bits of the hash."""
    combination = ["model_id", "a", "b"]
    piece = [*combination, "copy", "typical"]
    before = Window.partitionBy(*combination).orderBy("copy", F.desc("typical"))
    pieces = ordered.groupBy(*piece).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before) - F.col("n"))
    asked = pieces.join(quota, combination).where("before < quota").withColumn("take", F.least("n", F.col("quota") - F.col("before")))
    whole = ordered.join(asked.where("take = n").select("request_id", *piece), piece)
    cut = asked.where("take < n").select("request_id", *piece, "take")
    rows = ordered.join(cut.select(*piece).distinct(), piece, "left_semi").withColumn("part", F.shiftright("h", 52))
    parts = rows.groupBy(*piece, "part").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.withColumn("ahead", F.sum("m").over(Window.partitionBy(*piece).orderBy("part")) - F.col("m"))
    # parts that lie behind every request's share needn't be ranked
    most = cut.groupBy(*piece).agg(F.max("take").alias("most"))
    parts = parts.join(most, piece).where("ahead < most").select(*piece, "part", "ahead")
    ranked = rows.join(parts, [*piece, "part"]).withColumn("k", F.row_number().over(Window.partitionBy(*piece, "part").orderBy("h", "cid")) + F.col("ahead"))
    return whole.select("request_id", "cid").unionByName(ranked.join(cut, piece).where("k <= take").select("request_id", "cid"))


def p2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return choose(read("embeddings_in"), read("embedding_models"), read("subset_requests"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, chosen, ids, unusable) of each request that chooses anything: rows chosen, different ids among them, and
    ids that aren't usable vectors of the request's model."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    good = vectors.usable(read("embeddings_in"), read("embedding_models")).select("id", "model_id", F.lit(True).alias("good")).distinct()
    asked = read("subset_requests").select("request_id", "model_id").distinct()
    chosen = p2_subset(spark, sf_dir).join(asked, "request_id").join(good, ["id", "model_id"], "left")
    return chosen.groupBy("request_id").agg(F.count(F.lit(1)).alias("chosen"), F.count_distinct("id").alias("ids"), F.count_if(F.col("good").isNull()).alias("unusable"))


P2_SIZES_SQL = """
WITH u AS (SELECT DISTINCT e.id, e.model_id FROM embeddings_in e JOIN embedding_models m ON m.model_id = e.model_id AND m.dimension = len(e.vector)
  WHERE e.id IS NOT NULL AND len(e.vector) > 0 AND len(list_filter(e.vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e.vector, lambda x: x <> 0)) > 0),
n AS (SELECT r.request_id, least(r.subset_size, count(DISTINCT u.id))::BIGINT AS k FROM subset_requests r JOIN u USING (model_id) WHERE r.subset_size > 0 GROUP BY r.request_id, r.subset_size)
SELECT request_id, k AS chosen, k AS ids, 0::BIGINT AS unusable FROM n
"""
