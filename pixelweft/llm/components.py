"""Problem 4: pairwise matches to groups, by Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import f32
from ..session import Scratch


def links(similarities: DataFrame, score: float = 0.90, distance: int = 10) -> DataFrame:
    """Distinct links (u < v) of match rows. A row links two different non-null ids if ``exact_match`` is true, or if the
    score is a number in ``score``..1 and the distance at most ``distance``; null, NaN and infinite values don't link."""
    near = F.col("score").between(f32(score), f32(1.0)) & ~F.isnan("score") & (F.col("perceptual_distance") <= distance)
    linked = F.coalesce(F.col("exact_match"), F.lit(False)) | F.coalesce(near, F.lit(False))
    ends = F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & (F.col("left_id") != F.col("right_id"))
    return similarities.where(ends & linked).select(F.least("left_id", "right_id").alias("u"), F.greatest("left_id", "right_id").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """One row (id, group_id) for each id that stands in an edge; group_id is the smallest id linked to it directly or
    through others. Edges with a null end or two equal ends link nothing; repeated edges and extra columns don't matter;
    no edges give no rows.

    Borůvka: edges are totally ordered by their ends, so every component has one smallest outgoing edge, and hooking
    along it yields trees whose only cycles are pairs that chose the same edge; the smaller end of such a pair is the
    root. Trees collapse by pointer doubling, edges are relabelled, and of parallel edges the smallest stays. At least
    half of the components go in each round. The choice is a minimum with map-side combine, so a hub of a third of all
    edges costs no more than others; the joins on hot roots are left to the adaptive skew join. Every state is a table
    in the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    every = F.lit(True)
    graph, left = scratch.counted(ends.distinct().select("a", "b", F.col("a").alias("eu"), F.col("b").alias("ev")), every, "edges")
    labels: DataFrame | None = None
    while labels is None or left:
        half = graph.select(F.col("a").alias("c"), F.col("b").alias("o"), "eu", "ev").unionByName(graph.select(F.col("b").alias("c"), F.col("a").alias("o"), "eu", "ev"))
        chosen = scratch.table(half.groupBy("c").agg(F.min(F.struct("eu", "ev", "o"))["o"].alias("o")), "chosen")
        back = chosen.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        is_root = (F.col("oo") == F.col("c")) & (F.col("c") < F.col("o"))
        parents = scratch.table(chosen.join(back, "o").select("c", F.when(is_root, F.col("c")).otherwise(F.col("o")).alias("p")), "parents")
        scratch.drop(chosen)
        moved = 1
        while moved:
            up = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            twice, moved = scratch.counted(parents.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), F.col("moved"), "parents")
            scratch.drop(parents)
            parents = twice
        root = lambda x: parents.select(F.col("c").alias(x), F.col("p").alias(f"r{x}"))
        across = graph.join(root("a"), "a").join(root("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.struct("eu", "ev").alias("e"))
        smaller, left = scratch.counted(across.groupBy("a", "b").agg(F.min("e").alias("e")).select("a", "b", "e.eu", "e.ev"), every, "edges")
        if labels is None:
            longer = parents.select(F.col("c").alias("id"), F.col("p").alias("label"))
        else:
            longer = labels.join(parents.select(F.col("c").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        longer = scratch.table(longer, "labels")
        scratch.drop(labels)
        scratch.drop(graph)
        scratch.drop(parents)
        graph, labels = smaller, longer
    least = labels.groupBy("label").agg(F.min("id").alias("group_id"))
    return labels.join(least, "label").select("id", "group_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = links(spark.read.parquet(f"{sf_dir}/similarities.parquet"))
    return components(matches).select(F.col("id").alias("image_id"), "group_id")


P4_FOUND_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT least(left_id, right_id) AS u, greatest(left_id, right_id) AS v FROM similarities
  WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id
    AND (coalesce(exact_match, false)
         OR (score >= 0.9::FLOAT AND score <= 1.0::FLOAT AND NOT isnan(score) AND perceptual_distance <= 10))
), n AS (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e
), reach AS (
  SELECT a AS image_id, a AS other FROM n
  UNION
  SELECT r.image_id, n.b FROM reach r JOIN n ON n.a = r.other
)
SELECT image_id, min(other) AS group_id FROM reach GROUP BY image_id
"""
