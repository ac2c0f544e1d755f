"""Embedding vectors as Column expressions: validation, cosine, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_EMBEDDING_DIMENSION


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def embedding_error(v: Column) -> Column:
    """Why a vector is no embedding, null if it is one. In this order: empty, too long, not finite (a null entry counts
    as not finite), all zero. A null vector counts as empty."""
    return (
        F.when(v.isNull() | (F.size(v) == 0), "vector is empty")
        .when(F.size(v) > MAX_EMBEDDING_DIMENSION, "dimension is too large")
        .when(F.exists(v, lambda x: ~_finite(x)), "value is not finite")
        .when(F.forall(v, lambda x: x == 0), "all values are zero")
    )


def usable(v: Column) -> Column:
    return embedding_error(v).isNull()


def dimension(v: Column) -> Column:
    return F.size(v)


def _f32_sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


def dot32(a: Column, b: Column) -> Column:
    """Sequential 32-bit dot product."""
    return _f32_sum(F.zip_with(a, b, lambda x, y: x.cast("float") * y.cast("float")))


def cosine_error(a: Column, b: Column) -> Column:
    """Why two ``struct<vector, model_id>`` can't be compared: kind of error, null if they can."""
    return (
        F.when(a["model_id"].isNotNull() & b["model_id"].isNotNull() & (a["model_id"] != b["model_id"]), "InvalidEmbedding")
        .when(F.size(a["vector"]) != F.size(b["vector"]), "EmbeddingDimensionMismatch")
        .when((dot32(a["vector"], a["vector"]) == 0) | (dot32(b["vector"], b["vector"]) == 0), "InvalidEmbedding")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine in 32-bit arithmetic, not clamped; null where ``cosine_error`` names a reason or a norm is 0."""
    va, vb = a["vector"], b["vector"]
    norms = (F.sqrt(dot32(va, va)).cast("float") * F.sqrt(dot32(vb, vb)).cast("float")).cast("float")
    return F.when(cosine_error(a, b).isNull() & (norms != 0), (dot32(va, vb) / norms).cast("float"))


def dot64(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine64(a: Column, b: Column) -> Column:
    """Cosine of two arrays in DOUBLE; null for unequal lengths or a zero norm."""
    norm = F.sqrt(dot64(a, a)) * F.sqrt(dot64(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm != 0), dot64(a, b) / norm)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot32(v, v)).cast("float")
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


def similarity_bar(score: Column, width: int = 10) -> Column:
    """Text bar with one full step for each whole tenth, then empty steps."""
    steps = F.greatest(F.lit(0), F.least(F.lit(width), (score * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), steps), F.repeat(F.lit("░"), F.lit(width) - steps))


def star(score: Column, at: float = 0.95) -> Column:
    return F.when(score >= F.lit(at).cast("float"), "★").otherwise("")
