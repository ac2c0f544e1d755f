"""Usable embedding vectors, and vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import usable as well_formed


def usable(embeddings: DataFrame, models: DataFrame) -> DataFrame:
    """(id, model_id, dim, vector) of usable vectors: finite, not all zero, and of their model's dimension; without a
    model_id, of any model's dimension. A model that ``models`` doesn't list has no dimension. Null ids are left out."""
    sizes = models.where("model_id is not null").groupBy("model_id").agg(F.max("dimension").alias("_own"))
    any_size = models.where("dimension is not null").select(F.col("dimension").alias("_any")).distinct()
    rows = embeddings.where("id is not null").select("id", "model_id", F.size("vector").alias("dim"), "vector").where(well_formed(F.col("vector")))
    named = rows.join(sizes, "model_id").where("dim = _own").select("id", "model_id", "dim", "vector")
    free = rows.where("model_id is null").join(any_size, F.col("dim") == F.col("_any"), "left_semi")
    return named.unionByName(free.select("id", "model_id", "dim", "vector"))


def classes(rows: DataFrame) -> DataFrame:
    """Members (id, cid): rows of equal model and vector are one class, named by its smallest id; a repeated id is one
    member. Vectors meet by two 64-bit hashes and are then compared; one that differs from the vector of its class stands
    for itself."""
    keyed = rows.select("id", "model_id", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("k")).distinct()
    keys = keyed.groupBy("model_id", "h", "k").agg(F.min("id").alias("cid")).select(F.col("model_id").alias("m"), "h", "k", "cid")
    met = keyed.join(keys, ["h", "k"]).where(F.col("model_id").eqNullSafe(F.col("m"))).select("id", "cid")
    vector = rows.select("id", "vector")
    copies = met.where("id <> cid").join(vector, "id").join(vector.toDF("cid", "first"), "cid")
    checked = copies.select("id", F.when(F.col("vector") == F.col("first"), F.col("cid")).otherwise(F.col("id")).alias("cid")).distinct()
    return met.where("id = cid").unionByName(checked)


def matrix(column: pa.Array | pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """A list<float> column of equal lengths as rows of a DOUBLE matrix, of unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if unit:
        x /= np.abs(x).max(axis=1, keepdims=True)  # against overflow
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same for the same seed everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def axis_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest signed axis, and the next nearest: numbers in 0..2 * dim - 1."""
    size = np.abs(x)
    best = size.argmax(axis=1)
    rows = np.arange(len(x))
    sign = x[rows, best] < 0
    size[rows, best] = -1
    second = size.argmax(axis=1)
    return best * 2 + sign, second * 2 + (x[rows, second] < 0)
