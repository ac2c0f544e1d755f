"""Types, enums and configuration of the engine.

64-bit hashes are unsigned; Spark stores them as signed BIGINT with the same bit pattern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

#: Version of the fingerprint layout; rows of another version are never compared.
FORMAT_VERSION = 1
#: Blocks of the 4 x 4 grid.
N_BLOCKS = 16
HASH_BITS = 64

# Default weights and thresholds of a comparison.
DEFAULT_AHASH_WEIGHT = 0.10
DEFAULT_PHASH_WEIGHT = 0.60
DEFAULT_DHASH_WEIGHT = 0.30
DEFAULT_GLOBAL_WEIGHT = 0.40
DEFAULT_BLOCK_WEIGHT = 0.60
DEFAULT_BLOCK_DISTANCE_THRESHOLD = 32

# Default limits of the decoder and of embeddings.
DEFAULT_MAX_INPUT_BYTES = 50 * 1024 * 1024
DEFAULT_MAX_DIMENSION = 8192
DEFAULT_MIN_DIMENSION = 32
MAX_EMBEDDING_DIMENSION = 65536


class HashAlgorithm(str, Enum):
    """Perceptual hash algorithms; the value is the text stored in ``algorithm`` columns."""

    AHASH = "AHash"
    PHASH = "PHash"
    DHASH = "DHash"

    @property
    def hash_bits(self) -> int:
        return HASH_BITS

    @property
    def max_distance(self) -> int:
        return HASH_BITS

    @property
    def field(self) -> str:
        """Name of the struct field in a multi fingerprint."""
        return self.value.lower()

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class MultiHashConfig:
    """Weights of a multi-algorithm comparison."""

    ahash_weight: float = DEFAULT_AHASH_WEIGHT
    phash_weight: float = DEFAULT_PHASH_WEIGHT
    dhash_weight: float = DEFAULT_DHASH_WEIGHT
    global_weight: float = DEFAULT_GLOBAL_WEIGHT
    block_weight: float = DEFAULT_BLOCK_WEIGHT
    block_distance_threshold: int = DEFAULT_BLOCK_DISTANCE_THRESHOLD

    def weight(self, algorithm: HashAlgorithm) -> float:
        return getattr(self, f"{algorithm.field}_weight")


@dataclass(frozen=True)
class PreprocessConfig:
    """Limits checked before and after decoding."""

    max_input_bytes: int = DEFAULT_MAX_INPUT_BYTES
    max_dimension: int = DEFAULT_MAX_DIMENSION
    min_dimension: int = DEFAULT_MIN_DIMENSION


@dataclass(frozen=True)
class ModelInputConfig:
    """How a picture becomes the input tensor of an embedding model."""

    input_size: int = 224
    # Channel means and deviations of the widely used contrastive image models.
    mean: tuple[float, float, float] = (0.48145466, 0.4578275, 0.40821073)
    std: tuple[float, float, float] = (0.26862954, 0.26130258, 0.27577711)
    normalize_output: bool = True

    @classmethod
    def base_224(cls) -> ModelInputConfig:
        return cls()

    @classmethod
    def large_336(cls) -> ModelInputConfig:
        return cls(input_size=336)


def checked_threshold(threshold: float, strict: bool = True) -> float:
    """A similarity threshold in 0..1. ``strict``: raise for any other value; else clamp (NaN stays, and matches nothing)."""
    if strict and not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be in 0..1, not {threshold}")
    return threshold if math.isnan(threshold) else min(1.0, max(0.0, threshold))


HASHES = T.StructType([T.StructField("global_hash", T.LongType()), T.StructField("block_hashes", T.ArrayType(T.LongType()))])
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
SIMILARITY = T.StructType([T.StructField("score", T.FloatType()), T.StructField("exact_match", T.BooleanType()), T.StructField("perceptual_distance", T.IntegerType())])
EMBEDDING = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("model_id", T.StringType())])
MULTI = T.StructType([T.StructField("exact", T.BinaryType()), *(T.StructField(a.field, HASHES) for a in HashAlgorithm)])
SINGLE = T.StructType([T.StructField("exact", T.BinaryType()), *HASHES.fields])
