"""Error values: rows carry errors as data, jobs don't fail on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of errors and the text that precedes a message.
PREFIXES = {
    "DecodeError": "decode failed: ",
    "InvalidImage": "invalid image: ",
    "UnsupportedFormat": "unsupported format: ",
    "ProcessingError": "processing error: ",
    "ImageTooSmall": "image dimensions too small: ",
    "EmbeddingDimensionMismatch": "embedding dimension mismatch: ",
    "ProviderError": "embedding provider error: ",
    "InvalidEmbedding": "invalid embedding: ",
    "IoError": "io error: ",
}


class ImageError(Exception):
    """An error of one row."""

    def __init__(self, kind: str, message: str):
        super().__init__(PREFIXES[kind] + message)
        self.kind, self.message = kind, message


def error(kind: str, message: Column | str) -> Column:
    """Error struct with the kind's prefix."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(PREFIXES[kind]), text).alias("message"))


def dimension_mismatch(expected: Column, actual: Column) -> Column:
    return error("EmbeddingDimensionMismatch", F.concat(F.lit("expected "), expected.cast("string"), F.lit(", got "), actual.cast("string")))
