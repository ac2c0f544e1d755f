"""Continuous ingestion of picture files and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fingerprint import fingerprint
from ..schema import HashAlgorithm, PreprocessConfig
from ..sources.files import has_picture_ending


def picture_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New picture files of a folder as they arrive: (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder).where(has_picture_ending(F.col("path")))


def fingerprint_stream(stream: DataFrame, config: PreprocessConfig | None = None, algorithms: tuple[HashAlgorithm, ...] = tuple(HashAlgorithm)) -> DataFrame:
    """Fingerprints of a stream of pictures, row by row like the batch operator."""
    return fingerprint(stream, config=config, algorithms=algorithms)


def first_of_exact(stream: DataFrame, watermark: str | None = None, time: str = "modificationTime") -> DataFrame:
    """Only the first picture of each exact hash. With a watermark the state forgets hashes older than it."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["exact"]) if watermark else stream.dropDuplicates(["exact"])


def write_stream(stream: DataFrame, path: str, checkpoint: str, each_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes all that is available, then ends: to Parquet, or to a function called with each batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", path).start()
