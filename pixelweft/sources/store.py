"""Fingerprints at rest: Parquet with a version gate, JSON, and fixed-size binary records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting
from ..schema import FORMAT_VERSION, HashAlgorithm


def gated(df: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of the current format version. ``strict``: reading another version fails the job; else such rows are left out."""
    same = F.col("format_version") == FORMAT_VERSION
    if not strict:
        return df.where(same)
    return df.withColumn("format_version", F.when(same, F.col("format_version")).otherwise(F.raise_error(F.concat(F.lit("format version "), F.coalesce(F.col("format_version").cast("string"), F.lit("null")), F.lit(f" isn't {FORMAT_VERSION}"))).cast("int")))


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return gated(spark.read.parquet(path), strict)


def save_bucketed(df: DataFrame, table: str, keys: int, column: str = "coarse_key") -> None:
    """A table bucketed by a column, so that joins on it need no shuffle."""
    df.write.bucketBy(keys, column).sortBy(column).mode("overwrite").saveAsTable(table)


def export_json(df: DataFrame, path: str, filename: str = "path") -> None:
    """One JSON line a picture; rows with an error are left out."""
    fp = F.struct("exact", *(a.field for a in HashAlgorithm))
    df.where("error is null and exact is not null").select(formatting.export_row(F.col(filename), fp).alias("x")).select("x.*").write.json(path)


def to_records(df: DataFrame) -> DataFrame:
    """(record BINARY(536)) of multi fingerprints."""
    fp = F.struct("exact", *(a.field for a in HashAlgorithm))
    return df.select(formatting.pack_multi(fp).alias("record")).where("record is not null")


def from_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Multi fingerprints of 536-byte records; null for other lengths."""
    return df.select(formatting.unpack_multi(F.col(record)).alias("fp")).select("fp.*")


def read_record_file(spark: SparkSession, path: str, size: int = formatting.MULTI_BYTES) -> DataFrame:
    """(record) of files that are a plain sequence of records: cut by the scan, a file may be of any length."""
    sc = spark.sparkContext
    data = sc.binaryRecords(path, size).map(lambda b: (bytearray(b),))
    return spark.createDataFrame(data, "record binary")


def each(df: DataFrame, callback: Callable[[Row], None]) -> None:
    """Calls the function for each row in the driver, partition by partition: at most one partition is held."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        callback(row)


def each_partition(df: DataFrame, callback: Callable[[Iterator[Row]], None]) -> None:
    """Calls the function for each partition, in the workers."""
    df.foreachPartition(callback)


def counted(df: DataFrame, name: str = "fingerprints") -> tuple[DataFrame, Observation]:
    """The same rows, and what the first action on them will have counted: rows, ok, failed; of timed fingerprints also the
    microseconds of each stage, in all."""
    seen = Observation(name)
    bad = F.col("error").isNotNull()
    stages = [F.coalesce(F.sum(f"timing.{f.name}"), F.lit(0)).alias(f"{f.name}_us") for f in df.schema["timing"].dataType] if "timing" in df.columns else []
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), *stages), seen
