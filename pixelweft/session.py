"""Session defaults and scratch tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "pixelweft", cpus: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where that is unset one of our own, in local mode only
    (tests): on a cluster a folder of one machine isn't shared, so there the setting must be given."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pixelweft-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Bytes of a table that is spread over all cores by a shuffle.
SMALL = 1 << 30


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, spread over all cores where one small file would keep a costly kernel on a few of them. Only a table
    that a shuffle costs little (``SMALL`` bytes) is spread; larger ones are read as they are."""
    df = spark.read.parquet(path)
    want = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(want) if size <= SMALL and df._jdf.rdd().getNumPartitions() < want else df


_open: list[Scratch] = []


def release() -> None:
    """Frees the scratch tables of all operators so far. Results that aren't written or collected yet can't be read then."""
    while _open:
        _open[-1].close()


class Scratch:
    """Tables that cut lineage: each is written as Parquet to the shared folder, so that a lost executor costs a
    re-read and not a recomputation. ``drop`` frees one that no later step reads; the rest goes with ``release``, in long
    sessions, or when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}
        self._tables: list[str] = []
        _open.append(self)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path) if not partition_by else self.spark.read.parquet(path)
        self._paths[id(out)] = path
        return out

    def counted(self, df: DataFrame, what: Column, name: str = "t") -> tuple[DataFrame, int]:
        """The table, and in how many of its rows ``what`` is true, counted while it is written."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count_if(what).alias("n")), name)
        return out, seen.get["n"]

    def bucketed(self, df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
        """A table in buckets of one column, one file each: joins and groups on the column don't shuffle it."""
        path = self.path(name)
        table = f"scratch_{uuid.uuid4().hex[:12]}"
        df.repartition(buckets, column).write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
        self._tables.append(table)
        out = self.spark.table(table)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            delete(self.spark, path)

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
        try:
            for table in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(self.spark, self.root)
        except Exception:  # the JVM may be gone  # noqa: BLE001
            if self.root.startswith("file:") and os.path.isdir(local := self.root.removeprefix("file://")):
                import shutil

                shutil.rmtree(local, ignore_errors=True)


atexit.register(release)
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Arrow functions find it on any cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    import shutil

    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="pixelweft-code-")
    atexit.register(shutil.rmtree, folder, True)
    sources = os.path.join(folder, "src")
    shutil.copytree(package, os.path.join(sources, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "pixelweft_code"), "zip", sources))
