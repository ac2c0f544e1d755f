"""Picture files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PREFIXES, error
from ..operators.fingerprint import fingerprint
from ..schema import HashAlgorithm, PreprocessConfig

# Endings of picture files.
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")


def extension(path: Column) -> Column:
    """Lower-case ending of a path, "" if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def has_picture_ending(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def picture_files(spark: SparkSession, folder: str, config: PreprocessConfig | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, content, error) of the picture files of a folder. Files over the byte cap aren't read: the limit is
    pushed to the scan, and they come as rows with an IoError and null content. Empty files, which Spark's scan leaves out,
    come as rows of empty content."""
    config = config or PreprocessConfig()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).where(has_picture_ending(F.col("path")))
    small = files.where(F.col("length") <= config.max_input_bytes).select("path", "length", "content", F.lit(None).cast("struct<kind:string,message:string>").alias("error"))
    large = files.where(F.col("length") > config.max_input_bytes).select("path", "length")
    note = error("IoError", F.concat(F.col("length").cast("string"), F.lit(f" bytes exceed {config.max_input_bytes}")))
    both = small.unionByName(large.select("path", "length", F.lit(None).cast("binary").alias("content"), note.alias("error")))
    empty = _empty_files(spark, folder, recursive).where(has_picture_ending(F.col("path")))
    return both.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"), F.lit(None).cast("struct<kind:string,message:string>").alias("error")))


def _empty_files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """(path) of the files of no bytes, under the names that Spark's scan would give them. Folders are listed by workers, one
    task each."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    folders = [str(f.getPath()) for f in found if f.isDirectory()]
    alone = [str(f.getPath()) for f in found if f.isFile() and f.getLen() == 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner = _located(name)
                at = [i.path for i in system.get_file_info(fs.FileSelector(inner, recursive=recursive)) if i.type == fs.FileType.File and i.size == 0]
                head = name[: len(name) - len(inner.strip("/")) - (1 if name.endswith("/") else 0)].rstrip("/")
                yield pa.record_batch([pa.array([f"{head}/{p.lstrip('/')}" for p in at], pa.string())], names=["path"])

    listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders))).mapInArrow(run, "path string")
    return listed.unionByName(spark.createDataFrame([(a,) for a in alone], "path string"))


def _located(name: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name; the name that Hadoop gives to an object store is unknown to the reader."""
    name = re.sub("^s3a:", "s3:", name)
    return fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """(path, length) of files that are written to a folder all workers share, one for each row; rows without a name or
    content write none. Written when the result is, by the workers; a repeated name is written again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _located(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n is None or data is None:
                    continue
                with system.open_output_stream(f"{inner}/{n}") as f:
                    f.write(data)
                paths.append(f"{folder}/{n}")
                sizes.append(len(data))
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "path string, length bigint")


def picture_paths(spark: SparkSession, paths: DataFrame, config: PreprocessConfig | None = None, path: str = "path") -> DataFrame:
    """(path, length, content, error) of each of the listed files, whatever its ending. A file that is missing, can't be read,
    or is over the byte cap comes as a row with an IoError and null content; sizes are looked up before anything is read.
    Files are opened in the workers, so a list of any length is spread over all of them."""
    config = config or PreprocessConfig()
    most = config.max_input_bytes
    error_type = pa.struct([("kind", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                names, sizes, contents, errors = whole.column(0).slice(at, 16).to_pylist(), [], [], []
                for name in names:
                    size, content, bad = None, None, None
                    if name is not None:
                        try:
                            system, inner = _located(name)
                            info = system.get_file_info(inner)
                            if info.type != fs.FileType.File:
                                raise FileNotFoundError(f"no such file: {name}")
                            size = info.size
                            if size > most:
                                raise OSError(f"{size} bytes exceed {most}")
                            with system.open_input_stream(inner) as f:
                                content = f.read()
                        except (OSError, pa.ArrowException) as e:
                            bad = {"kind": "IoError", "message": PREFIXES["IoError"] + str(e)}
                    sizes.append(size)
                    contents.append(content)
                    errors.append(bad)
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(errors, error_type)], names=["path", "length", "content", "error"])

    return paths.select(F.col(path).cast("string").alias("path")).mapInArrow(run, "path string, length bigint, content binary, error struct<kind:string,message:string>")


def fingerprint_files(spark: SparkSession, folder: str, config: PreprocessConfig | None = None, algorithms: tuple[HashAlgorithm, ...] = tuple(HashAlgorithm), exact: str = "sha256") -> DataFrame:
    """(path, length, exact, hashes, error, format_version) of a folder; errors of reading and of decoding in one column."""
    return _fingerprinted(picture_files(spark, folder, config), config, algorithms, exact)


def fingerprint_paths(spark: SparkSession, paths: DataFrame, config: PreprocessConfig | None = None, algorithms: tuple[HashAlgorithm, ...] = tuple(HashAlgorithm), exact: str = "sha256", path: str = "path") -> DataFrame:
    """Likewise of listed files; a missing one is a row with an IoError."""
    return _fingerprinted(picture_paths(spark, paths, config, path), config, algorithms, exact)


def _fingerprinted(rows: DataFrame, config: PreprocessConfig | None, algorithms: tuple[HashAlgorithm, ...], exact: str) -> DataFrame:
    done = fingerprint(rows.withColumnRenamed("error", "_read"), algorithms=algorithms, config=config, exact=exact)
    return done.withColumn("error", F.coalesce("_read", "error")).drop("_read")


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image) decoded by the JVM: also JPEG. Guards and orientation don't apply; a picture that can't be decoded has
    a height of -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(folder).select(F.col("image.origin").alias("path"), "image")


def format_of(content: Column) -> Column:
    """Format by magic bytes, inside Spark; null if unknown."""
    starts = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    return (
        F.when(starts("89504E470D0A1A0A"), "PNG")
        .when(starts("FFD8FF"), "JPEG")
        .when(starts("474946383761") | starts("474946383961"), "GIF")
        .when(starts("424D"), "BMP")
        .when(starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "WebP")
    )


def byte_guard(content: Column, config: PreprocessConfig | None = None) -> Column:
    """Error of the checks that need no decoding, null if they pass or the content is null."""
    config = config or PreprocessConfig()
    size = F.octet_length(content)
    checks = F.when(size == 0, error("InvalidImage", "empty input"))
    if config.min_dimension > config.max_dimension:
        checks = checks.when(content.isNotNull(), error("InvalidImage", f"min_dimension {config.min_dimension} exceeds max_dimension {config.max_dimension}"))
    return checks.when(size > config.max_input_bytes, error("InvalidImage", F.concat(size.cast("string"), F.lit(f" bytes exceed {config.max_input_bytes}"))))
