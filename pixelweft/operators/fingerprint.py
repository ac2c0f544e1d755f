"""Fingerprints of pictures in BINARY columns, and embeddings by a model: Arrow batches in, rows with a value or an error out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ImageError
from ..functions.hashing import exact_sha256
from ..schema import ERROR, FORMAT_VERSION, HASHES, N_BLOCKS, HashAlgorithm, ModelInputConfig, PreprocessConfig
from . import decode, kernels
from .exact import blake3_many

#: Pictures of a kernel call: 64 normalised ones and their blocks are about 40 MB.
BATCH = 64
_HASHES = pa.struct([("global_hash", pa.int64()), ("block_hashes", pa.list_(pa.int64()))])
_TIMING = pa.struct([(n, pa.int64()) for n in ("decode", "normalise", "hash")])
TIMING = T.StructType([T.StructField(f.name, T.LongType()) for f in _TIMING])
_ERROR = pa.struct([("kind", pa.string()), ("message", pa.string())])


def _columns(greys: list[np.ndarray | None], errors: list[ImageError | None], fields: tuple[str, ...]) -> list[pa.Array]:
    good = np.array([g is not None for g in greys], bool)
    found = kernels.fingerprint(np.stack([g for g in greys if g is not None]), fields) if good.any() else {}
    offsets = pa.array(np.arange(len(greys) + 1, dtype=np.int32) * N_BLOCKS)
    out = []
    for f in fields:
        whole, blocks = np.zeros(len(greys), np.int64), np.zeros((len(greys), N_BLOCKS), np.int64)
        if f in found:
            whole[good], blocks[good] = found[f]
        lists = pa.ListArray.from_arrays(offsets, pa.array(blocks.ravel()))
        out.append(pa.StructArray.from_arrays([pa.array(whole), lists], fields=list(_HASHES), mask=pa.array(~good)))
    out.append(pa.array([None if e is None else {"kind": e.kind, "message": str(e)} for e in errors], _ERROR))
    return out


def _blake3_array(data: list[bytes | None]) -> pa.Array:
    found = iter(blake3_many([d for d in data if d is not None]))
    return pa.array([None if d is None else next(found) for d in data], pa.binary())


def read_grey(data: bytes | None, config: PreprocessConfig, times: list[tuple[int, int]] | None = None) -> tuple[np.ndarray | None, ImageError | None]:
    """The normalised picture or its error; whatever else a picture may cause is its own error, not the job's. ``times`` gets
    the nanoseconds of decoding and of normalising."""
    grey, bad = None, None
    began = decoded = time.perf_counter_ns()
    try:
        if data is not None:
            pixels = decode.decode(data, config)
            decoded = time.perf_counter_ns()
            grey = kernels.normalise(pixels)
    except ImageError as e:
        bad = e
    except Exception as e:  # noqa: BLE001
        bad = ImageError("ProcessingError", f"{type(e).__name__}: {e}")
    if times is not None:
        ended = time.perf_counter_ns()
        times.append((decoded - began, ended - decoded) if decoded > began else (ended - began, 0))
    return grey, bad


def fingerprint(df: DataFrame, content: str = "content", algorithms: tuple[HashAlgorithm, ...] = tuple(HashAlgorithm), config: PreprocessConfig | None = None, exact: str = "sha256", keep: tuple[str, ...] | None = None, timed: bool = False) -> DataFrame:
    """Adds exact, a struct of hashes for each algorithm, error and format_version to the ``keep`` columns (all but the
    content, if not given). A row has hashes or an error, never both, and errors touch no other row; null content gives
    neither. All requested algorithms share one decoding. ``exact``: "sha256", computed by Spark, or "blake3". ``timed`` adds
    the microseconds that the stages of each picture took, as timing STRUCT<decode, normalise, hash>. No shuffle.
    """
    config = config or PreprocessConfig()
    if exact not in ("sha256", "blake3"):
        raise ValueError(f"exact must be sha256 or blake3, not {exact}")
    fields = tuple(a.field for a in algorithms)
    kept = [c for c in (keep if keep is not None else df.columns) if c != content]
    rows = df.select(*kept, F.col(content).alias("_content"))
    rows = rows.withColumn("exact", exact_sha256(F.col("_content")) if exact == "sha256" else F.lit(None).cast("binary"))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("exact", T.BinaryType()), *(T.StructField(f, HASHES) for f in fields), T.StructField("error", ERROR), *([T.StructField("timing", TIMING)] if timed else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                data = batch.column("_content").to_pylist()
                times: list[tuple[int, int]] = []
                greys: list[np.ndarray | None] = []
                errors: list[ImageError | None] = []
                for d in data:
                    grey, bad = read_grey(d, config, times)
                    greys.append(grey)
                    errors.append(bad)
                key = batch.column("exact") if exact == "sha256" else _blake3_array(data)
                began = time.perf_counter_ns()
                columns = _columns(greys, errors, fields)
                if timed:
                    each = (time.perf_counter_ns() - began) // max(1, sum(g is not None for g in greys))
                    columns.append(pa.array([None if d is None else {"decode": a // 1000, "normalise": b // 1000, "hash": each // 1000 if g is not None else 0} for d, g, (a, b) in zip(data, greys, times, strict=True)], _TIMING))
                yield pa.record_batch([*(batch.column(c) for c in kept), key, *columns], names=[*kept, "exact", *fields, "error", *(["timing"] if timed else [])])

    return rows.mapInArrow(run, schema).withColumn("format_version", F.lit(FORMAT_VERSION))


def fingerprint_decoded(images: DataFrame, keep: tuple[str, ...] = (), image: str = "image", exact: str = "sha256") -> DataFrame:
    """Fingerprints of decoded pictures (Spark's image struct). The exact hash is that of the RGB pixels, so it never
    equals that of the encoded bytes. No guards on sizes; pictures that couldn't be decoded give a DecodeError."""
    if exact not in ("sha256", "blake3"):
        raise ValueError(f"exact must be sha256 or blake3, not {exact}")
    fields = tuple(a.field for a in HashAlgorithm)
    flat = images.select(*keep, F.col(f"{image}.height").alias("_h"), F.col(f"{image}.width").alias("_w"), F.col(f"{image}.nChannels").alias("_c"), F.col(f"{image}.data").alias("_d"))
    schema = T.StructType([*(flat.schema[c] for c in keep), T.StructField("_rgb", T.BinaryType()), *(T.StructField(f, HASHES) for f in fields), T.StructField("error", ERROR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                greys, errors, raw = [], [], []
                for h, w, c, d in zip(*(batch.column(n).to_pylist() for n in ("_h", "_w", "_c", "_d")), strict=True):
                    if d is None or h is None or h <= 0:
                        greys.append(None)
                        raw.append(None)
                        errors.append(ImageError("DecodeError", "not decoded"))
                        continue
                    pixels = np.frombuffer(d, np.uint8).reshape(h, w, c)
                    rgb = np.repeat(pixels, 3, axis=2) if c == 1 else np.ascontiguousarray(pixels[..., 2::-1])
                    greys.append(kernels.normalise(rgb))
                    raw.append(rgb.tobytes())
                    errors.append(None)
                pixels = pa.array(raw, pa.binary()) if exact == "sha256" else _blake3_array(raw)
                yield pa.record_batch([*(batch.column(c) for c in keep), pixels, *_columns(greys, errors, fields)], names=[*keep, "_rgb", *fields, "error"])

    key = exact_sha256(F.col("_rgb")) if exact == "sha256" else F.col("_rgb")
    return flat.mapInArrow(run, schema).select(*keep, key.alias("exact"), *fields, "error", F.lit(FORMAT_VERSION).alias("format_version"))


def single(df: DataFrame, algorithm: HashAlgorithm) -> DataFrame:
    """One algorithm of multi fingerprints, as rows of single fingerprints."""
    others = [a.field for a in HashAlgorithm]
    rest = [c for c in df.columns if c not in others]
    return df.select(*rest, F.lit(algorithm.value).alias("algorithm"), F.col(f"{algorithm.field}.global_hash").alias("global_hash"), F.col(f"{algorithm.field}.block_hashes").alias("block_hashes"))


# ---------------------------------------------------------------- embeddings by a model


class EmbeddingProvider(Protocol):
    """What makes embeddings: called in the workers, once for each picture, or with ``embed_many`` once for each batch of
    pictures; that gives a vector or an ImageError for each. ``model_id`` may be None."""

    model_id: str | None

    def embed(self, content: bytes) -> np.ndarray: ...


def model_input(content: bytes, config: ModelInputConfig) -> np.ndarray:
    """(3, size, size) floats of a picture: decoded without guards or orientation, resized, scaled by mean and deviation."""
    pixels = kernels.resize(kernels.to_rgb(decode.decode_pixels(content, PreprocessConfig())), config.input_size, config.input_size)
    x = pixels.astype(np.float32) / np.float32(255)
    return ((x - np.array(config.mean, np.float32)) / np.array(config.std, np.float32)).transpose(2, 0, 1)


class OnnxProvider:
    """A model file run by onnxruntime; loaded once in each worker. The first output, flattened, is the embedding."""

    model_id = None

    def __init__(self, model: bytes | str, config: ModelInputConfig | None = None):
        self.model, self.config, self._session = model, config or ModelInputConfig(), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def _loaded(self) -> object:
        if self._session is None:
            try:
                import onnxruntime

                self._session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
            except Exception as e:  # noqa: BLE001
                raise ImageError("ProviderError", f"model can't be loaded: {e}") from None
        return self._session

    def _run(self, inputs: np.ndarray) -> np.ndarray:
        """(n, dimension) vectors of (n, 3, size, size) inputs."""
        session = self._loaded()
        try:
            out = session.run(None, {session.get_inputs()[0].name: inputs})[0]
        except Exception as e:  # noqa: BLE001
            raise ImageError("ProviderError", f"inference failed: {e}") from None
        v = np.asarray(out, np.float32).reshape(len(inputs), -1)
        if self.config.normalize_output:
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(norm > 0, v / np.where(norm > 0, norm, 1), v)
        return v

    def embed(self, content: bytes) -> np.ndarray:
        return self._run(model_input(content, self.config)[None])[0]

    def embed_many(self, contents: list[bytes]) -> list[np.ndarray | ImageError]:
        """One call of the model for all pictures that can be decoded, or one for each where the model takes one at a time."""
        self._loaded()
        made: list[np.ndarray | ImageError] = []
        for content in contents:
            try:
                made.append(model_input(content, self.config))
            except ImageError as e:
                made.append(e)
            except Exception as e:  # noqa: BLE001
                made.append(ImageError("ProcessingError", f"{type(e).__name__}: {e}"))
        good = [i for i, x in enumerate(made) if not isinstance(x, ImageError)]
        whole = None
        first = self._session.get_inputs()[0].shape[:1]
        if good and not (first and isinstance(first[0], int) and first[0] == 1):
            try:
                whole = self._run(np.stack([made[i] for i in good]))
            except ImageError:  # one picture may be to blame
                whole = None
        for k, i in enumerate(good):
            try:
                made[i] = whole[k] if whole is not None else self._run(made[i][None])[0]
            except ImageError as e:
                made[i] = e
        return made


def embed(df: DataFrame, provider: EmbeddingProvider | Callable[[], EmbeddingProvider], content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds embedding STRUCT<vector, model_id> and error to the ``keep`` columns; null content gives neither. A vector that
    is empty, not finite or all zero is an InvalidEmbedding."""
    kind = pa.struct([("vector", pa.list_(pa.float32())), ("model_id", pa.string())])
    rows = df.select(*keep, F.col(content).alias("_content"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("embedding", T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("model_id", T.StringType())])), T.StructField("error", ERROR)])

    def checked(v: np.ndarray) -> np.ndarray:
        if not len(v):
            raise ImageError("InvalidEmbedding", "vector is empty")
        if not np.isfinite(v).all():
            raise ImageError("InvalidEmbedding", "value is not finite")
        if not v.any():
            raise ImageError("InvalidEmbedding", "all values are zero")
        return v

    def vectors_of(given: EmbeddingProvider, contents: list[bytes]) -> list[np.ndarray | ImageError]:
        out: list[np.ndarray | ImageError] = []
        try:
            found = given.embed_many(contents) if hasattr(given, "embed_many") else [None] * len(contents)
        except ImageError as e:
            return [e] * len(contents)
        for content, v in zip(contents, found, strict=True):
            try:
                if isinstance(v, ImageError):
                    raise v
                out.append(checked(np.asarray(given.embed(content) if v is None else v, np.float32)))
            except ImageError as e:
                out.append(e)
            except Exception as e:  # noqa: BLE001
                out.append(ImageError("ProviderError", f"{type(e).__name__}: {e}"))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = provider() if isinstance(provider, type) or (callable(provider) and not hasattr(provider, "embed")) else provider
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                data = batch.column("_content").to_pylist()
                made = iter(vectors_of(given, [d for d in data if d is not None]))
                values, errors = [], []
                for d in data:
                    value = next(made) if d is not None else None
                    bad = value if isinstance(value, ImageError) else None
                    values.append(None if value is None or bad else {"vector": value.tolist(), "model_id": given.model_id})
                    errors.append({"kind": bad.kind, "message": str(bad)} if bad else None)
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(values, kind), pa.array(errors, _ERROR)], names=[*keep, "embedding", "error"])

    return rows.mapInArrow(run, schema)
