"""Synthetic pictures that Spark and SQL describe alike: pixel (r, c) of a document is (r*r*p + c*q + r*c) mod 256, where
p and q come from its numbers. They exercise the hash stages where no decoded pictures are at hand."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import scaled, taps
from ..operators import kernels
from ..schema import N_BLOCKS, HashAlgorithm
from ..session import read_spread

P = "(doc_id % 251 + 1)"
Q = "(coalesce(n_chars, 0) % 241 + 1)"
#: 32-bit value of 1/255, as SQL.
INV = "(1.0::FLOAT / 255.0::FLOAT)::FLOAT"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.expr(P).alias("p"), F.expr(Q).alias("q"))


def grey(r: Column | int, c: Column | int) -> Column:
    r, c = (x if isinstance(x, Column) else F.lit(x) for x in (r, c))
    return F.pmod(r * r * F.col("p") + c * F.col("q") + r * c, F.lit(256))


def pixel(r: Column | int, c: Column | int) -> Column:
    return scaled(grey(r, c))


#: Pictures that a kernel call holds: few, so that its steps stay in the cache of a core.
BATCH = 16


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(doc_ids, grey pictures (n, 256, 256)) of the rows (doc_id, p, q)."""
    # bytes wrap around as the remainder by 256 does
    r, c = np.arange(256, dtype=np.uint8)[:, None], np.arange(256, dtype=np.uint8)[None]
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            p, q = (batch.column(n).fill_null(0).to_numpy().astype(np.uint8)[:, None, None] for n in ("p", "q"))
            yield batch.column("doc_id"), r * r * p + c * q + r * c


def regions(spark: SparkSession, sf_dir: str, blocks: bool) -> DataFrame:
    """(doc_id, block, total, least, most, placed) of the regions that the kernels cut out of each picture: the centre
    (block -1) or the 16 blocks. ``placed`` is the sum of the pixels times their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, grey in _drawn(batches):
            cut = kernels.block_grid(grey) if blocks else kernels.global_region(grey)[:, None]
            v = np.rint(cut.reshape(*cut.shape[:2], -1).astype(np.float64) * 255).astype(np.int64)
            block = np.tile(np.arange(v.shape[1]) if blocks else [-1], len(v)).astype(np.int32)
            figures = (v.sum(axis=2), v.min(axis=2), v.max(axis=2), v @ np.arange(1, v.shape[2] + 1))
            doc = pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), v.shape[1]))
            yield pa.record_batch([doc, pa.array(block), *(pa.array(f.ravel()) for f in figures)], names=["doc_id", "block", "total", "least", "most", "placed"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id bigint, block int, total bigint, least bigint, most bigint, placed bigint")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, total, placed) of the 16 blocks of each picture as the kernel halves them: the sum of the means, in
    quarters of a grey level, and the sum weighted by place; both null where the picture has no id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, grey in _drawn(batches):
            v = np.rint(kernels.box_halved(kernels.block_grid(grey)).reshape(len(grey) * N_BLOCKS, -1).astype(np.float64) * 1020)
            # whole numbers below 2^53, so DOUBLE adds them exactly
            figures = (v.sum(axis=1), v @ np.arange(1, v.shape[1] + 1, dtype=np.float64))
            doc = ids.take(pa.array(np.repeat(np.arange(len(grey)), N_BLOCKS)))
            block = pa.array(np.tile(np.arange(N_BLOCKS, dtype=np.int32), len(grey)))
            unknown = doc.is_null().to_numpy(zero_copy_only=False)
            yield pa.record_batch([doc, block, *(pa.array(f.astype(np.int64), mask=unknown) for f in figures)], names=["doc_id", "block", "total", "placed"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id bigint, block int, total bigint, placed bigint")


def kernel_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, ahash, phash, dhash, gap): what the kernels make of each picture, of the centre (block -1) and of the 16
    blocks. ``gap`` is the distance of the median coefficient, in DOUBLE, to the next ones: below the rounding of 32 bits
    it says that a bit is a toss-up."""
    fields = [a.field for a in HashAlgorithm]

    def gaps(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
        low = np.sort((basis @ x.astype(np.float64) @ basis.T / 256).reshape(*x.shape[:-2], 64), axis=-1)
        return np.minimum(low[..., 32] - low[..., 31], low[..., 33] - low[..., 32])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = np.cos(np.pi * (2 * np.arange(32)[None] + 1) * np.arange(8)[:, None] / 64)
        for ids, grey in _drawn(batches):
            found = kernels.fingerprint(grey, tuple(fields))
            halves = kernels.block_grid(grey).astype(np.float64).reshape(len(grey), N_BLOCKS, 32, 2, 32, 2).mean(axis=(3, 5))
            gap = np.concatenate([gaps(kernels.global_region(grey), basis)[:, None], gaps(halves, basis)], axis=1)
            hashes = [np.concatenate([found[f][0][:, None], found[f][1]], axis=1) for f in fields]
            doc = pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), N_BLOCKS + 1))
            block = pa.array(np.tile(np.arange(-1, N_BLOCKS), len(grey)).astype(np.int32))
            yield pa.record_batch([doc, block, *(pa.array(h.ravel()) for h in hashes), pa.array(gap.ravel())], names=["doc_id", "block", *fields, "gap"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id bigint, block int, ahash bigint, phash bigint, dhash bigint, gap double")


def _bmp(grey: np.ndarray) -> bytes:
    """An uncompressed BMP of 24 bits, bottom row first."""
    h, w = grey.shape
    body = np.repeat(grey[::-1, :, None], 3, axis=2).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def _png(grey: np.ndarray, row_filter: int, orientation: int | None = None) -> bytes:
    """A grey PNG with one filter for all rows: 0 none, 1 left, 2 above."""
    before = [None, np.pad(grey, ((0, 0), (1, 0)))[:, :-1], np.pad(grey, ((1, 0), (0, 0)))[:-1]][row_filter]
    lines = grey if before is None else grey - before
    data = zlib.compress(np.pad(lines, ((0, 0), (1, 0)), constant_values=row_filter).tobytes(), 1)
    chunk = lambda tag, b: struct.pack(">I", len(b)) + tag + b + struct.pack(">I", zlib.crc32(tag + b))
    note = b"" if orientation is None else chunk(b"eXIf", b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + note + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def _as_stored(grey: np.ndarray, orientation: int) -> np.ndarray:
    """What a camera held that way stores of a picture."""
    turned = {1: grey, 2: grey[:, ::-1], 3: grey[::-1, ::-1], 4: grey[::-1], 5: grey.T, 6: np.rot90(grey), 7: np.rot90(grey, 2).T, 8: np.rot90(grey, -1)}
    return np.ascontiguousarray(turned[orientation])


def encoded(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """(doc_id, content) of the pictures as files: BMP, and PNG with three filters, in turn; or all as PNG, stored in the
    eight orientations in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, grey in _drawn(batches):
            if turned:
                ways = [(i % 8 + 1, g) for i, g in zip(ids.to_pylist(), grey, strict=True)]
                yield pa.record_batch([ids, pa.array([_png(_as_stored(g, way), 0, way) for way, g in ways], pa.binary())], names=["doc_id", "content"])
                continue
            files = [_bmp(g) if i % 4 == 3 else _png(g, i % 4) for i, g in zip(ids.to_pylist(), grey, strict=True)]
            yield pa.record_batch([ids, pa.array(files, pa.binary())], names=["doc_id", "content"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id bigint, content binary")


def sql_grey(r: str, c: str) -> str:
    return f"((({r}) * ({r}) * p + ({c}) * q + ({r}) * ({c})) % 256)"


def sql_pixel(r: str, c: str) -> str:
    return f"({sql_grey(r, c)}::FLOAT * {INV})::FLOAT"


def sql_bilinear(row0: str, col0: str, size: int, width: int, height: int) -> list[str]:
    """The bilinear samples of a square that starts at (row0, col0); only for heights that divide the size."""
    out = []
    for y, _, _ in taps(size, height):
        for x0, x1, dx in taps(size, width):
            a, b = sql_pixel(f"{row0} + {y}", f"{col0} + {x0}"), sql_pixel(f"{row0} + {y}", f"{col0} + {x1}")
            out.append(f"({a} + (({b} - {a})::FLOAT * {dx!r}::FLOAT)::FLOAT)::FLOAT")
    return out


SQL_DOCUMENTS = f"(SELECT doc_id, {P} AS p, {Q} AS q FROM documents)"
