"""Numpy stages of the fingerprint: grey, resampling, regions and hashes. No Spark in here."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIZE = 256
REGION = 32
BLOCK = 64
GRID = 4
_INV255 = np.float32(1.0 / 255.0)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey levels of (…, 3) bytes, by whole-number weights."""
    c = rgb.astype(np.uint32)
    return ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8).astype(np.uint8)


def to_rgb(pixels: np.ndarray) -> np.ndarray:
    """(h, w, 3) bytes of grey, grey-alpha, RGB or RGBA pixels. Alpha is dropped, not blended."""
    if pixels.ndim == 2:
        pixels = pixels[..., None]
    if pixels.shape[2] in (1, 2):
        return np.repeat(pixels[..., :1], 3, axis=2)
    return np.ascontiguousarray(pixels[..., :3])


@lru_cache(maxsize=256)
def lanczos_weights(size: int, out: int, lobes: int = 3) -> np.ndarray:
    """(out, size) weights of a Lanczos filter whose support grows with the reduction; each row adds up to 1."""
    scale = max(1.0, size / out)
    centre = (np.arange(out) + 0.5) * size / out - 0.5
    x = (np.arange(size)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling of byte pixels, first along rows, then along columns; rounded to bytes after each."""
    h, w, c = rgb.shape
    if w != width:
        columns = lanczos_weights(w, width) @ rgb.transpose(1, 0, 2).reshape(w, h * c).astype(np.float32)
        rgb = _to_byte(columns).reshape(width, h, c).transpose(1, 0, 2)
    if h != height:
        rgb = _to_byte(lanczos_weights(h, height) @ rgb.reshape(h, width * c).astype(np.float32)).reshape(height, width, c)
    return rgb


def _to_byte(x: np.ndarray) -> np.ndarray:
    """Rounded half up."""
    x += np.float32(0.5)
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


def normalise(pixels: np.ndarray) -> np.ndarray:
    """256 x 256 grey levels of a picture of any size; the aspect ratio isn't kept."""
    return luma(resize(to_rgb(pixels), SIZE, SIZE))


def global_region(grey: np.ndarray) -> np.ndarray:
    """(…, 32, 32): the centre of the normalised picture, 0..1."""
    at = (SIZE - REGION) // 2
    return grey[..., at : at + REGION, at : at + REGION].astype(np.float32) * _INV255


def block_grid(grey: np.ndarray) -> np.ndarray:
    """(…, 16, 64, 64): the blocks row by row, 0..1."""
    lead = grey.shape[:-2]
    cut = grey.reshape(*lead, GRID, BLOCK, GRID, BLOCK).swapaxes(-3, -2)
    return cut.reshape(*lead, GRID * GRID, BLOCK, BLOCK).astype(np.float32) * _INV255


@lru_cache(maxsize=64)
def _taps(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(out, dtype=np.float32) * (np.float32(size) / np.float32(out))
    first = at.astype(np.int64)
    return first, np.minimum(first + 1, size - 1), at - first.astype(np.float32)


def bilinear(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resampling of (…, h, w) float pixels, aligned at the first pixel."""
    h, w = x.shape[-2:]
    if min(h, w, width, height) < 1:
        raise ValueError("sizes must be positive")
    y0, y1, dy = _taps(h, height)
    x0, x1, dx = _taps(w, width)
    along = lambda rows: rows[..., x0] + (rows[..., x1] - rows[..., x0]) * dx
    upper, lower = along(x[..., y0, :]), along(x[..., y1, :])
    return upper + (lower - upper) * dy[:, None]


def box_halved(x: np.ndarray) -> np.ndarray:
    """2 x 2 means."""
    return (x[..., ::2, ::2] + x[..., ::2, 1::2] + x[..., 1::2, ::2] + x[..., 1::2, 1::2]) * np.float32(0.25)


def pack(bits: np.ndarray) -> np.ndarray:
    """(…, 64) booleans, most significant first, as BIGINT bit patterns."""
    return np.packbits(bits, axis=-1).view(">i8")[..., 0].astype(np.int64)


def mean_bits(x: np.ndarray) -> np.ndarray:
    """(…, 64): value >= mean; the sum runs in order, in 32 bits."""
    mean = np.cumsum(x, axis=-1, dtype=np.float32)[..., -1:] / np.float32(64)
    return pack(x >= mean)


def ahash(x: np.ndarray) -> np.ndarray:
    """Average hash of (…, 32, 32) or (…, 64, 64) pixels."""
    small = bilinear(x, 8, 8)
    return mean_bits(small.reshape(*small.shape[:-2], 64))


def dhash(x: np.ndarray) -> np.ndarray:
    """Difference hash: brighter than the pixel to the right."""
    small = bilinear(x, 9, 8)
    return pack((small[..., :-1] > small[..., 1:]).reshape(*small.shape[:-2], 64))


def dct_low(x: np.ndarray, keep: int = 8) -> np.ndarray:
    """The first ``keep`` coefficients of the 32-point DCT-II along the last axis, scaled by 2/32. By a Fourier
    transform of the even entries followed by the odd ones backwards, so that flat input gives exact zeros."""
    n = x.shape[-1]
    spectrum = np.fft.rfft(np.concatenate([x[..., ::2], x[..., ::-2]], axis=-1))[..., :keep]
    angle = (-np.float32(np.pi) * np.arange(keep, dtype=np.float32) / np.float32(2 * n)).astype(np.float32)
    return ((spectrum.real * np.cos(angle) - spectrum.imag * np.sin(angle)) * np.float32(2.0 / n)).astype(np.float32)


def median_bits(coefficients: np.ndarray) -> np.ndarray:
    """(…, 64): value >= upper median. NaN sorts last and is never >= anything, so a NaN median gives 0."""
    median = np.sort(coefficients, axis=-1)[..., 32:33]
    with np.errstate(invalid="ignore"):
        return pack(coefficients >= median)


def phash(x: np.ndarray) -> np.ndarray:
    """Frequency hash of (…, 32, 32) pixels; 64 x 64 ones are halved first. A pixel that isn't finite gives 0."""
    finite = np.isfinite(x).all(axis=(-2, -1))
    if x.shape[-1] == BLOCK:
        x = box_halved(x)
    with np.errstate(invalid="ignore", over="ignore"):
        rows = dct_low(x)  # (…, 32, 8)
        low = dct_low(rows.swapaxes(-1, -2))  # (…, column 8, row 8)
    return np.where(finite, median_bits(low.swapaxes(-1, -2).reshape(*x.shape[:-2], 64)), 0)


HASHES = {"ahash": ahash, "phash": phash, "dhash": dhash}


def fingerprint(grey: np.ndarray, algorithms: tuple[str, ...] = ("ahash", "phash", "dhash")) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of (n, 256, 256) grey pictures, global hash (n,) and block hashes (n, 16) of each algorithm."""
    centre, blocks = global_region(grey), block_grid(grey)
    return {a: (HASHES[a](centre), HASHES[a](blocks)) for a in algorithms}
