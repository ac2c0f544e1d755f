"""Perceptual hash stages as Column expressions, for pixels that are already in array columns.

All arithmetic is 32-bit in the order given, because ties decide bits. ``operators.kernels`` has the same stages for whole
pictures.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import f32
from .u64 import bits_to_u64


def exact_sha256(content: Column) -> Column:
    """32-byte exact hash of BINARY content; null of null."""
    return F.unhex(F.sha2(content, 256))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey level of 8-bit red, green and blue, in whole numbers."""
    return F.shiftright(r.cast("int") * 77 + g.cast("int") * 150 + b.cast("int") * 29, 8)


def scaled(pixel: Column) -> Column:
    """0..255 to 0..1: multiplied by the 32-bit value of 1/255, not divided."""
    return f32(pixel) * f32(float(np.float32(1.0 / 255.0)))


def mean_threshold(pixels: Column) -> Column:
    """64 bits: value >= mean, where the mean is the sequential 32-bit sum over 64."""
    total = F.aggregate(pixels, f32(0.0), lambda s, x: f32(s + f32(x)))
    return F.transform(F.array(total), lambda t: bits_to_u64(F.transform(pixels, lambda x: f32(x) >= f32(t / f32(64.0)))))[0]


def median_threshold(coefficients: Column) -> Column:
    """64 bits: value >= the upper median (index 32 of the sorted values). A NaN is never >= anything; a NaN median gives 0."""
    median = F.element_at(F.array_sort(coefficients), 33)
    packed = F.transform(F.array(median), lambda m: bits_to_u64(F.transform(coefficients, lambda x: ~F.isnan(x) & ~F.isnan(m) & (x >= m))))[0]
    return packed


def taps(size: int, out: int) -> list[tuple[int, int, float]]:
    """Of each output position the two source positions and the weight of the second; aligned at the first pixel."""
    ratio = np.float32(size) / np.float32(out)
    found = []
    for i in range(out):
        at = np.float32(i) * ratio
        first = int(at)
        found.append((first, min(first + 1, size - 1), float(np.float32(at - np.float32(first)))))
    return found


def bilinear(pixel: object, size: int, width: int, height: int) -> list[Column]:
    """Bilinear resampling of a square picture; ``pixel(row, column)`` gives the Column of a source pixel. Row by row."""
    rows, columns = taps(size, height), taps(size, width)
    out = []
    for y0, y1, dy in rows:
        for x0, x1, dx in columns:
            upper = f32(pixel(y0, x0) + f32(f32(pixel(y0, x1) - pixel(y0, x0)) * f32(dx)))
            if dy == 0:
                out.append(upper)
                continue
            lower = f32(pixel(y1, x0) + f32(f32(pixel(y1, x1) - pixel(y1, x0)) * f32(dx)))
            out.append(f32(upper + f32(f32(lower - upper) * f32(dy))))
    return out


def gradient(grid: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits of a 9 x 8 grid: a pixel is brighter than the one to its right."""
    pairs = F.array(*(F.array(F.lit(y * width + x + 1), F.lit(y * width + x + 2)) for y in range(height) for x in range(width - 1)))
    return bits_to_u64(F.transform(pairs, lambda p: F.element_at(grid, p[0]) > F.element_at(grid, p[1])))


def box_halved(pixels: Column, size: int = 64) -> Column:
    """2 x 2 means of a square picture, added left to right, row by row."""
    half = size // 2
    at = lambda i, dy, dx: F.element_at(pixels, ((F.floor(i / half) * 2 + dy) * size + (i % half) * 2 + dx + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), lambda i: f32(f32(f32(f32(at(i, 0, 0) + at(i, 0, 1)) + at(i, 1, 0)) + at(i, 1, 1)) * f32(0.25)))
