"""Unsigned 64-bit hashes held in BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HASH_BITS, HashAlgorithm


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits, INT in 0..64; null if a side is null."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hex64(c: Column | str) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(_col(c)), 16, "0"))


def unsigned_text(c: Column | str) -> Column:
    """Decimal digits of the unsigned value, as unsigned JSON numbers have them."""
    return F.conv(F.hex(_col(c)), 16, 10)


def from_hex(c: Column | str) -> Column:
    """BIGINT bit pattern of up to 16 hex digits."""
    return F.conv(_col(c), 16, -10).cast("bigint")


def coarse_key(c: Column | str, bits: int) -> Column:
    """The top ``bits`` bits as a bucket key. 0 bits give 0 (a shift by 64 would be a shift by 0); more than 64 count as 64."""
    bits = max(0, min(bits, HASH_BITS))
    if bits == 0:
        return F.when(_col(c).isNotNull(), F.lit(0).cast("bigint"))
    return F.shiftrightunsigned(_col(c), HASH_BITS - bits)


def bits_to_u64(bits: Column) -> Column:
    """Packs an array of 64 booleans, most significant bit first."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(bits, zero, lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def pick(multi: Column, algorithm: Column | str | HashAlgorithm) -> Column:
    """The hashes of one algorithm out of a multi fingerprint; the algorithm may differ by row."""
    if isinstance(algorithm, HashAlgorithm):
        return multi[algorithm.field]
    algorithm = _col(algorithm)
    out = None
    for a in HashAlgorithm:
        out = (out if out is not None else F).when(algorithm == a.value, multi[a.field])
    return out
