"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(c: Column | str) -> Column:
    """The column as an array of doubles."""
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def sub_vector(a: Column, part: Column | int, size: int) -> Column:
    """The ``size`` components of part 0, 1, ..."""
    start = part * size + 1
    return F.slice(a, start, size)


def projection(a: Column, direction: list[float], offset: float, width: float) -> Column:
    """floor((direction . a + offset) / width) as a long."""
    return F.floor((dot(a, F.lit([float(x) for x in direction])) + F.lit(float(offset))) / F.lit(float(width)))


def drawn_bit(hash_value: Column, projection_number: int, seed: int) -> Column:
    """A random bit for each hash value of each projection: the first one of a digest of the three."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(projection_number)), hash_value.cast("string")).cast("binary"))
    return (F.substring(digest, 1, 1) >= "8").cast("long")


def pack_bits(bits: list[Column]) -> Column:
    """One number from bits, the first one highest."""
    out = F.lit(0).cast("long")
    for b in bits:
        out = F.shiftleft(out, 1) + b
    return out


def valid(a: Column, size: int) -> Column:
    """The vector, or an error if it hasn't ``size`` components."""
    return F.when(F.size(a) == size, a).otherwise(F.raise_error(F.lit(f"a vector must have {size} components")))
