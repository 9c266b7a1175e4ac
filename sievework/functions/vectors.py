"""Vectors of 8-bit integers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n))


def quantized(v: Column) -> Column:
    """array<int> of -127 to 127 from a normalised vector; halves go up."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x * 127 + 0.5).cast("int"))))


def stored_norm(q: Column) -> Column:
    """The length of a quantised vector, one for zero vectors."""
    n = norm(q)
    return F.when(n == 0, 1.0).otherwise(n)


def dot(a: Column, b: Column) -> Column:
    """The integer product of two quantised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    return dot(a, b) / (norm_a * norm_b)


def to_bytes(q: Column) -> Column:
    """A byte for each component, as binary."""
    return F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), ""))


def from_bytes(b: Column) -> Column:
    """The inverse of ``to_bytes``."""
    h = F.hex(b)
    cells = F.transform(F.sequence(F.lit(0), F.length(h) / 2 - 1).cast("array<int>"), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(h) > 0, F.transform(cells, lambda x: F.when(x > 127, x - 256).otherwise(x))).otherwise(F.array().cast("array<int>"))
