"""Column expressions over vectors held as ARRAY<FLOAT>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors: their dot product in double, left to right; -1 when they don't fit."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.when(F.size(a) == F.size(b), _sum(products)), F.lit(-1.0))


def l2_normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(_sum(F.transform(doubles, lambda x: x * x)))
    divisor = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    # through a one-element array, so that the norm is computed once and not again per element
    scaled = F.transform(F.array(divisor), lambda n: F.transform(doubles, lambda x: (x / n).cast("float")))
    return scaled[0]


def from_json_text(c: Column) -> Column:
    """Vector from JSON text; NULL when missing or undecodable."""
    return F.from_json(F.when(c != "", c), "array<float>")


def to_json_text(v: Column) -> Column:
    return F.to_json(v)


def is_embedded(v: Column) -> Column:
    """A vector is present (neither NULL nor empty)."""
    return F.coalesce(F.size(v) > 0, F.lit(False))
