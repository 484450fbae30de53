"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths, of no length or without components."""
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) < 1)
    scale = norm(a) * norm(b)
    return F.when(bad, 0.0).when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def decode_json_vector(raw: Column) -> Column:
    """A JSON array of numbers as doubles; null for anything else and for no numbers."""
    v = F.from_json(raw.cast("string"), "array<double>")
    return F.when(F.size(v) > 0, v)
