"""Vector expressions: plain column builders for arrays of numbers of any dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column, p: int = 2) -> Column:
    if p == 1:
        return total(F.transform(doubles(v), F.abs))
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its length; null for a zero vector."""
    n = F.nullif(norm(v), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(doubles(v), lambda x: x / n))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if a vector has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def quantize_bytes(v: Column) -> Column:
    """127 v / max |v|, cut towards zero, as array<tinyint>; zeros for a zero vector."""
    most = F.array_max(F.transform(doubles(v), F.abs))
    return F.transform(doubles(v), lambda x: F.when(most == 0, F.lit(0)).otherwise((127 * x / F.nullif(most, F.lit(0.0))).cast("int")).cast("tinyint"))


def parse_dense(text: Column) -> Column:
    return F.split(text, r"\s*,\s*").cast("array<double>")


def parse_sparse(text: Column, dim: int) -> Column:
    """``i:v,...`` as a dense array; what is missing is 0."""
    entries = F.map_from_entries(
        F.transform(F.split(text, r"\s*,\s*"), lambda e: F.struct(F.split_part(e, F.lit(":"), F.lit(1)).cast("int"), F.split_part(e, F.lit(":"), F.lit(2)).cast("double")))
    )
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)))
