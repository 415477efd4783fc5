"""Vector measures over array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is all zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def vector_to_text(v: Column) -> Column:
    """``[a b c]``, for text formats that cannot hold arrays."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), " "), F.lit("]"))


def text_to_vector(s: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"[\[\]]", ""), r"\s+", " "))
    return F.split(bare, " ").cast("array<float>")
