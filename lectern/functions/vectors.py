"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import as_col


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: str | Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    v = as_col(v)
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in [0, 1]; 0 for empty, unequal or zero vectors."""
    a, b = as_col(a), as_col(b)
    norms = l2_norm(a) * l2_norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norms)))).otherwise(0.0)
