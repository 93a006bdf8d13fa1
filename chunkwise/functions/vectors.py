"""Vector column expressions (vectors are ARRAY<FLOAT>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def l2_distance(a, b) -> Column:
    """Euclidean distance in double precision (NULL when either side is NULL or sizes differ)."""
    a, b = _c(a), _c(b)
    sq = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(a) == F.size(b), F.sqrt(sq))


def vector_literal(values) -> Column:
    """A constant query vector."""
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def sql_l2(a: str, b: str) -> str:
    return f"list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
