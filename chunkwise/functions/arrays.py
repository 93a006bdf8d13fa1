"""Array column expressions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not again in every lambda that mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_ends(ordered: Column) -> Column:
    """The places (from 0) of the last element of each run of equal ones in a non-empty sorted array."""
    places = F.sequence(F.lit(0), F.size(ordered) - 1)
    return F.filter(places, lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i + 1)))


def run_lengths(ends: Column) -> Column:
    """The lengths of the runs that end at ``ends``."""
    return F.transform(ends, lambda end, i: end - F.when(i > 0, F.get(ends, i - 1)).otherwise(-1))
