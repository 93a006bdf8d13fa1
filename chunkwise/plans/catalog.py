"""Registry of named queries over a data folder, each with an optional SQL twin.

A query is ``fn(spark, sf_dir) -> DataFrame``; its SQL twin (DuckDB dialect,
base tables registered as views) must return the same rows, same column names.
Floats are rounded (6 places; confidences 4) and arrays rendered as strings on
both sides so results can be compared exactly.
"""

from __future__ import annotations

import hashlib
import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkwise.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def scratch(spark: SparkSession, sf_dir: str, what: str) -> str:
    """A folder under the shared checkpoint directory, stable per data folder."""
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/chunkwise-scratch/{tag}/{what}"


_SHARED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table built once per session and data folder, stored as Parquet.

    Stands for a stored table (the chunk store, the annotation file): later
    queries read it, pruned to their columns, instead of recomputing it.  It
    lies below the shared checkpoint folder, so executor loss does not lose it.
    """
    key = (spark.sparkContext.applicationId, id(spark), os.path.abspath(sf_dir), name)
    df = _SHARED.get(key)
    if df is None:
        path = f"{scratch(spark, sf_dir, 'shared')}-{spark.sparkContext.applicationId}-{name}"
        built = build()
        built.write.mode("overwrite").parquet(path)
        df = _SHARED[key] = spark.read.schema(built.schema).parquet(path)
    return df


def load_all() -> None:
    """Import every query module (they register themselves)."""
    from chunkwise.plans import q_answers, q_eval, q_ingest, q_misc, q_search  # noqa: F401
