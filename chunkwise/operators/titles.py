"""Matching document titles of an annotation corpus to file names.

Tiers, first hit wins: (1) ``title + '.txt'`` equals a file name; (2) equal after
normalisation (NFKD, strip, whitespace runs -> one space); (3) equal first 40
characters of the normalised forms.  Where several files qualify, the smallest
file name wins.  Each tier is an equi-join against files pre-aggregated to one
row per key, so a popular prefix never multiplies rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_LEN = 40


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """NFKD, strip, collapse whitespace (Python semantics, Arrow-batched)."""
    return names.map(
        lambda s: None if s is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKD", s).strip())
    )


def match_titles(titles: DataFrame, files: DataFrame, title_col: str = "title", file_col: str = "file_name") -> DataFrame:
    """(title, file_name, tier) for every distinct title; file_name/tier NULL when unmatched."""
    t = titles.select(F.col(title_col).alias("title")).distinct()
    t = t.withColumn("target", F.concat(F.col("title"), F.lit(".txt")))
    t = t.withColumn("tnorm", normalize_name(F.col("target")))
    f = files.select(F.col(file_col).alias("file_name")).distinct().withColumn("fnorm", normalize_name(F.col("file_name")))
    exact = f.select(F.col("file_name").alias("target"), F.col("file_name").alias("f1"))
    by_norm = f.groupBy("fnorm").agg(F.min("file_name").alias("f2"))
    # smallest file per prefix = smallest of the per-name minima (normalises each file once)
    by_prefix = by_norm.groupBy(F.substring("fnorm", 1, PREFIX_LEN).alias("fpre")).agg(F.min("f2").alias("f3"))
    out = (
        t.join(exact, "target", "left")
        .join(by_norm, F.col("tnorm") == F.col("fnorm"), "left")
        .join(by_prefix, F.substring(F.col("tnorm"), 1, PREFIX_LEN) == F.col("fpre"), "left")
    )
    tier: Column = F.when(F.col("f1").isNotNull(), 1).when(F.col("f2").isNotNull(), 2).when(F.col("f3").isNotNull(), 3)
    return out.select("title", F.coalesce("f1", "f2", "f3").alias("file_name"), tier.cast("int").alias("tier"))
