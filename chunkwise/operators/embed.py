"""Embedding of a text column.

``embed`` appends an ARRAY<FLOAT> column.  The embedder is pluggable: any
``pandas.Series[str] -> pandas.Series[list[float]]`` callable (e.g. a client of
an embedding service) runs as an Arrow-batched pandas UDF, one call per batch.

The default offline embedder is a hashed bag of words: word tokens (lower
case, ``[\\p{L}\\p{N}_]+``) are hashed with ``md5`` to a bucket in ``[0, dim)``
and the bucket counts L2-normalised.  It is one JVM expression, no Python
worker takes part; ``sql_hashed_long`` is the same in SQL.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.functions.arrays import named, run_ends, run_lengths
from chunkwise.functions.text import sql_word_tokens, word_tokens

DEFAULT_DIM = 64


def token_buckets(text, dim: int = DEFAULT_DIM) -> Column:
    """ARRAY<BIGINT>: the hash bucket of every word token, in text order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(
        word_tokens(text),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)),
    )


def bucket_counts(buckets, dim: int = DEFAULT_DIM) -> Column:
    """ARRAY<BIGINT> of ``dim`` counts: how often each of 0 .. dim-1 stands in ``buckets``.

    Every bucket is added once, so that the sorted array is ``dim`` runs in bucket
    order; a run's length less one is the count.  One sort and one pass over it,
    whatever ``dim`` is.
    """
    buckets = F.col(buckets) if isinstance(buckets, str) else buckets
    marked = F.sort_array(F.concat(buckets, F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))))

    counts = lambda ends: F.transform(run_lengths(ends), lambda n: (n - 1).cast("long"))
    return named(marked, lambda run: named(run_ends(run), counts))


def hashed_embedding(text, dim: int = DEFAULT_DIM) -> Column:
    """ARRAY<FLOAT>: bucket counts of the text's tokens, L2-normalised in double; all zero without a token, null for null."""
    text = F.col(text) if isinstance(text, str) else text

    def normalised(counts: Column) -> Column:
        squares = F.aggregate(counts, F.lit(0).cast("long"), lambda total, c: total + c * c)
        return named(F.sqrt(squares), lambda norm: F.transform(counts, lambda c: F.when(norm > 0, c / norm).otherwise(F.lit(0.0)).cast("float")))

    return F.when(text.isNotNull(), named(bucket_counts(token_buckets(text, dim), dim), normalised))


def embed(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "embedding",
    embedder: Callable[[pd.Series], pd.Series] | None = None,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """``df`` with ``out_col`` = embedding of ``text_col``."""
    if embedder is None:
        # generated, not projected: filters and later columns then refer to the vector and do not repeat its expression
        return df.withColumn(out_col, F.explode(F.array(hashed_embedding(F.col(text_col), dim))))
    udf = F.pandas_udf(embedder, T.ArrayType(T.FloatType()))
    # the user's client is external and not idempotent in cost: never re-run it
    return df.withColumn(out_col, udf.asNondeterministic()(F.col(text_col)))


def product_embedding_text() -> Column:
    """Six labelled product fields joined by blank lines (price and image count excluded)."""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("ProductID: "), F.col("product_id").cast("string")),
        F.concat(F.lit("ProductName: "), F.col("product_name")),
        F.concat(F.lit("ProductBrand: "), F.col("product_brand")),
        F.concat(F.lit("Gender: "), F.col("gender")),
        F.concat(F.lit("PrimaryColor: "), F.col("primary_color")),
        F.concat(F.lit("Description: "), F.col("description")),
    )


SQL_PRODUCT_TEXT = (
    "concat('ProductID: ', product_id, chr(10) || chr(10), 'ProductName: ', product_name, chr(10) || chr(10), "
    "'ProductBrand: ', product_brand, chr(10) || chr(10), 'Gender: ', gender, chr(10) || chr(10), "
    "'PrimaryColor: ', primary_color, chr(10) || chr(10), 'Description: ', description)"
)


def sql_hashed_long(source: str, key_cols: str, text_expr: str, dim: int = DEFAULT_DIM) -> str:
    """SQL of the default embedding in long form: (keys..., idx, value) for non-zero entries."""
    return f"""
    (WITH toks AS (
        SELECT {key_cols}, unnest({sql_word_tokens(text_expr)}) AS tok FROM {source}
    ), cnt AS (
        SELECT {key_cols}, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS INTEGER) AS idx, count(*) AS c
        FROM toks GROUP BY ALL
    )
    SELECT {key_cols}, idx,
           CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key_cols})) AS FLOAT) AS DOUBLE) AS value
    FROM cnt)
    """


def embed_one(spark, text: str, dim: int = DEFAULT_DIM) -> list[float]:
    """Embedding of a single query string (one tiny job; returns the vector)."""
    df = spark.createDataFrame([(text,)], "text string")
    return list(embed(df, "text", dim=dim).first()["embedding"])


def sql_dense(source: str, key_cols: str, text_expr: str, dim: int = DEFAULT_DIM) -> str:
    """SQL of the default embedding as dense lists: (keys..., vec DOUBLE[])."""
    return f"""
    (WITH lf AS {sql_hashed_long(source, key_cols, text_expr, dim)},
          ks AS (SELECT DISTINCT {key_cols} FROM {source}),
          grid AS (SELECT ks.*, r.idx FROM ks, (SELECT CAST(range AS INTEGER) AS idx FROM range({dim})) r)
     SELECT {key_cols}, list(coalesce(lf.value, 0.0) ORDER BY grid.idx) AS vec
     FROM grid LEFT JOIN lf USING ({key_cols}, idx)
     GROUP BY ALL)
    """
