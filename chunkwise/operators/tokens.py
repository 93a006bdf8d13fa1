"""Token and cost estimates for embedding a corpus and a product catalogue.

* chunk count of a document (closed form, no chunking): 1 if n <= 4000 else
  ceil((n - 4000) / 3200) + 1;
* embedding tokens: the raw count for one chunk, else int(raw * 1.25)
  (overlap re-embeds a quarter);
* cost = tokens / 1e6 * 0.02 USD.

Token counting is pluggable: the default is the native ``ceil(chars / 4)``
rule; ``bpe_counter()`` gives an Arrow-batched pandas UDF over a tiktoken
encoding when its vocabulary file is available.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.functions.chunking import (
    DEFAULT_CHUNK_OVERLAP,
    DEFAULT_CHUNK_SIZE,
    estimated_chunk_count,
)
from chunkwise.operators.embed import product_embedding_text

# Embedding price in USD per one million tokens.
COST_PER_MILLION = 0.02
OVERLAP_FACTOR = DEFAULT_CHUNK_SIZE / (DEFAULT_CHUNK_SIZE - DEFAULT_CHUNK_OVERLAP)  # 1.25


def approx_tokens(text) -> Column:
    """Native default: ceil(characters / 4)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def bpe_counter(encoding: str = "cl100k_base"):
    """Pandas UDF counting BPE tokens (needs the encoding's vocabulary locally)."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.get_encoding(encoding)
        return pd.Series([len(enc.encode(t)) if t is not None else None for t in texts], dtype="Int64")

    return count


def cost(tokens: Column) -> Column:
    return tokens / F.lit(1_000_000.0) * F.lit(COST_PER_MILLION)


def contract_estimates(docs: DataFrame, counter=None) -> DataFrame:
    """Per file: (file_name, raw_chars, raw_tokens, estimated_chunks, embedding_tokens)."""
    counter = counter or approx_tokens
    base = docs.select(
        F.col("document_name").alias("file_name"),
        F.length("text").cast("long").alias("raw_chars"),
        counter(F.col("text")).alias("raw_tokens"),
    )
    chunks = estimated_chunk_count(F.col("raw_chars"))
    return base.withColumn("estimated_chunks", chunks).withColumn(
        "embedding_tokens",
        F.when(F.col("estimated_chunks") == 1, F.col("raw_tokens")).otherwise(
            F.floor(F.col("raw_tokens") * F.lit(OVERLAP_FACTOR))
        ).cast("long"),
    )


def product_estimates(products: DataFrame, counter=None) -> DataFrame:
    """Per product: (product_id, product_name, text_chars, tokens) of the embedding text."""
    counter = counter or approx_tokens
    text = product_embedding_text()
    return products.select(
        "product_id", "product_name",
        F.length(text).cast("long").alias("text_chars"),
        counter(text).alias("tokens"),
    )


def estimate_details(products: DataFrame | None, docs: DataFrame | None, counter=None) -> DataFrame:
    """Both sources in one shape: (source, item, chars, tokens, estimated_chunks, embedding_tokens).

    A missing source (None) contributes no rows (the reference reports it as an error and skips it).
    """
    parts = []
    if products is not None:
        p = product_estimates(products, counter)
        parts.append(p.select(
            F.lit("Products").alias("source"), F.col("product_id").cast("string").alias("item"),
            F.col("text_chars").alias("chars"), F.col("tokens"), F.lit(1).cast("long").alias("estimated_chunks"),
            F.col("tokens").alias("embedding_tokens"),
        ))
    if docs is not None:
        c = contract_estimates(docs, counter)
        parts.append(c.select(
            F.lit("Contracts").alias("source"), F.col("file_name").alias("item"), F.col("raw_chars").alias("chars"),
            F.col("raw_tokens").alias("tokens"), "estimated_chunks", "embedding_tokens",
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def estimate_totals(details: DataFrame) -> DataFrame:
    """Per source and a grand total (``rollup``): items, embedding calls, tokens, cost."""
    agg = details.rollup("source").agg(
        F.count("*").alias("items"),
        F.sum("estimated_chunks").alias("embedding_calls"),
        F.sum("embedding_tokens").alias("total_tokens"),
    )
    return agg.select(
        F.coalesce(F.col("source"), F.lit("TOTAL")).alias("source"),
        "items", "embedding_calls", "total_tokens",
        F.round(cost(F.col("total_tokens")), 8).alias("estimated_cost_usd"),
    )


def first_files_with_tail(contracts: DataFrame, show: int = 15) -> DataFrame:
    """The first ``show`` files by name plus one row summing the remaining files.

    The head is a distributed top-k (``TakeOrderedAndProject``); the tail is
    the total minus the head, so no global window orders the whole table.
    """
    head = contracts.orderBy("file_name").limit(show).select(
        F.col("file_name").alias("label"), "raw_chars", "estimated_chunks", "embedding_tokens",
        F.lit(1).cast("long").alias("files"),
    )
    tagged = contracts.select(F.lit(1).alias("kind"), "embedding_tokens").unionByName(
        head.select(F.lit(2).alias("kind"), "embedding_tokens")
    )
    kind = F.col("kind")
    sums = tagged.agg(
        (F.count_if(kind == 1) - F.count_if(kind == 2)).alias("rest"),
        (F.coalesce(F.sum(F.when(kind == 1, F.col("embedding_tokens"))), F.lit(0))
         - F.coalesce(F.sum(F.when(kind == 2, F.col("embedding_tokens"))), F.lit(0))).alias("rest_tokens"),
    )
    tail = sums.filter(F.col("rest") > 0).select(
        F.concat(F.lit("... and "), F.col("rest").cast("string"), F.lit(" more files")).alias("label"),
        F.lit(None).cast("long").alias("raw_chars"),
        F.lit(None).cast("long").alias("estimated_chunks"),
        F.col("rest_tokens").cast("long").alias("embedding_tokens"),
        F.col("rest").cast("long").alias("files"),
    )
    return head.unionByName(tail)
