"""Chunking operator: documents -> one row per non-blank chunk (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.chunking import (
    DEFAULT_CHUNK_OVERLAP,
    DEFAULT_CHUNK_SIZE,
    chunk_spans,
    estimate_page,
)


def chunk_documents(
    docs: DataFrame,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    name_col: str = "document_name",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(document_name, chunk_id, text, chunk_start, chunk_end, page [, keep...]).

    ``chunk_id`` is the ordinal among the kept chunks of a document, from 0;
    ``page`` is estimated from the chunk start (3000 characters per page).
    A narrow transformation: partitions of ``docs`` map to partitions of chunks.
    """
    exploded = docs.select(
        F.col(name_col).alias("document_name"),
        *[F.col(k) for k in keep],
        F.posexplode(chunk_spans(F.col(text_col), size, overlap)).alias("chunk_id", "c"),
    )
    return exploded.select(
        "document_name",
        F.col("chunk_id").cast("int").alias("chunk_id"),
        F.col("c.text").alias("text"),
        F.col("c.chunk_start").alias("chunk_start"),
        F.col("c.chunk_end").alias("chunk_end"),
        estimate_page(F.col("c.chunk_start")).alias("page"),
        *[F.col(k) for k in keep],
    )
