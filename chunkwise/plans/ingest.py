"""End-to-end store builds from files, as a user runs them.

``ingest_products``: catalogue CSV -> first row per id -> skip stored ids ->
embed -> append.  ``ingest_contracts``: ``*.txt`` folder + annotation JSON ->
chunk -> categorize -> skip stored (document, chunk) keys -> embed -> append.
Both are idempotent: a re-run appends nothing.  Each returns a one-row
summary DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.functions.chunking import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from chunkwise.operators.categorize import chunk_store, ingest_summary
from chunkwise.operators.chunk import chunk_documents
from chunkwise.operators.embed import embed, product_embedding_text
from chunkwise.operators.store import CHUNK_KEY, PRODUCT_KEY, append_if_absent
from chunkwise.session import cut_lineage
from chunkwise.sources import files


def ingest_products(spark: SparkSession, csv_path: str, store_path: str, embedder=None) -> DataFrame:
    """Load the catalogue CSV into the product store (new ids only)."""
    rows = files.read_products_csv(spark, csv_path).withColumn("_pos", F.monotonically_increasing_id())

    def with_embedding(df: DataFrame) -> DataFrame:
        out = embed(df.withColumn("embedding_text", product_embedding_text()), "embedding_text", embedder=embedder)
        return out.drop("embedding_text", "_pos")

    added = append_if_absent(rows, store_path, PRODUCT_KEY, order=[F.col("_pos")], embed_fn=with_embedding)
    return spark.createDataFrame([(added,)], "products_added long")


def ingest_contracts(
    spark: SparkSession,
    corpus_dir: str,
    annotations_path: str | None,
    store_path: str,
    embedder=None,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
) -> DataFrame:
    """Chunk, categorize and embed a text corpus into the chunk store (new keys only).

    A missing annotation file means every chunk is Uncategorized.  Returns the
    ingest summary (files, annotated files, chunks, categorized, uncategorized)
    plus the number of chunks appended.
    """
    docs = files.read_text_corpus(spark, corpus_dir)
    ann = files.read_annotations(spark, annotations_path, on_missing="empty") if annotations_path else None
    chunks = cut_lineage(chunk_store(chunk_documents(docs, size, overlap), ann))
    # one file a document, so no key repeats; the order only settles a store that was filled otherwise
    added = append_if_absent(chunks, store_path, CHUNK_KEY, order=[F.col("text")], embed_fn=lambda df: embed(df, "text", embedder=embedder))
    summary = ingest_summary(docs, chunks, ann)
    return summary.withColumn("chunks_added", F.lit(added).cast("long"))
