"""Incremental corpus ingestion with Structured Streaming.

New documents arrive as files; each micro-batch is chunked, categorized,
embedded and appended to the chunk store -- only keys not stored yet, so a
replayed batch (after a failure, before its commit reached the checkpoint)
appends nothing.  Chunking is stateless per document, so no watermark or state
store is needed; progress lives in the query's checkpoint location (a shared
folder).  ``trigger(availableNow=True)`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.operators.categorize import chunk_store
from chunkwise.operators.chunk import chunk_documents
from chunkwise.operators.embed import embed
from chunkwise.operators.store import CHUNK_KEY, append_if_absent


def one_version(docs: DataFrame) -> DataFrame:
    """One text per document name, the least: a document sent twice never ends as a mix of versions."""
    return docs.groupBy("document_name").agg(F.min("text").alias("text"))


def ingest_batch(docs: DataFrame, annotations: DataFrame | None, store_path: str, embedder=None,
                 size: int = 1000, overlap: int = 200) -> int:
    """Batch form: chunk -> categorize -> (anti-join) -> embed -> append.  Returns rows appended."""
    chunks = chunk_store(chunk_documents(one_version(docs), size, overlap), annotations)
    return append_if_absent(
        chunks, store_path, CHUNK_KEY, order=[F.col("text")],
        embed_fn=lambda df: embed(df, "text", embedder=embedder),
    )


def start_ingest_stream(
    spark: SparkSession,
    source_dir: str,
    source_schema: str,
    store_path: str,
    checkpoint_path: str,
    annotations: DataFrame | None,
    name_col: str = "document_name",
    text_col: str = "text",
    files_per_trigger: int | None = None,
    embedder=None,
    available_now: bool = True,
):
    """Start the streaming ingestion; returns the ``StreamingQuery``.

    Batches run one at a time (``foreachBatch``), which the insert-if-absent
    append relies on.
    """
    reader = spark.readStream.schema(source_schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = (
        reader.parquet(source_dir)
        .select(F.col(name_col).alias("document_name"), F.col(text_col).alias("text"))
    )

    def process(batch: DataFrame, _epoch: int) -> None:
        ingest_batch(batch, annotations, store_path, embedder)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
