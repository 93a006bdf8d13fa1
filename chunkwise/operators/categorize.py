"""Chunk x annotation interval-overlap join -> category array per chunk.

A chunk gets every category whose span ``[start_char, end_char)`` overlaps its
``[chunk_start, chunk_end)`` window (``ann.start < chunk_end and ann.end >
chunk_start``); the array is sorted and distinct, or ``['Uncategorized']``.

Plan: both sides are exploded to fixed-width position buckets and joined on
``(document_name, bucket)`` plus the overlap predicate, so a very large document
spreads over many join keys instead of one task, and the join never forms all
chunk x annotation pairs of a document.  Only keys travel through that join;
the category table is then joined back to the chunk rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCATEGORIZED = "Uncategorized"
DEFAULT_BUCKET = 4000


def _bucket_range(lo: Column, hi_exclusive: Column, width: int) -> Column:
    """Buckets of positions ``lo .. max(hi-1, lo)`` (``lo`` clamped at 0)."""
    first = F.floor(F.greatest(lo, F.lit(0)) / F.lit(width)).cast("long")
    last = F.floor(F.greatest(hi_exclusive - F.lit(1), lo, F.lit(0)) / F.lit(width)).cast("long")
    return F.sequence(first, F.greatest(first, last))


def overlapping_pairs(
    chunks: DataFrame,
    annotations: DataFrame,
    bucket: int = DEFAULT_BUCKET,
    ann_cols: tuple[str, ...] = ("category",),
) -> DataFrame:
    """Distinct (document_name, chunk_id, ann_cols...) with overlapping spans."""
    ck = chunks.select(
        "document_name", "chunk_id", "chunk_start", "chunk_end",
        F.explode(_bucket_range(F.col("chunk_start"), F.col("chunk_end"), bucket)).alias("b"),
    )
    # a span can only meet chunks of its own document: bound its bucket range by that
    # document's chunk extent (one row per document), so an oversized span cannot explode
    extent = chunks.groupBy("document_name").agg(F.max(F.greatest("chunk_end", "chunk_start")).alias("doc_end"))
    bounded = annotations.join(extent, "document_name", "inner")
    hi = F.least(F.col("end_char"), F.col("doc_end") + F.lit(1))
    an = bounded.select(
        F.col("document_name").alias("a_doc"),
        F.col("start_char").alias("a_start"),
        F.col("end_char").alias("a_end"),
        *[F.col(c) for c in ann_cols],
        F.explode(_bucket_range(F.least(F.col("start_char"), F.col("doc_end")), hi, bucket)).alias("a_b"),
    )
    joined = ck.join(
        an,
        (ck["document_name"] == an["a_doc"]) & (ck["b"] == an["a_b"])
        & (an["a_start"] < ck["chunk_end"]) & (an["a_end"] > ck["chunk_start"]),
        "inner",
    )
    return joined.select("document_name", "chunk_id", *ann_cols).distinct()


def assign_categories(chunks: DataFrame, annotations: DataFrame | None, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Chunks with a ``category ARRAY<STRING>`` column (J1 + J2).

    ``annotations``: (document_name, category, start_char, end_char[, text]);
    ``None`` means no annotation file: every chunk is Uncategorized.
    ``chunks`` is read three times (bucket keys, document extents, join-back):
    pass a materialised table, not a costly lazy plan (see ``chunk_store``).
    """
    if annotations is None:
        return chunks.withColumn("category", F.array(F.lit(UNCATEGORIZED)))
    pairs = overlapping_pairs(chunks, annotations.filter(F.col("category").isNotNull()), bucket)
    cats = pairs.groupBy("document_name", "chunk_id").agg(
        F.array_sort(F.collect_set("category")).alias("cats")
    )
    out = chunks.join(cats, ["document_name", "chunk_id"], "left")
    category = F.when(F.coalesce(F.size("cats"), F.lit(0)) > 0, F.col("cats")).otherwise(
        F.array(F.lit(UNCATEGORIZED))
    )
    return out.withColumn("category", category).drop("cats")


def is_categorized(col="category") -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return ~F.coalesce(col == F.array(F.lit(UNCATEGORIZED)), F.lit(False))


def ingest_summary(docs: DataFrame, chunks: DataFrame, annotations: DataFrame | None) -> DataFrame:
    """One row: files, annotated files, chunks, categorized and uncategorized chunks.

    One aggregate over a tagged union (no join of single-row results).
    """
    files = docs.select("document_name").distinct()
    if annotations is None:
        file_rows = files.select(F.lit(1).alias("kind"), F.lit(False).alias("flag"))
    else:
        ann_docs = annotations.select("document_name").distinct().withColumn("has_ann", F.lit(True))
        file_rows = files.join(ann_docs, "document_name", "left").select(
            F.lit(1).alias("kind"), F.coalesce(F.col("has_ann"), F.lit(False)).alias("flag")
        )
    chunk_rows = chunks.select(F.lit(2).alias("kind"), is_categorized().alias("flag"))
    kind, flag = F.col("kind"), F.col("flag")
    return file_rows.unionByName(chunk_rows).agg(
        F.count_if(kind == 1).alias("files"),
        F.count_if((kind == 1) & flag).alias("annotated_files"),
        F.count_if(kind == 2).alias("chunks"),
        F.count_if((kind == 2) & flag).alias("categorized_chunks"),
        F.count_if((kind == 2) & ~flag).alias("uncategorized_chunks"),
    )


def chunk_store(chunks: DataFrame, annotations: DataFrame | None, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """Materialise the chunk rows once (reliable checkpoint), then categorize them."""
    from chunkwise.session import cut_lineage

    return assign_categories(cut_lineage(chunks), annotations, bucket)
