"""Annotation preparation: QA answers -> clause spans, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.text import py_strip

SNIPPET_CHARS = 200


def category_of(qa_id: Column, question: Column) -> Column:
    """The part after the first ``__`` of the QA id; else the first double-quoted text of the question; else ``Unknown``."""
    parts = F.split(qa_id, "__")
    quoted = F.regexp_extract(question, r'"([^"]+)"', 1)
    return (
        F.when(F.size(parts) >= 2, parts[1])
        .when(quoted != "", quoted)
        .otherwise(F.lit("Unknown"))
    )


def answers_to_spans(qa: DataFrame) -> DataFrame:
    """Valid answers (non-blank text, known start) -> (title, qa_id, category, start_char, end_char, text).

    ``end_char = start + length(stripped text)``; the stored text is the
    stripped text cut to 200 characters (the span keeps its full length).
    """
    stripped = py_strip(F.col("answer_text"))
    valid = qa.filter((stripped != "") & F.col("answer_start").isNotNull())
    return valid.select(
        "title", "qa_id",
        category_of(F.col("qa_id"), F.col("question")).alias("category"),
        F.col("answer_start").cast("int").alias("start_char"),
        (F.col("answer_start") + F.length(stripped)).cast("int").alias("end_char"),
        F.substring(stripped, 1, SNIPPET_CHARS).alias("text"),
    )


def attach_files(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Spans of matched titles keyed by the matched file name (``document_name``)."""
    m = matches.filter(F.col("file_name").isNotNull()).select("title", F.col("file_name").alias("document_name"))
    return spans.join(m, "title")


def annotation_summary(matches: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: matched titles, unmatched titles, spans of matched titles, annotated files."""
    kinds = matches.select(
        F.lit(1).alias("kind"), F.col("file_name").isNotNull().alias("flag"), F.lit(None).cast("string").alias("doc")
    ).unionByName(
        attach_files(spans, matches).select(F.lit(2).alias("kind"), F.lit(True).alias("flag"), F.col("document_name").alias("doc"))
    )
    k = F.col("kind")
    return kinds.agg(
        F.count_if((k == 1) & F.col("flag")).alias("matched_docs"),
        F.count_if((k == 1) & ~F.col("flag")).alias("unmatched_docs"),
        F.count_if(k == 2).alias("total_spans"),
        F.count_distinct(F.when(k == 2, F.col("doc"))).alias("annotated_files"),
    )


def category_counts(spans: DataFrame, top: int = 20) -> DataFrame:
    """Span count per category, the ``top`` largest (ties by name)."""
    return spans.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("category")).limit(top)
