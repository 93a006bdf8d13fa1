"""Stratified, seeded sampling of annotation spans: at most n per category.

Order inside a category is ``md5(seed | document | category | start | end | text)``,
reproducible on any engine.  ``row_number() <= n`` over the category window is
planned as a partial top-n before the shuffle (``WindowGroupLimit``), so even a
category holding a third of all spans sends only n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.functions.text import is_blank, sql_strip

DEFAULT_LIMIT = 50
SMOKE_LIMIT = 5
DEFAULT_SEED = 42


def sample_key(seed: int) -> Column:
    return F.md5(
        F.concat_ws(
            "|", F.lit(str(seed)), F.col("document_name"), F.col("category"),
            F.col("start_char").cast("string"), F.col("end_char").cast("string"), F.col("text"),
        )
    )


def annotation_id() -> Column:
    """Stable span id (same text in SQL: ``sql_annotation_id``)."""
    return F.substring(
        F.md5(F.concat_ws("|", F.col("document_name"), F.col("category"), F.col("start_char").cast("string"),
                          F.col("end_char").cast("string"), F.col("text"))), 1, 16)


def sql_annotation_id(p: str = "") -> str:
    return (f"substring(md5(concat_ws('|', {p}document_name, {p}category, CAST({p}start_char AS VARCHAR), "
            f"CAST({p}end_char AS VARCHAR), {p}text)), 1, 16)")


def stratified_sample(
    annotations: DataFrame,
    limit_per_category: int = DEFAULT_LIMIT,
    seed: int = DEFAULT_SEED,
    categories: list[str] | None = None,
) -> DataFrame:
    """Spans with non-blank text, at most ``limit_per_category`` per category.

    ``categories`` restricts and orders the categories (unknown ones are
    skipped); ``category_pos`` keeps that order (or is NULL without a list).
    Adds ``ann_id``, ``category_pos`` and ``slot`` (1-based rank in the category).
    """
    spark = annotations.sparkSession
    spans = annotations.filter(F.col("text").isNotNull() & ~is_blank("text"))
    if categories:
        wanted = spark.createDataFrame(
            [(c.strip(), i) for i, c in enumerate(categories) if c and c.strip()], "category string, category_pos int"
        ).dropDuplicates(["category"])
        spans = spans.join(F.broadcast(wanted), "category", "inner")  # a parameter list: tiny
    else:
        spans = spans.withColumn("category_pos", F.lit(None).cast("int"))
    w = Window.partitionBy("category").orderBy(sample_key(seed), F.col("document_name"), F.col("start_char"))
    ranked = spans.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= limit_per_category)
    # equal spans may be sampled more than once: each is a case of its own
    same = Window.partitionBy("document_name", "category", "start_char", "end_char", "text").orderBy("slot")
    nth = F.row_number().over(same)
    return ranked.withColumn("ann_id", F.when(nth == 1, annotation_id()).otherwise(F.concat(annotation_id(), F.lit("#"), nth.cast("string"))))


def sql_stratified_sample(ann_cte: str, limit: int = DEFAULT_LIMIT, seed: int = DEFAULT_SEED) -> str:
    return f"""
    SELECT * EXCLUDE (nth), {sql_annotation_id()} || CASE WHEN nth = 1 THEN '' ELSE '#' || nth END AS ann_id FROM (
     SELECT *, row_number() OVER (PARTITION BY document_name, category, start_char, end_char, text ORDER BY slot) AS nth FROM (
      SELECT *, CAST(NULL AS INTEGER) AS category_pos,
             row_number() OVER (PARTITION BY category ORDER BY
                md5(concat_ws('|', '{seed}', document_name, category, CAST(start_char AS VARCHAR),
                                   CAST(end_char AS VARCHAR), text)), document_name, start_char) AS slot
      FROM {ann_cte} WHERE text IS NOT NULL AND {sql_strip('text')} <> '')
    WHERE slot <= {limit})
    """
