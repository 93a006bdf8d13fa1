"""Queries: scans, chunking, categorisation, ingestion summary, corpus statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.functions.chunking import sql_chunks, sql_page
from chunkwise.operators.categorize import chunk_store, ingest_summary
from chunkwise.operators.chunk import chunk_documents
from chunkwise.operators.embed import SQL_PRODUCT_TEXT, product_embedding_text
from chunkwise.operators.stats import append_sketches, category_histogram, category_list, corpus_status, distinct_across_ingests
from chunkwise.plans.catalog import register, scratch, shared
from chunkwise.sources import files
from chunkwise.sources.tables import (
    SQL_ANN_DENSE,
    SQL_ANN_GOLD,
    SQL_CORPUS,
    SQL_CORPUS_PAR,
    SQL_PRODUCTS,
    corpus,
    dense_annotations,
    gold_annotations,
    products,
    sql_with,
)

# ------------------------------------------------------------- shared parts --


def all_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold passage spans plus three arithmetic spans per document (the annotation file)."""
    return shared(
        spark, sf_dir, "annotations",
        lambda: gold_annotations(spark, sf_dir).unionByName(dense_annotations(spark, sf_dir)),
    )


SQL_ALL_ANN = f"SELECT * FROM ({SQL_ANN_GOLD}) UNION ALL SELECT * FROM ({SQL_ANN_DENSE})"


def categorized_chunks(spark: SparkSession, sf_dir: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """The chunk store of the corpus: chunks with categories (built once per session)."""

    def build() -> DataFrame:
        return chunk_store(chunk_documents(corpus(spark, sf_dir), size, overlap), all_annotations(spark, sf_dir))

    return shared(spark, sf_dir, f"chunks_{size}_{overlap}", build)


def sql_categorized_chunks(size: int = 1000, overlap: int = 200) -> dict[str, str]:
    """CTEs: corpus, ann, chunks, cchunks (chunks with ``category`` list)."""
    return {
        "corpus": SQL_CORPUS,
        "ann": SQL_ALL_ANN,
        "chunks": f"SELECT * FROM {sql_chunks('corpus', size, overlap)}",
        "cchunks": f"""
            SELECT c.document_name, c.chunk_id, c.text, c.chunk_start, c.chunk_end,
                   {sql_page('c.chunk_start')} AS page,
                   coalesce(list_sort(list_distinct(list(a.category) FILTER (WHERE a.category IS NOT NULL))),
                            ['Uncategorized']) AS category0
            FROM chunks c LEFT JOIN ann a
              ON a.document_name = c.document_name AND a.start_char < c.chunk_end AND a.end_char > c.chunk_start
            GROUP BY ALL""",
        "cchunks2": """
            SELECT * EXCLUDE (category0),
                   CASE WHEN len(category0) = 0 THEN ['Uncategorized'] ELSE category0 END AS category
            FROM cchunks""",
    }


# ------------------------------------------------------------------ scans ----


@register(
    "product_scan",
    sql_with(
        {"products": SQL_PRODUCTS},
        f"SELECT product_id, product_name, product_brand, gender, CAST(price_inr AS DOUBLE) AS price_inr, "
        f"num_images, description, primary_color, {SQL_PRODUCT_TEXT} AS embedding_text FROM products",
    ),
)
def q_product_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + SC9: catalogue written as the reference's CSV, read back with the CSV reader."""
    path = scratch(spark, sf_dir, "products_csv")
    files.write_products_csv(products(spark, sf_dir), path)
    p = files.read_products_csv(spark, path)
    return p.select(
        "product_id", "product_name", "product_brand", "gender",
        F.col("price_inr").cast("double").alias("price_inr"),
        "num_images", "description", "primary_color",
        product_embedding_text().alias("embedding_text"),
    )


@register("corpus_scan", sql_with({"corpus": SQL_CORPUS}, "SELECT document_name, length(text) AS n_chars, text FROM corpus"))
def q_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S2: documents materialised as ``.txt`` files, scanned back as a text corpus."""
    path = scratch(spark, sf_dir, "corpus_txt")
    files.materialize_corpus(
        corpus(spark, sf_dir).withColumnRenamed("document_name", "file_name"), path, replace=True
    )
    docs = files.read_text_corpus(spark, path)
    return docs.select("document_name", F.length("text").cast("long").alias("n_chars"), "text")


# --------------------------------------------------------------- chunking ----

_CHUNK_COLS = "document_name, chunk_id, text, chunk_start, chunk_end"


def _chunk_query(paragraphs: bool, size: int, overlap: int):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk_documents(corpus(spark, sf_dir, paragraphs=paragraphs), size, overlap)

    return q


def _chunk_sql(src_sql: str, size: int, overlap: int) -> str:
    return sql_with(
        {"corpus": src_sql},
        f"SELECT {_CHUNK_COLS}, {sql_page('chunk_start')} AS page FROM {sql_chunks('corpus', size, overlap)}",
    )


register("chunk_default", _chunk_sql(SQL_CORPUS, 1000, 200))(_chunk_query(False, 1000, 200))
register("chunk_paragraph", _chunk_sql(SQL_CORPUS_PAR, 1000, 200))(_chunk_query(True, 1000, 200))
register("chunk_small", _chunk_sql(SQL_CORPUS, 100, 20))(_chunk_query(False, 100, 20))


# ----------------------------------------------------------- categorising ----


@register(
    "chunk_categorize",
    sql_with(
        sql_categorized_chunks(),
        "SELECT document_name, chunk_id, chunk_start, chunk_end, page, array_to_string(category, '|') AS categories, "
        "category <> ['Uncategorized'] AS categorized FROM cchunks2",
    ),
)
def q_chunk_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2 + F7: chunks of every document with the categories of overlapping spans."""
    ch = categorized_chunks(spark, sf_dir)
    return ch.select(
        "document_name", "chunk_id", "chunk_start", "chunk_end", "page",
        F.array_join("category", "|").alias("categories"),
        (F.col("category") != F.array(F.lit("Uncategorized"))).alias("categorized"),
    )


@register(
    "ingest_summary",
    sql_with(
        sql_categorized_chunks(),
        """SELECT (SELECT count(DISTINCT document_name) FROM corpus) AS files,
                  (SELECT count(DISTINCT c.document_name) FROM corpus c
                    WHERE c.document_name IN (SELECT document_name FROM ann)) AS annotated_files,
                  count(*) AS chunks,
                  count(*) FILTER (WHERE category <> ['Uncategorized']) AS categorized_chunks,
                  count(*) FILTER (WHERE category = ['Uncategorized']) AS uncategorized_chunks
           FROM cchunks2""",
    ),
)
def q_ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, annotation coverage, chunk counts."""
    return ingest_summary(corpus(spark, sf_dir), categorized_chunks(spark, sf_dir), all_annotations(spark, sf_dir))


# ------------------------------------------------------------- statistics ----


@register(
    "category_list",
    sql_with(
        sql_categorized_chunks(),
        "SELECT DISTINCT cat AS category FROM (SELECT unnest(category) AS cat FROM cchunks2) "
        "WHERE cat IS NOT NULL AND cat <> ''",
    ),
)
def q_category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 + A4: sorted distinct categories."""
    return category_list(categorized_chunks(spark, sf_dir))


@register(
    "category_top10",
    sql_with(
        sql_categorized_chunks(),
        "SELECT cat AS category, count(*) AS n FROM (SELECT unnest(category) AS cat FROM cchunks2) "
        "GROUP BY cat ORDER BY n DESC, cat LIMIT 10",
    ),
)
def q_category_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: ten most frequent categories (ties by name)."""
    return category_histogram(categorized_chunks(spark, sf_dir), 10)


@register(
    "corpus_status",
    sql_with(
        {**sql_categorized_chunks(), "products": SQL_PRODUCTS},
        """SELECT 'online' AS status, true AS tables_initialized,
                  (SELECT count(*) FROM products) AS product_count,
                  (SELECT count(*) FROM cchunks2) AS contract_count,
                  (SELECT count(DISTINCT cat) FROM (SELECT unnest(category) AS cat FROM cchunks2)) AS category_count,
                  (SELECT string_agg(cat || ':' || n, ',' ORDER BY n DESC, cat) FROM (
                      SELECT cat, count(*) AS n FROM (SELECT unnest(category) AS cat FROM cchunks2)
                      GROUP BY cat ORDER BY n DESC, cat LIMIT 10)) AS top_categories""",
    ),
)
def q_corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2 + A3 + M3: one status row over the product and chunk tables."""
    st = corpus_status(products(spark, sf_dir), categorized_chunks(spark, sf_dir))
    return st.select(
        "status", "tables_initialized", "product_count", "contract_count", "category_count",
        F.array_join(
            F.transform("top_categories", lambda s: F.concat(s["category"], F.lit(":"), s["count"].cast("string"))), ","
        ).alias("top_categories"),
    )


INGESTS = 4


@register(
    "distinct_across_ingests",
    sql_with(
        sql_categorized_chunks(),
        f"""SELECT CAST({INGESTS} AS BIGINT) AS ingests, count(*) AS n_rows, count(DISTINCT document_name) AS documents,
                  (SELECT count(DISTINCT cat) FROM (SELECT unnest(category) AS cat FROM cchunks2)) AS categories,
                  true AS documents_close, true AS categories_close FROM cchunks2""",
    ),
)
def q_distinct_across_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 by sketches: documents and categories over several appends that share them, exact beside whether the estimate is within 5 %."""
    chunks = categorized_chunks(spark, sf_dir)
    path = f"{scratch(spark, sf_dir, 'sketches')}-{uuid.uuid4().hex}"
    for i in range(INGESTS):  # every document's chunks are spread over the appends
        append_sketches(chunks.where(F.col("chunk_id") % INGESTS == i), path, str(i), documents=F.col("document_name"), categories=F.col("category"))
    told = distinct_across_ingests(spark.read.parquet(path), "documents", "categories").select(
        "ingests", "n_rows", F.col("documents").alias("d"), F.col("categories").alias("c")
    )
    exact = chunks.select("document_name", F.explode_outer("category").alias("cat")).agg(
        F.countDistinct("document_name").alias("documents"), F.countDistinct("cat").alias("categories")
    )
    both = told.unionByName(exact, allowMissingColumns=True)  # a row each
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    close = lambda estimate, true: F.abs(F.col(estimate) - F.col(true)) <= F.greatest(0.05 * F.col(true), F.lit(0.5))
    return both.select(
        "ingests", "n_rows", "documents", "categories", close("d", "documents").alias("documents_close"), close("c", "categories").alias("categories_close")
    )


@register("annotation_roundtrip", sql_with({"ann": SQL_ALL_ANN}, "SELECT document_name, category, start_char, end_char, text FROM ann"))
def q_annotation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S3: spans written as per-document annotation JSON and read back."""
    path = scratch(spark, sf_dir, "annotations_json")
    files.write_annotations(all_annotations(spark, sf_dir), path)
    back = files.read_annotation_lines(spark, path)
    return back.select("document_name", "category", "start_char", "end_char", "text")


@register("annotation_map_file", sql_with({"ann": SQL_ALL_ANN}, "SELECT document_name, category, start_char, end_char, text FROM ann"))
def q_annotation_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: spans written as ``{file: [spans]}`` documents and read back in byte ranges."""
    folder = files.write_annotation_map(all_annotations(spark, sf_dir), scratch(spark, sf_dir, "annotation_map"))
    return files.read_annotations(spark, folder).drop("ann_pos")
