"""Parquet tables of a data folder and the logical inputs derived from them.

The logical inputs (a text corpus, span annotations, a product catalogue,
labelled vectors, agent traces) are built with Spark from the given tables, so
every query's work grows with them.  Each builder has a SQL twin (DuckDB
dialect) used by the oracle queries; both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chunkwise.functions.text import sql_strip
from chunkwise.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- corpus -----


def corpus(spark: SparkSession, sf_dir: str, paragraphs: bool = False) -> DataFrame:
    """(document_name, text): one row per document, name ``doc_<id>.txt``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("text")
    if paragraphs:  # the raw data has no blank line; doubling newlines exercises that branch
        text = F.replace(text, F.lit("\n"), F.lit("\n\n"))
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"),
        text.alias("text"),
    )


SQL_CORPUS = "SELECT concat('doc_', doc_id, '.txt') AS document_name, text FROM documents"
SQL_CORPUS_PAR = (
    "SELECT concat('doc_', doc_id, '.txt') AS document_name, replace(text, chr(10), chr(10) || chr(10)) AS text "
    "FROM documents"
)


# ----------------------------------------------------------- annotations -----

GOLD_CATEGORIES = 8


def gold_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans where a ``benchmark`` passage occurs verbatim in a document (first occurrence).

    Located with a multi-pattern scan (see ``operators.passages``), never a
    documents x passages product.
    """
    from chunkwise.operators.passages import locate_passages

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = locate_passages(docs, bench, doc_key="doc_id", passage_key="item_id")
    return found.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"),
        F.concat(F.lit("Cat "), (F.col("item_id") % GOLD_CATEGORIES).cast("string")).alias("category"),
        F.col("start_char").cast("int").alias("start_char"),
        (F.col("start_char") + F.col("passage_len")).cast("int").alias("end_char"),
        F.substring(F.col("passage"), 1, 200).alias("text"),
    )


SQL_ANN_GOLD = f"""
SELECT concat('doc_', d.doc_id, '.txt') AS document_name,
       concat('Cat ', b.item_id % {GOLD_CATEGORIES}) AS category,
       CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS start_char,
       CAST(strpos(d.text, b.text) - 1 + length(b.text) AS INTEGER) AS end_char,
       left(b.text, 200) AS text
FROM documents d JOIN benchmark b ON contains(d.text, b.text)
"""


def dense_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arithmetic spans per document (categories: lang, source, ``Cat 2``)."""
    docs = table(spark, sf_dir, "documents")
    j = F.col("j")
    n = F.nullif(F.col("n_chars"), F.lit(0))
    start = ((F.col("doc_id") * 37 + j * 911) % n).cast("int")
    end = F.least(start + F.lit(120), n.cast("int"))
    return (
        docs.select("doc_id", "text", "n_chars", "lang", "source", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
        .select(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"),
            F.when(j == 0, F.col("lang")).when(j == 1, F.col("source")).otherwise(F.concat(F.lit("Cat "), j.cast("string"))).alias("category"),
            start.alias("start_char"),
            end.alias("end_char"),
            F.substring(F.col("text"), start + 1, end - start).alias("text"),
        )
    )


SQL_ANN_DENSE = """
SELECT concat('doc_', doc_id, '.txt') AS document_name,
       CASE WHEN j = 0 THEN lang WHEN j = 1 THEN source ELSE concat('Cat ', j) END AS category,
       CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char,
       substring(text, s + 1, e - s) AS text
FROM (
  SELECT doc_id, lang, source, text, j, s, least(s + 120, n_chars) AS e
  FROM (SELECT d.*, j, (doc_id * 37 + j * 911) % nullif(n_chars, 0) AS s
        FROM documents d, range(3) t(j))
)
"""


# ------------------------------------------------------------- products -----


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalogue rows in the store schema (no embedding yet)."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("int").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("product_brand"),
        F.col("p_type").alias("gender"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price_inr"),
        F.col("p_size").cast("int").alias("num_images"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        F.split(F.col("p_name"), " ")[0].alias("primary_color"),
    )


SQL_PRODUCTS = """
SELECT CAST(p_partkey AS INTEGER) AS product_id, p_name AS product_name, p_brand AS product_brand,
       p_type AS gender, CAST(p_retailprice AS DECIMAL(10,2)) AS price_inr,
       CAST(p_size AS INTEGER) AS num_images, concat_ws(' ', p_name, p_brand, p_type) AS description,
       split_part(p_name, ' ', 1) AS primary_color
FROM part
"""


# -------------------------------------------------------------- vectors -----

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk-like vector rows: (vec_id, embedding, label, category ARRAY<STRING>)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        "embedding",
        "label",
        F.array(F.concat(F.lit("L"), F.col("label").cast("string")), F.lit("all")).alias("category"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector also acts as a query (searching within its own label)."""
    v = vectors(spark, sf_dir)
    return v.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label",
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("query_category"),
    )


SQL_VECTORS = "SELECT vec_id, embedding, label, [concat('L', label), 'all'] AS category FROM embeddings"
SQL_VECTOR_QUERIES = (
    "SELECT vec_id AS query_id, embedding AS query_vec, label, concat('L', label) AS query_category FROM embeddings"
)


# --------------------------------------------------------------- traces -----

TOOLS = ("retrieve_contracts", "retrieve_products")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent message parts from ``conversations``.

    A user turn is a tool call, the assistant turn after it the tool's return;
    system turns carry no part.  Call ids exist only for even ``conv_id`` (odd
    runs exercise the id-less pairing); a third of the calls carry invalid
    JSON arguments.
    """
    conv = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    tool = F.when(F.length("text") % 3 == 0, F.lit(TOOLS[1])).otherwise(F.lit(TOOLS[0]))
    words = F.regexp_replace("text", "[^A-Za-z ]", "")
    args = F.when(
        F.col("conv_id") % 3 == 0, F.col("text")
    ).otherwise(F.concat(F.lit('{"search_query": "'), words, F.lit('"}')))
    base = conv.select(
        "conv_id", "turn", "role", "text",
        F.lag("role").over(w).alias("prev_role"),
        F.lag("text").over(w).alias("prev_text"),
        F.lag("turn").over(w).alias("prev_turn"),
    )
    is_call = F.col("role") == "user"
    is_return = F.col("role") == "assistant"
    call_id = F.when(
        F.col("conv_id") % 2 == 0,
        F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"),
                 F.when(is_call, F.col("turn")).otherwise(F.col("prev_turn")).cast("string")),
    )
    prev_tool = F.when(F.length("prev_text") % 3 == 0, F.lit(TOOLS[1])).otherwise(F.lit(TOOLS[0]))
    return base.filter(is_call | is_return).select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("seq"),
        F.when(is_call, F.lit("tool-call")).otherwise(F.lit("tool-return")).alias("part_kind"),
        F.when(is_call, tool).when(F.col("prev_role") == "user", prev_tool).otherwise(F.lit(TOOLS[0])).alias("tool_name"),
        F.when(is_call, call_id).when(F.col("prev_role") == "user", call_id).alias("tool_call_id"),
        F.when(is_call, args).alias("args"),
        F.when(is_return, F.col("text")).alias("content"),
    )


SQL_TRACES = """
SELECT conv_id AS run_id, turn AS seq,
       CASE WHEN role = 'user' THEN 'tool-call' ELSE 'tool-return' END AS part_kind,
       CASE WHEN role = 'user' THEN (CASE WHEN length(text) % 3 = 0 THEN 'retrieve_products' ELSE 'retrieve_contracts' END)
            WHEN prev_role = 'user' THEN (CASE WHEN length(prev_text) % 3 = 0 THEN 'retrieve_products' ELSE 'retrieve_contracts' END)
            ELSE 'retrieve_contracts' END AS tool_name,
       CASE WHEN conv_id % 2 = 0 AND (role = 'user' OR prev_role = 'user')
            THEN concat('call_', conv_id, '_', CASE WHEN role = 'user' THEN turn ELSE prev_turn END) END AS tool_call_id,
       CASE WHEN role = 'user' THEN
            CASE WHEN conv_id % 3 = 0 THEN text
                 ELSE concat('{"search_query": "', regexp_replace(text, '[^A-Za-z ]', '', 'g'), '"}') END
       END AS args,
       CASE WHEN role = 'assistant' THEN text END AS content
FROM (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text, lag(turn) OVER w AS prev_turn
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role IN ('user', 'assistant')
"""


def sql_with(views: dict[str, str], body: str) -> str:
    """``WITH v1 AS (...), ... body``."""
    if not views:
        return body
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in views.items())
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


__all__ = [
    "TABLES", "table", "corpus", "gold_annotations", "dense_annotations", "products", "vectors",
    "vector_queries", "traces", "sql_with", "sql_strip",
]
