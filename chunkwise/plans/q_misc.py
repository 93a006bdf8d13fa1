"""Queries: token estimates, idempotent inserts, migrations, title matching, QA corpus, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.functions.chunking import sql_chunks
from chunkwise.functions.text import WS_CLASS, sql_strip
from chunkwise.operators.annotate import annotation_summary, answers_to_spans, attach_files, category_counts
from chunkwise.operators.embed import SQL_PRODUCT_TEXT, embed, product_embedding_text
from chunkwise.operators.store import (
    CHUNK_KEY,
    PRODUCT_KEY,
    contract_key,
    migrate_down,
    migrate_up,
    new_rows,
    sql_contract_key,
)
from chunkwise.operators.titles import match_titles
from chunkwise.operators.tokens import contract_estimates, estimate_details, estimate_totals, first_files_with_tail
from chunkwise.plans.catalog import register, scratch
from chunkwise.plans.q_ingest import all_annotations, categorized_chunks, sql_categorized_chunks
from chunkwise.sources import files
from chunkwise.sources.json_elements import write_json_arrays
from chunkwise.sources.tables import SQL_CORPUS, SQL_PRODUCTS, corpus, products, sql_with, table

# ------------------------------------------------------------ token estimate --

SQL_DETAILS = f"""
SELECT 'Products' AS source, CAST(product_id AS VARCHAR) AS item, CAST(length({SQL_PRODUCT_TEXT}) AS BIGINT) AS chars,
       CAST(ceil(length({SQL_PRODUCT_TEXT}) / 4) AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS estimated_chunks,
       CAST(ceil(length({SQL_PRODUCT_TEXT}) / 4) AS BIGINT) AS embedding_tokens
FROM products
UNION ALL
SELECT 'Contracts', document_name, n, t, c, CAST(CASE WHEN c = 1 THEN t ELSE floor(t * 1.25) END AS BIGINT)
FROM (SELECT document_name, CAST(length(text) AS BIGINT) AS n, CAST(ceil(length(text) / 4) AS BIGINT) AS t,
             CAST(CASE WHEN length(text) <= 4000 THEN 1 ELSE ceil((length(text) - 4000) / 3200) + 1 END AS BIGINT) AS c
      FROM corpus)
"""


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_details(products(spark, sf_dir), corpus(spark, sf_dir))


@register("token_estimate_detail", sql_with({"products": SQL_PRODUCTS, "corpus": SQL_CORPUS}, SQL_DETAILS))
def q_token_estimate_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11 + SC12 + SC14 + U1: per product and per file token and chunk estimates."""
    return _details(spark, sf_dir)


@register(
    "token_estimate_total",
    sql_with(
        {"products": SQL_PRODUCTS, "corpus": SQL_CORPUS, "d": SQL_DETAILS},
        """SELECT coalesce(source, 'TOTAL') AS source, count(*) AS items,
                  CAST(sum(estimated_chunks) AS BIGINT) AS embedding_calls, CAST(sum(embedding_tokens) AS BIGINT) AS total_tokens,
                  round(sum(embedding_tokens) / 1000000.0 * 0.02, 8) AS estimated_cost_usd
           FROM d GROUP BY ROLLUP (source)""",
    ),
)
def q_token_estimate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 + SC13: calls, tokens and cost per source plus the grand total."""
    return estimate_totals(_details(spark, sf_dir))


@register(
    "token_estimate_top15",
    sql_with(
        {"products": SQL_PRODUCTS, "corpus": SQL_CORPUS, "d": SQL_DETAILS},
        """WITH c AS (SELECT * FROM d WHERE source = 'Contracts'),
                h AS (SELECT item AS label, chars AS raw_chars, estimated_chunks, embedding_tokens, CAST(1 AS BIGINT) AS files
                      FROM c ORDER BY item LIMIT 15)
           SELECT * FROM h
           UNION ALL
           SELECT concat('... and ', (SELECT count(*) FROM c) - (SELECT count(*) FROM h), ' more files'), NULL, NULL,
                  CAST((SELECT sum(embedding_tokens) FROM c) - (SELECT coalesce(sum(embedding_tokens), 0) FROM h) AS BIGINT),
                  CAST((SELECT count(*) FROM c) - (SELECT count(*) FROM h) AS BIGINT)
           WHERE (SELECT count(*) FROM c) > 15""",
    ),
)
def q_token_estimate_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 15 files by name and one row for the remaining files."""
    return first_files_with_tail(contract_estimates(corpus(spark, sf_dir)))


# -------------------------------------------------------- insert if absent --

STORED_MAX_IMAGES = 25  # products with at most this many images are already in the store
RESENT_MIN_IMAGES = 40  # products re-sent a second time (altered) in the same batch


@register(
    "insert_if_absent_products",
    sql_with(
        {"products": SQL_PRODUCTS},
        f"""WITH batch AS (
              SELECT *, 0 AS batch_pos FROM products
              UNION ALL
              SELECT product_id, upper(product_name), product_brand, gender, price_inr, num_images, description,
                     primary_color, 1 FROM products WHERE num_images > {RESENT_MIN_IMAGES}),
            firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY batch_pos) = 1)
            SELECT product_id, product_name, 64 AS embedding_dim FROM firsts
            WHERE product_id NOT IN (SELECT product_id FROM products WHERE num_images <= {STORED_MAX_IMAGES})""",
    ),
)
def q_insert_if_absent_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per product id in the batch, minus ids already stored, then embedded."""
    p = products(spark, sf_dir)
    stored = p.filter(F.col("num_images") <= STORED_MAX_IMAGES)
    resent = p.filter(F.col("num_images") > RESENT_MIN_IMAGES).withColumn("product_name", F.upper("product_name"))
    batch = p.withColumn("batch_pos", F.lit(0)).unionByName(resent.withColumn("batch_pos", F.lit(1)))
    fresh = new_rows(batch, stored, PRODUCT_KEY, order=[F.col("batch_pos")])
    emb = embed(fresh.withColumn("embedding_text", product_embedding_text()), "embedding_text")
    return emb.select("product_id", "product_name", F.size("embedding").alias("embedding_dim"))


STORED_LANG = "en"  # chunks of English documents are already in the store


@register(
    "insert_if_absent_chunks",
    sql_with(
        {**sql_categorized_chunks(), "langs": "SELECT concat('doc_', doc_id, '.txt') AS document_name, lang FROM documents"},
        f"""SELECT c.document_name, c.chunk_id, c.page FROM cchunks2 c
            WHERE NOT EXISTS (SELECT 1 FROM cchunks2 s JOIN langs l USING (document_name)
                              WHERE l.lang = '{STORED_LANG}' AND s.document_name = c.document_name AND s.chunk_id = c.chunk_id)""",
    ),
)
def q_insert_if_absent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose (document_name, chunk_id) is not stored yet."""
    chunks = categorized_chunks(spark, sf_dir)
    langs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"), "lang"
    )
    stored = chunks.join(langs.filter(F.col("lang") == STORED_LANG), "document_name", "left_semi")
    return new_rows(chunks, stored, CHUNK_KEY).select("document_name", "chunk_id", "page")


# ---------------------------------------------------------------- migrations --


def _stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = categorized_chunks(spark, sf_dir)
    return ch.select(
        contract_key(F.col("document_name"), F.col("chunk_id")).alias("id"),
        F.col("document_name").alias("file_name"), F.col("chunk_id").alias("chunk_index"), F.col("text").alias("content"),
    )


@register(
    "migrate_up",
    sql_with(
        {"corpus": SQL_CORPUS, "chunks": f"SELECT * FROM {sql_chunks('corpus')}"},
        f"""SELECT {sql_contract_key('document_name', 'chunk_id')} AS contract_id, document_name, chunk_id, text,
                   'Uncategorized' AS category, CAST(NULL AS INTEGER) AS page FROM chunks""",
    ),
)
def q_migrate_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: Stage 1 chunk table -> Stage 2 (renames, default category, empty page)."""
    up = migrate_up(_stage1(spark, sf_dir))
    return up.select("contract_id", "document_name", "chunk_id", "text", F.array_join("category", "|").alias("category"), "page")


@register(
    "migrate_down",
    sql_with(
        {"corpus": SQL_CORPUS, "chunks": f"SELECT * FROM {sql_chunks('corpus')}"},
        f"SELECT {sql_contract_key('document_name', 'chunk_id')} AS id, document_name AS file_name, chunk_id AS chunk_index, "
        "text AS content FROM chunks",
    ),
)
def q_migrate_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: Stage 2 -> Stage 1 (drop page and category, rename back; rows kept)."""
    ch = categorized_chunks(spark, sf_dir).withColumn("contract_id", contract_key(F.col("document_name"), F.col("chunk_id")))
    down = migrate_down(ch.select("contract_id", "document_name", "category", "chunk_id", "page", "text"))
    return down.select("id", "file_name", "chunk_index", "content")


# ------------------------------------------------------- titles and QA corpus --


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of the corpus on disk: longer than 40 characters, one space between words."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("Contract "), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(" "), F.col("source"),
                 F.lit(" master services agreement.txt")).alias("file_name"),
    )


def qa_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document titles of the QA corpus: exact, doubled spaces, same 40-char prefix, unrelated (by doc_id % 4)."""
    f = file_names(spark, sf_dir)
    stem = F.regexp_replace(F.col("file_name"), r"\.txt$", "")
    r = F.col("doc_id") % 4
    title = (
        F.when(r == 0, stem)
        .when(r == 1, F.replace(stem, F.lit(" "), F.lit("  ")))
        .when(r == 2, F.concat(F.substring(stem, 1, 40), F.lit(" amended version")))
        .otherwise(F.concat(F.lit("Unrelated filing "), F.col("doc_id").cast("string")))
    )
    return f.select("doc_id", "file_name", title.alias("title"))


SQL_FILES = """SELECT doc_id, concat('Contract ', lpad(CAST(doc_id AS VARCHAR), 6, '0'), ' ', source,
                      ' master services agreement.txt') AS file_name FROM documents"""
SQL_TITLES = """SELECT doc_id, file_name,
                  CASE doc_id % 4 WHEN 0 THEN regexp_replace(file_name, '\\.txt$', '')
                                  WHEN 1 THEN replace(regexp_replace(file_name, '\\.txt$', ''), ' ', '  ')
                                  WHEN 2 THEN concat(substring(regexp_replace(file_name, '\\.txt$', ''), 1, 40), ' amended version')
                                  ELSE concat('Unrelated filing ', doc_id) END AS title
                FROM files"""


def _sql_norm(x: str) -> str:
    return f"regexp_replace({sql_strip(x)}, '{WS_CLASS}+', ' ', 'g')"


SQL_MATCH = f"""
WITH t AS (SELECT DISTINCT title, concat(title, '.txt') AS target FROM titles),
     f AS (SELECT file_name, {_sql_norm('file_name')} AS fnorm FROM files),
     n AS (SELECT fnorm, min(file_name) AS f2 FROM f GROUP BY fnorm),
     p AS (SELECT substring(fnorm, 1, 40) AS fpre, min(file_name) AS f3 FROM f GROUP BY 1)
SELECT t.title, coalesce(f.file_name, n.f2, p.f3) AS file_name,
       CAST(CASE WHEN f.file_name IS NOT NULL THEN 1 WHEN n.f2 IS NOT NULL THEN 2 WHEN p.f3 IS NOT NULL THEN 3 END AS INTEGER) AS tier
FROM t LEFT JOIN f ON f.file_name = t.target
       LEFT JOIN n ON n.fnorm = {_sql_norm('t.target')}
       LEFT JOIN p ON p.fpre = substring({_sql_norm('t.target')}, 1, 40)
"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = qa_titles(spark, sf_dir)
    return match_titles(t.select("title"), t.select("file_name"))


@register("title_match", sql_with({"files": SQL_FILES, "titles": SQL_TITLES}, SQL_MATCH))
def q_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-tier match of QA document titles to file names."""
    return _matches(spark, sf_dir)


def qa_json_path(spark: SparkSession, sf_dir: str) -> str:
    """Write the nested QA corpus (one document entry per JSON line) and return its folder.

    Derived from the annotation spans: the id carries the category after
    ``__`` (or not, then the question quotes it, or neither), some answers
    have padding, are blank, or lack a start.
    """
    ann = all_annotations(spark, sf_dir)
    t = qa_titles(spark, sf_dir)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    s = F.col("start_char")
    spans = ann.join(t.select(name.alias("document_name"), "title"), "document_name")
    qa = F.struct(
        F.when(s % 3 != 0, F.concat(F.col("title"), F.lit("__"), F.col("category")))
        .otherwise(F.concat(F.col("title"), F.lit("_q"), s.cast("string"))).alias("id"),
        F.when((s % 3 == 0) & (s % 2 == 1), F.lit("Which clause is this?"))
        .otherwise(F.concat(F.lit('Highlight the parts (if any) of this contract related to "'), F.col("category"),
                            F.lit('" that should be reviewed by a lawyer.'))).alias("question"),
        F.array(F.struct(
            F.when(s % 11 == 0, F.lit("   ")).when(s % 5 == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" \n")))
            .otherwise(F.col("text")).alias("text"),
            F.when(s % 13 == 0, F.lit(None).cast("int")).otherwise(s).alias("answer_start"),
        )).alias("answers"),
    )
    # one entry per document and 4000-character window of span starts: bounded groups
    grouped = spans.withColumn("qa", qa).withColumn("part", F.floor(s / 4000)).groupBy("title", "document_name", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("qa.id").alias("k"), F.col("qa").alias("v")))).alias("qas")
    )
    entries = grouped.select(
        F.array(F.struct(
            F.col("title").alias("title"),
            F.array(F.struct(F.transform("qas", lambda x: x["v"]).alias("qas"))).alias("paragraphs"),
        )).alias("data")
    )
    path = scratch(spark, sf_dir, "qa_json")
    entries.write.mode("overwrite").json(path)
    return path


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = files.read_qa_corpus(spark, qa_json_path(spark, sf_dir), multiline=False)
    return answers_to_spans(qa)


SQL_QA_SPANS = f"""
WITH src AS (
  SELECT t.title, a.category AS cat, a.start_char AS s, a.text AS atext
  FROM ann a JOIN titles t ON a.document_name = concat('doc_', t.doc_id, '.txt')),
qa AS (
  SELECT title,
         CASE WHEN s % 3 <> 0 THEN concat(title, '__', cat) ELSE concat(title, '_q', s) END AS qa_id,
         CASE WHEN s % 3 = 0 AND s % 2 = 1 THEN 'Which clause is this?'
              ELSE concat('Highlight the parts (if any) of this contract related to "', cat, '" that should be reviewed by a lawyer.') END AS question,
         CASE WHEN s % 11 = 0 THEN '   ' WHEN s % 5 = 0 THEN concat('  ', atext, ' ' || chr(10)) ELSE atext END AS answer_text,
         CASE WHEN s % 13 = 0 THEN NULL ELSE s END AS answer_start
  FROM src)
SELECT title, qa_id,
       CASE WHEN len(string_split(qa_id, '__')) >= 2 THEN string_split(qa_id, '__')[2]
            WHEN regexp_extract(question, '"([^"]+)"', 1) <> '' THEN regexp_extract(question, '"([^"]+)"', 1)
            ELSE 'Unknown' END AS category,
       CAST(answer_start AS INTEGER) AS start_char,
       CAST(answer_start + length({sql_strip('answer_text')}) AS INTEGER) AS end_char,
       substring({sql_strip('answer_text')}, 1, 200) AS text
FROM qa WHERE {sql_strip('answer_text')} <> '' AND answer_start IS NOT NULL
"""


def _qa_ctes() -> dict[str, str]:
    return {"ann": sql_categorized_chunks()["ann"], "files": SQL_FILES, "titles": SQL_TITLES, "spans": SQL_QA_SPANS}


@register("qa_flatten", sql_with(_qa_ctes(), "SELECT * FROM spans"))
def q_qa_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + F5 + SC15 + SC16 + S6: nested QA JSON read with a declared schema and flattened to spans."""
    return _spans(spark, sf_dir)


@register("qa_document", sql_with(_qa_ctes(), "SELECT * FROM spans"))
def q_qa_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corpus in single JSON documents of the published layout, read in byte ranges."""
    entries = spark.read.text(qa_json_path(spark, sf_dir)).select(F.regexp_extract("value", r'^\{"data":\[(.*)\]\}$', 1).alias("element"))
    folder = f"{scratch(spark, sf_dir, 'qa_documents')}/{uuid.uuid4().hex}"
    write_json_arrays(entries, "data", folder)
    return answers_to_spans(files.read_qa_corpus(spark, folder))


@register(
    "annotation_summary",
    sql_with(
        {**_qa_ctes(), "m": SQL_MATCH},
        """SELECT count(*) FILTER (WHERE file_name IS NOT NULL) AS matched_docs,
                  count(*) FILTER (WHERE file_name IS NULL) AS unmatched_docs,
                  (SELECT count(*) FROM spans s JOIN m USING (title) WHERE m.file_name IS NOT NULL) AS total_spans,
                  (SELECT count(DISTINCT m.file_name) FROM spans s JOIN m USING (title) WHERE m.file_name IS NOT NULL)
                      AS annotated_files
           FROM m""",
    ),
)
def q_annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: matched / unmatched titles, spans and annotated files."""
    return annotation_summary(_matches(spark, sf_dir), _spans(spark, sf_dir))


@register(
    "annotation_top20",
    sql_with(
        {**_qa_ctes(), "m": SQL_MATCH},
        """SELECT category, count(*) AS n FROM spans s JOIN m USING (title) WHERE m.file_name IS NOT NULL
           GROUP BY category ORDER BY n DESC, category LIMIT 20""",
    ),
)
def q_annotation_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span count per category of the matched documents, top 20."""
    return category_counts(attach_files(_spans(spark, sf_dir), _matches(spark, sf_dir)), 20)


# ------------------------------------------------------------------ streaming --


def write_incoming(docs: DataFrame, folder: str) -> str:
    """Documents as the files that a stream finds; their number follows the size (the shuffle's partitions)."""
    docs.repartition("document_name").write.mode("overwrite").parquet(folder)
    return folder


@register(
    "stream_ingest",
    sql_with(
        sql_categorized_chunks(),
        "SELECT document_name, chunk_id, chunk_start, chunk_end, page, array_to_string(category, '|') AS categories FROM cchunks2",
    ),
)
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: documents arrive as files; a streaming query chunks, categorizes, embeds and appends new keys."""
    from chunkwise.streaming.ingest import start_ingest_stream

    run = uuid.uuid4().hex[:8]
    src = scratch(spark, sf_dir, f"stream/{run}/incoming")
    store = scratch(spark, sf_dir, f"stream/{run}/store")
    ckpt = scratch(spark, sf_dir, f"stream/{run}/checkpoint")
    write_incoming(corpus(spark, sf_dir), src)
    q = start_ingest_stream(spark, src, "document_name string, text string", store, ckpt, all_annotations(spark, sf_dir))
    q.awaitTermination()
    out = spark.read.parquet(store)
    return out.select(
        "document_name", "chunk_id", "chunk_start", "chunk_end", "page", F.array_join("category", "|").alias("categories")
    )
