"""Queries: sampling, relevance labelling, retrieval cases, metrics and report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.functions.text import sql_normalize_ws, sql_word_tokens
from chunkwise.operators.embed import sql_dense
from chunkwise.operators.metrics import KEY_COMPAT, KEY_QUALIFIED, sql_case_metrics
from chunkwise.operators.relevance import label_relevance
from chunkwise.operators.sampling import sql_stratified_sample, stratified_sample
from chunkwise.plans.catalog import register, scratch
from chunkwise.plans.q_ingest import all_annotations, categorized_chunks, sql_categorized_chunks
from chunkwise.plans.retrieval_eval import retrieval_eval
from chunkwise.sources import files
from chunkwise.sources.tables import sql_with

K = 8
LIMIT = 50
SMOKE_CATEGORIES = ["Cat 2", "en", "src3", "Cat 5", "no such category"]


_EVALS: dict = {}


def evaluation(spark: SparkSession, sf_dir: str):
    """The retrieval evaluation of a data folder; its sample and labels are built once per session."""
    from chunkwise.plans.q_search import embedded_chunks

    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _EVALS:
        _EVALS[key] = retrieval_eval(
            all_annotations(spark, sf_dir), categorized_chunks(spark, sf_dir), k=K, limit_per_category=LIMIT,
            embedded_chunks=embedded_chunks(spark, sf_dir),
        )
    return _EVALS[key]


def sql_eval_ctes() -> dict[str, str]:
    """CTEs of the whole evaluation, brute force (every span x every chunk of its document)."""
    an = sql_normalize_ws("p.atext")
    cn = sql_normalize_ws("p.ctext")
    return {
        **sql_categorized_chunks(),
        "sample": sql_stratified_sample("ann", LIMIT),
        "pairs": """SELECT s.ann_id, s.document_name, c.chunk_id, s.start_char, s.end_char, s.text AS atext,
                           c.text AS ctext, c.chunk_start, c.chunk_end
                    FROM sample s JOIN cchunks2 c ON c.document_name = s.document_name""",
        "atok": f"SELECT ann_id, tok, count(*) AS a FROM (SELECT ann_id, unnest({sql_word_tokens('text')}) AS tok FROM sample) GROUP BY ALL",
        "atot": "SELECT ann_id, sum(a) AS total FROM atok GROUP BY 1",
        "ctok": f"""SELECT document_name, chunk_id, tok, count(*) AS c FROM (
                      SELECT document_name, chunk_id, unnest({sql_word_tokens('text')}) AS tok FROM cchunks2
                      WHERE document_name IN (SELECT document_name FROM sample)) GROUP BY ALL""",
        "inter": """SELECT p.ann_id, p.document_name, p.chunk_id, sum(least(a.a, c.c)) AS inter
                    FROM pairs p JOIN atok a ON a.ann_id = p.ann_id
                    JOIN ctok c ON c.document_name = p.document_name AND c.chunk_id = p.chunk_id AND c.tok = a.tok
                    GROUP BY ALL""",
        "lab0": f"""SELECT p.ann_id, p.document_name, p.chunk_id,
                           p.start_char < p.chunk_end AND p.end_char > p.chunk_start AS s1,
                           {an} <> '' AND (contains({cn}, {an}) OR contains({an}, {cn})) AS s2,
                           CASE WHEN coalesce(t.total, 0) > 0 THEN coalesce(i.inter, 0) / t.total ELSE 0.0 END AS ratio
                    FROM pairs p LEFT JOIN inter i USING (ann_id, document_name, chunk_id)
                    LEFT JOIN atot t ON t.ann_id = p.ann_id""",
        "lab": """SELECT ann_id, document_name, chunk_id, ratio,
                         CASE WHEN s1 THEN 1.0 WHEN s2 THEN 0.95 ELSE round(ratio, 4) END AS confidence,
                         CASE WHEN s1 THEN 'offset' WHEN s2 THEN 'contains' WHEN ratio >= 0.5 THEN 'tokens' END AS signal
                  FROM lab0""",
        "rel": "SELECT * FROM lab WHERE signal IS NOT NULL",
        "cases": f"""SELECT s.*, CASE WHEN s.document_name NOT IN (SELECT document_name FROM cchunks2) THEN 'no_document'
                                      WHEN s.ann_id NOT IN (SELECT ann_id FROM rel) THEN 'no_match' ELSE 'ok' END AS status
                     FROM sample s""",
        "cases_ok": "SELECT * FROM cases WHERE status = 'ok'",
        "qv": sql_dense("cases_ok", "ann_id", "text"),
        "cvec": sql_dense("cchunks2", "document_name, chunk_id", "text"),
        "ret": f"""SELECT q.ann_id, c.document_name, c.chunk_id,
                          row_number() OVER (PARTITION BY q.ann_id ORDER BY round(list_distance(cv.vec, qv.vec), 9),
                                             c.document_name, c.chunk_id) AS rank
                   FROM cases_ok q JOIN qv ON qv.ann_id = q.ann_id
                   JOIN cchunks2 c ON list_contains(c.category, q.category)
                   JOIN cvec cv ON cv.document_name = c.document_name AND cv.chunk_id = c.chunk_id
                   QUALIFY rank <= {K}""",
        "m_q": sql_case_metrics("cases_ok", "ret", "rel", K, "ann_id", KEY_QUALIFIED),
        "m_c": sql_case_metrics("cases_ok", "ret", "rel", K, "ann_id", KEY_COMPAT),
    }


# ------------------------------------------------------------------ sampling --


@register(
    "stratified_sample",
    sql_with(
        {"ann": "SELECT * FROM (" + sql_categorized_chunks()["ann"] + ")", "s": sql_stratified_sample("ann", LIMIT)},
        "SELECT ann_id, document_name, category, start_char, end_char, CAST(slot AS INTEGER) AS slot FROM s",
    ),
)
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 + F4 + W3: at most 50 non-blank spans per category, md5-seeded order."""
    s = stratified_sample(all_annotations(spark, sf_dir), LIMIT)
    return s.select("ann_id", "document_name", "category", "start_char", "end_char", F.col("slot").cast("int").alias("slot"))


def _smoke_sql() -> str:
    values = ", ".join(f"('{c}', {i})" for i, c in enumerate(SMOKE_CATEGORIES))
    return sql_with(
        {
            "ann": "SELECT * FROM (" + sql_categorized_chunks()["ann"] + ")",
            "wanted": f"SELECT * FROM (VALUES {values}) t(category, category_pos)",
            "s": sql_stratified_sample("ann", 5),
        },
        "SELECT s.ann_id, s.document_name, s.category, CAST(w.category_pos AS INTEGER) AS category_pos, "
        "CAST(s.slot AS INTEGER) AS slot FROM s JOIN wanted w USING (category)",
    )


@register("stratified_sample_smoke", _smoke_sql())
def q_stratified_sample_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 + F3: smoke mode (5 per category) over a category list, list order kept."""
    s = stratified_sample(all_annotations(spark, sf_dir), 5, categories=SMOKE_CATEGORIES)
    return s.select("ann_id", "document_name", "category", F.col("category_pos").cast("int").alias("category_pos"),
                    F.col("slot").cast("int").alias("slot"))


# ----------------------------------------------------------------- relevance --


@register(
    "token_overlap",
    sql_with(sql_eval_ctes(), "SELECT ann_id, document_name, chunk_id, round(ratio, 6) AS ratio FROM lab WHERE ratio >= 0.5"),
)
def q_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3 + SC4: span/chunk pairs whose token-multiset overlap ratio reaches 0.5."""
    ev = evaluation(spark, sf_dir)
    return ev.labels.filter(F.col("ratio") >= 0.5).select(
        "ann_id", "document_name", "chunk_id", F.round("ratio", 6).alias("ratio")
    )


@register(
    "relevance_labels",
    sql_with(sql_eval_ctes(), "SELECT ann_id, document_name, chunk_id, confidence, signal FROM rel"),
)
def q_relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5 + SC6 + J5: relevant (span, chunk) pairs with confidence and deciding signal."""
    ev = evaluation(spark, sf_dir)
    return ev.labels.select("ann_id", "document_name", "chunk_id", "confidence", "signal")


@register(
    "relevance_labels_no_offsets",
    sql_with(
        sql_eval_ctes(),
        """SELECT ann_id, document_name, chunk_id, CASE WHEN s2 THEN 0.95 ELSE round(ratio, 4) END AS confidence,
                  CASE WHEN s2 THEN 'contains' ELSE 'tokens' END AS signal
           FROM lab0 WHERE s2 OR ratio >= 0.5""",
    ),
)
def q_relevance_labels_no_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + J5: the same labels from a chunk store without offsets; containment and token overlap decide."""
    ev = evaluation(spark, sf_dir)
    chunks = categorized_chunks(spark, sf_dir).drop("chunk_start", "chunk_end")
    labels = label_relevance(ev.sample, chunks, use_offsets=False)
    return labels.select("ann_id", "document_name", "chunk_id", "confidence", "signal")


@register(
    "retrieval_cases",
    sql_with(
        sql_eval_ctes(),
        """SELECT c.ann_id,
                  concat(replace(substring(c.document_name, 1, 28), ' ', '_'), '__', replace(c.category, ' ', '_'), '__',
                         c.start_char) AS case_name,
                  c.category, c.document_name, c.start_char, c.status,
                  coalesce((SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) FROM rel
                            WHERE rel.ann_id = c.ann_id), '') AS relevant
           FROM cases c""",
    ),
)
def q_retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + SC20: every sampled span as a case, with its relevant chunk ids and status."""
    ev = evaluation(spark, sf_dir)
    return ev.cases.select(
        "ann_id", "case_name", "category", "document_name", "start_char", "status",
        F.array_join(F.transform("relevant", lambda x: x.cast("string")), ",").alias("relevant"),
    )


# ------------------------------------------------------------------- metrics --


def _metric_query(metric: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = evaluation(spark, sf_dir)
        a = ev.per_case(KEY_QUALIFIED).select("ann_id", F.lit("document_chunk").alias("key_mode"),
                                               F.round(metric, 6).alias(metric))
        b = ev.per_case(KEY_COMPAT).select("ann_id", F.lit("chunk_id").alias("key_mode"), F.round(metric, 6).alias(metric))
        return a.unionByName(b)

    return q


def _metric_sql(metric: str) -> str:
    return sql_with(
        sql_eval_ctes(),
        f"SELECT ann_id, 'document_chunk' AS key_mode, round({metric}, 6) AS {metric} FROM m_q "
        f"UNION ALL SELECT ann_id, 'chunk_id' AS key_mode, round({metric}, 6) AS {metric} FROM m_c",
    )


register("recall_at_k", _metric_sql("recall"))(_metric_query("recall"))
register("precision_at_k", _metric_sql("precision"))(_metric_query("precision"))
register("mrr", _metric_sql("mrr"))(_metric_query("mrr"))
register("ndcg_at_k", _metric_sql("ndcg"))(_metric_query("ndcg"))


@register(
    "eval_report",
    sql_with(
        sql_eval_ctes(),
        """SELECT coalesce(category, 'ALL') AS category, count(*) AS cases,
                  round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
                  round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
           FROM m_q JOIN cases_ok USING (ann_id) GROUP BY ROLLUP (category)""",
    ),
)
def q_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Recall/Precision/MRR/nDCG@8 per category and overall."""
    return evaluation(spark, sf_dir).report(KEY_QUALIFIED)


SNAPSHOT_STAMP = "2024-01-01_00-00"
REPORT_SCHEMA = "category string, cases long, recall double, precision double, mrr double, ndcg double"


@register(
    "eval_snapshot",
    sql_with(
        sql_eval_ctes(),
        f"""SELECT mode, '{SNAPSHOT_STAMP}' AS ts, coalesce(category, 'ALL') AS category, count(*) AS cases,
                  round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
           FROM (SELECT 'document_chunk' AS mode, * FROM m_q UNION ALL SELECT 'chunk_id', * FROM m_c) JOIN cases_ok USING (ann_id)
           GROUP BY GROUPING SETS ((mode, category), (mode))""",
    ),
)
def q_eval_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of both key modes saved as snapshots and read back as one table."""
    root = f"{scratch(spark, sf_dir, 'snapshots')}-{uuid.uuid4().hex}"
    ev = evaluation(spark, sf_dir)
    for mode, key in (("document_chunk", KEY_QUALIFIED), ("chunk_id", KEY_COMPAT)):
        if not files.save_snapshot(ev.report(key), root, mode, SNAPSHOT_STAMP):
            raise OSError(f"no snapshot of mode {mode}")
    return files.read_snapshots(spark, root, REPORT_SCHEMA).select(
        "mode", "ts", "category", "cases", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")]
    )
