"""Queries: answer-evaluation tables and agent traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.operators.answers import (
    DEFAULT_TEMPLATE,
    JUDGE_USER_TEMPLATE,
    NONE_RETRIEVED,
    QUESTION_TEMPLATES,
    answer_cases,
    answer_report,
    decode_verdicts,
    judge_prompts,
)
from chunkwise.operators.embed import embed, sql_dense
from chunkwise.operators.render import render_context
from chunkwise.operators.sampling import sql_stratified_sample, stratified_sample
from chunkwise.operators.search import knn_join
from chunkwise.operators.tokens import approx_tokens
from chunkwise.operators.traces import pair_tool_calls, retrieved_context, usage
from chunkwise.plans.catalog import register, shared
from chunkwise.plans.q_ingest import all_annotations, sql_categorized_chunks
from chunkwise.plans.q_search import embedded_chunks, sql_contract_row
from chunkwise.session import cut_lineage
from chunkwise.sources.tables import SQL_TRACES, sql_with, table, traces

ANSWER_LIMIT = 10
K = 8


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fill(template: str, slots: dict[str, str]) -> str:
    """One-pass fill: slots become control characters first, so that slot names inside values are no slots."""
    for i, name in enumerate(slots):
        template = f"replace({template}, '{{{name}}}', chr({i + 1}))"
    for i, value in enumerate(slots.values()):
        template = f"replace({template}, chr({i + 1}), {value})"
    return template


def _sql_question_ctes() -> dict[str, str]:
    values = ", ".join(f"({_sql_str(c)}, {_sql_str(t)})" for c, t in sorted(QUESTION_TEMPLATES.items()))
    stem = "replace(replace(replace(replace(document_name, '.txt', ''), '.pdf', ''), '-', ' '), '_', ' ')"
    from chunkwise.functions.text import sql_strip

    short = f"CASE WHEN length({stem}) > 45 THEN {sql_strip(f'substring({stem}, 1, 45)')} ELSE {stem} END"
    return {
        **sql_categorized_chunks(),
        "sample": sql_stratified_sample("ann", ANSWER_LIMIT),
        "tpl": f"SELECT * FROM (VALUES {values}) t(category, template)",
        "acases": f"""SELECT s.ann_id,
                        concat(replace(substring(s.document_name, 1, 25), ' ', '_'), '__', replace(s.category, ' ', '_'),
                               '__', s.start_char) AS case_name,
                        {_sql_fill(f"coalesce(t.template, {_sql_str(DEFAULT_TEMPLATE)})", {"doc_short": short, "category": "s.category"})} AS question,
                        s.document_name, s.category, s.text AS gold_text
                 FROM sample s LEFT JOIN tpl t ON t.category = s.category""",
    }


def _answer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_cases(stratified_sample(all_annotations(spark, sf_dir), ANSWER_LIMIT))


@register(
    "answer_cases",
    sql_with(_sql_question_ctes(), "SELECT ann_id, case_name, question, document_name, category, gold_text FROM acases"),
)
def q_answer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + SC18 + SC19 + SC20: 10 spans per category turned into natural-language questions."""
    return _answer_cases(spark, sf_dir)


def _answer_outputs(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    """Stand-in extractive answerer: retrieve 8 chunks per question; answer = the best chunk."""
    q = embed(cases.select("ann_id", "question"), "question", "query_vec")
    hits = cut_lineage(knn_join(q, embedded_chunks(spark, sf_dir), K, query_id="ann_id", payload=("page", "category", "text")))
    ctx = render_context(hits, "contracts", ("ann_id",))
    best = hits.filter(F.col("rank") == 1).select("ann_id", F.col("text").alias("answer_text"))
    return ctx.join(best, "ann_id").select("ann_id", "answer_text", F.col("context").alias("retrieved_context"))


def _fill_sql() -> str:
    t = _sql_str(JUDGE_USER_TEMPLATE).replace("\n", "' || chr(10) || '")
    ctx = f"CASE WHEN coalesce(o.retrieved_context, '') = '' THEN {_sql_str(NONE_RETRIEVED)} ELSE o.retrieved_context END"
    return _sql_fill(f"({t})", {
        "question": "c.question", "expected_answer": "c.gold_text", "system_answer": "coalesce(o.answer_text, '')",
        "retrieved_context": ctx,
    })


@register(
    "judge_prompts",
    sql_with(
        {
            **_sql_question_ctes(),
            "cvec": sql_dense("cchunks2", "document_name, chunk_id", "text"),
            "qv": sql_dense("acases", "ann_id", "question"),
            "ranked": f"""SELECT qv.ann_id, c.*, row_number() OVER (PARTITION BY qv.ann_id
                              ORDER BY round(list_distance(cv.vec, qv.vec), 9), c.document_name, c.chunk_id) AS rank
                          FROM qv, cchunks2 c JOIN cvec cv ON cv.document_name = c.document_name AND cv.chunk_id = c.chunk_id
                          QUALIFY rank <= {K}""",
            "outs": f"""SELECT ann_id,
                          max(CASE WHEN rank = 1 THEN text END) AS answer_text,
                          string_agg({sql_contract_row()}, chr(10) || chr(10) ORDER BY rank) AS retrieved_context
                        FROM ranked GROUP BY ann_id""",
        },
        f"SELECT c.ann_id, {_fill_sql()} AS prompt FROM acases c LEFT JOIN outs o ON o.ann_id = c.ann_id",
    ),
)
def q_judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC21: the judge's message per answer case (question, gold text, answer, retrieved context)."""
    cases = _answer_cases(spark, sf_dir)
    return judge_prompts(cases, _answer_outputs(spark, sf_dir, cases))


def _verdicts(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    """Stand-in judge output: a verdict JSON per case from the ``labels`` table (quality, 1 - toxic)."""
    labels = table(spark, sf_dir, "labels")
    doc_id = F.regexp_extract("document_name", r"^doc_(\d+)\.txt$", 1).cast("long")
    j = cases.select("ann_id", doc_id.alias("doc_id")).join(labels, "doc_id", "left")
    js = F.when(
        F.col("quality").isNotNull(),
        F.concat(
            F.lit('{"correctness": '), F.when(F.col("quality") == 1, F.lit("true")).otherwise(F.lit("false")),
            F.lit(', "correctness_reason": "quality label", "faithfulness": '),
            F.when(F.col("toxic") == 0, F.lit("true")).otherwise(F.lit("false")),
            F.lit(', "faithfulness_reason": "toxicity label"}'),
        ),
    )
    return decode_verdicts(j.select("ann_id", js.alias("verdict_json")))


@register(
    "judge_report",
    sql_with(
        {
            **_sql_question_ctes(),
            "v": f"""SELECT c.ann_id, c.category,
                       coalesce(CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 END, false) AS correctness,
                       coalesce(CASE WHEN l.quality IS NOT NULL THEN l.toxic = 0 END, false) AS faithfulness
                     FROM acases c LEFT JOIN labels l
                       ON l.doc_id = CAST(regexp_extract(c.document_name, '^doc_(\\d+)\\.txt$', 1) AS BIGINT)""",
        },
        """SELECT coalesce(category, 'ALL') AS category, count(*) AS cases,
                  round(avg(CAST(correctness AS DOUBLE)), 6) AS correctness,
                  round(avg(CAST(faithfulness AS DOUBLE)), 6) AS faithfulness
           FROM v GROUP BY ROLLUP (category)""",
    ),
)
def q_judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22 + A15: verdicts decoded from JSON; share correct / faithful per category and overall."""
    cases = _answer_cases(spark, sf_dir)
    return answer_report(cases, _verdicts(spark, sf_dir, cases))


# ------------------------------------------------------------------- traces --

# SQL twin of the pairing on this fixture: turns alternate call / return, so a
# return belongs to the call just before it (by id on even runs, by the id-less
# rule on odd ones).  The general rule is checked against the sequential model
# in tests/test_store_traces_misc.py.
SQL_PAIRS = """
SELECT c.run_id, c.seq AS call_seq, c.tool_name, c.tool_call_id,
       CASE WHEN json_valid(c.args) THEN 'json' ELSE 'raw' END AS args_kind,
       CASE WHEN json_valid(c.args) THEN json_extract_string(c.args, '$.search_query') ELSE c.args END AS args_query,
       r.content AS result, r.seq AS return_seq
FROM tr c LEFT JOIN tr r
  ON r.run_id = c.run_id AND r.part_kind = 'tool-return' AND r.seq = c.seq + 1 AND r.tool_name = c.tool_name
WHERE c.part_kind = 'tool-call'
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls paired with returns; the trace table is stored once per session (read by several branches)."""
    parts = shared(spark, sf_dir, "trace_parts", lambda: traces(spark, sf_dir))
    return pair_tool_calls(parts)


@register("trace_pairs", sql_with({"tr": SQL_TRACES}, SQL_PAIRS))
def q_trace_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 + SC23: every tool call with its return (by call id, else latest open call of the tool)."""
    p = _pairs(spark, sf_dir)
    query = F.when(F.col("args_kind") == "json", F.get_json_object("args_json", "$.search_query")).otherwise(
        F.get_json_object("args_json", "$.raw")
    )
    return p.select("run_id", "call_seq", "tool_name", "tool_call_id", "args_kind", query.alias("args_query"),
                    "result", "return_seq")


@register(
    "trace_context",
    sql_with(
        {"tr": SQL_TRACES, "p": SQL_PAIRS},
        """SELECT run_id, string_agg(result, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY call_seq)
                  AS retrieved_context, count(*) AS n_results
           FROM p WHERE tool_name = 'retrieve_contracts' AND result IS NOT NULL AND result <> '' GROUP BY run_id""",
    ),
)
def q_trace_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + A18: per run, the contract-retrieval results joined by the call separator."""
    return retrieved_context(_pairs(spark, sf_dir))


@register(
    "trace_usage",
    sql_with(
        {"tr": SQL_TRACES, "p": SQL_PAIRS},
        """SELECT m.run_id, m.input_tokens, m.output_tokens, m.input_tokens + m.output_tokens AS total_tokens,
                  CAST(CASE WHEN m.requests > 0 THEN m.requests ELSE 1 END AS BIGINT) AS requests,
                  CAST(coalesce(c.n, 0) AS BIGINT) AS tool_calls_count
           FROM (SELECT conv_id AS run_id,
                        CAST(coalesce(sum(CASE WHEN role <> 'assistant' THEN ceil(length(text) / 4) END), 0) AS BIGINT) AS input_tokens,
                        CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4) END), 0) AS BIGINT) AS output_tokens,
                        count(*) FILTER (WHERE role = 'assistant') AS requests
                 FROM conversations GROUP BY conv_id) m
           LEFT JOIN (SELECT run_id, count(*) AS n FROM p GROUP BY run_id) c ON c.run_id = m.run_id""",
    ),
)
def q_trace_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run token usage (4 characters per token), requests (at least 1), tool calls."""
    conv = table(spark, sf_dir, "conversations")
    tok = approx_tokens(F.col("text"))
    messages = conv.select(
        F.col("conv_id").alias("run_id"), "role",
        F.when(F.col("role") != "assistant", tok).alias("input_tokens"),
        F.when(F.col("role") == "assistant", tok).alias("output_tokens"),
    )
    return usage(messages, _pairs(spark, sf_dir))
