"""Answer evaluation tables: questions from spans, judge prompts, verdicts, rates.

The answering agent and the judge model are external calls; here they are
pluggable pandas functions.  Everything around them is DataFrame work:
template lookup (a broadcast join with a 41-row table), question and prompt
rendering, verdict decoding (``from_json``) and the correctness /
faithfulness report.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.functions.text import case_name, doc_short

CASE_PREFIX = 25
NONE_RETRIEVED = "(none retrieved)"

# The question template per clause category, and the fallback.
DEFAULT_TEMPLATE = "Find and explain the {category} clause in {doc_short}."
QUESTION_TEMPLATES = {
    "Affiliate License-Licensee": "What rights does the licensee have to sublicense to its affiliates under {doc_short}?",
    "Affiliate License-Licensor": "Can the licensor grant licenses through its affiliates under {doc_short}?",
    "Agreement Date": "What is the effective signing date of {doc_short}?",
    "Anti-Assignment": "Can either party in {doc_short} assign this agreement to a third party without the other party's prior written consent?",
    "Audit Rights": "What audit or inspection rights do the parties have under {doc_short}?",
    "Cap On Liability": "What is the maximum liability cap specified in {doc_short}?",
    "Change Of Control": "What happens under {doc_short} if one of the parties undergoes a change of control or acquisition?",
    "Competitive Restriction Exception": "Are there any carve-outs or exceptions to the competitive restrictions in {doc_short}?",
    "Covenant Not To Sue": "Does {doc_short} include a covenant not to sue? If so, what does it cover?",
    "Document Name": "What is the official name or title of {doc_short}?",
    "Effective Date": "When does {doc_short} become legally effective?",
    "Exclusivity": "What exclusivity obligations or exclusive dealing provisions are defined in {doc_short}?",
    "Expiration Date": "When does {doc_short} expire, and under what conditions can it be renewed?",
    "Governing Law": "Which jurisdiction's laws govern {doc_short}, and where must disputes be resolved?",
    "Insurance": "What types and amounts of insurance are the parties required to maintain under {doc_short}?",
    "Ip Ownership Assignment": "Who owns the intellectual property developed or created under {doc_short}, and are there any assignment provisions?",
    "Irrevocable Or Perpetual License": "Does {doc_short} grant an irrevocable or perpetual license? Describe the scope and any conditions.",
    "Joint Ip Ownership": "Are there joint intellectual property ownership provisions in {doc_short}? How is ownership and control shared between the parties?",
    "License Grant": "What license rights — including scope, territory, exclusivity, and sublicensing — are granted under {doc_short}?",
    "Liquidated Damages": "What liquidated damages or penalties are specified in {doc_short} for breach or non-performance?",
    "Minimum Commitment": "What minimum purchase, revenue, or volume commitments are required under {doc_short}?",
    "Most Favored Nation": "Does {doc_short} include a most-favored-nation (MFN) or best-pricing clause?",
    "No-Solicit Of Customers": "Does {doc_short} restrict either party from soliciting the other's customers during or after the agreement?",
    "No-Solicit Of Employees": "Does {doc_short} restrict either party from recruiting or hiring the other's employees?",
    "Non-Compete": "What non-compete or non-competition restrictions does {doc_short} impose, and for how long?",
    "Non-Disparagement": "Does {doc_short} include a non-disparagement clause? What are the parties prohibited from saying?",
    "Non-Transferable License": "Is the license granted in {doc_short} transferable or sublicensable?",
    "Notice Period To Terminate Renewal": "What advance notice period is required to prevent automatic renewal of {doc_short}?",
    "Parties": "Who are the parties to {doc_short}, and how are they defined?",
    "Post-Termination Services": "What services or obligations must be fulfilled after termination of {doc_short}?",
    "Price Restrictions": "What price restrictions, pricing floors, or price-setting terms are specified in {doc_short}?",
    "Renewal Term": "What are the renewal terms of {doc_short}? Does it auto-renew, and on what conditions?",
    "Revenue/Profit Sharing": "How are revenues or profits allocated or shared between the parties under {doc_short}?",
    "Rofr/Rofo/Rofn": "Does {doc_short} include a right of first refusal, right of first offer, or right of first negotiation?",
    "Source Code Escrow": "Does {doc_short} require source code escrow? What are the conditions that trigger release?",
    "Termination For Convenience": "Can either party terminate {doc_short} for convenience without cause? What notice period is required?",
    "Third Party Beneficiary": "Does {doc_short} name any third-party beneficiaries who can enforce its terms?",
    "Uncapped Liability": "Are there any categories of liability that are explicitly uncapped in {doc_short}?",
    "Unlimited/All-You-Can-Eat-License": "Does {doc_short} grant an unlimited or all-you-can-eat license with no usage restrictions?",
    "Volume Restriction": "What volume or quantity restrictions apply to the parties under {doc_short}?",
    "Warranty Duration": "What is the duration of the warranty or guarantee specified in {doc_short}?",
}

# The judge's user message layout.
JUDGE_USER_TEMPLATE = (
    "QUESTION:\n{question}\n\n"
    "EXPECTED ANSWER (CUAD ground truth):\n{expected_answer}\n\n"
    "SYSTEM ANSWER:\n{system_answer}\n\n"
    "RETRIEVED CONTEXT:\n{retrieved_context}\n"
)

VERDICT_SCHEMA = "correctness boolean, correctness_reason string, faithfulness boolean, faithfulness_reason string"


def template_parts(template: str) -> list[tuple[str, str]]:
    """The template cut at its slots: (literal text, name of the slot behind it or '')."""
    cut = re.split(r"\{(\w+)\}", template) + [""]
    return list(zip(cut[::2], cut[1::2]))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(category, template_parts(text)) for category, text in sorted(QUESTION_TEMPLATES.items())]
    return spark.createDataFrame(rows, "category string, parts array<struct<literal:string,slot:string>>")


def _parts_column(template: str) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("literal"), F.lit(s).alias("slot")) for x, s in template_parts(template)])


def _fill(parts: Column, slots: dict[str, Column]) -> Column:
    """Every slot filled once; slot names inside the filled-in values stay as they are."""

    def piece(p: Column) -> Column:
        value = F.lit("")
        for name, filled in slots.items():
            value = F.when(p["slot"] == name, F.coalesce(filled, F.lit(""))).otherwise(value)
        return F.concat(p["literal"], value)

    return F.array_join(F.transform(parts, piece), "")


def answer_cases(sample: DataFrame) -> DataFrame:
    """(ann_id, case_name, question, document_name, category, gold_text) from sampled spans."""
    tpl = F.broadcast(templates(sample.sparkSession))  # 41 fixed rows
    joined = sample.join(tpl, "category", "left")
    template = F.coalesce(F.col("parts"), _parts_column(DEFAULT_TEMPLATE))
    question = _fill(template, {"doc_short": doc_short("document_name"), "category": F.col("category")})
    return joined.select(
        "ann_id",
        case_name("document_name", "category", "start_char", CASE_PREFIX).alias("case_name"),
        question.alias("question"),
        "document_name", "category",
        F.col("text").alias("gold_text"),
    )


def judge_prompts(cases: DataFrame, outputs: DataFrame, key: str = "ann_id") -> DataFrame:
    """(key, prompt): the judge's user message per case; empty context -> ``(none retrieved)``.

    ``outputs``: (key, answer_text, retrieved_context).
    """
    joined = cases.join(outputs, key, "left")
    ctx = F.when(F.coalesce(F.col("retrieved_context"), F.lit("")) == "", F.lit(NONE_RETRIEVED)).otherwise(
        F.col("retrieved_context")
    )
    prompt = _fill(
        _parts_column(JUDGE_USER_TEMPLATE),
        {"question": F.col("question"), "expected_answer": F.col("gold_text"),
         "system_answer": F.col("answer_text"), "retrieved_context": ctx},
    )
    return joined.select(key, prompt.alias("prompt"))


def decode_verdicts(raw: DataFrame, key: str = "ann_id", col: str = "verdict_json") -> DataFrame:
    """Judge output JSON -> typed verdict; missing output or field -> False."""
    v = F.from_json(F.col(col), VERDICT_SCHEMA)
    return raw.select(
        key,
        F.coalesce(v["correctness"], F.lit(False)).alias("correctness"),
        v["correctness_reason"].alias("correctness_reason"),
        F.coalesce(v["faithfulness"], F.lit(False)).alias("faithfulness"),
        v["faithfulness_reason"].alias("faithfulness_reason"),
    )


def run_judge(prompts: DataFrame, judge, key: str = "ann_id") -> DataFrame:
    """Apply a user-supplied judge ``pandas.Series[prompt] -> pandas.Series[json]`` (one call per batch)."""
    udf = F.pandas_udf(judge, T.StringType()).asNondeterministic()
    return prompts.select(key, udf(F.col("prompt")).alias("verdict_json"))


def answer_report(cases: DataFrame, verdicts: DataFrame, key: str = "ann_id") -> DataFrame:
    """Share of correct and faithful answers per category and overall; cases without verdict count as False."""
    joined = cases.select(key, "category").join(verdicts.select(key, "correctness", "faithfulness"), key, "left")
    c = F.coalesce(F.col("correctness"), F.lit(False)).cast("double")
    f = F.coalesce(F.col("faithfulness"), F.lit(False)).cast("double")
    agg = joined.rollup("category").agg(
        F.count("*").alias("cases"), F.avg(c).alias("correctness"), F.avg(f).alias("faithfulness")
    )
    return agg.select(
        F.coalesce(F.col("category"), F.lit("ALL")).alias("category"), "cases",
        F.round("correctness", 6).alias("correctness"), F.round("faithfulness", 6).alias("faithfulness"),
    )
