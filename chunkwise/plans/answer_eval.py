"""Answer evaluation as one plan with a pluggable answerer and judge.

sample spans -> questions (templates) -> answerer (external; Arrow-batched) ->
judge prompts -> judge (external) -> verdicts -> correctness / faithfulness
shares per category and overall.  ``answerer(questions: pd.Series) ->
pd.DataFrame[answer_text, retrieved_context]`` and ``judge(prompts: pd.Series)
-> pd.Series[json]`` are the user's model clients; both are marked
non-deterministic so Spark never re-runs them for the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.operators.answers import answer_cases, answer_report, decode_verdicts, judge_prompts, run_judge
from chunkwise.operators.sampling import DEFAULT_SEED, stratified_sample
from chunkwise.session import cut_lineage

ANSWER_LIMIT = 10
_OUT = T.StructType([T.StructField("answer_text", T.StringType()), T.StructField("retrieved_context", T.StringType())])


@dataclass
class AnswerEval:
    cases: DataFrame
    outputs: DataFrame
    prompts: DataFrame
    verdicts: DataFrame
    report: DataFrame


def answer_evaluation(spans: DataFrame, answerer, judge, limit_per_category: int = ANSWER_LIMIT,
                      seed: int = DEFAULT_SEED, categories: list[str] | None = None) -> AnswerEval:
    """Build every table of the answer evaluation; model outputs are checkpointed once."""
    cases = cut_lineage(answer_cases(stratified_sample(spans, limit_per_category, seed, categories)))

    def answer_batch(questions: pd.Series) -> pd.DataFrame:
        out = answerer(questions)
        return pd.DataFrame({"answer_text": out["answer_text"], "retrieved_context": out["retrieved_context"]})

    udf = F.pandas_udf(answer_batch, _OUT).asNondeterministic()
    outputs = cut_lineage(
        cases.select("ann_id", udf(F.col("question")).alias("o")).select(
            "ann_id", "o.answer_text", "o.retrieved_context"
        )
    )
    prompts = judge_prompts(cases, outputs)
    verdicts = cut_lineage(decode_verdicts(run_judge(prompts, judge)))
    return AnswerEval(cases, outputs, prompts, verdicts, answer_report(cases, verdicts))
