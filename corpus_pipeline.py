"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet into shared storage and reads it back as the next stage's
input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwise.llm import decontaminate, langid, line_dedup, minhash_dedup, packing
from chunkwise.llm.queries import PACK_END, PACK_TOKENIZER, table
from chunkwise.llm.storage import stored
from chunkwise.llm.tokens import default_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; the models learn from the rows that may train."""
    models = langid.fit_languages(docs.where(langid.training_rows(docs)))
    return langid.keep_accepted(docs, models)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that stand in an earlier one."""
    return line_dedup.dedup_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of what is left: one row per piece."""
    return packing.pack_documents(docs, default_path(PACK_TOKENIZER), PACK_END)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Character models and tokenisers cannot be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
