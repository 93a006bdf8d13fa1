"""Retrieval evaluation.

sample spans (stratified) -> label relevant chunks (multi-signal) -> keep cases
with a document and a match -> embed the span text as the query -> k nearest
chunks within the span's category -> hits -> per-case metrics -> report.

The sample, the labels, the cases and the retrieved rows are stored in the
checkpoint folder where they are used more than once; neither chunks nor cases
go to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.text import case_name
from chunkwise.operators.embed import embed
from chunkwise.operators.metrics import KEY_COMPAT, KEY_QUALIFIED, case_metrics, metric_report
from chunkwise.operators.relevance import DEFAULT_THRESHOLD, label_relevance
from chunkwise.operators.sampling import DEFAULT_LIMIT, DEFAULT_SEED, stratified_sample
from chunkwise.operators.search import knn_join
from chunkwise.session import cut_lineage

CASE_PREFIX = 28


@dataclass
class RetrievalEval:
    sample: DataFrame
    labels: DataFrame
    cases: DataFrame  # every sampled span with status ok / no_document / no_match
    retrieved_plan: DataFrame
    k: int
    _retrieved: DataFrame | None = None

    @property
    def retrieved(self) -> DataFrame:
        """Top-k rows per case (cases x k rows), materialised once and shared by every metric."""
        if self._retrieved is None:
            self._retrieved = cut_lineage(self.retrieved_plan)
        return self._retrieved

    def ok_cases(self) -> DataFrame:
        return self.cases.filter(F.col("status") == "ok")

    def per_case(self, key: tuple[str, ...] = KEY_QUALIFIED) -> DataFrame:
        rel = self.labels.select("ann_id", "document_name", "chunk_id")
        return case_metrics(self.ok_cases(), self.retrieved, rel, self.k, "ann_id", key)

    def report(self, key: tuple[str, ...] = KEY_QUALIFIED) -> DataFrame:
        pc = self.per_case(key).join(self.ok_cases().select("ann_id", "category"), "ann_id")
        return metric_report(pc, "category")


def build_cases(sample: DataFrame, chunks: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Attach relevant chunk ids to each sampled span; mark spans without document or match."""
    wanted = sample.select("document_name").distinct()
    docs = chunks.select("document_name").join(wanted, "document_name", "left_semi").distinct().withColumn(
        "has_doc", F.lit(True)
    )
    rel = labels.groupBy("ann_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))
    out = sample.join(docs, "document_name", "left").join(rel, "ann_id", "left")
    status = (
        F.when(F.col("has_doc").isNull(), F.lit("no_document"))
        .when(F.col("relevant").isNull(), F.lit("no_match"))
        .otherwise(F.lit("ok"))
    )
    return out.select(
        "ann_id",
        case_name("document_name", "category", "start_char", CASE_PREFIX).alias("case_name"),
        F.col("text").alias("query"),
        "category", "document_name", "start_char", "end_char",
        F.lit(k).alias("k"),
        F.coalesce(F.col("relevant"), F.array().cast("array<int>")).alias("relevant"),
        status.alias("status"),
    )


def retrieval_eval(
    spans: DataFrame,
    chunks: DataFrame,
    k: int = 8,
    limit_per_category: int = DEFAULT_LIMIT,
    seed: int = DEFAULT_SEED,
    categories: list[str] | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    use_offsets: bool = True,
    embedded_chunks: DataFrame | None = None,
    embedder=None,
) -> RetrievalEval:
    """Retrieval evaluation over ``spans`` (annotations) and ``chunks`` (with ``category``)."""
    sample = cut_lineage(stratified_sample(spans, limit_per_category, seed, categories))
    labels = cut_lineage(label_relevance(sample, chunks, threshold, use_offsets))
    cases = cut_lineage(build_cases(sample, chunks, labels, k))
    ok = cases.filter(F.col("status") == "ok")
    queries = embed(ok.select("ann_id", "query", "category"), "query", "query_vec", embedder=embedder)
    corpus = embedded_chunks if embedded_chunks is not None else cut_lineage(embed(chunks, "text", embedder=embedder))
    retrieved = knn_join(queries, corpus, k, query_id="ann_id", query_category="category")
    return RetrievalEval(sample, labels, cases, retrieved, k)  # retrieval runs on first use


__all__ = ["RetrievalEval", "retrieval_eval", "build_cases", "KEY_QUALIFIED", "KEY_COMPAT"]
