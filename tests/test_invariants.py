"""Invariants on the real small data folder: index recall, metric ranges, Recall@K monotone in K."""

from pyspark.sql import functions as F

from chunkwise.operators.metrics import KEY_QUALIFIED, case_metrics
from chunkwise.operators.search import knn_join
from chunkwise.sources.tables import vector_queries, vectors

SF = "/root/testdata/sf0.001"


def _vector_relevance(spark):
    v = vectors(spark, SF)
    q = v.select(F.col("vec_id").alias("case_id"), F.col("label").alias("ql"))
    rel = q.join(v.select("vec_id", "label"), F.col("ql") == F.col("label")).filter(F.col("case_id") != F.col("vec_id"))
    return q, rel.select("case_id", F.lit("v").alias("document_name"), F.col("vec_id").cast("int").alias("chunk_id"))


def test_index_recall_as_registered(spark):
    """The registered parameters: k rows per query, recall over 0.9, few exact distances."""
    from chunkwise.operators import ivf
    from chunkwise.plans.q_search import K, approximate_neighbours, vector_index

    for sf in (SF, "/root/testdata/sf0.1"):
        n = vectors(spark, sf).count()
        exact = knn_join(vector_queries(spark, sf), vectors(spark, sf), K, keys=("vec_id",))
        found = ivf.recall(exact, approximate_neighbours(spark, sf), "query_id", ("vec_id",)).first()
        assert (found.queries, found.rows) == (n, K * n)
        assert found.recall >= 0.9
        assert ivf.RERANK * K < 0.1 * n  # rows per query whose exact distance is taken
        assert len(vector_index(spark, sf).cells.n) > 10


def test_metrics_in_range_and_recall_monotone(spark):
    cases, rel = _vector_relevance(spark)
    ret = knn_join(vector_queries(spark, SF), vectors(spark, SF), 16, keys=("vec_id",)).select(
        F.col("query_id").alias("case_id"), "rank", F.lit("v").alias("document_name"), F.col("vec_id").cast("int").alias("chunk_id")
    )
    recall = {}
    for k in (4, 8, 16):
        m = case_metrics(cases, ret, rel, k, "case_id", KEY_QUALIFIED)
        bad = m.filter(
            (F.col("recall") < 0) | (F.col("recall") > 1) | (F.col("precision") < 0) | (F.col("precision") > 1)
            | (F.col("mrr") < 0) | (F.col("mrr") > 1) | (F.col("ndcg") < 0) | (F.col("ndcg") > 1 + 1e-12)
        ).count()
        assert bad == 0
        recall[k] = {r.case_id: r.recall for r in m.collect()}
    for cid in recall[4]:
        assert recall[4][cid] <= recall[8][cid] <= recall[16][cid]
