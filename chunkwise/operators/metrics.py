"""Ranking metrics per evaluation case, and their report.

Per case (``retrieved`` = top-k rows with ``rank``; ``relevant`` = set of keys):

* Recall@K    = |distinct retrieved keys that are relevant| / |relevant|; 1.0 with no relevant key
* Precision@K = relevant retrieved rows / retrieved rows (not K); 0.0 with nothing retrieved
* MRR         = 1 / rank of the first relevant row; 0.0 without one
* nDCG@K      = sum(hit / log2(rank + 1)) / sum_{i<=min(K, |relevant|)} 1 / log2(i + 1); 1.0 with no relevant key

``key`` chooses what identifies a chunk: ``("document_name", "chunk_id")``
(default) or ``("chunk_id",)``, the reference's mode in which equal ordinals of
different documents count as the same chunk (nDCG can then exceed 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_QUALIFIED = ("document_name", "chunk_id")
KEY_COMPAT = ("chunk_id",)
METRICS = ("recall", "precision", "mrr", "ndcg")


def ideal_dcg(n_rel: Column, k: int) -> Column:
    m = F.least(n_rel, F.lit(k))
    return F.when(m <= 0, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0),
                    lambda acc, i: acc + F.lit(1.0) / F.log2(i.cast("double") + F.lit(1.0)))
    )


def case_metrics(
    cases: DataFrame,
    retrieved: DataFrame,
    relevant: DataFrame,
    k: int = 8,
    case_id: str = "case_id",
    key: tuple[str, ...] = KEY_QUALIFIED,
) -> DataFrame:
    """(case_id, n_relevant, n_retrieved, hits, recall, precision, mrr, ndcg) for every case."""
    key = list(key)
    rel = relevant.select(case_id, *key).distinct()
    n_rel = rel.groupBy(case_id).agg(F.count("*").alias("n_relevant"))
    ret = retrieved.filter(F.col("rank") <= k).select(case_id, "rank", *key)
    flagged = ret.join(rel.withColumn("hit", F.lit(True)), [case_id, *key], "left").withColumn(
        "hit", F.coalesce(F.col("hit"), F.lit(False))
    )
    hit_key = F.struct(*[F.col(c) for c in key])
    per_case = flagged.groupBy(case_id).agg(
        F.count("*").alias("n_retrieved"),
        F.count_if("hit").alias("hits"),
        F.count_distinct(F.when(F.col("hit"), hit_key)).alias("distinct_hits"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit"), F.lit(1.0) / F.log2(F.col("rank").cast("double") + F.lit(1.0))).otherwise(0.0)).alias("dcg"),
    )
    out = cases.select(case_id).distinct().join(n_rel, case_id, "left").join(per_case, case_id, "left")
    nr = F.coalesce(F.col("n_relevant"), F.lit(0))
    nret = F.coalesce(F.col("n_retrieved"), F.lit(0))
    dh = F.coalesce(F.col("distinct_hits"), F.lit(0))
    idcg = ideal_dcg(nr, k)
    return out.select(
        case_id,
        nr.cast("long").alias("n_relevant"),
        nret.cast("long").alias("n_retrieved"),
        F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"),
        F.when(nr == 0, F.lit(1.0)).otherwise(dh / nr).alias("recall"),
        F.when(nret == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("hits"), F.lit(0)) / nret).alias("precision"),
        F.when(F.col("first_hit").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / F.col("first_hit")).alias("mrr"),
        F.when(nr == 0, F.lit(1.0)).when(idcg == 0, F.lit(0.0)).otherwise(F.coalesce(F.col("dcg"), F.lit(0.0)) / idcg).alias("ndcg"),
    )


def metric_report(per_case: DataFrame, group_col: str = "category", total_label: str = "ALL") -> DataFrame:
    """Mean of every metric per group plus one overall row (``rollup``)."""
    agg = per_case.rollup(group_col).agg(
        F.count("*").alias("cases"),
        *[F.avg(m).alias(m) for m in METRICS],
    )
    return agg.select(
        F.coalesce(F.col(group_col), F.lit(total_label)).alias(group_col),
        "cases",
        *[F.round(m, 6).alias(m) for m in METRICS],
    )


def sql_case_metrics(cases: str, retrieved: str, relevant: str, k: int, case_id: str, key: tuple[str, ...]) -> str:
    kc = ", ".join(key)
    on = " AND ".join(f"r.{c} = rel.{c}" for c in (case_id, *key))
    return f"""
    (WITH rel AS (SELECT DISTINCT {case_id}, {kc} FROM {relevant}),
          nrel AS (SELECT {case_id}, count(*) AS n_relevant FROM rel GROUP BY 1),
          flagged AS (SELECT r.{case_id}, r.rank, {', '.join('r.' + c for c in key)},
                             rel.{case_id} IS NOT NULL AS hit
                      FROM (SELECT * FROM {retrieved} WHERE rank <= {k}) r LEFT JOIN rel ON {on}),
          pc AS (SELECT {case_id}, count(*) AS n_retrieved, count(*) FILTER (WHERE hit) AS hits,
                        count(DISTINCT CASE WHEN hit THEN ({kc}) END) AS distinct_hits,
                        min(CASE WHEN hit THEN rank END) AS first_hit,
                        sum(CASE WHEN hit THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg
                 FROM flagged GROUP BY 1),
          base AS (SELECT c.{case_id}, coalesce(n.n_relevant, 0) AS nr, coalesce(p.n_retrieved, 0) AS nret,
                          coalesce(p.hits, 0) AS hits, coalesce(p.distinct_hits, 0) AS dh, p.first_hit,
                          coalesce(p.dcg, 0.0) AS dcg,
                          list_sum(list_transform(range(1, least(coalesce(n.n_relevant, 0), {k}) + 1),
                                                  lambda i: 1.0 / log2(i + 1.0))) AS idcg
                   FROM (SELECT DISTINCT {case_id} FROM {cases}) c
                   LEFT JOIN nrel n USING ({case_id}) LEFT JOIN pc p USING ({case_id}))
     SELECT {case_id}, CAST(nr AS BIGINT) AS n_relevant, CAST(nret AS BIGINT) AS n_retrieved, CAST(hits AS BIGINT) AS hits,
            CASE WHEN nr = 0 THEN 1.0 ELSE dh / nr END AS recall,
            CASE WHEN nret = 0 THEN 0.0 ELSE hits / nret END AS precision,
            CASE WHEN first_hit IS NULL THEN 0.0 ELSE 1.0 / first_hit END AS mrr,
            CASE WHEN nr = 0 THEN 1.0 WHEN coalesce(idcg, 0) = 0 THEN 0.0 ELSE dcg / idcg END AS ndcg
     FROM base)
    """
