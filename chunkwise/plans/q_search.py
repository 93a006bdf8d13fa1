"""Queries: embeddings, exact/approximate search, context rendering, category resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.operators import ivf
from chunkwise.operators.embed import (
    SQL_PRODUCT_TEXT,
    embed,
    embed_one,
    product_embedding_text,
    sql_dense,
    sql_hashed_long,
)
from chunkwise.operators.render import render_context
from chunkwise.operators.resolve import resolve_categories, vocabulary
from chunkwise.operators.search import contract_results, knn_join, product_results, search, verification
from chunkwise.operators.store import sql_contract_key
from chunkwise.plans.catalog import register, scratch, shared
from chunkwise.plans.q_ingest import categorized_chunks, sql_categorized_chunks
from chunkwise.session import spread
from chunkwise.sources.tables import (
    SQL_PRODUCTS,
    SQL_VECTOR_QUERIES,
    SQL_VECTORS,
    products,
    sql_with,
    table,
    vector_queries,
    vectors,
)

K = 8
PRODUCT_QUERY = "small brass ring"  # the direct product search's query text (a parameter)
FILTER_CATEGORY = "L3"


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk store with embeddings (built once per session)."""
    return shared(spark, sf_dir, "chunks_embedded", lambda: embed(categorized_chunks(spark, sf_dir), "text"))


def embedded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product store with embeddings (built once per session)."""

    def build() -> DataFrame:
        return embed(spread(products(spark, sf_dir)).withColumn("embedding_text", product_embedding_text()), "embedding_text")

    return shared(spark, sf_dir, "products_embedded", build)


def sql_embedded_chunks() -> dict[str, str]:
    return {**sql_categorized_chunks(), "cvec": sql_dense("cchunks2", "document_name, chunk_id", "text")}


# ---------------------------------------------------------------- embedding --


@register(
    "embed_hashed",
    sql_with(
        sql_categorized_chunks(),
        f"SELECT document_name, chunk_id, idx, value FROM {sql_hashed_long('chunks', 'document_name, chunk_id', 'text')} "
        "WHERE value <> 0",
    ),
)
def q_embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default hashed bag-of-words embedding of every chunk (sparse long form)."""
    ch = embed(categorized_chunks(spark, sf_dir).select("document_name", "chunk_id", "text"), "text")
    return ch.select("document_name", "chunk_id", F.posexplode("embedding").alias("idx", "v")).filter(
        F.col("v") != 0
    ).select("document_name", "chunk_id", F.col("idx").cast("int").alias("idx"), F.col("v").cast("double").alias("value"))


# ------------------------------------------------------------ single query --


@register(
    "knn_products",
    sql_with(
        {
            "products": SQL_PRODUCTS,
            "pv": sql_dense("products", "product_id", SQL_PRODUCT_TEXT),
            "q": f"SELECT 1 AS qid, '{PRODUCT_QUERY}' AS t",
            "qv": sql_dense("q", "qid", "t"),
            "scored": "SELECT p.*, list_distance(pv.vec, qv.vec) AS d FROM products p JOIN pv USING (product_id), qv",
        },
        f"""SELECT CAST(row_number() OVER (ORDER BY round(d, 9), product_id) AS INTEGER) AS rank,
                  product_id, product_name, product_brand, gender, CAST(price_inr AS DOUBLE) AS price_inr,
                  description, primary_color, round(d, 6) AS distance
           FROM scored QUALIFY rank <= {K}""",
    ),
)
def q_knn_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: top-8 products for one query text by L2 distance."""
    qv = embed_one(spark, PRODUCT_QUERY)
    top = product_results(search(embedded_products(spark, sf_dir), qv, K, keys=("product_id",)))
    return top.withColumn("distance", F.round("distance", 6))


def _first_passage(spark: SparkSession, sf_dir: str) -> str:
    """Query text for the direct chunk search: the benchmark passage with the smallest id."""
    return table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()["text"]


@register(
    "knn_contracts",
    sql_with(
        {
            **sql_embedded_chunks(),
            "q": "SELECT 1 AS qid, text AS t FROM benchmark ORDER BY item_id LIMIT 1",
            "qv": sql_dense("q", "qid", "t"),
            "scored": "SELECT c.*, list_distance(cvec.vec, qv.vec) AS d FROM cchunks2 c JOIN cvec USING (document_name, chunk_id), qv",
        },
        f"""SELECT CAST(row_number() OVER (ORDER BY round(d, 9), document_name, chunk_id) AS INTEGER) AS rank,
                  {sql_contract_key('document_name', 'chunk_id')} AS contract_id, document_name, chunk_id, page, text,
                  array_to_string(category, '|') AS categories, round(d, 6) AS distance
           FROM scored QUALIFY rank <= {K}""",
    ),
)
def q_knn_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: top-8 chunks for one query text, no category filter."""
    qv = embed_one(spark, _first_passage(spark, sf_dir))
    top = contract_results(search(embedded_chunks(spark, sf_dir), qv, K))
    return top.select(
        "rank", "contract_id", "document_name", "chunk_id", "page", "text",
        F.array_join("category", "|").alias("categories"), F.round("distance", 6).alias("distance"),
    )


@register(
    "knn_filtered",
    sql_with(
        {"v": SQL_VECTORS},
        f"""SELECT CAST(row_number() OVER (ORDER BY round(d, 9), vec_id) AS INTEGER) AS rank, vec_id, label,
                  round(d, 6) AS distance, list_contains(category, '{FILTER_CATEGORY}') AS matched
           FROM (SELECT v.*, list_distance(CAST(v.embedding AS DOUBLE[]),
                        CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS d
                 FROM v WHERE list_contains(category, '{FILTER_CATEGORY}') AND embedding IS NOT NULL)
           QUALIFY rank <= {K}""",
    ),
)
def q_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2 + F8 + SC10: category-filtered top-8 with the per-row match flag."""
    v = vectors(spark, sf_dir)
    qv = list(v.filter(F.col("vec_id") == 0).select("embedding").first()["embedding"])
    top = search(v, qv, K, category=FILTER_CATEGORY, keys=("vec_id",))
    return top.select(
        "rank", "vec_id", "label", F.round("distance", 6).alias("distance"),
        F.array_contains("category", FILTER_CATEGORY).alias("matched"),
    )


def _sql_near_first(where: str) -> str:
    return f"""(SELECT *, row_number() OVER (ORDER BY round(d, 9), vec_id) AS rank
                FROM (SELECT v.*, list_distance(CAST(v.embedding AS DOUBLE[]),
                             CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS d
                      FROM v WHERE {where} AND embedding IS NOT NULL) QUALIFY rank <= {K})"""


@register(
    "search_verified",
    sql_with(
        {"v": SQL_VECTORS},
        f"""SELECT 'filter' AS search, count(*) FILTER (WHERE list_contains(category, '{FILTER_CATEGORY}')) AS verified,
                   count(*) AS returned FROM {_sql_near_first(f"list_contains(category, '{FILTER_CATEGORY}')")}
            UNION ALL SELECT 'none', count(*), count(*) FROM {_sql_near_first("true")}""",
    ),
)
def q_search_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: rows that pass the filter / rows returned, with a filter and without one (then all pass)."""
    v = vectors(spark, sf_dir)
    qv = list(v.filter(F.col("vec_id") == 0).select("embedding").first()["embedding"])
    counts = [
        verification(search(v, qv, K, category=c, keys=("vec_id",)), c).select(F.lit(name).alias("search"), "verified", "returned")
        for name, c in (("filter", FILTER_CATEGORY), ("none", None))
    ]
    return counts[0].unionByName(counts[1])


@register(
    "search_resolved",
    sql_with(
        {"v": SQL_VECTORS},
        f"""SELECT CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance
            FROM {_sql_near_first(f"list_contains(category, '{FILTER_CATEGORY}')")}""",
    ),
)
def q_search_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 + SC7 + L2: a misspelt category is corrected against the stored vocabulary, then filters the search."""
    v = vectors(spark, sf_dir)
    qv = list(v.filter(F.col("vec_id") == 0).select("embedding").first()["embedding"])
    top = search(v, qv, K, category=FILTER_CATEGORY.lower(), keys=("vec_id",), resolve=True)
    return top.select("rank", "vec_id", F.round("distance", 6).alias("distance"))


# ------------------------------------------------------------- batch query --


@register(
    "knn_batch",
    sql_with(
        {"v": SQL_VECTORS, "q": SQL_VECTOR_QUERIES},
        f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS INTEGER) AS rank,
                  vec_id, round(d, 6) AS distance
           FROM (SELECT q.query_id, v.vec_id,
                        list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[])) AS d
                 FROM q JOIN v ON list_contains(v.category, q.query_category) WHERE v.embedding IS NOT NULL)
           QUALIFY rank <= {K}""",
    ),
)
def q_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + L3 + W2: every query's top-8 within its category."""
    res = knn_join(
        vector_queries(spark, sf_dir), vectors(spark, sf_dir), K, query_category="query_category", keys=("vec_id",)
    )
    return res.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


_INDEXES: dict[tuple, ivf.IvfIndex] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> ivf.IvfIndex:
    """The inverted-file index of the vectors, written once per session and data folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _INDEXES:
        path = f"{scratch(spark, sf_dir, 'ivf')}-{uuid.uuid4().hex}"
        _INDEXES[key] = ivf.build_index(vectors(spark, sf_dir), path, ("vec_id",))
    return _INDEXES[key]


def approximate_neighbours(spark: SparkSession, sf_dir: str, report: dict | None = None) -> DataFrame:
    return ivf.search_index(vector_index(spark, sf_dir), vector_queries(spark, sf_dir), vectors(spark, sf_dir), K, report=report)


@register("knn_lsh")
def q_knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: approximate top-8 per query (the name is older than its method, an inverted file with quantised residuals)."""
    res = approximate_neighbours(spark, sf_dir)
    return res.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


RECALL_FLOOR = 0.9


@register(
    "knn_index_recall",
    f"""SELECT count(*) AS queries, count(*) * least({K}, count(*)) AS rows, true AS recall_held
        FROM embeddings WHERE embedding IS NOT NULL""",
)
def q_knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 against L3: queries and rows of the approximate result, and whether it has RECALL_FLOOR of the true neighbours."""
    exact = knn_join(vector_queries(spark, sf_dir), vectors(spark, sf_dir), K, keys=("vec_id",))
    found = ivf.recall(exact, approximate_neighbours(spark, sf_dir), "query_id", ("vec_id",))
    return found.select("queries", "rows", (F.col("recall") >= RECALL_FLOOR).alias("recall_held"))


# ---------------------------------------------------------------- context --


def sql_contract_row(alias: str = "") -> str:
    p = alias
    return (
        f"concat('# ', {p}document_name, ' (chunk ', {p}chunk_id, ', page ', "
        f"CASE WHEN coalesce({p}page, 0) = 0 THEN 'N/A' ELSE CAST({p}page AS VARCHAR) END, "
        f"') [Categories: ', array_to_string({p}category, ', '), ']', chr(10), {p}text, chr(10))"
    )


SQL_PRODUCT_ROW = "concat('# ', product_id, chr(10), 'Product Details:', product_name, chr(10), chr(10), description, chr(10))"


@register(
    "context_contracts",
    sql_with(
        {
            **sql_embedded_chunks(),
            "qv": sql_dense("benchmark", "item_id", "text"),
            "scored": """SELECT qv.item_id, c.*, list_distance(cvec.vec, qv.vec) AS d
                         FROM cchunks2 c JOIN cvec USING (document_name, chunk_id), qv""",
            "ranked": f"""SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d, 9), document_name, chunk_id) AS rank
                          FROM scored QUALIFY rank <= {K}""",
        },
        f"SELECT item_id, string_agg({sql_contract_row()}, chr(10) || chr(10) ORDER BY rank) AS context, "
        "count(*) AS n_rows FROM ranked GROUP BY item_id",
    ),
)
def q_context_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + SC8: every benchmark passage retrieves 8 chunks; rendered as one context string."""
    queries = embed(table(spark, sf_dir, "benchmark"), "text", "query_vec")
    hits = knn_join(
        queries, embedded_chunks(spark, sf_dir), K, query_id="item_id",
        payload=("page", "category", "text"),
    )
    return render_context(hits, "contracts", ("item_id",))


@register(
    "context_products",
    sql_with(
        {
            "products": SQL_PRODUCTS,
            "pv": sql_dense("products", "product_id", SQL_PRODUCT_TEXT),
            "q": "SELECT DISTINCT p_type AS qtext FROM part",
            "qv": sql_dense("q", "qtext", "qtext"),
            "ranked": f"""SELECT qv.qtext, p.*, row_number() OVER (PARTITION BY qv.qtext
                              ORDER BY round(list_distance(pv.vec, qv.vec), 9), p.product_id) AS rank
                          FROM products p JOIN pv USING (product_id), qv QUALIFY rank <= {K}""",
        },
        f"SELECT qtext AS query, string_agg({SQL_PRODUCT_ROW}, chr(10) || chr(10) ORDER BY rank) AS context, "
        "count(*) AS n_rows FROM ranked GROUP BY qtext",
    ),
)
def q_context_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + SC8: one product search per distinct product type, rendered as context."""
    queries = embed(table(spark, sf_dir, "part").select(F.col("p_type").alias("query")).distinct(), "query", "query_vec")
    hits = knn_join(
        queries, embedded_products(spark, sf_dir), K, query_id="query", keys=("product_id",),
        payload=("product_name", "description"),
    )
    return render_context(hits, "products", ("query",))


# ------------------------------------------------------ category resolution --


def category_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested category strings: each category as is, upper-cased, truncated, and prefixed."""
    vocab = vocabulary(categorized_chunks(spark, sf_dir))
    c = F.col("category")
    variants = F.array(
        c, F.upper(c), F.substring(c, 1, F.greatest(F.length(c) - 1, F.lit(1))), F.concat(F.lit("x"), c),
        F.concat(F.lit("zz"), F.reverse(c)),
    )
    return vocab.select(F.explode(variants).alias("requested")).distinct()


SQL_VOCAB = "SELECT DISTINCT cat AS category FROM (SELECT unnest(category) AS cat FROM cchunks2) WHERE cat IS NOT NULL AND cat <> ''"
SQL_REQUESTS = """SELECT DISTINCT requested FROM (
    SELECT unnest([category, upper(category), substring(category, 1, greatest(length(category) - 1, 1)),
                   concat('x', category), concat('zz', reverse(category))]) AS requested FROM vocab)"""


@register(
    "resolve_category_exact",
    sql_with(
        {
            **sql_categorized_chunks(),
            "vocab": SQL_VOCAB,
            "req": SQL_REQUESTS,
            "lower_map": "SELECT lower(category) AS lc, max(category) AS hit FROM vocab GROUP BY 1",
        },
        """SELECT r.requested,
                  CASE WHEN v.category IS NOT NULL THEN r.requested ELSE coalesce(m.hit, r.requested) END AS resolved,
                  v.category IS NULL AND m.hit IS NOT NULL AS was_corrected
           FROM req r LEFT JOIN vocab v ON v.category = r.requested LEFT JOIN lower_map m ON m.lc = lower(r.requested)""",
    ),
)
def q_resolve_category_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7 + J12, tiers 1-2 (exact, then case-insensitive)."""
    vocab = vocabulary(categorized_chunks(spark, sf_dir))
    return resolve_categories(category_requests(spark, sf_dir), vocab, fuzzy=False)


@register("resolve_category_fuzzy")
def q_resolve_category_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7 + J12 with the fuzzy tier (rows-only; exactness tested against difflib)."""
    vocab = vocabulary(categorized_chunks(spark, sf_dir))
    return resolve_categories(category_requests(spark, sf_dir), vocab, fuzzy=True)
