"""Exact nearest-neighbour search by L2 distance, with category filters.

* ``search``: one query vector against a table -> the k nearest rows, ranked.
  Plan: filter -> distance -> ``orderBy().limit(k)`` which Spark runs as a
  per-partition top-k followed by a k-row merge (``TakeOrderedAndProject``).
* ``knn_join``: a table of queries against a table of vectors -> k nearest per
  query, exact, over Voronoi cells (``cells``): the vectors are shuffled once,
  queries visit only the cells that can still hold a neighbour, and the payload
  is joined to the survivors.

Approximate search is in ``ivf``.

Ties are broken by the corpus key columns; NULL vectors never match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.functions.vectors import l2_distance, vector_literal
from chunkwise.operators import cells as cells_module
from chunkwise.operators.cells import Cells, Rows, Scorer, cell_facts, distances, matrix, pivot_rows, placed, visit
from chunkwise.session import cut_lineage

DEFAULT_K = 8
# Distances are ranked after rounding to this many places, so float noise in the
# last bits (which differs between engines and summation orders) never decides
# an order; remaining ties are broken by the key columns.
RANK_DECIMALS = 9
STEP = 1 << 16  # candidates whose distances are computed at a time


def category_filter(category: str | None, col: str = "category") -> Column | None:
    """``category = ANY(col)``; a falsy category means no filter."""
    if not category:
        return None
    return F.array_contains(F.col(col), F.lit(category))


def match_flag(category: str | None, col: str = "category") -> Column:
    """Whether a row passes the filter that was asked for; always true without one."""
    wanted = category_filter(category, col)
    return F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))


def verification(top: DataFrame, category: str | None, col: str = "category") -> DataFrame:
    """(verified, returned): how many of the returned rows pass the filter."""
    return top.agg(F.count_if(match_flag(category, col)).alias("verified"), F.count("*").alias("returned"))


def search(
    corpus: DataFrame,
    query_vec,
    k: int = DEFAULT_K,
    category: str | None = None,
    where: Column | None = None,
    vec_col: str = "embedding",
    category_col: str = "category",
    keys: tuple[str, ...] = ("document_name", "chunk_id"),
    resolve: bool = False,
) -> DataFrame:
    """Top-k rows of ``corpus`` nearest to one query vector, with ``rank`` (1..k) and ``distance``.

    ``query_vec`` is a list of floats or a Column; ``where`` is an extra
    structured filter (e.g. a price bound, our extension), applied before
    ranking.  ``resolve=True`` first corrects ``category`` against the
    corpus's category vocabulary (the agent tool's behaviour; direct search
    uses it as given).
    """
    if resolve and category:
        from chunkwise.operators.resolve import resolve_categories, vocabulary

        req = corpus.sparkSession.createDataFrame([(category,)], "requested string")
        category = resolve_categories(req, vocabulary(corpus)).first()["resolved"]  # one row
    qv = query_vec if isinstance(query_vec, Column) else vector_literal(query_vec)
    df = corpus.filter(F.col(vec_col).isNotNull())
    cf = category_filter(category, category_col)
    if cf is not None:
        df = df.filter(cf)
    if where is not None:
        df = df.filter(where)
    scored = df.withColumn("distance", l2_distance(F.col(vec_col), qv)).filter(F.col("distance").isNotNull())
    order = [F.round("distance", RANK_DECIMALS).asc()] + [F.col(k_).asc() for k_ in keys]
    top = scored.orderBy(*order).limit(k)
    # k rows only: ranking them in one partition is free
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _exact_scorer(k: int, key_cols: list[str], dims: int, category: bool) -> Scorer:
    """Top-k rows per query among the rows of the cells that it reaches."""

    def prepare(part, cell):
        x, places = matrix(part.column("vec"), dims), np.arange(part.num_rows)
        by_key = pc.sort_indices(pa.table({c: part.column(c) for c in key_cols}), [(c, "ascending") for c in key_cols], null_placement="at_start")
        place_of = np.empty(len(x), np.int64)
        place_of[by_key.to_numpy()] = places
        holders: dict[str | None, list[int]] = {}
        if category:
            for i, names in enumerate(part.column("cat").to_pylist()):
                for name in set(names or ()):
                    holders.setdefault(name, []).append(i)
        last = {}  # the category that was asked for last; queries come by category

        def rows_of(name):
            if name not in last:
                last.clear()
                at = np.array(holders.get(name, []), np.int64) if name else places
                last[name] = Rows(x[at], cell[at], at) if len(at) else None
            return last[name]

        def nearest(rows, q, seen, theta):
            slack = 1e-6 * (rows.square.max() + (q * q).sum(axis=1).max() + 1.0)
            who, which, _ = rows.least(q, seen, k, theta * theta, slack)
            which = rows.at[which]
            exact = np.concatenate([np.zeros(0), *[
                np.sqrt(((x[which[s : s + STEP]] - q[who[s : s + STEP]]) ** 2).sum(axis=1)) for s in range(0, len(who), STEP)
            ]])
            rounded = np.array([round(d, RANK_DECIMALS) for d in exact.tolist()])
            order = np.lexsort((place_of[which], rounded, who))
            who, which, exact = who[order], which[order], exact[order]
            first = np.searchsorted(who, who)  # where the query's rows begin
            best = np.arange(len(who)) - first < k
            return who[best], which[best], exact[best]

        def score(asked, q, seen, theta):
            names = np.array([name or None for name in asked.column("qcat").to_pylist()] if category else [None] * len(q), object)
            out = []
            for name in dict.fromkeys(names.tolist()):
                some, rows = np.flatnonzero(names == name), rows_of(name)
                if rows is not None:
                    who, which, exact = nearest(rows, q[some], seen[some], theta[some])
                    out.append((some[who], which, exact))
            return tuple(np.concatenate(c) for c in zip(*out)) if out else (places[:0], places[:0], np.zeros(0))

        return score

    return prepare


def _nearest_only(pivots: np.ndarray):
    def reach(q, theta):
        out = np.zeros((len(q), len(pivots)), bool)
        out[np.arange(len(q)), distances(q, pivots).argmin(axis=1)] = True
        return out

    return reach


def _within_limit(cells: Cells):
    """Cells other than the nearest one that can hold a row within each query's limit."""

    def reach(q, theta):
        d = distances(q, cells.pivots)
        out = cells.floors(d) <= theta[:, None] * (1 + 1e-9) + 1e-6
        out[np.arange(len(q)), d.argmin(axis=1)] = False
        return out

    return reach


def asked_queries(queries: DataFrame, query_id: str, query_vec: str, query_category: str | None) -> tuple[DataFrame, int]:
    """(qid, qvec, qcat, one row per id, stored) and the number of their components."""
    category = F.col(query_category) if query_category else F.lit(None).cast("string")
    asked = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("qvec"), category.alias("qcat")).where("qvec IS NOT NULL")
    one = F.min(F.struct("qvec", "qcat")).alias("q")
    # stored before anything else reads it: a paid embedder runs once per query
    asked = cut_lineage(asked.groupBy("qid").agg(one).select("qid", "q.qvec", "q.qcat"))
    sizes = asked.agg(F.min(F.size("qvec")).alias("a"), F.max(F.size("qvec")).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"query vectors have mixed dimensions {sizes.a} to {sizes.b}")
    return asked, sizes.a or 0


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    query_category: str | None = None,
    vec_col: str = "embedding",
    category_col: str = "category",
    keys: tuple[str, ...] = ("document_name", "chunk_id"),
    payload: tuple[str, ...] = (),
    report: dict | None = None,
) -> DataFrame:
    """(query_id, keys..., payload..., distance, rank) for the k nearest corpus rows per query; exact.

    The corpus is dealt to Voronoi cells.  A query first visits its own cell;
    the distance of its k-th row there is its limit, and triangle and
    half-space bounds tell which other cells can hold a nearer one.  Those are
    visited next (all of them, where the own cell has fewer than k rows for it).

    With ``query_category`` set, a query only sees rows whose category array
    contains its category (a NULL/empty query category means no filter).  Rows
    that share a query id are one query (the least vector).  ``keys`` identify
    the corpus rows; the corpus should be a stored table.  ``report`` gets the
    numbers of cells and of parts visited.
    """
    asked, dims = asked_queries(queries, query_id, query_vec, query_category)
    cat = F.col(category_col) if query_category else F.lit(None).cast("array<string>")
    rows = corpus.where(F.size(vec_col) == dims).select(*keys, F.col(vec_col).alias("vec"), cat.alias("cat"))
    wanted = min(cells_module.MAX_CELLS, -(-corpus.select(*keys).count() // cells_module.CELL_ROWS))
    pivots = pivot_rows(rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), keys, wanted) if dims else np.zeros((0, 0))
    rest = [c for c in payload if c not in keys]
    kinds = {c: corpus.schema[c].dataType for c in (*keys, *rest)}
    fields = [T.StructField(query_id, asked.schema["qid"].dataType), *[T.StructField(c, kinds[c]) for c in (*keys, *rest)]]
    if not len(pivots):
        return corpus.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    dealt = placed(rows, pivots)
    if len(pivots) > 1:
        dealt = cut_lineage(dealt)
    found = cell_facts(dealt, pivots)
    if report is not None:
        report["cells"] = len(pivots)
    w = Window.partitionBy("qid").orderBy(F.round("distance", RANK_DECIMALS).asc(), *[F.col(c).asc() for c in keys])
    score = _exact_scorer(k, list(keys), dims, query_category is not None)
    free = asked.withColumn("theta", F.lit(float("inf")))
    ranked = visit(free, dealt, found, _nearest_only(pivots), score, keys, report=report).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if len(pivots) > 1:  # there are other cells
        ranked = cut_lineage(ranked)
        limit = ranked.where(F.col("rank") == k).select("qid", F.col("distance").alias("theta"))
        bound = asked.join(limit, "qid", "left").withColumn("theta", F.coalesce("theta", F.lit(float("inf"))))
        more = visit(bound, dealt, found, _within_limit(found), score, keys, report=report)
        ranked = ranked.drop("rank").unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if rest:  # only the survivors meet their payload
        ranked = corpus.select(*keys, *rest).join(ranked, list(keys))
    return ranked.select(F.col("qid").alias(query_id), *keys, *rest, "distance", "rank")


def write_category_bridge(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("document_name", "chunk_id"),
                          category_col: str = "category") -> None:
    """Materialise ``(category, keys...)`` partitioned by category: the filtered-search index.

    A category filter then reads one partition (partition pruning) instead of
    testing ``array_contains`` on every stored chunk.
    """
    bridge = chunks.select(F.explode(F.array_distinct(F.col(category_col))).alias("cat"), *keys)
    bridge.repartition("cat").write.mode("overwrite").partitionBy("cat").parquet(path)


def search_with_bridge(
    corpus: DataFrame,
    bridge_path: str,
    query_vec,
    category: str,
    k: int = DEFAULT_K,
    vec_col: str = "embedding",
    keys: tuple[str, ...] = ("document_name", "chunk_id"),
) -> DataFrame:
    """``search`` restricted to one category through the bridge table (same result)."""
    spark = corpus.sparkSession
    members = spark.read.parquet(bridge_path).filter(F.col("cat") == F.lit(category)).select(*keys)
    return search(corpus.join(members, list(keys), "left_semi"), query_vec, k, vec_col=vec_col, keys=keys)


def product_results(top: DataFrame) -> DataFrame:
    """Search-result projection for products: seven fields plus distance; price as double."""
    return top.select(
        "rank", "product_id", "product_name", "product_brand", "gender",
        F.col("price_inr").cast("double").alias("price_inr"), "description", "primary_color", "distance",
    )


def contract_results(top: DataFrame) -> DataFrame:
    """Search-result projection for chunks: six fields plus distance; a NULL category becomes []."""
    from chunkwise.operators.store import contract_key

    return top.select(
        "rank", contract_key(F.col("document_name"), F.col("chunk_id")).alias("contract_id"),
        "document_name", "chunk_id", "page", "text",
        F.coalesce(F.col("category"), F.array().cast("array<string>")).alias("category"), "distance",
    )
