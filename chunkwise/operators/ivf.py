"""Approximate nearest neighbours: inverted-file cells, product-quantised residuals, exact re-ranking.

``build_index`` writes a table partitioned by cell: per vector its keys, cell
and a code of ``SUBSPACES`` bytes, one byte per stretch of components, naming
the nearest of at most 256 residuals (vector minus its cell's centroid) of that
stretch.  Centroids and code books are fitted by Lloyd's rounds on a bounded
sample, ``SAMPLE_ROWS`` rows in the order of a hash of their keys; every row is
indexed.  ``search_index`` lets a query visit the nearest cells until they hold
``probe_share`` of all rows, ranks their rows by the distance to the vector that
their code stands for, and re-ranks the best ``rerank`` rows exactly against the
table itself.  No distance bound is used, so a query gets ``k`` rows whenever
the table has so many.

Rows whose vector is null, of another size than most, or not finite are not
indexed.  The model (centroids, code books, rows per cell) lies beside the
table, so an index can be opened again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.functions.vectors import l2_distance
from chunkwise.operators.cells import Cells, Rows, cell_facts, distances, matrix, placed, visit
from chunkwise.operators.search import DEFAULT_K, RANK_DECIMALS, asked_queries

SAMPLE_ROWS = 20_000
MAX_CELLS = 1024
SUBSPACES = 32
CODES = 256
ROUNDS = 8
PROBE_SHARE = 0.6
RERANK = 5  # rows re-ranked exactly, in multiples of k


@dataclass
class IvfIndex:
    """A written index: its table and its model."""

    table: DataFrame
    cells: Cells
    books: list[np.ndarray]
    keys: tuple[str, ...]

    @property
    def dims(self) -> int:
        return self.cells.pivots.shape[1]


def fit_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from the first ``k`` distinct rows."""
    _, first = np.unique(x, axis=0, return_index=True)
    out = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = distances(x, out).argmin(axis=1)
        n = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def _stretches(dims: int, subspaces: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), min(subspaces, dims))


def build_index(
    corpus: DataFrame, path: str, keys: tuple[str, ...], vec_col: str = "embedding",
    cells: int | None = None, subspaces: int = SUBSPACES, sample_rows: int = SAMPLE_ROWS,
) -> IvfIndex:
    """Write the index of ``corpus`` below ``path``; by default ``2 * sqrt(rows)`` cells."""
    spark = corpus.sparkSession
    sizes = corpus.where(f"`{vec_col}` IS NOT NULL").groupBy(F.size(vec_col).alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, total = (sizes[0]["dims"], sizes[0]["count"]) if sizes else (0, 0)
    sound = (F.size(vec_col) == dims) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = corpus.where(sound).select(*keys, F.col(vec_col).alias("vec"))
    picked = rows.select("vec", F.xxhash64(*keys).alias("h")).orderBy("h", "vec").limit(sample_rows).collect()
    sample = np.array([r.vec for r in picked], np.float64).reshape(len(picked), dims)
    if not len(sample):
        empty = Cells(np.zeros((1, dims)), np.zeros(1, np.int64), np.zeros(1), np.zeros(1))
        fields = [*[corpus.schema[c] for c in keys], T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())]
        return IvfIndex(spark.createDataFrame([], T.StructType(fields)), empty, [], keys)
    wanted = min(cells or 2 * int(np.sqrt(total)), MAX_CELLS, max(1, len(sample) // 4))
    centroids = fit_centroids(sample, max(wanted, 1))
    residuals = sample - centroids[distances(sample, centroids).argmin(axis=1)]
    stretches = _stretches(dims, subspaces)
    books = [fit_centroids(residuals[:, s], CODES) for s in stretches]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), dims)
            x -= centroids[batch.column("cell").to_numpy(zero_copy_only=False)]
            code = np.empty((len(x), len(books)), np.uint8)
            for i, (s, book) in enumerate(zip(stretches, books)):
                code[:, i] = distances(x[:, s], book).argmin(axis=1)
            raw = pa.array([row.tobytes() for row in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "cell", "r")], raw], [*keys, "cell", "r", "code"])

    fields = [*[rows.schema[c] for c in keys], T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType()), T.StructField("code", T.BinaryType())]
    coded = placed(rows, centroids).mapInArrow(encode, T.StructType(fields))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by ranges of cell and keys: a large cell is written by several tasks
    coded.repartitionByRange(parts, "cell", *keys).write.partitionBy("cell").parquet(f"{path}/codes")
    facts = cell_facts(spark.read.parquet(f"{path}/codes"), centroids)
    model = [("cell", i, float(n), [lo, hi, *c]) for i, (n, lo, hi, c) in enumerate(zip(facts.n, facts.low.tolist(), facts.high.tolist(), centroids.tolist()))]
    model += [(f"book {i}", j, 0.0, v) for i, book in enumerate(books) for j, v in enumerate(book.tolist())]
    spark.createDataFrame(model, "kind string, number int, n double, vector array<double>").coalesce(1).write.parquet(f"{path}/model")
    return open_index(spark, path, keys)


def open_index(spark: SparkSession, path: str, keys: tuple[str, ...]) -> IvfIndex:
    """A written index; the model is bounded by MAX_CELLS centroids and CODES codes a stretch."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "number").collect()
    cell = [r for r in rows if r.kind == "cell"]
    whole = np.array([r.vector for r in cell], np.float64)
    facts = Cells(whole[:, 2:], np.array([int(r.n) for r in cell]), whole[:, 0], whole[:, 1])
    n_books = len({r.kind for r in rows}) - 1
    books = [np.array([r.vector for r in rows if r.kind == f"book {i}"], np.float64) for i in range(n_books)]
    return IvfIndex(spark.read.parquet(f"{path}/codes"), facts, books, keys)


def _probed(index: IvfIndex, probe_share: float, least: int):
    """The nearest cells until they hold ``probe_share`` of the rows and ``least`` rows."""
    cells, need = index.cells, max(probe_share * index.cells.n.sum(), least)

    def reach(q, theta):
        order = np.argsort(distances(q, cells.pivots), axis=1, kind="stable")
        held = np.cumsum(cells.n[order], axis=1)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, held - cells.n[order] < need, axis=1)
        return out

    return reach


def _code_scorer(index: IvfIndex, best: int):
    """The ``best`` rows per query by the distance to what their codes stand for."""
    stretches, books, pivots = _stretches(index.dims, len(index.books)), index.books, index.cells.pivots

    def prepare(part, cell):
        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
        x = pivots[cell]
        for i, (s, book) in enumerate(zip(stretches, books)):
            x[:, s] += book[code[:, i]]
        rows = Rows(x, cell, np.arange(len(x)))

        def score(asked, q, seen, theta):
            who, which, near = rows.least(q, seen, best, theta)
            rank = np.arange(len(who)) - np.searchsorted(who, who)  # of a query's rows, nearest first
            few = rank < best
            return who[few], rows.at[which[few]], np.sqrt(np.maximum(near[few], 0.0))

        return score

    return prepare


def search_index(
    index: IvfIndex, queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K,
    query_id: str = "query_id", query_vec: str = "query_vec", vec_col: str = "embedding",
    probe_share: float = PROBE_SHARE, rerank: int | None = None, report: dict | None = None,
) -> DataFrame:
    """(query_id, keys..., distance, rank): k rows per query, distances exact, most of them the nearest ones.

    ``corpus`` is the table that the index was built from; its ``keys`` identify
    rows.  Query vectors of another size than the index's raise.  ``report``
    gets the number of visits.
    """
    keys, best = index.keys, max(rerank or RERANK * k, k)
    asked, dims = asked_queries(queries, query_id, query_vec, None)
    if dims and index.books and dims != index.dims:
        raise ValueError(f"query vectors have {dims} components, the index has {index.dims}")
    fields = [T.StructField(query_id, asked.schema["qid"].dataType), *[corpus.schema[c] for c in keys]]
    if not dims or not index.books:
        return corpus.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    free = asked.drop("qcat").withColumn("theta", F.lit(float("inf")))
    found = visit(free, index.table, index.cells, _probed(index, probe_share, best), _code_scorer(index, best), keys, "near", report)
    rough = Window.partitionBy("qid").orderBy("near", *keys)
    chosen = found.withColumn("rank", F.row_number().over(rough)).where(F.col("rank") <= best).select("qid", *keys)
    pairs = chosen.join(corpus.select(*keys, F.col(vec_col).alias("vec")), list(keys)).join(asked.select("qid", "qvec"), "qid")
    exact = pairs.select("qid", *keys, l2_distance("vec", "qvec").alias("distance")).where("distance IS NOT NULL")
    w = Window.partitionBy("qid").orderBy(F.round("distance", RANK_DECIMALS).asc(), *[F.col(c).asc() for c in keys])
    ranked = exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(query_id), *keys, "distance", "rank")


def recall(exact: DataFrame, approximate: DataFrame, query_id: str, keys: tuple[str, ...]) -> DataFrame:
    """(queries, rows, recall): what the approximate result has, and its share of the exact result's rows."""
    sides = exact.select(query_id, *keys, F.lit(1).alias("true"), F.lit(0).alias("got")).unionByName(
        approximate.select(query_id, *keys, F.lit(0).alias("true"), F.lit(1).alias("got"))
    )
    rows = sides.groupBy(query_id, *keys).agg(F.max("true").alias("true"), F.max("got").alias("got"))
    share = F.sum(F.col("true") * F.col("got")) / F.greatest(F.sum("true"), F.lit(1))
    queries = F.countDistinct(F.when(F.col("got") == 1, F.col(query_id)))
    return rows.agg(queries.alias("queries"), F.coalesce(F.sum("got"), F.lit(0)).alias("rows"), F.coalesce(share, F.lit(1.0)).alias("recall"))
