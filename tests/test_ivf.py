"""The inverted-file index: layout, reopening, edges, k rows for every query."""

import random

import numpy as np
import pytest

from chunkwise.operators import cells, ivf
from chunkwise.operators.search import knn_join

SCHEMA = "doc string, n int, embedding array<double>"


def _clustered(spark, n=900, dims=12, seed=1):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 3) for _ in range(dims)] for _ in range(9)]
    rows = [(f"d{i % 5}", i, [m + rnd.gauss(0, 0.5) for m in middle[i % 9]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_index_is_a_partitioned_table_of_every_row_and_reopens(spark, tmp_path):
    rows, df = _clustered(spark)
    odd = spark.createDataFrame([("x", 1, None), ("x", 2, [1.0]), ("x", 3, [float("nan")] * 12), ("x", 4, [None] * 12)], SCHEMA)
    built = ivf.build_index(df.union(odd), str(tmp_path / "ix"), ("doc", "n"), cells=20, subspaces=6)
    assert built.table.count() == len(rows) == built.cells.n.sum()
    assert (tmp_path / "ix" / "codes").is_dir() and any(p.name.startswith("cell=") for p in (tmp_path / "ix" / "codes").iterdir())
    assert {len(r.code) for r in built.table.collect()} == {6}
    again = ivf.open_index(spark, str(tmp_path / "ix"), ("doc", "n"))
    assert np.array_equal(again.cells.pivots, built.cells.pivots) and all(np.array_equal(a, b) for a, b in zip(again.books, built.books))
    asked = df.where("n % 7 = 0").selectExpr("n AS query_id", "embedding AS query_vec")
    report = {}
    found = ivf.search_index(again, asked, df, 5, probe_share=0.3, report=report)
    exact = knn_join(asked, df, 5, keys=("doc", "n"))
    got = ivf.recall(exact, found, "query_id", ("doc", "n")).first()
    assert (got.queries, got.rows) == (asked.count(), 5 * asked.count()) and got.recall >= 0.9 and report["visits"] > 0
    first = {r.query_id: r for r in found.where("rank = 1").collect()}
    assert all(r.distance == 0.0 and r.n == q for q, r in first.items())  # exact distances


def test_a_query_gets_k_rows_from_small_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    monkeypatch.setattr(cells, "QUERIES_A_TASK", 4)
    _, df = _clustered(spark, 120)
    built = ivf.build_index(df, str(tmp_path / "ix"), ("doc", "n"), cells=30)
    asked = df.where("n < 10").selectExpr("n AS query_id", "embedding AS query_vec")
    found = ivf.search_index(built, asked, df, 50, probe_share=0.0, rerank=50)
    assert found.groupBy("query_id").count().where("count <> 50").count() == 0
    assert ivf.search_index(built, asked, df, 500, probe_share=0.0).count() == 10 * 120  # all there are


def test_index_edges(spark, tmp_path):
    _, df = _clustered(spark, 40)
    asked = spark.createDataFrame([(1, [0.0] * 12), (2, None)], "query_id int, query_vec array<double>")
    none = ivf.build_index(df.limit(0), str(tmp_path / "none"), ("doc", "n"))
    assert ivf.search_index(none, asked, df, 3).count() == 0
    copies = spark.range(300).selectExpr("'d' AS doc", "cast(id AS int) AS n", "array_repeat(0.5D, 12) AS embedding")
    same = ivf.build_index(copies, str(tmp_path / "same"), ("doc", "n"))
    assert [r.n for r in ivf.search_index(same, asked, copies, 3, rerank=300).orderBy("rank").collect()] == [0, 1, 2]
    one = ivf.build_index(df.limit(1), str(tmp_path / "one"), ("doc", "n"))
    assert ivf.search_index(one, asked, df, 3).count() == 1
    assert ivf.search_index(one, asked.where("query_id = 2"), df, 3).count() == 0
    with pytest.raises(ValueError):
        ivf.search_index(one, spark.createDataFrame([(1, [0.0])], "query_id int, query_vec array<double>"), df, 3)
