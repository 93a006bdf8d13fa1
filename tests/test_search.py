"""Exact search, batch kNN, category resolution."""

import math
import random
import struct

from pyspark.sql import functions as F

from chunkwise.operators.resolve import resolve_categories
from chunkwise.operators.search import knn_join, search
from spec_models import best_category

SCHEMA = "document_name string, chunk_id int, embedding array<float>, category array<string>"


def _corpus(spark, n=60, dim=8, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        vec = [rnd.choice([0.0, 0.5, 1.0]) for _ in range(dim)]  # coarse values: many equal distances
        rows.append((f"d{i % 7}", i, vec, [f"C{i % 3}", "all"]))
    rows.append(("dnull", 0, None, ["C0"]))
    return rows, spark.createDataFrame(rows, SCHEMA)


def _brute(rows, q, k, cat=None):
    scored = []
    for d, c, v, cats in rows:
        if v is None or (cat and cat not in cats):
            continue
        scored.append((round(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, q))), 9), d, c))
    return [(d, c) for _, d, c in sorted(scored)[:k]]


def test_search_ties_nulls_and_filters(spark):
    rows, df = _corpus(spark)
    q = [0.5] * 8
    for k, cat in [(5, None), (8, "C1"), (500, None), (3, "nope"), (4, "")]:
        got = [(r.document_name, r.chunk_id) for r in search(df, q, k, category=cat).orderBy("rank").collect()]
        assert got == _brute(rows, q, k, cat or None), (k, cat)


def test_knn_join_matches_brute_force(spark):
    rows, df = _corpus(spark, n=200, seed=5)
    rnd = random.Random(9)
    queries = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(8)], rnd.choice(["C0", "C1", "C2", None, ""])) for i in range(25)]
    qdf = spark.createDataFrame(queries, "query_id int, query_vec array<float>, qcat string")
    got = {}
    for r in knn_join(qdf, df.repartition(5), 6, query_category="qcat").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.document_name, r.chunk_id))
    for qid, vec, cat in queries:
        exp = _brute(rows, vec, 6, cat or None)
        assert [(d, c) for _, d, c in sorted(got.get(qid, []))] == exp, qid


def _small_cells(monkeypatch, part=17, cell=9, queries=5):
    from chunkwise.operators import cells

    monkeypatch.setattr(cells, "PART_ROWS", part)
    monkeypatch.setattr(cells, "CELL_ROWS", cell)
    monkeypatch.setattr(cells, "QUERIES_A_TASK", queries)


def test_knn_join_many_cells_exact(spark, monkeypatch):
    _small_cells(monkeypatch)
    rows, df = _corpus(spark, n=180, seed=2)
    rnd = random.Random(4)
    queries = [(i, [float(i % 3) / 2] * 8 if i < 12 else [rnd.random() for _ in range(8)], rnd.choice(["C0", "C1", None, "none"])) for i in range(40)]
    qdf = spark.createDataFrame(queries, "query_id int, query_vec array<float>, qcat string")
    for cat in (None, "qcat"):
        got, report = {}, {}
        for r in knn_join(qdf.union(qdf), df, 4, query_category=cat, report=report).collect():  # repeated queries count once
            got.setdefault(r.query_id, []).append((r.rank, r.document_name, r.chunk_id))
        assert report["cells"] > 10
        for qid, vec, name in queries:
            exact = _brute(rows, [struct.unpack("f", struct.pack("f", x))[0] for x in vec], 4, name if cat else None)
            assert [(d, c) for _, d, c in sorted(got.get(qid, []))] == exact, (qid, cat)


def test_knn_join_hot_cell_and_copies(spark, monkeypatch):
    """A third of the rows and of the queries are one vector: slices of the cell, copies of its parts."""
    _small_cells(monkeypatch, part=20, cell=20, queries=8)
    rnd = random.Random(11)
    rows = [("d", i, [1.0, 2.0] if i % 3 == 0 else [rnd.random() * 9, rnd.random() * 9], ["a"]) for i in range(240)]
    rows += [("odd", 1, [1.0], ["a"]), ("odd", 2, [float("nan"), 1.0], ["a"])]
    queries = [(i, [1.0, 2.0] if i % 3 == 0 else [rnd.random() * 9, rnd.random() * 9]) for i in range(60)]
    got = {}
    qdf = spark.createDataFrame(queries, "query_id int, query_vec array<double>")
    for r in knn_join(qdf, spark.createDataFrame(rows, SCHEMA.replace("float", "double")), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.document_name, r.chunk_id))
    for qid, vec in queries:
        assert [(d, c) for _, d, c in sorted(got[qid])] == _brute(rows[:240], vec, 5), qid


def test_knn_join_visits_few_cells_of_clustered_vectors(spark, monkeypatch):
    _small_cells(monkeypatch, part=50, cell=25, queries=1000)
    rnd = random.Random(3)
    middle = [[rnd.gauss(0, 20) for _ in range(6)] for _ in range(30)]
    rows = [("d", i, [m + rnd.gauss(0, 0.3) for m in middle[i % 30]], ["a"]) for i in range(1500)]
    qdf = spark.createDataFrame([(i, rows[i][2]) for i in range(0, 1500, 5)], "query_id int, query_vec array<double>")
    report = {}
    out = knn_join(qdf, spark.createDataFrame(rows, SCHEMA.replace("float", "double")), 4, report=report)
    assert out.count() == 1200
    parts = 30  # 1500 rows in parts of 50, at least
    assert report["visits"] < 300 * parts / 4


def test_knn_join_empty_sides(spark):
    _, df = _corpus(spark, n=5)
    none = spark.createDataFrame([], "query_id int, query_vec array<float>")
    one = spark.createDataFrame([(1, [0.5] * 8), (2, None)], "query_id int, query_vec array<float>")
    assert knn_join(none, df, 3).count() == 0
    assert knn_join(one, df.limit(0), 3).count() == 0
    assert knn_join(one, df.where("embedding IS NULL"), 3, payload=("category",)).columns[-3:] == ["category", "distance", "rank"]


def test_resolve_categories(spark):
    vocab = ["Governing Law", "Audit Rights", "audit rights", "Exclusivity", "Non-Compete", "Cap On Liability"]
    requests = ["Governing Law", "governing law", "AUDIT RIGHTS", "Exclusivty", "Non Compete", "Cap on liabilty",
                "zzzz", "", "Audit Right"]
    vdf = spark.createDataFrame([(v,) for v in vocab], "category string")
    rdf = spark.createDataFrame([(r,) for r in requests], "requested string")
    got = {r.requested: (r.resolved, r.was_corrected) for r in resolve_categories(rdf, vdf).collect()}
    for r in requests:
        assert got[r] == best_category(r, sorted(vocab)), r


def test_resolve_empty_vocabulary(spark):
    vdf = spark.createDataFrame([], "category string")
    rdf = spark.createDataFrame([("Anything",)], "requested string")
    r = resolve_categories(rdf, vdf).first()
    assert (r.resolved, r.was_corrected) == ("Anything", False)


def test_search_where_and_resolve(spark):
    rows, df = _corpus(spark)
    q = [0.5] * 8
    got = [r.chunk_id for r in search(df, q, 5, where=F.col("chunk_id") % 2 == 0).orderBy("rank").collect()]
    exp = [c for _, c in _brute([r for r in rows if r[1] % 2 == 0], q, 5)]
    assert got == exp
    fixed = [(r.document_name, r.chunk_id) for r in search(df, q, 4, category="c1", resolve=True).orderBy("rank").collect()]
    assert fixed == _brute(rows, q, 4, "C1")  # case-only correction
    assert search(df, q, 4, category="c1").count() == 0  # direct search: no correction


def test_category_bridge_prunes_and_matches(spark, tmp_path):
    from chunkwise.operators.search import search_with_bridge, write_category_bridge

    rows, df = _corpus(spark)
    path = str(tmp_path / "bridge")
    write_category_bridge(df, path)
    q = [0.25] * 8
    for cat in ("C0", "C2", "all"):
        got = [(r.document_name, r.chunk_id) for r in search_with_bridge(df, path, q, cat, 6).orderBy("rank").collect()]
        assert got == _brute(rows, q, 6, cat)
    plan = spark.read.parquet(path).filter(F.col("cat") == "C1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cat" in plan


def test_resolve_cutoff_edges_and_ties(spark):
    import difflib

    vocab = ["abcdefghij", "abcdefghzz", "abcdefghyy", "zzzz"]
    # ratio("abcdefxxxx", "abcdefghij") = 0.6 exactly; one more match char lifts it above
    requests = ["abcdefxxxx", "abcdexxxxx", "abcdefghxx", "zzz", "ABCDEFGHIJ"]
    for r in requests:
        assert isinstance(difflib.get_close_matches(r, vocab, n=1, cutoff=0.6), list)
    vdf = spark.createDataFrame([(v,) for v in vocab], "category string")
    rdf = spark.createDataFrame([(r,) for r in requests], "requested string")
    got = {r.requested: (r.resolved, r.was_corrected) for r in resolve_categories(rdf, vdf).collect()}
    for r in requests:
        assert got[r] == best_category(r, sorted(vocab)), r


def _misspelt(rnd, word):
    out = list(word)
    for _ in range(rnd.randint(0, 6)):
        at = rnd.randint(0, len(out))
        out[at : at + rnd.randint(0, 2)] = rnd.choice(["", "a", "e", "xy", " ", "é"])
    return "".join(out)


def test_ratio_equals_difflib():
    import difflib

    from chunkwise.operators.resolve import ratio

    rnd = random.Random(8)
    words = ["Governing Law", "Audit Rights", "Cap On Liability", "abcabcabc", "aaaa", "", "Non-Compete", "xyzzy"]
    for _ in range(10_000):
        a = rnd.choice(words)
        b = _misspelt(rnd, rnd.choice([a, rnd.choice(words)]))
        assert ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    for _ in range(40):  # long ones, where common characters are set aside
        a = "".join(rnd.choice("abcdefgh 0123456789") for _ in range(rnd.randint(150, 400)))
        b = _misspelt(rnd, a[: rnd.randint(100, 400)] + "".join(rnd.choice("aé") for _ in range(rnd.randint(0, 200))))
        assert ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_close_pairs_lose_no_match(spark):
    import difflib

    from chunkwise.operators.resolve import close_pairs, fuzzy_matches

    rnd = random.Random(2)
    vocab = sorted({"".join(rnd.choice("abcde fghé") for _ in range(rnd.randint(1, 14))) for _ in range(150)} | {"a", "ab", "zzz"})
    asked = sorted({_misspelt(rnd, rnd.choice(vocab)) for _ in range(120)} | {"", "zz", "q"})
    vdf, rdf = spark.createDataFrame([(v,) for v in vocab], "category string"), spark.createDataFrame([(r,) for r in asked], "requested string")
    for cutoff in (0.6, 0.8):
        pairs = {(r.requested, r.category) for r in close_pairs(rdf, vdf, cutoff).collect()}
        want = {(r, v) for r in asked for v in vocab if difflib.SequenceMatcher(None, v, r).ratio() >= cutoff}
        assert want <= pairs and len(pairs) < len(asked) * len(vocab) / 2
        got = {r.requested: r.fuzzy for r in fuzzy_matches(rdf, vdf, cutoff).collect()}
        close = {r: difflib.get_close_matches(r, vocab, n=1, cutoff=cutoff) for r in asked}
        assert got == {r: hits[0] for r, hits in close.items() if hits}


def test_embedder_runs_once_per_query(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from chunkwise.operators.embed import embed

    calls = spark.sparkContext.accumulator(0)

    def client(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return pd.Series([[float(len(t)), 1.0] for t in texts])

    _, df = _corpus(spark, n=40, seed=3)
    df = df.withColumn("embedding", F.slice("embedding", 1, 2))
    asked = embed(spark.createDataFrame([(i, "x" * i) for i in range(20)], "query_id int, query string"), "query", "query_vec", embedder=client)
    assert knn_join(asked, df, 3).count() == 60 and calls.value == 20


def test_default_embedding_is_native_and_equals_a_plain_count(spark):
    import hashlib
    import struct

    import regex

    from chunkwise.operators.embed import embed

    texts = [None, "", "?! --", "one One oNe two", "ÄÖ ß_1 a-b", " ".join(f"w{i % 97}" for i in range(5000))]

    def plain(text, dim):
        counts = [0] * dim
        for token in regex.findall(r"[\p{L}\p{N}_]+", text.lower()):
            counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
        norm = sum(c * c for c in counts) ** 0.5
        return [struct.unpack("f", struct.pack("f", c / norm if norm else 0.0))[0] for c in counts]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for dim in (1, 7, 64):
        out = embed(rows, "text", dim=dim)
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.i: r.embedding for r in out.collect()}
        assert got == {i: None if t is None else plain(t, dim) for i, t in enumerate(texts)}
    assert embed(rows.where("i < 0"), "text").count() == 0


def test_products_are_embedded_once_and_stored(spark):
    from chunkwise.plans.q_search import embedded_products

    for _ in range(2):  # the search reads its corpus several times
        found = embedded_products(spark, "/root/testdata/sf0.001")
        assert "md5" not in found._jdf.queryExecution().executedPlan().toString()
        assert all("products_embedded" in f for f in found.inputFiles())


def test_scorer_keeps_ties_limits_and_categories(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from chunkwise.operators import cells
    from chunkwise.operators.search import _exact_scorer

    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    rnd = np.random.default_rng(5)
    x = np.repeat(rnd.integers(0, 3, (30, 4)).astype(float), 4, axis=0)[rnd.permutation(120)]
    cell = rnd.integers(0, 9, 120).astype(np.int32)
    names = [[["a"], ["a", "b"], [], None][i % 4] for i in range(120)]
    ids = [None if i == 17 else (i * 77) % 120 for i in range(120)]
    part = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x.tolist()), pa.array(names)], ["id", "vec", "cat"])
    score = _exact_scorer(5, ["id"], 4, True)(part, cell)
    q, asked = rnd.integers(0, 3, (12, 4)).astype(float), ["a", "b", None, "none"] * 3
    seen = rnd.random((12, 9)) < 0.6
    theta = np.where(np.arange(12) % 2 == 0, np.inf, 2.0)
    who, which, value = score(pa.RecordBatch.from_arrays([pa.array(asked)], ["qcat"]), q, seen, theta)
    for j, name in enumerate(asked):
        fit = [i for i in range(120) if seen[j, cell[i]] and (name is None or name in (names[i] or ()))]
        far = lambda i: float(np.sqrt(((x[i] - q[j]) ** 2).sum()))
        want = sorted(fit, key=lambda i: (round(far(i), 9), -1 if ids[i] is None else ids[i]))[:5]
        got = which[who == j].tolist()
        near = [i for i in want if far(i) <= theta[j]]
        assert got[: len(near)] == near and set(got) <= set(want)
        assert np.allclose(value[who == j], [far(i) for i in got])


def test_vectors_and_queries_travel_to_few_parts(spark):
    """Queries are copied once per part: the default part holds tens of thousands of vectors."""
    rows = spark.range(20_000).selectExpr("id AS vec_id", "array(cast(id % 199 AS double), cast(id % 101 AS double)) AS embedding")
    report = {}
    found = knn_join(rows.where("vec_id < 50").selectExpr("vec_id AS query_id", "embedding AS query_vec"), rows, 2, keys=("vec_id",), report=report)
    assert found.where("rank = 1 AND distance = 0 AND query_id = vec_id").count() == 50
    assert report["visits"] <= 2 * 50
