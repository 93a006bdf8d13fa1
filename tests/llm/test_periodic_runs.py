"""Runs held against a plain version that tries every period from its definition."""

import hashlib
import re
import time
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import SF_SMALL

from chunkwise.llm import periodic_runs, queries


def plain_runs(words):
    """Maximal stretches by period, from small to large; a stretch of a smaller period is that period's."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                out.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=4), st.integers(1, 7)), max_size=7))
def test_runs_equal_plain_version(parts):
    words = list("".join(t * n for t, n in parts))
    assert periodic_runs.word_runs(words) == plain_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=80))
def test_runs_of_two_words_equal_plain_version(words):
    assert periodic_runs.word_runs(words) == plain_runs(words)


def test_long_texts_take_little_time():
    began = time.time()
    assert periodic_runs.word_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    base = [str(i) for i in range(20_000)]
    assert periodic_runs.word_runs(base * 5) == [(0, 100_000, 20_000)]
    block = ["a"] * 10 + ["b"]
    got = periodic_runs.word_runs(block * 2_000)
    assert (0, 22_000, 11) in got and len(got) == 2_001
    assert time.time() - began < 60


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def check(docs, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in rows]
    assert sorted(got, key=repr) == sorted((expected(*d) for d in docs), key=repr)


def test_query_equals_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF_SMALL, "documents").collect() if len(r.text) < 20_000]
    wanted = {d[0] for d in docs}
    out = queries.op13_periodic_runs(spark, SF_SMALL)
    assert out.columns == COLUMNS
    rows = [r for r in out.collect() if r.doc_id in wanted]
    assert sum(r.n_runs > 0 for r in rows) >= 5
    check(docs, rows)


def test_query_on_edges(spark, edge_docs, no_docs, tmp_path):
    more = spark.createDataFrame([(n, "a b " * 30 + "c" * n) for n in range(20, 60)] + [(77, "x\x0by\x0cz " * 9), (None, "b " * 7)], "doc_id long, text string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    rows = queries.op13_periodic_runs(spark, str(tmp_path / "a")).collect()
    check([(r.doc_id, r.text) for r in docs.where("doc_id IS NULL OR doc_id <> 6").collect()], [r for r in rows if r.doc_id != 6])
    assert len(rows) == docs.count()
    no_docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert queries.op13_periodic_runs(spark, str(tmp_path / "b")).count() == 0


def test_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "so " * 8 + "it goes"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 8, 1)] and rows[1].collapsed == "so it goes"
    assert (rows[2].n_words, rows[2].runs, rows[2].collapsed) == (0, [], "")
