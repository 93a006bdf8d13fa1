"""Chunking edge cases against the plain-Python model of the specification."""

import random

import pytest
from pyspark.sql import functions as F

from chunkwise.functions.chunking import chunk_geometry, chunk_spans, estimate_page
from chunkwise.operators.chunk import chunk_documents
from spec_models import chunk_spans_by_rule


def _texts():
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "é", "ünï", "ß", "日本", "x"]

    def prose(n):
        out = []
        while sum(len(w) + 1 for w in out) < n:
            w = rnd.choice(words)
            r = rnd.random()
            out.append(w + (". " if r < 0.1 else "\n\n" if r < 0.13 else " "))
        return "".join(out)[:n]

    cases = {
        "empty": "",
        "exact_4000": "a" * 4000,
        "n_4001": "a" * 4001,
        "n_7200": "b" * 7200,
        "n_7201": "c" * 7201,
        "no_delimiter": "z" * 20000,
        "blank_long": " " * 9000,
        "crlf": ("line one. \r\n" * 900),
        "leading_trailing_short": "   padded short text   ",
        "leading_trailing_long": "   " + prose(9000) + "   \n",
        "para_at_window_start": "x" * 2000 + "\n\n" + "y" * 6000,
        "para_at_end_plus_198": "x" * 4198 + "\n\n" + "y" * 6000,
        "para_at_end_plus_199": "x" * 4199 + "\n\n" + "y" * 6000,
        "sentence_pad": "x" * 4098 + ". " + "y" * 6000,
        "blank_middle": "a" * 3000 + " " * 6000 + "b" * 3000,
    }
    for i in range(25):
        cases[f"random_{i}"] = prose(rnd.randint(3000, 30000))
    return cases


@pytest.mark.parametrize("size,overlap", [(1000, 200), (100, 20), (50, 0)])
def test_chunks_match_model(spark, size, overlap):
    cases = _texts()
    df = spark.createDataFrame(sorted(cases.items()), "document_name string, text string")
    got = {}
    for r in chunk_documents(df, size, overlap).collect():
        got.setdefault(r.document_name, []).append((r.chunk_id, r.text, r.chunk_start, r.chunk_end, r.page))
    for name, text in cases.items():
        exp = [(i, t, s, e, s // 3000 + 1) for i, (t, s, e) in enumerate(chunk_spans_by_rule(text, size, overlap))]
        assert sorted(got.get(name, [])) == exp, name


def test_null_text_has_no_chunks(spark):
    df = spark.createDataFrame([("a", None)], "document_name string, text string")
    assert chunk_documents(df).count() == 0


def test_overlap_too_large_is_rejected():
    with pytest.raises(ValueError):
        chunk_geometry(10, 6)
    with pytest.raises(ValueError):
        chunk_spans(F.col("text"), 10, 6)


def test_page_estimate(spark):
    rows = spark.range(1).select(
        estimate_page(F.lit(0)).alias("a"), estimate_page(F.lit(2999)).alias("b"), estimate_page(F.lit(3000)).alias("c")
    ).first()
    assert (rows.a, rows.b, rows.c) == (1, 1, 2)


def test_chunk_spans_cover_text(spark):
    text = _texts()["random_3"]
    df = spark.createDataFrame([("d", text)], "document_name string, text string")
    spans = sorted((r.chunk_start, r.chunk_end) for r in chunk_documents(df).collect())
    assert spans[0][0] == 0 and spans[-1][1] >= len(text)
    for (s1, e1), (s2, e2) in zip(spans, spans[1:]):
        assert s2 <= e1  # overlapping or touching windows: no gap


def test_many_chunks_one_document(spark):
    rnd = random.Random(21)
    text = "".join(rnd.choice(["word ", "mot. ", "x\n\n", "ü "]) for _ in range(60000))
    df = spark.createDataFrame([("big", text)], "document_name string, text string")
    got = sorted((r.chunk_id, r.text, r.chunk_start, r.chunk_end) for r in chunk_documents(df, 50, 10).collect())
    exp = [(i, t, s, e) for i, (t, s, e) in enumerate(chunk_spans_by_rule(text, 50, 10))]
    assert len(exp) > 64 * 10 and got == exp
