"""Winnowing held against a plain version that hashes and compares every window."""

import hashlib
import random

import xxhash
from llm_helpers import SF_SMALL, prose
from pyspark.sql import functions as F

from chunkwise.llm import fingerprints, queries


def plain_winnow(text, k=fingerprints.K, w=fingerprints.WINDOW):
    """[(hash, position)] of every window's minimum, the rightmost of equal ones."""
    text = text or ""
    if not text:
        return []
    last = max(len(text) - k, 0)
    grams = []
    for i in range(last + 1):
        full = xxhash.xxh64_intdigest(text[i : i + k].encode("utf-32-be"), seed=42)
        grams.append(((full - (1 << 64) if full >> 63 else full) >> 31, i))
    out = []
    for s in range(max(len(grams) - w + 1, 1)):
        low, at = min(grams[s : s + w], key=lambda g: (g[0], -g[1]))
        if not out or out[-1] != (low & fingerprints.HASH, at):
            out.append((low & fingerprints.HASH, at))
    return out


def plain_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def as_text(pairs):
    return " ".join(f"{h:x}:{p}" for h, p in pairs)


SAMPLES = ["", None, "a", "ab" * 300, "a" * 500, "x" * 15, "x" * 16, "x" * 17, "z" * 46, "z" * 47, "z" * 48, "naïve 漢字😀 " * 40, prose(3, 400, 9),
           prose(1, 12), "aé😀" * 9, prose(8, 5000, 100)]


def test_keys_equal_plain_version_for_several_sizes(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "doc_id long, text string")
    for k, w, block in ((fingerprints.K, fingerprints.WINDOW, fingerprints.BLOCK), (5, 4, 7), (3, 1, 10), (8, 13, 50)):
        keys = fingerprints.winnow_keys(F.col("text"), k, w, block)
        for r in rows.select("doc_id", fingerprints.key_text(keys).alias("got")).collect():
            assert r.got == as_text(plain_winnow(SAMPLES[r.doc_id], k, w)), (r.doc_id, k, w)


def test_spliced_keys_equal_those_of_the_whole(spark):
    rnd = random.Random(4)
    cases = []
    for i in range(400):
        a, b = ("".join(rnd.choice("ab") if rnd.random() < 0.7 else "c" for _ in range(rnd.choice([1, 3, 8, 20, 60, 200]))) for _ in range(2))
        cases.append((i, a, b, rnd.randint(1, len(a)), rnd.randint(0, len(b))))
    rows = spark.createDataFrame(cases, "doc_id long, a string, b string, head int, tail int")
    for k, w in ((5, 4), (3, 8), (1, 1), (4, 6)):
        keyed = rows.select("*", fingerprints.winnow_keys(F.col("a"), k, w).alias("x"), fingerprints.winnow_keys(F.col("b"), k, w).alias("y"))
        got = fingerprints.spliced_keys(F.col("x"), F.col("a"), F.col("head"), F.col("y"), F.col("b"), F.col("tail"), k, w)
        for r in keyed.select("*", fingerprints.key_text(got).alias("got")).collect():
            assert r.got == as_text(plain_winnow(r.a[: r.head] + r.b[: r.tail], k, w)), (r, k, w)


def test_shared_passages_of_the_guaranteed_length_are_found(spark):
    need = fingerprints.K + fingerprints.WINDOW - 1
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        passage = "".join(rnd.choice("abcdefgh ") for _ in range(need))
        other = lambda: "".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 200)))
        rows.append((i, other() + passage + other(), other() + passage + other()))
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    hashes = [fingerprints.key_hashes(fingerprints.winnow_keys(F.col(c))) for c in "ab"]
    assert df.where(F.size(F.array_intersect(*hashes)) == 0).count() == 0


def check_rows(docs, rows):
    """Rows of the query against the plain version; docs: [(id, text)] in the order of ties."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] if d[0] is not None else 0), reverse=True)
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = plain_winnow(text), plain_winnow(edited)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed),
                     round(plain_likeness(own, changed), 12), round(plain_likeness(own, plain_winnow(after)), 12)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_equals_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF_SMALL, "documents").collect()]
    check_rows(docs, queries.op11_fingerprints(spark, SF_SMALL).collect())


def run_on(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return queries.op11_fingerprints(spark, str(tmp_path))


def test_query_on_edges(spark, edge_docs, no_docs, tmp_path):
    rows = run_on(spark, edge_docs, tmp_path / "edges").collect()
    assert len(rows) == edge_docs.count()
    check_rows([(r.doc_id, r.text) for r in edge_docs.collect()], rows)
    empty = run_on(spark, no_docs, tmp_path / "none")
    assert empty.count() == 0 and "fingerprint" in empty.columns
    one = run_on(spark, edge_docs.where("doc_id = 4"), tmp_path / "one").collect()
    assert [r.near_next for r in one] == [1.0]


def test_rows_of_one_id_spread_over_blocks(spark):
    docs = spark.range(0, 4000, numPartitions=4).selectExpr("IF(id % 2 = 0, 7, id) AS doc_id", "repeat(cast(id AS string), 9) AS text")
    heads = fingerprints.block_heads(docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key")), 8)
    assert sum(h["doc_id"] == 7 for h in heads) >= 3
    beside = fingerprints.with_next(docs, blocks=8)
    assert beside.count() == 4000 and beside.where("next_text IS NULL").count() == 0
    assert beside.select("next_text").distinct().count() == 4000


def test_fingerprints_column_and_native_plan(spark, edge_docs):
    out = fingerprints.fingerprints(edge_docs)
    assert out.columns == ["doc_id", "n_chars", "fingerprint"]
    for r in out.join(edge_docs.select("doc_id", "text"), "doc_id").collect():
        assert [(p.hash, p.position) for p in r.fingerprint] == plain_winnow(r.text)
    plan = queries.op11_fingerprints(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
