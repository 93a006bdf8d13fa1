"""Relevance labelling and ranking metrics against brute-force models."""

import random

import pytest

from chunkwise.operators.metrics import KEY_COMPAT, KEY_QUALIFIED, case_metrics
from chunkwise.operators.relevance import label_relevance
from spec_models import metrics_model, relevance_model


def _data():
    rnd = random.Random(11)
    vocab = ["the", "party", "shall", "not", "assign", "agreement", "law", "of", "state", "x1", "término", "ley"]
    chunks, spans = [], []
    for d in range(6):
        for c in range(5):
            words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
            text = " ".join(words)
            if c == 4:
                text = "   "  # blank chunk
            chunks.append((f"doc{d}", c, text, c * 100, c * 100 + 150))
    specials = ["the the the party", "---", "(he", "state.", "law of", "shall not assign", "x", "", "   ",
                "Party, shall", "ley término", "assign the"]
    i = 0
    for d in range(6):
        for t in specials + [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 8))) for _ in range(6)]:
            s = rnd.randint(0, 700)
            spans.append((f"a{i}", f"doc{d}", s, s + len(t), t))
            i += 1
    return chunks, spans


@pytest.mark.parametrize("use_offsets", [True, False])
def test_labels_match_model(spark, use_offsets):
    chunks, spans = _data()
    cdf = spark.createDataFrame(chunks, "document_name string, chunk_id int, text string, chunk_start int, chunk_end int")
    sdf = spark.createDataFrame(spans, "ann_id string, document_name string, start_char int, end_char int, text string")
    got = {(r.ann_id, r.chunk_id): r.confidence for r in label_relevance(sdf, cdf, 0.5, use_offsets).collect()}
    exp = {}
    for aid, doc, s, e, t in spans:
        for d, cid, ct, cs, ce in chunks:
            if d != doc:
                continue
            ok, conf = relevance_model(t, s, e, ct, cs if use_offsets else None, ce if use_offsets else None)
            if ok:
                exp[(aid, cid)] = conf
    assert got == exp


def test_ratio_exactly_half(spark):
    cdf = spark.createDataFrame([("d", 0, "alpha beta", 0, 10)], "document_name string, chunk_id int, text string, chunk_start int, chunk_end int")
    sdf = spark.createDataFrame([("a", "d", 50, 60, "alpha gamma")], "ann_id string, document_name string, start_char int, end_char int, text string")
    r = label_relevance(sdf, cdf).collect()
    assert len(r) == 1 and r[0].confidence == 0.5 and r[0].signal == "tokens"


def _metric_case(spark, retrieved, relevant, k, key):
    cases = spark.createDataFrame([("c",)], "case_id string")
    ret = spark.createDataFrame([("c", i + 1, d, cid) for i, (d, cid) in enumerate(retrieved)] or [("x", 1, "d", 0)],
                                "case_id string, rank int, document_name string, chunk_id int")
    ret = ret.filter("case_id = 'c'")
    rel = spark.createDataFrame([("c", d, cid) for d, cid in relevant] or [("x", "d", 0)],
                                "case_id string, document_name string, chunk_id int").filter("case_id = 'c'")
    r = case_metrics(cases, ret, rel, k, "case_id", key).first()
    return (r.recall, r.precision, r.mrr, r.ndcg)


@pytest.mark.parametrize("retrieved,relevant", [
    ([("a", 1), ("a", 2)], []),  # no relevant
    ([], [("a", 1)]),  # nothing retrieved
    ([("a", 3), ("a", 1)], [("a", 1), ("a", 2)]),  # fewer than k
    ([("a", i) for i in range(10, 17)] + [("a", 1)], [("a", 1)]),  # first hit at k
    ([("b", 1), ("a", 1), ("a", 2)], [("a", 1)]),  # same chunk_id in two documents
])
@pytest.mark.parametrize("key", [KEY_QUALIFIED, KEY_COMPAT])
def test_metrics(spark, retrieved, relevant, key):
    k = 8
    got = _metric_case(spark, retrieved, relevant, k, key)
    if key == KEY_COMPAT:
        ret_ids, rel_ids = [c for _, c in retrieved], {c for _, c in relevant}
    else:
        ret_ids, rel_ids = list(retrieved), set(relevant)
    exp = metrics_model(ret_ids, rel_ids, k)
    assert got == pytest.approx(exp)


def test_labels_match_model_on_nulls_odd_offsets_and_long_spans(spark):
    rnd = random.Random(5)
    vocab = ["a", "ab", "abc", "bcd", "cdab", "x_1", "né", "--", "(", "§", "c.d"]
    words = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    offset = lambda: rnd.choice([0, 50, 4095, 4096, 9000, 2**31 - 1, None, rnd.randint(0, 20000)])
    texts = [None, "", " \t", "§", "(", "-- --", "ab", "cda", "a b", "AB\n ab", words(400)]
    chunks = [("d" if i % 3 else "e", i, rnd.choice(texts) if i % 2 else words(rnd.randint(1, 9)), offset(), offset()) for i in range(60)]
    spans = [(f"a{i}", "d" if i % 2 else "e", rnd.randint(0, 20000), rnd.choice([0, 30, 8000, 2**31 - 1]),
              rnd.choice(texts) if i % 3 else words(rnd.randint(1, 6))) for i in range(80)]
    spans.append(("none", None, 0, 10, "ab"))
    cdf = spark.createDataFrame(chunks, "document_name string, chunk_id int, text string, chunk_start int, chunk_end int")
    sdf = spark.createDataFrame(spans, "ann_id string, document_name string, start_char int, end_char int, text string")
    got = {(r.ann_id, r.chunk_id): r.confidence for r in label_relevance(sdf, cdf).collect()}
    exp = {}
    for aid, doc, s, e, t in spans:
        for d, cid, ct, cs, ce in chunks:
            if d == doc:
                if t is None or ct is None:  # no text: only the offsets can speak
                    ok, conf = (cs is not None and ce is not None and s < ce and e > cs), 1.0
                else:
                    ok, conf = relevance_model(t, s, e, ct, cs, ce)
                if ok:
                    exp[(aid, cid)] = conf
    assert got == exp and len(set(exp.values())) > 2
    assert label_relevance(sdf.where("ann_id = ''"), cdf).count() == 0 == label_relevance(sdf, cdf.where("chunk_id < 0")).count()


def test_labelling_shuffles_seven_times_after_its_tables_are_made(spark):
    chunks, spans = _data()
    cdf = spark.createDataFrame(chunks, "document_name string, chunk_id int, text string, chunk_start int, chunk_end int")
    sdf = spark.createDataFrame(spans, "ann_id string, document_name string, start_char int, end_char int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = label_relevance(sdf, cdf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 7 and "Python" not in plan
