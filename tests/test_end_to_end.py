"""End-to-end builds from files on disk and the answer evaluation with stand-in model clients."""

import json
import os
import tempfile

import pandas as pd

from chunkwise.plans.answer_eval import answer_evaluation
from chunkwise.plans.ingest import ingest_contracts, ingest_products
from spec_models import categories_model, chunk_spans_by_rule


def test_ingest_products_and_contracts(spark):
    base = tempfile.mkdtemp(prefix="e2e-")
    csv_path = os.path.join(base, "products.csv")
    with open(csv_path, "w") as fh:
        fh.write("ProductID,ProductName,ProductBrand,Gender,Price (INR),NumImages,Description,PrimaryColor\n")
        fh.write('1,Shirt,B1,Men,999.5,3,"Blue, slim",Blue\n2,Dress,B2,Women,1499,5,Red dress,Red\n1,Shirt again,B1,Men,1,1,dup,Blue\n')
    store_p = os.path.join(base, "store_products")
    assert ingest_products(spark, csv_path, store_p).first().products_added == 2
    assert ingest_products(spark, csv_path, store_p).first().products_added == 0  # re-run: nothing
    stored = {r.product_id: (r.product_name, len(r.embedding)) for r in spark.read.parquet(store_p).collect()}
    assert stored == {1: ("Shirt", 64), 2: ("Dress", 64)}  # first row of a repeated id wins

    corpus = os.path.join(base, "contracts")
    os.makedirs(corpus)
    texts = {"a.txt": ("Clause one. " * 600), "b.txt": "short agreement text", "c.txt": "x. " * 2000}
    for name, text in texts.items():
        with open(os.path.join(corpus, name), "w") as fh:
            fh.write(text)
    ann_path = os.path.join(base, "ann.json")
    with open(ann_path, "w") as fh:
        json.dump({"a.txt": [{"category": "Law", "start_char": 5000, "end_char": 5100, "text": "t"}],
                   "zzz.txt": [{"category": "Gone", "start_char": 0, "end_char": 5}]}, fh)
    store_c = os.path.join(base, "store_contracts")
    s = ingest_contracts(spark, corpus, ann_path, store_c).first()
    n_exp = sum(len(chunk_spans_by_rule(t)) for t in texts.values())
    assert (s.files, s.annotated_files, s.chunks, s.chunks_added) == (3, 1, n_exp, n_exp)
    assert ingest_contracts(spark, corpus, ann_path, store_c).first().chunks_added == 0
    rows = spark.read.parquet(store_c).filter("document_name = 'a.txt'").collect()
    for r in rows:
        assert r.category == categories_model(r.chunk_start, r.chunk_end, [("Law", 5000, 5100)])
    assert ingest_contracts(spark, corpus, os.path.join(base, "missing.json"), os.path.join(base, "s2")).first().categorized_chunks == 0


def test_answer_evaluation_with_stand_in_clients(spark):
    spans = spark.createDataFrame(
        [("doc_1.txt", "Governing Law", 0, 10, "laws of x"), ("doc_2.txt", "Governing Law", 5, 9, "state"),
         ("doc_3.txt", "Audit Rights", 1, 4, "audit"), ("doc_4.txt", "Audit Rights", 2, 3, "   ")],
        "document_name string, category string, start_char int, end_char int, text string",
    )

    def answerer(q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"answer_text": ["ans: " + x for x in q],
                             "retrieved_context": ["" if "audit" in x.lower() else "ctx" for x in q]})

    def judge(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            faithful = "(none retrieved)" not in p
            out.append(json.dumps({"correctness": "jurisdiction" in p, "correctness_reason": "r",
                                   "faithfulness": faithful, "faithfulness_reason": "f"}))
        return pd.Series(out)

    ev = answer_evaluation(spans, answerer, judge)
    rep = {r.category: (r.cases, r.correctness, r.faithfulness) for r in ev.report.collect()}
    assert rep["Governing Law"] == (2, 1.0, 1.0)
    assert rep["Audit Rights"] == (1, 0.0, 0.0)  # blank span dropped; empty context -> not faithful
    assert rep["ALL"] == (3, round(2 / 3, 6), round(2 / 3, 6))
    q = {r.category: r.question for r in ev.cases.collect()}
    assert q["Governing Law"].startswith("Which jurisdiction's laws govern doc 1") or "doc 2" in q["Governing Law"]
