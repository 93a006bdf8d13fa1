"""Span-overlap categorisation and ingestion summary."""

from chunkwise.operators.categorize import assign_categories, ingest_summary
from spec_models import categories_model


def test_overlap_edge_cases(spark):
    chunks = spark.createDataFrame(
        [("d1", 0, "t", 0, 4000), ("d1", 1, "t", 3200, 7200), ("d1", 2, "t", 6400, 10400), ("d2", 0, "t", 0, 50),
         ("d3", 0, "t", 0, 0)],
        "document_name string, chunk_id int, text string, chunk_start int, chunk_end int",
    )
    spans = [
        ("d1", "Touch", 4000, 4100),  # touches chunk 0's end: only chunk 1
        ("d1", "Zero", 5000, 5000),  # zero length inside chunk 1
        ("d1", "Past", 12000, 13000),  # past the text end
        ("d1", "Dup", 100, 200), ("d1", "Dup", 300, 400),  # duplicate category in one chunk
        ("d1", "Long", 0, 100000),
        ("d1", "Inverted", 3500, 3300),
        ("d3", "Neg", -5, 5),
    ]
    ann = spark.createDataFrame(spans, "document_name string, category string, start_char int, end_char int")
    got = {(r.document_name, r.chunk_id): r.category for r in assign_categories(chunks, ann).collect()}
    for (doc, cid), cats in got.items():
        row = [c for c in chunks.collect() if c.document_name == doc and c.chunk_id == cid][0]
        exp = categories_model(row.chunk_start, row.chunk_end, [(c, s, e) for d, c, s, e in spans if d == doc])
        assert cats == exp, (doc, cid, cats, exp)
    assert got[("d2", 0)] == ["Uncategorized"]


def test_small_bucket_width_is_exact(spark):
    import random

    rnd = random.Random(3)
    chunks = [("d", i, "t", i * 300, i * 300 + 500) for i in range(40)]
    spans = [("d", f"C{j % 5}", s, s + rnd.randint(0, 900)) for j, s in enumerate(rnd.sample(range(0, 12500), 60))]
    cdf = spark.createDataFrame(chunks, "document_name string, chunk_id int, text string, chunk_start int, chunk_end int")
    adf = spark.createDataFrame(spans, "document_name string, category string, start_char int, end_char int")
    got = {r.chunk_id: r.category for r in assign_categories(cdf, adf, bucket=97).collect()}
    for _, cid, _, cs, ce in chunks:
        assert got[cid] == categories_model(cs, ce, [(c, s, e) for _, c, s, e in spans])


def test_no_annotation_file(spark):
    chunks = spark.createDataFrame([("d", 0, "t", 0, 5)], "document_name string, chunk_id int, text string, chunk_start int, chunk_end int")
    assert assign_categories(chunks, None).first().category == ["Uncategorized"]


def test_ingest_summary(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "document_name string, text string")
    chunks = spark.createDataFrame(
        [("a", 0, ["C"]), ("a", 1, ["Uncategorized"]), ("b", 0, ["Uncategorized"])],
        "document_name string, chunk_id int, category array<string>",
    )
    ann = spark.createDataFrame([("a", "C", 0, 1), ("zzz", "C", 0, 1)], "document_name string, category string, start_char int, end_char int")
    r = ingest_summary(docs, chunks, ann).first()
    assert (r.files, r.annotated_files, r.chunks, r.categorized_chunks, r.uncategorized_chunks) == (2, 1, 3, 1, 2)
