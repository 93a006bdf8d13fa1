"""Inserts, migrations, traces, tokens, titles, QA spans, sources and streaming."""

import json
import os
import random
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from chunkwise.operators.annotate import answers_to_spans
from chunkwise.operators.store import append_if_absent, migrate_down, migrate_up, new_rows
from chunkwise.operators.titles import match_titles
from chunkwise.operators.tokens import contract_estimates, first_files_with_tail
from chunkwise.operators.traces import args_columns, pair_tool_calls
from chunkwise.sources import files

PARTS = "run_id long, seq long, part_kind string, tool_name string, tool_call_id string, args string, content string"


def test_insert_if_absent_and_idempotence(spark):
    path = tempfile.mkdtemp(prefix="store-") + "/t"
    batch = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "b2", 1), (3, "c", 0)], "k int, v string, pos int")
    assert append_if_absent(batch, path, ("k",), order=[F.col("pos")]) == 3  # empty target
    stored = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert stored == {1: "a", 2: "b", 3: "c"}  # key twice in one batch: first by order wins
    again = spark.createDataFrame([(2, "changed", 0), (4, "d", 0)], "k int, v string, pos int")
    assert append_if_absent(again, path, ("k",), order=[F.col("pos")]) == 1  # stored key is skipped, not updated
    assert append_if_absent(again, path, ("k",), order=[F.col("pos")]) == 0  # replay appends nothing
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "b", 3: "c", 4: "d"}


def test_new_rows_without_target(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert new_rows(batch, None, ("k",), order=[F.col("v")]).collect()[0].v == "a"


def test_migrations_round_trip(spark):
    s1 = spark.createDataFrame([(7, "f.txt", 0, "hello")], "id long, file_name string, chunk_index int, content string")
    up = migrate_up(s1)
    assert sorted(up.columns) == sorted(["contract_id", "document_name", "chunk_id", "text", "category", "page"])
    r = up.first()
    assert r.category == ["Uncategorized"] and r.page is None
    assert migrate_up(up) is up  # already stage 2: unchanged
    down = migrate_down(up)
    assert sorted(down.columns) == sorted(s1.columns) and down.first().content == "hello"


def test_trace_pairing_rules(spark):
    parts = [
        (1, 0, "tool-call", "retrieve_contracts", None, '{"search_query": "a"}', None),
        (1, 1, "tool-call", "retrieve_contracts", None, "not json", None),
        (1, 2, "tool-return", "retrieve_contracts", None, None, "R-latest"),  # no id: latest open call (seq 1)
        (1, 3, "tool-return", "retrieve_contracts", None, None, "R-next"),  # then seq 0
        (1, 4, "tool-return", "retrieve_products", None, None, "orphan"),  # return without call
        (2, 0, "tool-call", "retrieve_products", "x1", '{"q": 1}', None),
        (2, 1, "tool-call", "retrieve_products", "x2", None, None),
        (2, 2, "tool-return", "retrieve_products", "x1", None, "for-x1"),  # by id, not latest
        (2, 3, "tool-return", "retrieve_products", "zz", None, "unknown-id"),  # unknown id: latest open (x2)
    ]
    df = spark.createDataFrame(parts, PARTS)
    got = {(r.run_id, r.call_seq): (r.result, r.args_kind) for r in pair_tool_calls(df).collect()}
    assert got == {
        (1, 0): ("R-next", "json"), (1, 1): ("R-latest", "raw"),
        (2, 0): ("for-x1", "json"), (2, 1): ("unknown-id", "empty"),
    }


def test_args_columns(spark):
    from pyspark.sql import functions as F2

    df = spark.createDataFrame([('{"b": 1, "a": [true, null]}',), ("oops",), (None,), ('say "x"\n',)], "args string")
    got = [(r.j, r.k) for r in df.select(*[c.alias(n) for c, n in zip(args_columns(F2.col("args")), "jk")]).collect()]
    assert [k for _, k in got] == ["json", "raw", "empty", "raw"]
    assert [json.loads(j) for j, _ in got] == [{"a": [True, None], "b": 1}, {"raw": "oops"}, {}, {"raw": 'say "x"\n'}]


def test_token_estimates(spark):
    docs = spark.createDataFrame(
        [(f"f{i:02d}.txt", "x" * n) for i, n in enumerate([10, 4000, 4001, 7200, 7201] + [100] * 15)],
        "document_name string, text string",
    )
    est = {r.file_name: r for r in contract_estimates(docs).collect()}
    assert est["f00.txt"].estimated_chunks == 1 and est["f00.txt"].embedding_tokens == 3
    assert est["f02.txt"].estimated_chunks == 2 and est["f02.txt"].embedding_tokens == int(1001 * 1.25)
    assert est["f04.txt"].estimated_chunks == 3
    top = first_files_with_tail(contract_estimates(docs)).collect()
    assert len(top) == 16 and top[-1].files == 5
    assert sum(r.embedding_tokens for r in top) == sum(r.embedding_tokens for r in est.values())


def test_title_tiers_with_nfkd(spark):
    files_ = ["Alpha Beta Agreement.txt", "Café  Contract.txt", "Long name of a contract with forty chars plus tail.txt",
              "Long name of a contract with forty chars zzz other.txt"]
    titles = ["Alpha Beta Agreement", unicodedata.normalize("NFD", "Café Contract"),
              "Long name of a contract with forty chars different", "Nothing"]
    t = spark.createDataFrame([(x,) for x in titles], "title string")
    f = spark.createDataFrame([(x,) for x in files_], "file_name string")
    got = {r.title: (r.file_name, r.tier) for r in match_titles(t, f).collect()}
    assert got["Alpha Beta Agreement"] == ("Alpha Beta Agreement.txt", 1)
    assert got[titles[1]] == ("Café  Contract.txt", 2)
    assert got[titles[2]] == ("Long name of a contract with forty chars plus tail.txt", 3)  # smallest name wins
    assert got["Nothing"] == (None, None)


def test_answers_to_spans(spark):
    qa = spark.createDataFrame(
        [("T", "T__Cat A", "q", "  text  ", 5), ("T", "T-1", 'about "Cat B" here', "abc", 1),
         ("T", "", "no quotes", "abc", 2), ("T", "T__C", "q", "   ", 3), ("T", "T__C", "q", "abc", None)],
        "title string, qa_id string, question string, answer_text string, answer_start int",
    )
    got = sorted((r.category, r.start_char, r.end_char, r.text) for r in answers_to_spans(qa).collect())
    assert got == [("Cat A", 5, 9, "text"), ("Cat B", 1, 4, "abc"), ("Unknown", 2, 5, "abc")]


def test_sources_round_trip(spark):
    base = tempfile.mkdtemp(prefix="src-")
    with open(os.path.join(base, "a.txt"), "w", newline="") as fh:
        fh.write("one\r\ntwo\rthree\n")
    with open(os.path.join(base, "skip.md"), "w") as fh:
        fh.write("ignored")
    docs = {r.document_name: r.text for r in files.read_text_corpus(spark, base).collect()}
    assert docs == {"a.txt": "one\ntwo\nthree\n"}
    with pytest.raises(FileNotFoundError):
        files.read_text_corpus(spark, base + "/missing")
    ann_path = os.path.join(base, "ann.json")
    with open(ann_path, "w") as fh:
        json.dump({"a.txt": [{"category": "C", "start_char": 0, "end_char": 3}]}, fh)
    spans = files.read_annotations(spark, ann_path).collect()
    assert spans[0].text == "" and spans[0].category == "C"
    assert files.read_annotations(spark, base + "/none.json") is None
    with pytest.raises(FileNotFoundError):
        files.read_annotations(spark, base + "/none.json", on_missing="error")
    csv_path = os.path.join(base, "p.csv")
    with open(csv_path, "w") as fh:
        fh.write('ProductID,ProductName,ProductBrand,Gender,Price (INR),NumImages,Description,PrimaryColor\n'
                 '1,"Shirt, blue",B,Men,1199.5,4,"Line ""one""",Blue\n')
    p = files.read_products_csv(spark, csv_path).first()
    assert p.product_name == "Shirt, blue" and float(p.price_inr) == 1199.5 and p.description == 'Line "one"'


def test_stream_replay_is_idempotent(spark):
    from chunkwise.streaming.ingest import ingest_batch, start_ingest_stream

    base = tempfile.mkdtemp(prefix="stream-")
    src, store, ckpt = base + "/in", base + "/store", base + "/ckpt"
    docs = spark.createDataFrame([(f"d{i}", ("word " * (300 * i + 10))) for i in range(6)], "document_name string, text string")
    docs.repartition(3).write.parquet(src)
    q = start_ingest_stream(spark, src, "document_name string, text string", store, ckpt, None)
    q.awaitTermination()
    n = spark.read.parquet(store).count()
    assert n == docs.selectExpr("document_name", "text").transform(
        lambda d: __import__("chunkwise.operators.chunk", fromlist=["x"]).chunk_documents(d)).count()
    assert ingest_batch(docs, None, store) == 0  # a replayed batch appends nothing
    assert spark.read.parquet(store).count() == n


def test_snapshot_sink_and_status(spark):
    from chunkwise.operators.store import table_status

    base = tempfile.mkdtemp(prefix="snap-")
    df = spark.createDataFrame([("ALL", 0.5)], "category string, recall double")
    assert files.save_snapshot(df, base, "retrieval", "2026-01-01_10-00")
    back = spark.read.json(f"{base}/mode=retrieval/ts=2026-01-01_10-00").first()
    assert back.recall == 0.5
    df.write.parquet(f"{base}/store")
    st = {r.table: (r.exists, r.columns) for r in table_status(spark, {"store": f"{base}/store",
                                                                      "missing": f"{base}/nope"}).collect()}
    assert st == {"store": (True, "category,recall"), "missing": (False, None)}


def test_annotation_sink_round_trip(spark):
    base = tempfile.mkdtemp(prefix="ann-")
    spans = spark.createDataFrame(
        [("a.txt", "C1", 5, 9, "abcd"), ("a.txt", "C2", 0, 3, "xyz"), ("b.txt", "C1", 1, 2, "")],
        "document_name string, category string, start_char int, end_char int, text string",
    )
    files.write_annotations(spans, base + "/out")
    back = sorted(tuple(r) for r in files.read_annotation_lines(spark, base + "/out")
                  .select("document_name", "category", "start_char", "end_char", "text").collect())
    assert back == sorted(tuple(r) for r in spans.collect())


def test_status_offline_and_online(spark):
    from chunkwise.operators.stats import corpus_status

    chunks = spark.createDataFrame([("a", 0, ["X", "Y"]), ("a", 1, ["X"])], "document_name string, chunk_id int, category array<string>")
    prods = spark.createDataFrame([(1,)], "product_id int")
    off = corpus_status(prods, None).first()
    assert off.status == "offline" and off.contract_count == 0 and off.top_categories is None
    on = corpus_status(prods, chunks).first()
    assert (on.status, on.product_count, on.contract_count, on.category_count) == ("online", 1, 2, 2)
    assert [(t.category, t["count"]) for t in on.top_categories] == [("X", 2), ("Y", 1)]


def test_invalid_utf8_files(spark):
    base = tempfile.mkdtemp(prefix="utf-")
    with open(os.path.join(base, "good.txt"), "wb") as fh:
        fh.write("héllo".encode("utf-8"))
    with open(os.path.join(base, "bad.txt"), "wb") as fh:
        fh.write(b"\xff\xfe broken")
    assert files.invalid_utf8_count(spark, base).first().invalid_files == 1


def test_passages_with_empty_partitions(spark):
    from chunkwise.operators.passages import locate_passages

    docs = spark.createDataFrame([(i, "filler text " * 5 + ("the gold clause here" if i == 7 else "")) for i in range(40)],
                                 "doc_id long, text string").repartition(16)
    bench = spark.createDataFrame([(1, "gold clause"), (2, "never present"), (3, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_char) for r in locate_passages(docs, bench).collect()
                 if r.item_id != 3)
    assert got == [(7, 1, 64)]
    assert locate_passages(docs, bench).filter("item_id = 3").count() == 40  # empty passage: every document at 0


def test_pairing_equals_definition(spark):
    import random

    from spec_models import fills_by_rule

    rnd = random.Random(5)
    parts = []
    for run in range(90):
        ids = {0: ["a", "b", None, "", "zz"], 1: ["a", "b", "c"], 2: [None]}[run % 3]  # mixed, named only, brackets only
        for seq in range(rnd.randint(1, 14)):
            tool = rnd.choice(["retrieve_contracts", "retrieve_products"])
            if rnd.random() < 0.5:
                parts.append((run, seq, "tool-call", tool, rnd.choice(ids[:4]), '{"q": %d}' % seq, None))
            else:
                parts.append((run, seq, "tool-return", tool, rnd.choice(ids), None, rnd.choice([None, f"r{run}-{seq}", f"s{seq}"])))
    df = spark.createDataFrame(parts, PARTS)
    got = {(r.run_id, r.call_seq): (r.result, r.return_seq) for r in pair_tool_calls(df).collect()}
    assert got == fills_by_rule(parts)


def test_pluggable_token_counter(spark):
    from pyspark.sql import functions as F2

    docs = spark.createDataFrame([("a.txt", "one two three four five")], "document_name string, text string")
    words = lambda c: F2.size(F2.split(F2.trim(c), " +")).cast("long")
    r = contract_estimates(docs, counter=words).first()
    assert r.raw_tokens == 5 and r.embedding_tokens == 5


def test_materialize_corpus_and_skip(spark):
    base = tempfile.mkdtemp(prefix="mat-")
    docs = spark.createDataFrame([("a.pdf", "alpha\n"), ("b.txt", "beta")], "file_name string, text string")
    assert files.materialize_corpus(docs.limit(1), base + "/c") == 1
    assert files.materialize_corpus(docs, base + "/c") == 1  # the half-finished folder is completed
    assert sorted(os.listdir(base + "/c")) == ["a.txt", "b.txt"]
    assert files.materialize_corpus(docs, base + "/c") == 0
    assert files.materialize_corpus(docs, base + "/c", replace=True) == 2
    back = {r.document_name: r.text for r in files.read_text_corpus(spark, "file://" + base + "/c").collect()}
    assert back == {"a.txt": "alpha\n", "b.txt": "beta"}


def _random_trace(rnd, run, size):
    """Parts of one run: calls of two tools, named, loose and empty returns."""
    ids, parts = [], []
    for seq in range(size):
        tool = rnd.choice(["t", "t", "u"])
        if rnd.random() < 0.5:
            call_id = f"c{seq}" if rnd.random() < 0.5 else ""
            ids += [(call_id, tool)] if call_id else []
            parts.append((run, seq, "tool-call", tool, call_id, "{}", None))
        else:
            call_id, of = rnd.choice(ids) if ids and rnd.random() < 0.4 else ("", tool)
            parts.append((run, seq, "tool-return", of, call_id, None, None if rnd.random() < 0.3 else f"r{seq}"))
    return parts


PART_SCHEMA = "run_id long, seq long, part_kind string, tool_name string, tool_call_id string, args string, content string"


def test_pairing_in_short_stretches_equals_definition(spark, monkeypatch):
    from chunkwise.operators import traces
    from spec_models import fills_by_rule

    rnd = random.Random(21)
    parts = [p for run in range(60) for p in _random_trace(rnd, run, rnd.choice([5, 20, 60]))]
    want = fills_by_rule(parts)
    df = spark.createDataFrame(parts, PART_SCHEMA)
    for stretch, fan in ((3, 2), (7, 3), (1 << 16, 16)):
        monkeypatch.setattr(traces, "STRETCH", stretch)
        monkeypatch.setattr(traces, "FAN", fan)
        got = {(r.run_id, r.call_seq): (r.result, r.return_seq) for r in pair_tool_calls(df).collect()}
        assert got == want, (stretch, fan)


def test_one_run_of_a_million_events_is_walked_in_parallel(spark):
    """Every event of one run and tool: the walk is dealt over stretches and equals one walk over all."""
    from chunkwise.operators import traces

    n = 1_000_000
    h = "pmod(xxhash64(id), 100)"
    events = spark.range(n).selectExpr(
        "1L AS run_id", "'t' AS tool_name", "id AS time", f"IF({h} < 51, 0, IF({h} < 95, 1, 2)) AS what",
        f"IF({h} < 51, id, IF({h} < 95, NULL, pmod(xxhash64(id, 7), id + 1))) AS call", f"{h} % 10 = 3 AS empty", "cast(id AS string) AS content",
    ).where("what <> 2 OR pmod(xxhash64(call), 100) < 51")  # named returns name calls
    fills = traces.loose_fills(events)
    frame = events.withColumn("stretch", traces.F.lit(0)).toPandas().sort_values("time")
    plain = [f for f in traces._walker(1, True)(iter([frame]))][0]
    got = fills.toPandas().sort_values("return_seq")
    assert got["call_seq"].tolist() == plain["call"].tolist() and got["return_seq"].tolist() == plain["time"].tolist()
    assert n // traces.STRETCH > 10  # stretches that were walked beside each other


def test_passages_equal_search_in_every_document(spark):
    from chunkwise.operators.passages import locate_passages

    rnd = random.Random(6)
    letters = "abé😀 "
    docs = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300)))) for i in range(80)] + [(3, "aab"), (90, None), (91, ""), (None, "ab ab")]
    docs += [docs[5], docs[5]]
    whole = [d[1] for d in docs if d[1]]
    items = []
    for i in range(120):
        text = rnd.choice(whole)
        at = rnd.randint(0, len(text) - 1)
        items.append((i, text[at : at + rnd.choice([1, 2, 3, 7, 8, 9, 31, 64, 100, 300])]))
    items += [(200, "never there"), (201, None), (7, "ab"), (None, "a"), (203, "a"), (203, "a")]
    ddf, pdf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_char, r.passage_len, r.passage) for r in locate_passages(ddf, pdf).collect()), key=repr)
    want = sorted(((d, i, t.find(p), len(p), p) for d, t in docs if t is not None for i, p in items if p is not None and p in t), key=repr)
    assert got == want


def test_passage_keys_are_few():
    from chunkwise.operators.passages import text_keys

    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(50_000))
    for c, keys in text_keys(text, [4, 6, 8]).items():
        assert len(keys) < 5 * len(text) / 2**c


def test_sketches_of_appends_merge(spark, tmp_path):
    from chunkwise.operators.stats import append_sketches, distinct_across_ingests

    path = str(tmp_path / "sketches")
    for i in range(5):  # each append shares half of its keys with the next
        rows = spark.range(i * 1000, i * 1000 + 2000).selectExpr("cast(id AS string) AS name", "array(concat('c', id % 40), NULL) AS cats")
        append_sketches(rows, path, str(i), names=F.col("name"), cats=F.col("cats"))
    append_sketches(rows, path, "4", names=F.col("name"), cats=F.col("cats"))  # a replay changes nothing
    append_sketches(rows.limit(0), path, "5", names=F.col("name"), cats=F.col("cats"))
    r = distinct_across_ingests(spark.read.parquet(path), "names", "cats").first()
    assert (r.ingests, r.n_rows, r.cats) == (6, 10_000, 40) and abs(r.names - 6000) < 0.03 * 6000


def test_snapshots_read_back_with_mode_and_stamp(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([("a", 0.5), (None, 1.0)], "category string, recall double")
    assert files.save_snapshot(df, root, "m1", "2024-01-01_00-00") and files.save_snapshot(df.limit(1), root, "m2", "2024-01-02_10-30")
    back = files.read_snapshots(spark, root, "category string, recall double")
    assert sorted((r.mode, r.ts, r.recall) for r in back.collect()) == [
        ("m1", "2024-01-01_00-00", 0.5), ("m1", "2024-01-01_00-00", 1.0), ("m2", "2024-01-02_10-30", 0.5)]
    assert "PartitionFilters: [isnotnull(mode" in back.where("mode = 'm2'")._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "file").write_text("x")
    assert files.save_snapshot(df, str(tmp_path / "file"), "m", "t") is False


def test_stream_source_has_as_many_files_as_the_session_asks_for(spark):
    """The documents of the streaming ingest are not dealt to a fixed number of files."""
    from pyspark.sql import functions as F

    from chunkwise.plans import q_misc

    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = q_misc.write_incoming(spark.range(300).select(F.concat(F.lit("d"), "id").alias("document_name"), F.lit("t").alias("text")), q_misc.scratch(spark, "none", "incoming-test"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    rows = spark.read.parquet(folder)
    assert rows.count() == 300 and rows.select(F.input_file_name()).distinct().count() == 11


def test_a_table_of_one_file_is_dealt_to_all_cores(spark, tmp_path):
    from chunkwise.session import spread

    path = str(tmp_path / "one")
    spark.range(5000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 50) AS text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    dealt = spread(df)
    assert "hashpartitioning(doc_id" in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.exceptAll(df).isEmpty() and dealt.count() == 5000
    many = str(tmp_path / "many")
    df.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(many)
    assert "Exchange" not in spread(spark.read.parquet(many))._jdf.queryExecution().executedPlan().toString()


def test_passage_keys_are_few():
    from chunkwise.operators.passages import text_keys

    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(50_000))
    for c, keys in text_keys(text, [4, 6, 8]).items():
        assert len(keys) < 5 * len(text) / 2**c


def test_sketches_of_appends_merge(spark, tmp_path):
    from chunkwise.operators.stats import append_sketches, distinct_across_ingests

    path = str(tmp_path / "sketches")
    for i in range(5):  # each append shares half of its keys with the next
        rows = spark.range(i * 1000, i * 1000 + 2000).selectExpr("cast(id AS string) AS name", "array(concat('c', id % 40), NULL) AS cats")
        append_sketches(rows, path, str(i), names=F.col("name"), cats=F.col("cats"))
    append_sketches(rows, path, "4", names=F.col("name"), cats=F.col("cats"))  # a replay changes nothing
    append_sketches(rows.limit(0), path, "5", names=F.col("name"), cats=F.col("cats"))
    r = distinct_across_ingests(spark.read.parquet(path), "names", "cats").first()
    assert (r.ingests, r.n_rows, r.cats) == (6, 10_000, 40) and abs(r.names - 6000) < 0.03 * 6000


def test_snapshots_read_back_with_mode_and_stamp(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([("a", 0.5), (None, 1.0)], "category string, recall double")
    assert files.save_snapshot(df, root, "m1", "2024-01-01_00-00") and files.save_snapshot(df.limit(1), root, "m2", "2024-01-02_10-30")
    back = files.read_snapshots(spark, root, "category string, recall double")
    assert sorted((r.mode, r.ts, r.recall) for r in back.collect()) == [
        ("m1", "2024-01-01_00-00", 0.5), ("m1", "2024-01-01_00-00", 1.0), ("m2", "2024-01-02_10-30", 0.5)]
    assert "PartitionFilters: [isnotnull(mode" in back.where("mode = 'm2'")._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "file").write_text("x")
    assert files.save_snapshot(df, str(tmp_path / "file"), "m", "t") is False


def test_stream_source_has_as_many_files_as_the_session_asks_for(spark):
    """The documents of the streaming ingest are not dealt to a fixed number of files."""
    from pyspark.sql import functions as F

    from chunkwise.plans import q_misc

    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = q_misc.write_incoming(spark.range(300).select(F.concat(F.lit("d"), "id").alias("document_name"), F.lit("t").alias("text")), q_misc.scratch(spark, "none", "incoming-test"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    rows = spark.read.parquet(folder)
    assert rows.count() == 300 and rows.select(F.input_file_name()).distinct().count() == 11


def test_text_corpus_is_read_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}.txt").write_bytes(f"text {i}\r\nend".encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # as much as an opened file counts
    try:
        docs = files.read_text_corpus(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() <= 8
        assert sorted(tuple(r) for r in docs.collect()) == sorted((f"d{i}.txt", f"text {i}\nend") for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _odd_corpus(folder):
    """Files of many kinds, and what of them the corpus has."""
    texts = {f"d{i}.txt": f"text {i}".encode() for i in range(40)}
    texts |= {"a b%20+é{x}.txt": "\ufeffé\r\n\r\n".encode(), "cr.txt": b"\r", "bad.txt": b"\xff\r\xfe", "_k=v.txt": b"k", "long.txt": b"x\r\n" * 5000}
    left_out = {"empty.txt": b"", ".hidden.txt": b"h", "_under.txt": b"u", "_metadata.txt": b"m", "d.md": b"o", "d.txt.1.part": b"p", "D.TXT": b"c", "d.txt\n": b"n"}
    for name, text in {**texts, **left_out}.items():
        (folder / name).write_bytes(text)
    (folder / "folder.txt").mkdir()
    (folder / "folder.txt" / "inner.txt").write_bytes(b"inner")
    (folder / "link.txt").symlink_to(folder / "d1.txt")
    texts["link.txt"] = texts["d1.txt"]
    odd = "a b%20+é{x}.txt"
    texts[odd.replace("%", "%25").replace(" ", "%20").replace("{", "%7B").replace("}", "%7D")] = texts.pop(odd)  # as Spark shows it
    return sorted((n, t.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")) for n, t in texts.items())


def test_text_corpus_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no names of the corpus' files, and the rows are those of Spark's own reader."""
    expected = _odd_corpus(tmp_path)
    monkeypatch.setattr(files, "LOT_FILES", 7, raising=False)
    monkeypatch.setattr(files, "LOT_BYTES", 100, raising=False)
    monkeypatch.setattr(files, "LOTS_A_TASK", 2, raising=False)
    docs = files.read_text_corpus(spark, str(tmp_path))
    assert docs.inputFiles() == []
    (tmp_path / "later.txt").write_bytes(b"not there when the folder was listed")
    assert docs.rdd.getNumPartitions() >= 4 and sorted(tuple(r) for r in docs.collect()) == expected
    (tmp_path / "later.txt").unlink()
    by_spark = files._scanned_texts(spark, str(tmp_path), "*.txt")
    assert sorted(tuple(r) for r in by_spark.select("document_name", F.regexp_replace("value", "\r\n?", "\n")).collect()) == expected
    names = sorted(n for n, _ in expected if n in ("cr.txt", "d1.txt", "d2.txt"))
    assert sorted(r.document_name for r in files.read_text_corpus(spark, f"file:{tmp_path}/", "{cr,d[12]}.t?t").collect()) == names
    (tmp_path / "none").mkdir()
    assert files.read_text_corpus(spark, str(tmp_path / "none")).collect() == []


def test_text_corpus_of_a_store_that_only_spark_reads(spark, tmp_path):
    expected = _odd_corpus(tmp_path)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.corpus.link./in", f"file://{tmp_path}")
    docs = files.read_text_corpus(spark, "viewfs://corpus/in")
    assert sorted(tuple(r) for r in docs.collect()) == expected


def test_passage_keys_leave_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    from chunkwise.operators import passages

    sizes = [400_000, 700_000, 10, 2_000_000, 0, 5, 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * n for n in sizes])], ["dk", "text"])
    pieces = list(passages._pieces(batch, 1))
    assert [r for p in pieces for r in p.column(0).to_pylist()] == list(range(7))
    chars = [[len(t) for t in p.column(1).to_pylist()] for p in pieces]
    assert all(len(c) == 1 or sum(c) <= passages.PIECE_CHARS for c in chars) and len(pieces) >= 4
    assert list(passages._pieces(batch.slice(0, 0), 1)) == []
