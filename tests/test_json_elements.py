"""Byte ranges of single JSON documents against the whole document parsed at once."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkwise.sources import files, json_elements


def pieces(rng):
    odd = ['"', "\\", "}", "{", "]", "[", ":", ",", " ", "é", "𝄞", "\n", "a", "bc", '\\"', "}}", '":']
    return "".join(rng.choice(odd) for _ in range(rng.randrange(12)))


def annotation_map(rng, n):
    return {
        f"{i}{pieces(rng)}": [
            {"category": pieces(rng), "start_char": rng.randrange(100), "end_char": rng.randrange(100), "text": pieces(rng)}
            for _ in range(rng.choice([0, 0, 1, 2, 9]))
        ]
        for i in range(n)
    }


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
def test_annotation_maps_in_ranges(spark, tmp_path, layout, range_bytes):
    rng = random.Random(range_bytes)
    docs = annotation_map(rng, 6 if range_bytes < 10 else 30)
    path = tmp_path / "ann.json"
    path.write_text(json.dumps(docs, **layout), encoding="utf-8")
    rows = files.read_annotations(spark, str(path), range_bytes=range_bytes).collect()
    got = {(r.document_name, r.ann_pos): (r.category, r.start_char, r.end_char, r.text) for r in rows}
    assert len(got) == len(rows)
    assert got == {(k, i): (a["category"], a["start_char"], a["end_char"], a["text"]) for k, v in docs.items() for i, a in enumerate(v)}


def test_walk_of_every_cut(tmp_path):
    """All elements and keys come out once, whatever the range length."""
    rng = random.Random(5)
    raw = json.dumps(annotation_map(rng, 12)).encode()
    path = tmp_path / "a.json"
    path.write_bytes(raw)
    want = [(None, e) for v in json.loads(raw).values() for e in map(json.dumps, v)]
    for step in range(3, 400, 7):
        got, keys, quotes, depth = [], [], 0, 0
        with open(path, "rb") as file:
            for start in range(0, len(raw), step):
                data, at = json_elements._range(file, start, min(start + step, len(raw)), len(raw))
                rest = iter([raw[at : at + 5], raw[at + 5 :], b""])
                for key, e in json_elements.elements(data, bool(quotes % 2), depth, lambda: next(rest, b"")):
                    keys.append(key) if e is None else got.append((None, json.dumps(json.loads(e))))
                depth += json_elements.depth_change(data, bool(quotes % 2))
                quotes += json_elements._ESCAPED.sub(b"", data).count(b'"')
        assert got == want and keys == list(json.loads(raw)) and depth == 0 and quotes % 2 == 0


def test_qa_document_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    qa = {"version": "1 }", "data": [
        {"title": pieces(rng), "paragraphs": [{"context": pieces(rng), "qas": [
            {"id": f"{i}_{j}", "question": pieces(rng), "answers": [{"text": pieces(rng), "answer_start": j}], "is_impossible": False} for j in range(4)
        ]}]} for i in range(40)
    ]}
    path = tmp_path / "qa.json"
    path.write_text(json.dumps(qa))
    rows = files.read_qa_corpus(spark, str(path), range_bytes=200)
    want = [
        (d["title"], q["id"], q["question"], q["answers"][0]["text"], q["answers"][0]["answer_start"])
        for d in qa["data"] for q in d["paragraphs"][0]["qas"]
    ]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    found = json_elements.json_elements(spark, str(path), 200)
    assert [r.place for r in found.orderBy("place").collect()] == list(range(40))


def test_odd_documents(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for i, text in enumerate(["{}", "", '{"a": []}', '{"a": null, "b": 3}', "[]"]):
        (tmp_path / "empty" / f"{i}.json").write_text(text)
    assert json_elements.json_elements(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "cut.json").write_text('{"a": [{"category": "x"')
    with pytest.raises(ValueError):
        json_elements.json_elements(spark, str(tmp_path / "cut.json"))


def test_map_writer_splits_a_hot_document(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise(F.lit('hot "doc"')).alias("document_name"), F.lit("c").alias("category"),
        F.col("id").cast("int").alias("start_char"), F.col("id").cast("int").alias("end_char"), F.lit("t}").alias("text"),
    )
    folder = files.write_annotation_map(rows, str(tmp_path))
    back = files.read_annotations(spark, folder, range_bytes=500)
    assert sorted((r.document_name, r.start_char) for r in back.collect()) == sorted((r.document_name, r.start_char) for r in rows.collect())


def test_array_writer_and_reader(spark, tmp_path):
    texts = [json.dumps({"i": i, "t": 'a "}"\n{'}) for i in range(250)]
    rows = spark.createDataFrame([(t,) for t in texts], "element string")
    json_elements.write_json_arrays(rows, 'the "data"', str(tmp_path / "out"), per_file=40)
    back = json_elements.json_elements(spark, str(tmp_path / "out"), range_bytes=300).collect()
    assert sorted(json.loads(r.element)["i"] for r in back) == list(range(250)) and {r.key for r in back} == {'the "data"'}
    for file in (tmp_path / "out").rglob("*.txt"):
        assert json.loads(file.read_text())['the "data"'][0] is None
    json_elements.write_json_arrays(rows.limit(0), "data", str(tmp_path / "none"))
    assert json_elements.json_elements(spark, str(tmp_path / "none")).count() == 0


def test_elements_are_passed_on_in_bounded_batches(tmp_path):
    """Long elements leave a task a few at a time, not 2,000."""
    path = tmp_path / "long.json"
    path.write_text(json.dumps({"data": [{"t": "x" * 100_000, "i": i} for i in range(200)]}))
    size = path.stat().st_size
    ranges = pd.DataFrame([(str(path), size, 0, size, 0, 0)], columns=["path", "size", "start", "stop", "in_string", "depth"])
    batches = list(json_elements._elements_of(iter([ranges])))
    found = [e for b in batches for e in b["element"] if e is not None]
    assert [json.loads(e)["i"] for e in found] == list(range(200))
    assert max(b["element"].str.len().sum() for b in batches) <= json_elements.BATCH_CHARS + 110_000


def test_keys_do_not_copy_the_rest_of_a_range():
    class Counted(bytes):
        copied = 0

        def __getitem__(self, at):
            got = super().__getitem__(at)
            Counted.copied += len(got) if isinstance(at, slice) else 0
            return got

    data = Counted(json.dumps({f"file {i}": [{"a": i}] for i in range(500)}).encode())
    found = list(json_elements.elements(data, False, 0, lambda: b""))
    assert len(found) == 1000 and found[-2][0] == "file 499" and json.loads(found[-1][1]) == {"a": 499}
    assert Counted.copied <= len(data)
