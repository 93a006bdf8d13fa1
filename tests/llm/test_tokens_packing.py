import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import SF_SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkwise.llm import packing, queries, token_files
from chunkwise.llm.storage import new_folder
from chunkwise.llm.tokens import TextEncoder, default_path


def library_ids(name, text, end):
    tok = Tokenizer.from_file(default_path(name))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    rnd = random.Random(5)
    parts = ["a", "don't", " ", "  ", "\n", "\n\n", "É", "é", "́", "ß", "漢字", "😀", "1", "23", ".", ",", "'s", "...", "<|endoftext|>",
             "\t", "\r\n", "\xa0", "​", "　", "Σ", "İ", "\x1c", "\x85", "word", "Word,"]
    tok = Tokenizer.from_file(default_path(name))
    enc = TextEncoder(default_path(name))
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 15)))
        assert enc.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def check_token_rows(rows, docs, name, end):
    start = 0
    assert [r["id"] for r in rows] == sorted((d["doc_id"] for d in docs), key=lambda i: (i is not None, i or 0))
    texts = defaultdict(list)
    for d in docs:
        texts[d["doc_id"]].append(zlib.crc32(library_ids(name, d["text"], end).tobytes()))
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        texts[r["id"]].remove(r["ids_crc32"])


def test_token_files_edge_rows(spark, edge_docs):
    folder = new_folder(spark, "test")
    token_files.write_token_files(edge_docs, folder, default_path("word_bpe_49k.json"), 1, shards=3)
    rows = sorted((r.asDict() for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r["start"])
    check_token_rows(rows, edge_docs.collect(), "word_bpe_49k.json", 1)


def test_token_files_hot_id_and_empty(spark, no_docs):
    folder = new_folder(spark, "test")
    assert token_files.write_token_files(no_docs, folder, default_path("word_bpe_49k.json"), 1, shards=3) == []
    assert token_files.read_token_files(spark, folder).count() == 0
    hot = spark.range(90).select(F.when(F.col("id") < 60, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"))
    folder = new_folder(spark, "test")
    manifest = token_files.write_token_files(hot, folder, default_path("word_bpe_49k.json"), 1, shards=6)
    assert max(s["docs"] for s in manifest) < 45  # the hot id is spread
    rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and len(rows) == 90


def test_token_query(spark):
    rows = queries.op1_token_files(spark, SF_SMALL).orderBy("start").withColumnRenamed("doc_id", "id").collect()
    docs = queries.table(spark, SF_SMALL, "documents").collect()
    check_token_rows([r.asDict() for r in rows], docs, "word_bpe_49k.json", 1)


def check_packing(rows, docs, name, end, size):
    whole = defaultdict(list)
    for d in docs:
        whole[d["doc_id"]].append(library_ids(name, d["text"], end))
    by_bin = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert set(pieces) == set(whole)
    for doc, texts in whole.items():
        expected = []
        for ids in texts:
            cuts = packing.cut_lengths(len(ids), size)
            start = 0
            for k, n in enumerate(cuts):
                expected.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                start += n
        assert sorted(expected) == sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc])
    return len(by_bin)


def test_packing_edges(spark, edge_docs, no_docs):
    out = packing.pack_documents(edge_docs, default_path("byte_bpe_50k.json"), 2)
    check_packing(out.collect(), edge_docs.collect(), "byte_bpe_50k.json", 2, 1024)
    assert packing.pack_documents(no_docs, default_path("byte_bpe_50k.json"), 2).count() == 0


def test_packing_query_is_tight(spark):
    out = queries.op3_best_fit_packing(spark, SF_SMALL).collect()
    bins = check_packing(out, queries.table(spark, SF_SMALL, "documents").collect(), "byte_bpe_50k.json", 2, 1024)
    assert bins <= 1.05 * sum(r["length"] for r in out) / 1024 + 4


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the tightest fit, now full
    assert bins.place(4) == (0, 6)
    assert bins.place(5) == (2, 0) and bins.place(8) == (3, 0)
    assert bins.place(9) == (4, 0)  # closes bin 3, the fullest
    assert bins.place(1) == (4, 9) and bins.place(2) == (2, 5)
