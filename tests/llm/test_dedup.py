from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import SF_SMALL, prose

from chunkwise.llm import decontaminate, line_dedup, minhash_dedup, queries
from chunkwise.llm.text_hash import words


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def brute_classes(texts):
    """Least id of each id's component of links; texts without words stand alone."""
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    own = {i: shingles(t) for i, t in texts.items()}
    by = defaultdict(set)
    for i, s in own.items():
        for x in s:
            by[x].add(i)
    for pair in {(a, b) for group in by.values() for a in group for b in group if a < b}:
        if jaccard(own[pair[0]], own[pair[1]]) >= 0.8 - 1e-9:
            a, b = find(pair[0]), find(pair[1])
            top[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_near_duplicate_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF_SMALL, "documents").collect()}
    got = {r.doc_id: r.class_id for r in queries.op4_minhash_dedup(spark, SF_SMALL).collect()}
    assert got == brute_classes(texts)


def test_chain_of_links_and_copies(spark):
    w = prose(11, 200).split()
    step = lambda k: " ".join([f"new{i}" for i in range(k)] + w[k:])  # noqa: E731  similar to its neighbours only
    rows = [(i, step(8 * i)) for i in range(8)] + [(100, step(0)), (101, prose(12, 80)), (102, None), (103, ""), (104, None)]
    rows = [(9 - i if i < 8 else i, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(dict(rows)) and len(set(got.values())) < len(got) - 4
    kept = sorted(r.doc_id for r in minhash_dedup.keep_one(docs).collect())
    assert kept == sorted(set(got.values()))


def test_pairs_on_a_template_are_all_found(spark):
    """Pages that agree at 0.75 fill the buckets; the pairs among them are near copies at 0.81."""
    frame, texts = prose(200, 184), {}
    for i in range(250):
        own = prose(3000 + i, 30).split()
        texts[2 * i], texts[2 * i + 1] = f"{frame} {' '.join(own)}", f"{frame} {' '.join(own[:-22])} {prose(7000 + i, 22)}"
    own = {i: shingles(t) for i, t in texts.items()}
    assert all(jaccard(own[2 * i], own[2 * i + 1]) >= 0.805 for i in range(250))
    assert max(jaccard(own[i], own[j]) for i in range(0, 500, 10) for j in range(0, i, 10)) < 0.78
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    got = minhash_dedup.near_duplicates(edge_docs)
    assert got.count() == edge_docs.count()
    by_id = {r.doc_id: r.class_id for r in got.collect()}
    assert by_id[5] == 4 and by_id[1] == 1 and by_id[2] == 2 and by_id[3] == 3
    kept = minhash_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1
    assert minhash_dedup.near_duplicates(no_docs).count() == 0 and minhash_dedup.keep_one(no_docs).count() == 0


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        n, same = 400, []
        for _ in range(30):
            a = rng.integers(1, 1 << 63, n).astype(np.uint64)
            b = np.where(np.arange(n) < 2 * n * share / (1 + share), a, rng.integers(1, 1 << 63, n).astype(np.uint64))
            sig = minhash_dedup.signatures([np.sort(a), np.sort(b)])
            same.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(same) - share) < 0.03


def test_contract_follows_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.label for r in minhash_dedup.contract(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_contained(texts, items):
    out = set()
    for item, body in items.items():
        q = set(shingles(body))
        out |= {(d, item) for d, t in texts.items() if q and len(q & set(shingles(t))) >= 0.8 * len(q) - 1e-9}
    return out


def test_decontamination_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF_SMALL, "documents").collect()}
    items = {r.item_id: r.text for r in queries.table(spark, SF_SMALL, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF_SMALL).collect()}
    assert got == brute_contained(texts, items) and got


def test_decontamination_sizes_and_edges(spark, edge_docs, no_docs):
    items = {1: prose(50, 30), 2: prose(51, 6), 3: prose(52, 9), 4: "one two", 5: None, 6: prose(50, 30), 7: prose(53, 45)}
    w = items[7].split()
    texts = {
        1: prose(60, 9000) + " " + items[1] + " " + prose(61, 9000), 2: prose(62, 3000) + " " + items[2], 3: items[3] + " tail", 4: "One, two!",
        5: None, 6: "", 7: " ".join(["x", *w[:40], "changed", *w[41:]]), 8: " ".join(w[:20]), 9: prose(63, 500),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_pairs(docs, bench).collect()}
    assert got == brute_contained(texts, items) == {(1, 1), (1, 6), (2, 2), (3, 3), (4, 4), (7, 7)}
    clean = decontaminate.drop_contaminated(docs.selectExpr("doc_id", "text", "'x' AS id", "'y' AS key"), bench)
    assert clean.columns == ["doc_id", "text", "id", "key"] and sorted(r.doc_id for r in clean.collect()) == [5, 6, 8, 9]
    assert decontaminate.contained_pairs(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(edge_docs, bench).count() == edge_docs.count() - 1  # "one two"


def brute_lines(docs):
    """Line dedup by dictionaries: {(id, text): new text}."""
    rows = sorted({(i, t) for i, t in docs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone = {}, defaultdict(set)
    for i, t in rows:
        lines = t.split("\n")
        _, at, size = line_dedup.line_chunks(lines)
        for a, n in sorted(zip(at.tolist(), size.tolist())):
            if first.setdefault(tuple(lines[a : a + n]), (i, a)) != (i, a):
                gone[i, t] |= set(range(a, a + n))
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) if gone[i, t] else t for i, t in rows}


@pytest.mark.parametrize("folder", [SF_SMALL])
def test_line_dedup_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").collect()]
    expected = {i: t for (i, _), t in brute_lines(docs).items()}
    rows = queries.op6_line_dedup(spark, folder).collect()
    assert {r.doc_id: r.text for r in rows} == expected and sum(r.lines_removed for r in rows) > 0
    for r in rows:
        assert r.lines_removed >= 0


def test_passages_found_wherever_they_stand(spark):
    passage = prose(70, 66, 4)
    docs = [(i, prose(800 + i, 30, 3) + "\n" + passage + "\n" + prose(900 + i, 20, 2)) for i in range(12)] + [(20, prose(99, 40, 3)), (21, "a\nb")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage in out[0] and out[20] == docs[12][1] and out[21] == "a\nb"
    for i in range(1, 12):
        assert out[i] == docs[i][1].replace(passage + "\n", "")


def test_two_line_passages_and_short_edges(spark):
    bodies = [prose(400 + i, 40, 2) for i in range(16)] + [f"a b\n{prose(450, 9)}\nc\nd e", f"f\n\ng h\n{prose(451, 30, 2)}\ni"]
    docs = [(100 * k + i, f"{prose(500 + 100 * k + i, 20)}\n{b}\n{prose(5000 + 100 * k + i, 20)}") for k in range(2) for i, b in enumerate(bodies)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, b in enumerate(bodies):
        assert out[i] == docs[i][1]
        assert out[100 + i].split() == docs[len(bodies) + i][1].replace(b, "").split()


def test_one_line_passages(spark):
    passage, page = prose(460, 60), prose(461, 52)
    docs = [(i, f"{prose(600 + i, 20)}\n{passage}\n{prose(700 + i, 20)}") for i in range(4)] + [(10, page), (11, page), (12, passage)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and out[10] == page and out[11] == out[12] == ""
    for i in range(1, 4):
        assert out[i] == docs[i][1].replace(passage + "\n", "")


def test_line_dedup_edges(spark, edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[5] == "" and got[4]
    assert line_dedup.dedup_lines(no_docs, removed_col="n").count() == 0


def test_chunks_depend_on_their_own_lines_only():
    body = prose(30, 120, 9).split("\n")
    base = {(h, n) for h, _, n in zip(*line_dedup.line_chunks(body))}
    shifted = {(h, n) for h, _, n in zip(*line_dedup.line_chunks(["zero", "one more line", *body, "tail"]))}
    assert len(base - shifted) <= 2 and base & shifted
