import random
import re

from llm_helpers import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwise.llm import licenses, quality, queries, secrets

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "hex": re.compile("[0-9a-f]+"),
}


def brute_secrets(text):
    out = []
    for i, rule in enumerate(secrets.RULES):
        for m in PATTERNS.get(rule.kind, re.compile(rule.pattern)).finditer(text or ""):
            size = m.end() - m.start()
            short = size < 16 if rule.kind == "hex" else rule.kind == "assign" and len(m[2]) < 12
            if not short and size >= rule.min_length:
                out.append((m.start(), m.end(), i))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


SECRET_PARTS = ["password", "token", '"', "'", " ", ":", "=", "AKIA", "ABC123", "0123456789abcdef", "secret", "api_key", "APIKEY", "é", "eyJ",
                "ab-c", ".", "ghp_", "x" * 36, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "Bearer ", "sk_live_", "\n", "漢"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=14).map("".join))
def test_automaton_equals_regexes(text):
    assert secrets.scan_text(text) == brute_secrets(text)


def test_secret_query_and_edges(spark, edge_docs, no_docs):
    import hashlib

    docs = {r.doc_id: r.text for r in queries.table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op10_secret_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute_secrets(docs[r.doc_id])
        text = ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, b, k in spans)
        base = ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, b, k in spans if k < 3)
        assert (r.spans, r.base_sha256) == (text, hashlib.sha256(base.encode()).hexdigest())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in range(3)]
    found = secrets.find_secrets(edge_docs)
    assert found.columns == ["doc_id", "spans"] and found.count() == edge_docs.count()
    assert secrets.find_secrets(no_docs).count() == 0


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    starts = [p[0] for p in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))


def test_license_query_and_edges(spark, edge_docs, no_docs):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op8_license_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(edge_docs).count() == edge_docs.count()
    assert licenses.scan_licenses(no_docs).count() == 0


def test_license_overlaps(spark):
    rows = [
        (1, "MIT License mit license, general  public.license Mit"), (2, "Licensed under the GNU Lesser General Public License, version 2.1"),
        (3, "SPDX-License-Identifier: Apache-2.0"), (4, "CC BY-NC-SA 4.0 licence. All rights reserved"), (5, "mit der license"), (6, None),
        (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (3, 0, 4, "gpl,mit")
    assert got[2].labels == "gpl,lgpl" and got[2].base_labels == "gpl"  # the base phrase stays; the contained rule hit does not add
    assert (got[3].labels, got[3].score) == ("apache", 1.0)
    assert got[4].labels == "cc-by-nc-sa,proprietary"
    assert (got[5].labels, got[5].score, got[6].n_words) == ("", 0.0, 0)
    kept = licenses.detections(docs.where("doc_id = 2")).collect()
    assert [r.label for r in kept] == ["lgpl"] and docs.count() == 7
    assert len(licenses.signature_rules()) >= 200


@settings(max_examples=600, deadline=None)
@given(st.sampled_from(licenses.signature_rules()).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(re.compile(r[4], re.I | re.A), fullmatch=True))))
def test_license_matches_hold_their_keywords(found):
    (*_, keywords, _), text = found
    assert any(k in text.lower() for k in keywords.split("|")) and any(k in text.lower() for k in licenses.gate_literals())


def test_license_notices_alone(spark):
    expected = {
        "CC BY-SA 4.0": "cc-by-sa", "cc0 1.0 universal": "cc0", "CC 0": "cc0", "Creative Commons Attribution 4.0": "cc-by", "Expat License": "mit",
        "Internet Systems Consortium License": "isc", "Proprietary and confidential": "proprietary", "Unauthorised copying of this file": "proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "https://www.mozilla.org/MPL/2.0/": "mpl",
        "Redistribution and use in source and binary forms, with or without modification": "bsd",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee": "isc",
        "Altered source versions must be plainly marked as such": "zlib",
    }
    docs = spark.createDataFrame(list(enumerate(expected)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert got == dict(enumerate(expected.values()))


def test_license_plan_is_native(spark):
    plan = licenses.scan_licenses(queries.table(spark, SF_SMALL, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", " ", "  ", "\n", "\t", "é", "#", "\xa0", "\x1c"]), max_size=60).map("".join))
def test_quality_counts(text):
    assert tuple(quality.text_counts(text)[0]) == brute_quality(text)


def test_quality_query_and_edges(spark, edge_docs, no_docs):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op9_quality_rules(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = brute_quality(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(edge_docs, labels)
    out = quality.judge_quality(edge_docs, model).collect()
    assert len(out) == edge_docs.count() and all(r.kept == (not r.base_failed) for r in out)  # no labels: no verdict beyond the rules
    assert quality.judge_quality(no_docs, model).count() == 0


def test_forest_separates_junk():
    import numpy as np

    rnd = random.Random(1)
    good = np.array([[5 + rnd.random(), 0.0, 0.05 + 0.02 * rnd.random(), 0.05 + 0.02 * rnd.random()] for _ in range(900)])
    bad = np.array([[8 + rnd.random(), 0.3 + 0.1 * rnd.random(), 0.02, 0.35] for _ in range(60)])
    model = quality.QualityModel(good, bad)
    assert (model.score(good) > model.threshold).mean() <= 0.01 and (model.score(bad) > model.threshold).mean() >= 0.95
