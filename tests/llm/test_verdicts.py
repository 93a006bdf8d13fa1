"""License labels and quality verdicts against plain versions: every rule ungated, every tree walked row by row."""

import random
import re

import numpy as np
from llm_helpers import SF_SMALL

from chunkwise.llm import licenses, quality, queries

LEVELS = {3: 1.0, 2: 0.8, 1: 0.4}


def brute_detections(text):
    """All rules on the whole text; what lies inside a stronger, longer or earlier one goes, found by comparing all with all."""
    found = [
        (m.start(), m.end(), priority, rule, label)
        for rule, priority, label, _, regex in licenses.signature_rules()
        for m in re.finditer(regex, text, re.I | re.A)
    ]

    def beaten(a):
        for b in found:
            if b is not a and b[0] <= a[0] and a[1] <= b[1]:
                if b[2] > a[2] or (b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[3] < a[3])):
                    return True
        return False

    return [a for a in found if not beaten(a)]


def brute_labels(text):
    words = [w.lower() for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    base = {label for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase}
    kept = brute_detections(text)
    best = max([LEVELS[k[2]] for k in kept] + [0.8 if base else 0.0])
    return ",".join(sorted(base | {k[4] for k in kept})), best


def planted_texts(n):
    rng = random.Random(8)
    names = ["MIT", "Apache", "GNU Lesser General Public", "GNU General Public", "Mozilla Public", "BSD 3-Clause", "ISC", "Boost Software"]
    parts = [f"{x} License" for x in names] + [f"licensed under the terms of the {x} license, version 2.0" for x in names] + [
        "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: (MIT", "CC BY-NC-SA 4.0", "cc0 1.0 universal", "Creative Commons Attribution 4.0",
        "https://creativecommons.org/licenses/by-sa/3.0", "All rights reserved.", "released into the public domain", "Copyright (c) 2020", "copyleft",
        "without warranty of any kind", "Unauthorised copying of this file", "proprietary and confidential", "license", "public", "gpl", "some words",
    ]
    return [" ".join(rng.choice(parts) + rng.choice(["", ",", ".", "\n", ";"]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_license_labels_equal_ungated_rules(spark):
    texts = planted_texts(300) + ["MIT license " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    for i, text in enumerate(texts[:-1]):
        assert got[i] == brute_labels(text), text
    assert got[len(texts) - 1] == brute_labels("MIT license")
    places = {}
    for r in licenses.detections(docs.where(f"doc_id < {len(texts) - 1}")).collect():
        places.setdefault(r.doc_id, set()).add((r.start, r.end, r.priority, r.rule, r.label))
    for i, text in enumerate(texts[:-1]):
        assert places.get(i, set()) == set(brute_detections(text)), text


def test_license_query_labels(spark):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op8_license_scan(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.labels, r.score) for r in rows} == {i: brute_labels(t) for i, t in docs.items()}
    assert any(r.labels for r in rows)


def brute_path(forest, at, row):
    if forest.child[at][0] == at:
        return forest.path[at]
    return brute_path(forest, forest.child[at][1 if row[forest.feature[at]] > forest.cut[at] else 0], row)


def brute_features(text):
    solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
    size = max(len(solid), 1)
    return [
        len(solid) / max(len(re.findall("[^\x20\x09-\x0d]+", text)), 1), sum(c in "#*$%&|<>" for c in solid) / size,
        sum("A" <= c <= "Z" for c in solid) / size, sum("!" <= c <= "~" and not c.isalnum() for c in solid) / size,
    ]


def test_quality_verdicts_equal_a_walk_of_every_tree(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    model = quality.fit_quality(docs, queries.table(spark, SF_SMALL, "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op9_quality_rules(spark, SF_SMALL).collect()
    assert len(rows) == len(texts) and np.isfinite(model.threshold)
    verdicts = set()
    for r in rows:
        row = (np.array(brute_features(texts[r.doc_id])) - model.middle) / model.spread
        mean = sum(brute_path(model.forest, root, row) for root in model.forest.roots) / len(model.forest.roots)
        anomaly = 2.0 ** (-mean / model.forest.expected)
        assert abs(anomaly - r.anomaly) < 1e-9
        assert r.kept == (not r.base_failed and anomaly <= model.threshold)
        verdicts.add((r.base_failed, r.kept))
    assert {(True, False), (False, True)} <= verdicts


def test_forest_leaves_hold_the_rows_left_over():
    """Leaf depths and sizes by a plain partition of rows with the same splits."""
    rows = np.random.default_rng(3).normal(size=(40, 3))
    forest = quality.IsolationForest(rows, trees=5, tree_rows=40)

    def check(at, part, depth):
        left, right = forest.child[at]
        if left == at:
            n = len(part)
            credit = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
            assert abs(forest.path[at] - depth - credit) < 1e-12
            return n
        over = part[:, forest.feature[at]] > forest.cut[at]
        assert 0 < over.sum() < len(part)
        return check(left, part[~over], depth + 1) + check(right, part[over], depth + 1)

    assert [check(root, rows, 0) for root in forest.roots] == [40] * 5


def test_quality_model_comes_from_all_labelled_rows(spark):
    """22,000 labelled rows: scale and threshold as numpy finds them over every row, every row in the forest."""
    rng = random.Random(5)

    def text(i, good):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(12)]
        return " ".join(words if good else [*words[:4], *[rng.choice(["#$%&", "QX!!", "**|"]) for _ in range(rng.randrange(3, 9))], *words[4:]])

    rows = [(i, text(i, i % 10 < 9), int(i % 10 < 9)) for i in range(22_000)] + [(None, text(0, True), 1), (30_000, "too few words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    model = quality.fit_quality(docs, docs)
    counts, features = (np.array(x) for x in zip(*(quality.text_counts(t) for _, t, _ in rows[:22_000])))
    passed = ~quality.base_failed(counts)
    features, good = features[passed], np.array([g == 1 for _, _, g in rows[:22_000]])[passed]
    kept = features[good]
    assert np.allclose(model.middle, np.median(kept, axis=0), atol=1e-12)
    assert np.allclose(model.spread, np.maximum(np.quantile(kept, 0.95, axis=0) - np.quantile(kept, 0.05, axis=0), 1e-3), atol=1e-12)
    score = np.concatenate([model.score(part) for part in np.array_split(features, 10)])
    cut = np.sort(score[good])[quality._kept_rank(good.sum(), quality.GOOD_LOST)]
    above = score[~good & (score > cut)]
    assert len(above) and model.threshold == (cut + above.min()) / 2
    assert len(model.forest.roots) == quality.TREES and model.forest.expected == quality._path_credit(passed.sum() / quality.TREES)
    again = quality.fit_quality(docs.repartition(3), docs)
    assert again.threshold == model.threshold and (again.forest.cut == model.forest.cut).all()
