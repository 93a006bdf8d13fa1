import collections
import html
import itertools
import re

import corpus_pipeline
import numpy as np
import pytest
from llm_helpers import SF_SMALL

from chunkwise.llm import html_text, langid, queries, ranks


def test_language_query_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, SF_SMALL, "documents").collect()}
    rows = queries.op7_language_id(spark, SF_SMALL).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.accepted for r in rows]) >= 0.99


def test_language_edges(spark, edge_docs, no_docs):
    train = queries.table(spark, SF_SMALL, "documents")
    models = langid.fit_languages(train.where(langid.training_rows(train)))
    got = {r.doc_id: r for r in langid.predict_languages(edge_docs, models).collect()}
    for i in (1, 2, 3, 10):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert all(r.lang_pred in models.langs for i, r in got.items() if i not in (1, 2, 3, 10))
    kept = langid.keep_accepted(edge_docs, models)
    assert kept.columns == edge_docs.columns
    assert langid.predict_languages(no_docs, models).count() == 0 and langid.keep_accepted(no_docs, models).count() == 0
    nothing = langid.fit_languages(train.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {r.lang_pred for r in langid.predict_languages(edge_docs, nothing).collect()} == {"und"}
    assert models.predict(["漢字漢字漢字漢字漢字漢字"])["accepted"].tolist() == [False]


def plain_kneser_ney(texts):
    """Counts, continuations and interpolation written out; returns P(last letter | the others) of a 4-gram."""
    def letters(text):
        out = [" "]
        for c in text:
            c = c.lower() if c.isalpha() else " "
            if not (c == " " and out[-1] == " "):
                out.append(c)
        return "".join(out if out[-1] == " " else [*out, " "])

    levels = {4: collections.Counter(g for t in map(letters, texts) for g in (t[i : i + 4] for i in range(len(t) - 3)))}
    for depth in (3, 2, 1):
        levels[depth] = collections.Counter(g[1:] for g in levels[depth + 1])

    def p(gram):
        value = langid.FLOOR
        for depth in (1, 2, 3, 4):
            level, part = levels[depth], gram[4 - depth :]
            once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
            discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
            after = [n for g, n in level.items() if g[:-1] == part[:-1]]
            if after:
                value = max(level[part] - discount, 0) / sum(after) + discount * len(after) / sum(after) * value
        return value

    return p


def packed(gram):
    return sum((langid.BLANK if c == " " else ord(c)) << (16 * (3 - i)) for i, c in enumerate(gram))


MODEL_TEXTS = {"x": ["abra cadabra", "Abracadabra! barbara, a bar", "écran é"], "y": ["lorem ipsum dolor sit amet", "漢字 lorem"]}


def model_docs(spark, parts):
    rows = [(lang, t) for lang, texts in MODEL_TEXTS.items() for t in texts for _ in range(3)]
    return spark.createDataFrame(rows, "lang string, text string").repartition(parts)


def test_thresholds_come_from_all_training_rows(spark):
    """20,001 texts and more are all measured: limits and spreads as numpy finds them over every row."""
    rows = [("x", f"abra cadabra {'zq' * (i % 23 == 0)} {i * 7919 % 9973:b}".replace("0", "o").replace("1", "i")) for i in range(21_000)]
    rows += [("y", f"lorem ipsum dolor {chr(97 + i % 26) * (1 + i % 5)}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    models = langid.fit_languages(docs)
    entropy, count = models.cross_entropy([t for _, t in rows])
    best, bits = entropy.argmin(axis=1), entropy.min(axis=1)
    for j in range(2):
        mine, n = bits[best == j], count[best == j]
        assert len(mine) > 1000
        middle = np.median(mine)
        assert models.limits[j] == pytest.approx(max(np.quantile(mine, 1 - langid.REJECTED), middle + 1), abs=1e-12)
        assert models.spread[j] == pytest.approx(max(1.0, np.sqrt(np.mean((mine - middle) ** 2 * n))), abs=1e-8)


def test_exact_ranks(spark):
    rng = np.random.default_rng(4)
    groups = {0: np.concatenate([rng.normal(size=500), [0.0, -0.0, 1e300, -1e-300]]), 1: np.repeat([2.5, -2.5], 40), 7: np.array([3.0])}
    rows = spark.createDataFrame([(g, int(k)) for g, v in groups.items() for k in ranks.order_keys(v)], "group int, key long").repartition(5)
    got = ranks.quantiles(rows, [0.0, 0.05, 0.5, 0.9995, 1.0])
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, [0.0, 0.05, 0.5, 0.9995, 1.0]), rtol=1e-12, atol=0)
    assert ranks.quantiles(rows.limit(0), [0.5]) == {}


def test_kneser_ney_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(langid, "SHARD_KEYS", 7)  # many files a table
    models = langid.fit_languages(model_docs(spark, 3))
    plain = [plain_kneser_ney([t for t in MODEL_TEXTS[lang] for _ in range(3)]) for lang in models.langs]
    grams = ["abra", "bra ", " abr", "zzzz", "abrz", "xbra", "lore", "orem", " é c", "écra", "字 lo", "a la"]
    got = np.exp2(models.log_probabilities(np.array([packed(g) for g in grams], np.uint64)))
    for g, row in zip(grams, got):
        assert np.allclose(row, [p(g) for p in plain], rtol=1e-4), g
    total = sum(plain[0]("abr" + c) for c in "abcdr éinwy")
    assert 0.9 < total < 1.02


def test_model_does_not_depend_on_partitions(spark, monkeypatch):
    grams = np.array([packed("".join(g)) for g in itertools.product("abr le", repeat=4)], np.uint64)
    one = langid.fit_languages(model_docs(spark, 1)).log_probabilities(grams)
    monkeypatch.setattr(langid, "HELD_GRAMS", 10)  # counts leave a task in many pieces
    many = langid.fit_languages(model_docs(spark, 50)).log_probabilities(grams)
    assert np.array_equal(one, many)


def test_cached_answers_equal_direct_ones(spark, monkeypatch):
    monkeypatch.setattr(langid, "CACHE_BYTES", 1)  # 1,024 slots for all n-grams of these texts
    models = langid.fit_languages(model_docs(spark, 2))
    texts = ["".join(g) for g in itertools.product("abrclo ", repeat=5)]
    for part in (texts, texts[::-1]):
        bits, n = models.cross_entropy(part)
        for t, b, k in list(zip(part, bits, n))[::997]:
            codes = langid.letter_codes(t)
            if len(codes):
                whole = langid._pack(np.concatenate([[langid.BLANK] * 3, codes]).astype(np.uint32), 4)[1:]
                assert np.allclose(b, -models.log_probabilities(whole).sum(axis=0) / k, rtol=1e-4)


def test_many_languages_and_letters_of_other_planes(spark):
    rows = [(f"l{i:03}", f"word{chr(0x20000 + i)} {chr(97 + i % 26) * 5} text") for i in range(40)] + [("null", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    models = langid.fit_languages(docs)
    assert models.langs == [f"l{i:03}" for i in range(40)]
    out = langid.predict_languages(docs.withColumnRenamed("lang", "doc_id"), models).collect()
    assert sum(r.doc_id == r.lang_pred for r in out) == 40
    assert langid.letter_codes("\U00020001")[1] >= langid.SPARE


def test_a_row_without_id_is_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "some text", "en"), (1, "more text", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.held_out for r in queries.op7_language_id(spark, str(tmp_path)).collect()}[None] is False


def brute_article(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body[1]))).split()) if body else ""


def test_html_query(spark):
    pages = {r.page_id: r for r in queries.table(spark, SF_SMALL, "pages").collect()}
    rows = queries.op2_html_text(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.text == brute_article(pages[r.page_id].html) and r.n_chars == len(r.text)


def test_html_layouts():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header>
    <div class="cookie-notice">We use cookies to make the site work for you</div><div id=main><header><h1>Head &amp; line</h1></header>
    <p>First <i>pa</i>ra here, with a number of&nbsp;words that make it long enough.</p><ul><li>One point<li>Two points of it</ul>
    <div class="ad-slot">Buy now</div><script>var a = "<p>no</p>";</script><p title="a > b">Second para.<br>New line</p>
    <section id="comments"><p>I am a reader and I like this very much indeed, thanks a lot</p></section></div>
    <aside>Related <a href=x>stuff</a></aside><form><label>Name</label><textarea>text</textarea></form><footer>(c) us</footer></body></html>"""
    assert html_text.main_text(page) == (
        "Head & line First para here, with a number of words that make it long enough. One point Two points of it Second para. New line"
    )
    plain = "<p>" + "Plain words without any marked container around them, but enough of them to be read. " * 2 + "</p>"
    assert html_text.main_text(f"<ul><li><a href=1>a</a><li><a href=2>b</a></ul>{plain}").startswith("Plain words")
    for odd in (None, "", "<", "<<<>>", "<!-- open", "<p", "&", "<script>never closed"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<article>1 < 2 &lt; 3 &am</article>") == "1 < 2 < 3 &am"
    many = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert len(html_text.main_text(many)) == 5 * 20_000 - 1


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        scores = list(rng.normal(0, 1, n))
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side, scores=scores, edges=edges):
            return sum(max(-s, 0) if x else max(s, 0) for s, x in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(html_text.minimum_cut(scores, edges)) - best) < 1e-6


def test_html_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (1, "u", None, "x"), (2, "v", "<article>a b</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in out.collect()) == [0, 0, 0, 3]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_pipeline_stages_and_run(spark):
    from test_dedup import brute_classes, brute_contained, brute_lines
    from test_tokens_packing import check_packing

    docs = queries.table(spark, SF_SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), docs.schema)
        assert docs.columns == queries.table(spark, SF_SMALL, "documents").columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in queries.table(spark, SF_SMALL, "benchmark").collect()}
    assert seen["line_dedup"] == {i: t for (i, _), t in brute_lines(list(seen["language_id"].items())).items()}
    classes = brute_classes(seen["line_dedup"])
    assert set(seen["minhash_near_dedup"]) == set(classes.values())
    bad = {d for d, _ in brute_contained(seen["minhash_near_dedup"], items)}
    assert set(seen["decontamination"]) == set(seen["minhash_near_dedup"]) - bad
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    rest = [{"doc_id": i, "text": t} for i, t in seen["decontamination"].items()]
    check_packing(out, rest, "byte_bpe_50k.json", 2, 1024)


def test_pipeline_edges(spark, edge_docs, no_docs):
    extra = edge_docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars", "id", "key")
    for docs in (extra, extra.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, docs, SF_SMALL).count() >= 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_are_stable(name):
    assert re.fullmatch(r"op\d+_\w+", name)
