"""Quality rules: fixed rule statistics, then an isolation forest over them.

Words are runs of anything but ASCII white space.  The base rules fail a text
with fewer than 10 words, or where words in repeated five-word windows make up
more than a fifth.  Texts that pass get the method's verdict: an isolation
forest (random splits; anomalous rows are isolated on short paths) scores the
ratios in ``FEATURES``, and the threshold is calibrated on labelled rows.

Scale, forest and threshold come from all labelled rows that pass the base rules:
each row is dealt to a tree by a hash of its id (to several trees while there are
fewer than ``TREES * TREE_ROWS`` rows), quantiles and threshold are exact
(``ranks``).  A task holds the four ratios of one tree's rows, 1 / ``TREES`` of
all.  Without usable labels nothing is rejected beyond the base rules.

Null and empty texts have no words: all counts 0, base rules failed.  Equal
rows get equal results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.ranks import key_values, order_keys, order_statistics, quantiles
from chunkwise.llm.storage import stored

TREES = 200
TREE_ROWS = 64  # a tree's rows, or more where there are more labelled rows than trees of that size take
DEPTH = 6  # of a tree: log2(TREE_ROWS)
GOOD_LOST = 0.003  # share of good labelled rows that the threshold may reject
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbol_share", "upper_share", "punct_share")
_PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]


def _repeated(words: list[bytes]) -> int:
    """Words inside five-word windows that occur at least twice (compared exactly, through word numbers)."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    base, key = len(number), ids[:n]
    for i in range(1, WINDOW):
        if base * len(number) >= 1 << 62:  # renumber what has been seen so far
            key = np.unique(key, return_inverse=True)[1]
            base = len(key)
        key = key * len(number) + ids[i : n + i]
        base *= len(number)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def text_counts(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of one text."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()  # splits bytes at ASCII white space only
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    counts = [len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)]
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(chars, 1)
    features = [
        chars / max(len(words), 1), symbols / size, by_byte[65:91].sum() / size, by_byte[_PUNCT].sum() / size,
    ]
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


# ------------------------------------------------------------- the forest ----


def _path_credit(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows (what a leaf of n rows adds)."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random-split trees in flat arrays; ``score`` is 2^(-mean path / expected path), 0 to 1, high = anomalous."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int | list[int] = 7):
        rng = np.random.default_rng(seed)
        self.feature, self.cut, self.child, self.path, self.roots = [], [], [], [], []
        self.expected = max(_path_credit(min(tree_rows, len(rows))), 1.0)
        for _ in range(trees):
            pick = rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)
            self.roots.append(len(self.feature))
            self._grow(rows[pick], 0, int(np.ceil(np.log2(max(len(pick), 2)))), rng)
        self.feature, self.cut = np.array(self.feature), np.array(self.cut)
        self.child, self.path = np.array(self.child), np.array(self.path)

    @classmethod
    def joined(cls, trees: list, tree_rows: float) -> IsolationForest:
        """One forest of trees with ``feature``, ``cut``, ``left``, ``right`` and ``path``, of ``tree_rows`` rows in the mean."""
        out = cls.__new__(cls)
        sizes = np.array([len(t.path) for t in trees])
        starts = np.cumsum(sizes) - sizes
        out.roots, out.expected = starts.tolist(), max(_path_credit(tree_rows), 1.0)
        out.feature, out.cut, out.path = (np.concatenate([np.array(getattr(t, c)) for t in trees]) for c in ("feature", "cut", "path"))
        out.child = np.stack([np.concatenate([np.array(getattr(t, c)) + at for t, at in zip(trees, starts)]) for c in ("left", "right")], axis=1)
        return out

    def _grow(self, rows: np.ndarray, depth: int, limit: int, rng) -> int:
        at = len(self.feature)
        self.feature.append(0)
        self.cut.append(np.inf)
        self.child.append((at, at))  # a leaf leads to itself
        self.path.append(depth + _path_credit(len(rows)))
        low, high = rows.min(axis=0), rows.max(axis=0)
        split = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(split):
            f = int(rng.choice(split))
            cut = rng.uniform(low[f], high[f])
            left = rows[:, f] <= cut
            self.feature[at], self.cut[at] = f, cut
            self.child[at] = (self._grow(rows[left], depth + 1, limit, rng), self._grow(rows[~left], depth + 1, limit, rng))
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(np.array(self.roots), (len(rows), len(self.roots)))
        line = np.arange(len(rows))[:, None]
        for _ in range(64):
            right = rows[line, self.feature[at]] > self.cut[at]
            nxt = self.child[at, right.astype(np.int64)]
            if (nxt == at).all():
                break
            at = nxt
        return 2.0 ** (-self.path[at].mean(axis=1) / self.expected)


def _ratios(keys) -> np.ndarray:
    """FEATURES of rows by their keys."""
    return key_values(np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64)).reshape(-1, len(FEATURES))


def grow_forest(rows: DataFrame, scaled: Callable[[np.ndarray], np.ndarray], total: int) -> IsolationForest:
    """A forest over all ``total`` rows (id, keys of the FEATURES); each is in as many trees as give a tree TREE_ROWS rows."""
    copies = min(TREES, -(-TREES * TREE_ROWS // total))
    step = F.lit(2) * F.pmod(F.shiftright(F.col("h"), 8), F.lit(10)) + 1  # odd and no multiple of 5: no tree twice
    step = F.when(step % 5 == 0, step + 2).otherwise(step)
    trees = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(F.col("h") + i * step, F.lit(TREES)).cast("int"))
    dealt = rows.withColumn("h", F.shiftright(F.xxhash64("id"), 8)).select("keys", F.explode(trees).alias("tree"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        x = _ratios(part["keys"])
        x = scaled(x[np.lexsort(x.T)])
        tree = IsolationForest(x, trees=1, tree_rows=len(x), seed=[7, int(part["tree"].iloc[0])])
        return pd.DataFrame({
            "tree": part["tree"].iloc[:1].to_numpy(), "feature": [tree.feature], "cut": [tree.cut],
            "left": [tree.child[:, 0]], "right": [tree.child[:, 1]], "path": [tree.path],
        })

    kinds = "tree int, feature array<long>, cut array<double>, left array<long>, right array<long>, path array<double>"
    grown = dealt.groupBy("tree").applyInPandas(grow, kinds).orderBy("tree").collect()  # TREES rows of at most 2 ** (DEPTH + 1) nodes
    return IsolationForest.joined(grown, total * copies / len(grown))


def _kept_rank(n: int, good_lost: float) -> int:
    """Place of the least threshold that loses no more good rows than allowed (but none that only separates among bad rows)."""
    return max(0, int(np.ceil((1 - good_lost) * n)) - 1)


class QualityModel:
    """Forest over labelled rows, their features scaled by the spread of the good ones, with the calibrated threshold."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, good_lost: float = GOOD_LOST):
        self.forest, self.threshold = None, np.inf
        if len(good) < 2 or not len(bad):
            return
        self.middle = np.median(good, axis=0)
        self.spread = np.maximum(np.quantile(good, 0.95, axis=0) - np.quantile(good, 0.05, axis=0), 1e-3)
        self.forest = IsolationForest(self._scaled(np.concatenate([good, bad])))
        kept, lost = np.sort(self.score(good)), np.sort(self.score(bad))
        cut = kept[_kept_rank(len(kept), good_lost)]
        above = lost[lost > cut]
        self.threshold = (cut + above[0]) / 2 if len(above) else np.inf

    @classmethod
    def fitted(cls, rows: DataFrame, good_lost: float = GOOD_LOST) -> QualityModel:
        """From all of ``rows`` (id, good boolean, keys of the FEATURES; stored)."""
        out = cls(np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
        sizes = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
        if sizes.get(True, 0) < 2 or not sizes.get(False, 0):
            return out
        ratios = rows.where("good").select(F.posexplode("keys").alias("group", "key"))
        low, middle, high = (np.array(x) for x in zip(*(v for _, v in sorted(quantiles(stored(ratios, "quality-ratios"), [0.05, 0.5, 0.95]).items()))))
        out.middle, out.spread = middle, np.maximum(high - low, 1e-3)
        out.forest = grow_forest(rows, out._scaled, sum(sizes.values()))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                score = out.score(_ratios(batch["keys"]))
                yield pd.DataFrame({"good": batch["good"], "score": score, "key": order_keys(score)})

        scored = stored(rows.select("good", "keys").mapInPandas(measure, "good boolean, score double, key long"), "quality-scores")
        rank = _kept_rank(sizes[True], good_lost)
        cut = order_statistics(scored.where("good").select(F.lit(0).alias("group"), "key"), [(0, rank)])[0, rank]
        above = scored.where(~F.col("good") & (F.col("score") > cut)).agg(F.min("score").alias("least")).first().least
        out.threshold = np.inf if above is None else (cut + above) / 2
        return out

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.middle) / self.spread

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.score(self._scaled(rows)) if self.forest else np.zeros(len(rows))


# ----------------------------------------------------------- the operator ----


def _statistics(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    both = [text_counts(t) for t in texts]
    return (
        np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS)),
        np.array([f for _, f in both], float).reshape(-1, len(FEATURES)),
    )


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> QualityModel:
    """Model from all labelled rows; ratios are taken in the scan, so that no text is shuffled."""
    ids = F.col(id_col)
    marks = labels.where(ids.isNotNull() & F.col(label_col).isNotNull())
    marks = marks.groupBy(ids.alias("id")).agg((F.min(F.col(label_col).cast("int")) > 0).alias("good"))
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, features = _statistics(batch["text"])
            passed = ~base_failed(counts)
            if passed.any():
                yield pd.DataFrame({"id": batch["id"].to_numpy()[passed], "keys": list(order_keys(features[passed]))})

    rows = docs.where(ids.isNotNull()).select(ids.alias("id"), F.col(text_col).alias("text"))
    measured = rows.mapInPandas(measure, f"id {kind}, keys array<long>")
    return QualityModel.fitted(stored(measured.join(marks.where("good IS NOT NULL"), "id"), "quality-labelled"))


def judge_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, anomaly, kept): one row per document, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ", ".join(f"{c} long" for c in COUNTS)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, features = _statistics(batch["text"])
            failed, anomaly = base_failed(counts), model.score(features)
            out = pd.DataFrame(counts, columns=list(COUNTS))
            out.insert(0, "id", batch["id"].to_numpy())
            yield out.assign(base_failed=failed, anomaly=anomaly, kept=~failed & (anomaly <= model.threshold))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(judge, f"id {kind}, {names}, base_failed boolean, anomaly double, kept boolean")
    return out.withColumnRenamed("id", id_col)
