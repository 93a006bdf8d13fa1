"""Language identification by interpolated Kneser-Ney character models.

One model per language over letter n-grams (order ``ORDER``; runs of other
characters count as one blank, letters are lower-cased; letters beyond the basic
plane share ``SPARE_CODES`` codes that no other letter has).  The n-grams of whole
training texts are counted exactly with Spark aggregates, and all other numbers
derive from these counts in Spark: continuation counts of the shorter n-grams,
contexts, discounts (absolute, one per language and order), and from them each
n-gram's own share and each context's weight for the next shorter one.

The tables are written into shared storage as shards of keys in order with a row
of values for all languages per key (``ModelFiles``); workers map them into
memory.  Nothing of a model's size passes through the driver or a task's
closure, no n-gram is left out, and the model does not depend on how the rows
were partitioned.

A text gets the language of the lowest cross-entropy per character.  It is
rejected if that exceeds the language's threshold, calibrated on training texts
so that a ``REJECTED`` share of them exceeds it, plus a margin for short texts
(whose mean varies more).  A text that is null or has no letter is ``und`` with
score 0 and rejected.  Models and thresholds come from all training rows; the
thresholds are exact quantiles (``ranks``).

Ties go to the alphabetically first language.  Rows whose language is null
train nothing; without any training row every text is ``und``.  Equal texts get
equal results; an empty table gives an empty result; other columns pass only
through ``keep_accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.ranks import order_keys, quantiles
from chunkwise.llm.storage import new_folder, stored
from chunkwise.llm.token_files import _place, _put
from chunkwise.llm.worker_cache import per_worker

ORDER = 4
HELD_GRAMS = 500_000  # distinct n-grams a counting task holds at a time
SHARD_KEYS = 1_000_000  # keys of one model file
CACHE_BYTES = 1 << 23  # of a worker's answers for n-grams met lately
SLICE = 250_000  # characters that are worked on at a time
FLOOR = 1.0 / 4096  # what a letter never seen gets from below the lowest order
REJECTED = 0.0005
SHARP = 6.0  # scale of the score's softmax over cross-entropies
BLANK = 1
SPARE, SPARE_CODES = 0xD800, 0xF900 - 0xD800  # 16-bit codes without letters
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """code point -> 16-bit code of the lower-cased letter, or BLANK for anything that is no letter."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x32400):  # no letters beyond
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            code = ord(low) if len(low) == 1 else c
            table[c] = code if code < 0x10000 else SPARE + code % SPARE_CODES
    return table


def letter_codes(text: str) -> np.ndarray:
    """Letters with single blanks around and between runs of them; empty without a letter."""
    codes = per_worker("letters", _letter_table)[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    letter = codes != BLANK
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as the blank
    codes = codes[keep]
    return np.concatenate([[BLANK], codes] if codes[-1] == BLANK else [[BLANK], codes, [BLANK]]).astype(np.uint32)


def _pieces(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts one after the other, number of codes per text, text per code)."""
    parts = [letter_codes(t) if t else np.zeros(0, np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([*parts, np.zeros(0, np.uint32)]), sizes, np.repeat(np.arange(len(parts)), sizes)


def _slices(texts: list) -> Iterator[list]:
    """Runs of texts of about SLICE characters, so that arrays stay small whatever a batch holds."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pack(codes: np.ndarray, order: int) -> np.ndarray:
    n = max(len(codes) - order + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(order):  # 16 bits each
        out = (out << np.uint64(16)) | codes[i : i + n]
    return out


def _tail(packed: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` letters of packed n-grams, as signed keys."""
    return (packed & np.uint64((1 << (16 * order)) - 1)).view(np.int64)


# ------------------------------------------------------------- the counts ----


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their counts) of several such pairs."""
    keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, which, np.concatenate([p[1] for p in parts]))
    return keys, n


def count_grams(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n): exact counts of the highest order over all rows, 16 bits a letter.

    A task sums up to HELD_GRAMS distinct n-grams before it passes them on.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for part in _slices(texts.tolist()):
                    codes, _, text = _pieces(part)
                    grams = _pack(codes, ORDER)[text[ORDER - 1 :] == text[: len(text) - ORDER + 1]]
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                    size += len(held[lang][-1][0])
                if size > HELD_GRAMS:
                    held = {name: [_summed(parts)] for name, parts in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if 2 * size > HELD_GRAMS:
                        yield from (pd.DataFrame({"lang": name, "gram": p[0][0].view(np.int64), "n": p[0][1]}) for name, p in held.items())
                        held, size = {}, 0
        for name, parts in held.items():
            grams, n = _summed(parts)
            yield pd.DataFrame({"lang": name, "gram": grams.view(np.int64), "n": n})

    counted = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_levels(counts: DataFrame) -> DataFrame:
    """(lang, depth, gram, context, n) of all orders: real counts at the highest, below it numbers of distinct left neighbours."""
    levels, longer = [counts.select("lang", F.lit(ORDER).alias("depth"), "gram", "n")], counts
    for depth in range(ORDER - 1, 0, -1):
        shorter = longer.select("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * depth)) - 1)).alias("gram"))
        longer = shorter.groupBy("lang", "gram").agg(F.count("*").alias("n"))
        levels.append(longer.select("lang", F.lit(depth).alias("depth"), "gram", "n"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.withColumn("context", F.shiftrightunsigned("gram", 16))


def model_rows(counts: DataFrame) -> DataFrame:
    """(kind, depth, key, lang, value): kind 0 is an n-gram's own share, kind 1 a context's weight for the next shorter one.

    Discount: ``n1 / (n1 + 2 n2)`` of the n-grams seen once and twice, within [0.05, 0.95].
    """
    levels = stored(gram_levels(counts), "grams")
    once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    share = F.least(F.lit(0.95), F.greatest(F.lit(0.05), once / F.greatest(once + 2 * twice, F.lit(1))))
    discounts = levels.groupBy("lang", "depth").agg(share.alias("discount"))
    contexts = levels.groupBy("lang", "depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = contexts.join(discounts, ["lang", "depth"])
    own = levels.join(contexts, ["lang", "depth", "context"])
    own = own.select(F.lit(0).alias("kind"), "depth", F.col("gram").alias("key"), "lang", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("value"))
    weight = F.col("discount") * F.col("kinds") / F.col("total")
    return own.unionByName(contexts.select(F.lit(1).alias("kind"), "depth", F.col("context").alias("key"), "lang", weight.alias("value")))


# ------------------------------------------------------------- the files -----


def write_model(rows: DataFrame, langs: list[str], folder: str) -> list[tuple[int, int, int, int, str]]:
    """Write model rows as shards; returns (kind, depth, first key, keys, file) of each, in order.

    A shard is ``keys`` 64-bit keys in order, then as many rows of 32-bit floats, one per language.
    """
    width = len(langs)
    numbers = {lang: i for i, lang in enumerate(langs)}
    keyed = rows.groupBy("kind", "depth", "key").agg(F.collect_list("lang").alias("langs"), F.collect_list("value").alias("values"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _place(folder)
        table, keys, values, held = None, [], [], 0

        def close() -> pd.DataFrame:
            k = np.concatenate(keys)
            name = f"{table[0]}-{table[1]}-{k[0]}.bin"
            _put(fs, f"{root}/{name}", k.astype("<i8").tobytes() + np.concatenate(values).astype("<f4").tobytes())
            return pd.DataFrame({"kind": [table[0]], "depth": [table[1]], "first": [k[0]], "n": [len(k)], "name": [name]})

        for batch in batches:
            for this, part in batch.groupby(["kind", "depth"], sort=False):
                if table is not None and (this != table or held >= SHARD_KEYS):
                    yield close()
                    keys, values, held = [], [], 0
                table = this
                dense = np.full((len(part), width), float(this[0]))  # no share of its own; all weight to the shorter n-gram
                line = np.repeat(np.arange(len(part)), part["langs"].map(len))
                dense[line, [numbers[x] for row in part["langs"] for x in row]] = np.concatenate(part["values"].to_list())
                keys.append(part["key"].to_numpy(np.int64)), values.append(dense)
                held += len(part)
        if table is not None:
            yield close()

    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    shards = -(-keyed.count() // SHARD_KEYS) + 2 * ORDER
    dealt = keyed.repartitionByRange(shards, "kind", "depth", "key").sortWithinPartitions("kind", "depth", "key")
    return sorted(tuple(r) for r in dealt.mapInPandas(write, "kind int, depth int, first long, n long, name string").collect())  # a row per file


class ModelFiles:
    """A worker's view of the written tables, with a cache of n-grams met lately."""

    def __init__(self, folder: str, shards: list, width: int):
        fs, root = _place(folder)
        self.width = width
        self.tables: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        for kind, depth, first, n, name in shards:
            if isinstance(fs, pafs.LocalFileSystem):
                raw = np.memmap(f"{root}/{name}", np.uint8, "r")
            else:
                with fs.open_input_stream(f"{root}/{name}") as f:
                    raw = np.frombuffer(f.read(), np.uint8)
            firsts, parts = self.tables.setdefault((kind, depth), ([], []))
            firsts.append(first), parts.append((raw[: 8 * n].view("<i8"), raw[8 * n :].view("<f4").reshape(n, width)))
        slots = 1 << max(10, (CACHE_BYTES // (8 + 4 * width)).bit_length() - 1)
        self.bits = np.uint64(64 - (slots.bit_length() - 1))
        self.cached = np.zeros(slots, np.uint64)  # 0 is no n-gram: letters and blanks are above 0
        self.answers = np.zeros((slots, width), np.float32)

    def _rows(self, kind: int, depth: int, wanted: np.ndarray) -> np.ndarray:
        out = np.full((len(wanted), self.width), kind, np.float32)
        firsts, parts = self.tables.get((kind, depth), ([], []))
        shard = np.searchsorted(firsts, wanted, "right") - 1
        for i in np.unique(shard[shard >= 0]) if len(parts) else ():
            keys, values = parts[i]
            mine = np.flatnonzero(shard == i)
            at = np.minimum(np.searchsorted(keys, wanted[mine]), len(keys) - 1)
            hit = keys[at] == wanted[mine]
            out[mine[hit]] = values[at[hit]]
        return out

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """log2 P(last letter | the ones before) of packed n-grams, per language."""
        p = np.full((len(packed), self.width), FLOOR, np.float32)
        for depth in range(1, ORDER + 1):
            gram = _tail(packed, depth)
            context = (gram.view(np.uint64) >> np.uint64(16)).view(np.int64)
            p = self._rows(0, depth, gram) + self._rows(1, depth, context) * p
        return np.log2(p)

    def looked_up(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row per n-gram, rows): ``log_probabilities`` through the cache."""
        slot = ((packed * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
        missed = np.flatnonzero(self.cached[slot] != packed)
        if not len(missed):
            return slot, self.answers
        grams, which = np.unique(packed[missed], return_inverse=True)
        found = self.log_probabilities(grams)
        row = slot.copy()
        row[missed] = len(self.cached) + which
        rows = np.concatenate([self.answers, found])
        places, first = np.unique(slot[missed], return_index=True)
        self.cached[places] = packed[missed[first]]
        self.answers[places] = found[which[first]]
        return row, rows


class LanguageModels:
    """All languages' models by their files; small, so that it can travel with tasks.  See ``predict``."""

    def __init__(self, langs: list[str], folder: str = "", shards: list = ()):
        self.langs, self.folder, self.shards = list(langs), folder, list(shards)
        self.limits = np.full(len(self.langs), np.inf)
        self.spread = np.zeros(len(self.langs))

    def files(self) -> ModelFiles:
        return per_worker(("language models", self.folder), lambda: ModelFiles(self.folder, self.shards, len(self.langs)), large=True)

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """log2 P(last letter | the ones before) of packed n-grams, per language."""
        return self.files().log_probabilities(packed)

    def cross_entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character per language, scored characters) of each text."""
        parts = [self._cross_entropy(part) for part in _slices(list(texts))]
        empty = (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(empty, *parts))

    def _cross_entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, sizes, text = _pieces(texts)
        count = np.maximum(sizes - 1, 0)
        bits = np.zeros((len(sizes), len(self.langs)))
        if len(codes) and self.langs:
            packed = _pack(np.concatenate([np.full(ORDER - 1, BLANK, np.uint32), codes]), ORDER)
            heads = (np.cumsum(sizes) - sizes)[sizes > 0]
            for i in range(1, ORDER):  # what lies before a text's start is blank, not the text before
                for j in range(i):
                    at = heads[heads + j < len(codes)] + j
                    at = at[text[at] == text[at - j]]
                    shift = np.uint64(16 * i)
                    packed[at] = (packed[at] & ~(np.uint64(0xFFFF) << shift)) | (np.uint64(BLANK) << shift)
            inner = np.ones(len(codes), bool)
            inner[heads] = False  # the blank before the first letter is given
            packed, owner = packed[inner], text[inner]
            row, table = self.files().looked_up(packed)
            for j in range(len(self.langs)):
                bits[:, j] = -np.bincount(owner, np.ascontiguousarray(table[:, j])[row], len(sizes))
        return bits / np.maximum(count, 1)[:, None], count

    def predict(self, texts) -> pd.DataFrame:
        """lang_pred, score, accepted of each text."""
        entropy, count = self.cross_entropy(texts)
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(entropy), "score": 0.0, "accepted": False})
        best = entropy.argmin(axis=1)
        line = np.arange(len(entropy))
        odds = np.exp2(-SHARP * (entropy - entropy[line, best][:, None]))
        empty = count == 0
        limit = self.limits[best] + 4 * self.spread[best] / np.sqrt(np.maximum(count, 1))
        return pd.DataFrame({
            "lang_pred": np.where(empty, UNKNOWN, np.array(self.langs, object)[best]),
            "score": np.where(empty, 0.0, 1 / odds.sum(axis=1)),
            "accepted": ~empty & (entropy[line, best] <= limit),
        })

    def set_limits(self, seen: DataFrame, rejected: float = REJECTED) -> None:
        """Thresholds from all training texts (best language, bits, key of the bits, n): the (1 - rejected) quantile of their bits."""
        found = quantiles(seen.select(F.col("best").alias("group"), "key"), [0.5, 1 - rejected])
        if not found:
            return
        middle = F.element_at(F.create_map(*[F.lit(x) for j, (m, _) in found.items() for x in (j, m)]), F.col("best"))
        spread = F.sqrt(F.avg((F.col("bits") - middle) ** 2 * F.col("n")))
        for r in seen.groupBy("best").agg(F.round(spread, 9).alias("spread")).collect():  # rounded: no order of summing shows
            self.spread[r.best] = max(1.0, r.spread)
        for j, (m, high) in found.items():
            self.limits[j] = max(high, m + 1.0)


def fit_languages(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModels:
    """Models and thresholds from every row of ``train`` with a language and a text."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = stored(count_grams(rows, lang_col, text_col), "gram-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # their names
    folder = new_folder(train.sparkSession, "language-models")
    models = LanguageModels(langs, folder, write_model(model_rows(counts), langs, folder) if langs else [])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entropy, count = models.cross_entropy(batch["text"])
            if len(entropy):
                bits = entropy.min(axis=1)
                yield pd.DataFrame({"best": entropy.argmin(axis=1), "bits": bits, "key": order_keys(bits), "n": count})[count > 0]

    if models.langs:
        seen = rows.select(F.col(text_col).alias("text")).mapInPandas(measure, "best int, bits double, key long, n long")
        models.set_limits(stored(seen, "language-bits"))
    return models


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The rows that may train: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def predict_languages(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every document, in the scan."""
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = models.predict(batch["text"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(predict, f"id {kind}, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """The documents whose language is accepted, all columns as they were."""
    where = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = models.predict(batch.column(where).to_pylist())["accepted"].to_numpy(bool)
            yield batch.filter(pa.array(accepted))

    return docs.mapInArrow(keep, docs.schema)
