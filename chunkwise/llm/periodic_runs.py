"""Periodic runs of words by recursive frequency splitting.

Words are what lies between ASCII white space.  A run is a stretch of
consecutive words with smallest period ``q`` (words ``q`` apart are equal) and at
least ``max(MIN_LENGTH, MIN_POWER * q)`` words that cannot be extended on either
side with that period.

1. Splitting.  Every word of a run stands in it at least ``MIN_POWER`` times, so
   a word that is rarer than that in a segment belongs to no run inside it and
   splits it there.  The pieces are segments again; this goes on until no word is
   too rare and drops segments too short for a run.  Only segments that were
   split are counted anew.
2. Lag scan of the segments that are left, for each lag ``q``.  A run of period
   ``q`` holds ``MIN_POWER`` places that are multiples of ``q``, so equal words at
   that many consecutive multiples mark the candidates: a segment of ``m`` words
   takes ``m / q`` comparisons for lag ``q``, ``m log m`` in all.  Candidates are
   extended word by word to both sides.  Lags rise, so a stretch found before has
   the smaller period (which divides this one) and stands.

All of it happens in the scan, one text at a time; nothing is shuffled.  A null
text has no words; it, an empty text and an empty table have no runs.  Equal
rows get equal results.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_POWER = 4
MIN_LENGTH = 6
SPACE = r"[\x20\x09-\x0D]+"


def _segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that survive splitting."""
    active = [(0, len(ids))]
    while active:
        sizes = np.array([e - s for s, e in active])
        places = np.concatenate([np.arange(s, e) for s, e in active])
        segment = np.repeat(np.arange(len(active)), sizes)
        pair = segment * (int(ids.max()) + 1) + ids[places]
        _, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        rare = n[which] < MIN_POWER
        split = np.bincount(segment, rare, len(active)) > 0
        for i in np.flatnonzero(~split):
            yield active[i]
        # the stretches between rare words of the segments that were split
        keep = ~rare & split[segment]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])) != 0)
        starts, ends = edges[::2], edges[1::2]
        # two segments may meet without a rare word between them
        cuts = np.flatnonzero(np.diff(segment) != 0) + 1
        active = []
        for s, e in zip(starts, ends):
            inner = cuts[np.searchsorted(cuts, s, "right") : np.searchsorted(cuts, e, "left")]
            bounds = [s, *inner, e]
            active += [(int(places[a]), int(places[b - 1]) + 1) for a, b in zip(bounds, bounds[1:]) if b - a >= MIN_LENGTH]


def _extent(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """Widest (start, end) in [low, high - lag) around ``at`` where words ``lag`` apart are equal."""
    start, end, step = at, at + 1, 64
    while end < high - lag:
        stop = min(end + step, high - lag)
        differ = np.flatnonzero(ids[end:stop] != ids[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    step = 64
    while start > low:
        stop = max(start - step, low)
        differ = np.flatnonzero(ids[stop:start] != ids[stop + lag : start + lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def _lag_scan(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs inside one segment."""
    runs: list[tuple[int, int, int]] = []
    part = ids[low:high]
    for lag in range(1, len(part) // MIN_POWER + 1):
        marks = part[::lag]
        same = marks[1:] == marks[:-1]
        # MIN_POWER multiples of the lag in a row: MIN_POWER - 1 equal pairs
        row = same[: len(same) - MIN_POWER + 2].copy()
        for j in range(1, MIN_POWER - 1):
            row &= same[j : len(same) - MIN_POWER + 2 + j]
        if not row.any():
            continue
        known = [(s, s + n) for s, n, p in runs if lag % p == 0 and n >= MIN_POWER * lag]
        done = -1  # candidates before this place are settled
        for mark in np.flatnonzero(row):
            at = low + int(mark) * lag
            if at < done:
                continue
            inside = [e for s, e in known if s <= at and at + (MIN_POWER - 1) * lag < e]
            if inside:
                done = max(inside) - (MIN_POWER - 1) * lag
                continue
            start, end = _extent(ids, at, lag, low, high)
            done = end
            length = end + lag - start
            if length >= max(MIN_LENGTH, MIN_POWER * lag) and (start, start + length) not in {(s, s + n) for s, n, p in runs if lag % p == 0}:
                runs.append((start, length, lag))
    return runs


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < MIN_LENGTH:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return sorted((run for s, e in _segments(ids) for run in _lag_scan(ids, s, e)), key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without the repeats: of each run its first period stays."""
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [w for w, d in zip(words, drop) if not d] if drop.any() else words


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): runs as an array of (start, length, period), the text without repeats."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = text.encode("utf-8").split() if text else []  # bytes split at ASCII white space only
                runs = word_runs(words)
                listed = [{"start": s, "length": n, "period": p} for s, n, p in runs]
                out.append((len(words), listed, b" ".join(kept_words(words, runs)).decode("utf-8")))
            yield pd.DataFrame({"id": batch["id"], **dict(zip(("n_words", "runs", "collapsed"), map(list, zip(*out))))}) if out else pd.DataFrame(
                {"id": batch["id"], "n_words": [], "runs": [], "collapsed": []})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, schema).withColumnRenamed("id", id_col)


def text_words(text: Column) -> Column:
    """Words of a text as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def with_repeats(text: Column, number: Column) -> Column:
    """``text`` whose words from one on are replaced by repeats of the first ones, as ``number`` says.

    ``number`` is the crc32 of the document's id; a tenth of the documents (it is
    a multiple of 10) are changed, and only those with words.  A null number
    changes nothing.
    """
    g = F.floor(number / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        turned = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n == 0, text).otherwise(F.array_join(F.transform(words, turned), " "))

    changed = F.transform(F.array(text_words(text)), repeated)[0]
    return F.when(F.coalesce(number % 10 == 0, F.lit(False)), changed).otherwise(text)


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: n_runs, its strongest run, and digests of all runs and of the collapsed text.

    The strongest run has the greatest exact length / period; ties go to the
    smallest start, then the smallest period.
    """
    runs = F.col("runs")
    # fractions are compared by cross products
    ahead = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])  # noqa: E731  (runs are in order: ties keep the first)
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda acc, x: F.when(ahead(x, acc), x).otherwise(acc))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return rows.select(
        id_col, "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.encode("listed", "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
