"""Category spelling correction against the vocabulary of the chunk table.

For every distinct requested string: no vocabulary -> unchanged; exact match ->
unchanged; case-insensitive match -> that category (when several share a lower
case form, the greatest in sort order wins); else the closest category by the
Ratcliff-Obershelp ratio if it reaches ``cutoff`` (ties -> greatest string);
else unchanged.  Returns ``(requested, resolved, was_corrected)``.

Tiers 1-2 are equi-joins.  Tier 3 is a set-similarity join: the ratio is at most
twice the common characters (as multisets) over both lengths, so a pair that
reaches ``cutoff`` shares so many characters that their rarest ones already meet
(prefix filter), the lengths are within ``cutoff / (2 - cutoff)`` of each other,
and the places of the shared characters leave room for the rest.  Pairs that
pass the multiset bound are scored; everything up to there stays in the JVM, and
neither vocabulary nor requests pass through the driver.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.operators.stats import unnest_categories

POPULAR_FROM = 200  # a request so long matches by its less common characters first, as in Python's difflib


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct non-empty categories of the chunk table (column ``category``)."""
    cats = unnest_categories(chunks)
    return cats.filter(F.col("cat").isNotNull() & (F.col("cat") != "")).distinct().withColumnRenamed("cat", "category")


def _longest_block(a: np.ndarray, b: np.ndarray, usable: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, size) of the longest common block over usable places of ``b``; the first of equal ones."""
    best, lengths = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, char in enumerate(a):
        ends = np.where((b == char) & usable, lengths[:-1] + 1, 0)  # block ending at each place of b
        j = int(ends.argmax()) if len(ends) else 0
        if len(ends) and ends[j] > best[2]:
            best = (i - int(ends[j]) + 1, j - int(ends[j]) + 1, int(ends[j]))
        lengths = np.concatenate([[0], ends])
    return best


def ratio(category: str, requested: str) -> float:
    """Ratcliff-Obershelp ratio: twice the characters in common blocks, longest block first, over both lengths."""
    if not category and not requested:
        return 1.0
    a, b = (np.array([ord(c) for c in s], np.int64) for s in (category, requested))
    usable = np.ones(len(b), bool)
    if len(b) >= POPULAR_FROM:
        often = [ord(c) for c, n in Counter(requested).items() if n > len(b) // 100 + 1]
        usable = ~np.isin(b, often)
    matched, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        a0, a1, b0, b1 = open_parts.pop()
        i, j, size = _longest_block(a[a0:a1], b[b0:b1], usable[b0:b1])
        i, j = a0 + i, b0 + j
        # places that cannot start a block may still lengthen one
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            matched += size
            open_parts += [(a0, i, b0, j), (i + size, a1, j + size, b1)]
    return 2.0 * matched / (len(a) + len(b))


def _score(batches):
    for pdf in batches:
        yield pdf.assign(score=[ratio(c, r) for c, r in zip(pdf["category"], pdf["requested"])])


def _characters(strings: DataFrame, name: str) -> DataFrame:
    """(name, size, char, n): how often each string has each character."""
    chars = strings.select(name, F.length(name).alias("size"), F.explode(F.split(name, "")).alias("char")).where("char <> ''")
    return chars.groupBy(name, "size", "char").agg(F.count("*").cast("int").alias("n"))


def _prefixes(characters: DataFrame, often: DataFrame, name: str, share: float) -> DataFrame:
    """(name, size, char, nth, place): the rarest characters, of which a pair over the cutoff has one in common.

    The second, third ... of equal characters count as characters of their own.
    """
    each = characters.select(name, "size", "char", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
    ranked = each.join(often, ["char", "nth"], "left").withColumn(
        "place", F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("often", F.lit(0)), "char", "nth"))
    )
    needed = F.ceil(F.col("size") * share - 1e-9)  # fewest common characters with a partner of any allowed size
    return ranked.where(F.col("place") <= F.col("size") - needed + 1).drop("often")


def close_pairs(requests: DataFrame, vocab: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(requested, category) of all pairs whose common characters allow a ratio of ``cutoff``."""
    share = cutoff / (2 - cutoff)
    asked, known = _characters(requests, "requested"), _characters(vocab, "category")
    often = known.select("char", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).groupBy("char", "nth").agg(F.count("*").alias("often"))
    left = _prefixes(asked, often, "requested", share)
    right = _prefixes(known, often, "category", share).withColumnsRenamed({"size": "other", "place": "other_place"})
    room = F.least("place", "other_place") + F.least(F.col("size") - F.col("place"), F.col("other") - F.col("other_place"))
    possible = (
        (F.col("other") >= F.col("size") * share - 1e-9) & (F.col("size") >= F.col("other") * share - 1e-9)
        & (room >= (F.col("size") + F.col("other")) * cutoff / 2 - 1e-9)
    )
    pairs = left.join(right, ["char", "nth"]).where(possible).select("requested", "category", "size", "other").distinct()
    counts = lambda c, name, out: c.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("char", "n"))).alias(out))
    both = pairs.join(counts(asked, "requested", "a"), "requested").join(counts(known, "category", "b"), "category")
    common = F.aggregate(F.map_entries("a"), F.lit(0), lambda acc, e: acc + F.least(e["value"], F.coalesce(F.try_element_at("b", e["key"]), F.lit(0))))
    return both.where(common >= (F.col("size") + F.col("other")) * cutoff / 2 - 1e-9).select("requested", "category")


def fuzzy_matches(requests: DataFrame, vocab: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(requested, fuzzy) best close match per distinct requested string (no row if none)."""
    scored = close_pairs(requests, vocab, cutoff).mapInPandas(_score, "requested string, category string, score double")
    top = scored.where(F.col("score") >= cutoff).groupBy("requested").agg(F.max(F.struct("score", "category")).alias("m"))
    return top.select("requested", F.col("m.category").alias("fuzzy"))


def resolve_categories(requests: DataFrame, vocab: DataFrame, cutoff: float = 0.6, fuzzy: bool = True) -> DataFrame:
    """(requested, resolved, was_corrected) for the distinct non-null ``requested`` values."""
    req = requests.select("requested").filter(F.col("requested").isNotNull()).distinct()
    exact = vocab.select(F.col("category").alias("requested"), F.lit(True).alias("exact"))
    lower = vocab.groupBy(F.lower("category").alias("lc")).agg(F.max("category").alias("lower_hit"))
    out = (
        req.join(exact, "requested", "left")
        .join(lower, F.lower(F.col("requested")) == F.col("lc"), "left")
        .drop("lc")
    )
    if fuzzy:
        pending = out.filter(F.col("exact").isNull() & F.col("lower_hit").isNull()).select("requested")
        out = out.join(fuzzy_matches(pending, vocab, cutoff), "requested", "left")
    else:
        out = out.withColumn("fuzzy", F.lit(None).cast("string"))
    resolved = F.when(F.col("exact"), F.col("requested")).otherwise(
        F.coalesce(F.col("lower_hit"), F.col("fuzzy"), F.col("requested"))
    )
    corrected = F.col("exact").isNull() & (F.col("lower_hit").isNotNull() | F.col("fuzzy").isNotNull())
    return out.select("requested", resolved.alias("resolved"), corrected.alias("was_corrected"))
