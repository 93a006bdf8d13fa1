"""Near-duplicate classes by DartMinHash and banding.

Texts with equal words are one: they share a digest and are represented by
their least id.  A text is the multiset of its shingles (see ``text_hash``);
its m-th occurrence of a shingle is one unit of weight.  Every unit is the
region of a Poisson process of hashed darts (rank, coordinate), the same for
all texts; a text throws the darts of its units up to a rank at which all
``COORDINATES`` are hit and keeps the earliest of each.  Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates give buckets.  In two rounds, every bucket
whose members are not yet in one class names pivots, and its members of other
classes are compared with these: linear in the bucket, never all pairs.
Signatures first rule out pairs that are far off, exact weighted Jaccard over
all shingles decides (``THRESHOLD`` or more), and links become classes by star
contraction.  The first pivot is the bucket's least id, the next ``DRAWS`` come
from its largest class.  Pivots only settle most buckets cheaply: the texts of every bucket of three or more that
still holds several classes then meet in an exact join on their rarest units.  Of
two texts at the threshold each has a shared unit among its rarest
``1 - THRESHOLD`` of all, in any order of units that is the same for all texts, so
no pair of such a bucket is left out, whoever was a pivot.  The order is by counts folded
into ``RARITY_SLOTS`` slots (it changes cost, never results).

A pair of similarity 0.8 shares a bucket with probability 0.99995, one of 0.9
practically always.  Nothing is capped; hot buckets only meet in aggregates and
in joins whose skewed keys Spark splits.  Links and classes stay in Spark;
every round is written to shared storage.

Null and empty texts have no words and are all copies of one another only if
``empty_together``; by default each stands alone.  Ids name documents: rows that
share an id are one, stay or go together, and are compared by one of their
texts.  A row without an id has no class and stays.  Empty tables give no rows.
Other columns are not read, but kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.storage import stored
from chunkwise.llm.text_hash import fold_shingles, mix, shingle_hashes, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
DRAWS = 4  # pivots of a bucket in the second round
RARITY_SLOTS = 1 << 18  # counts by which units are ordered: 2 MB whatever the data
SLACK = 0.16  # a signature this far below the threshold (4.5 standard deviations) rules a pair out
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
SLICE = 500  # texts whose darts are worked on at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weight_units(shingles: np.ndarray) -> np.ndarray:
    """One hash per unit of weight: the m-th occurrence of a shingle differs from the first."""
    ordered = np.sort(shingles)
    start = np.ones(len(ordered), bool)
    start[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(start)
    nth = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return np.where(nth == 0, ordered, mix(ordered + nth.astype(np.uint64) * _GOLD))


def signatures(units: list[np.ndarray]) -> np.ndarray:
    """Array (texts, COORDINATES) of the identities of the earliest darts; texts must have a unit each."""
    out = np.zeros((len(units), COORDINATES), np.uint32)
    todo, reach = np.arange(len(units)), np.array([DARTS / len(u) for u in units])
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), [len(units[i]) for i in todo])
        unit = np.concatenate([units[i] for i in todo])
        limit = reach[todo][owner]
        rank = np.zeros(len(unit))
        seen_rank, seen_slot, seen_name = [], [], []
        step = 0
        while len(unit):  # the next dart of every unit, as long as it lies within reach
            step += 1
            dart = mix(unit + np.uint64(step * int(_GOLD) % (1 << 64)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0)
            near = rank <= limit
            unit, owner, limit, rank, dart = unit[near], owner[near], limit[near], rank[near], dart[near]
            name = mix(dart)
            seen_rank.append(rank)
            seen_slot.append(owner * COORDINATES + (name % np.uint64(COORDINATES)).astype(np.int64))
            seen_name.append((name >> np.uint64(32)).astype(np.uint32))
        rank, slot, name = np.concatenate(seen_rank), np.concatenate(seen_slot), np.concatenate(seen_name)
        latest_first = np.argsort(-rank, kind="stable")
        kept, hit = np.zeros(len(todo) * COORDINATES, np.uint32), np.zeros(len(todo) * COORDINATES, bool)
        kept[slot[latest_first]] = name[latest_first]  # the last written is the earliest dart
        hit[slot] = True
        whole = hit.reshape(-1, COORDINATES).all(axis=1)
        out[todo[whole]] = kept.reshape(-1, COORDINATES)[whole]
        todo = todo[~whole]
        reach[todo] *= 1.5
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """Array (texts, BANDS) of bucket keys."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * _GOLD + rows[:, :, r])
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of distinct weight units."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(len(a) + len(b) - shared, 1)


# ------------------------------------------------------------ the classes ----


def _signed(docs: DataFrame, id_col: str, text_col: str, empty_together: bool) -> DataFrame:
    """(id, copy, small, bands): digest of the words, 1-byte signature, bucket keys; nulls for a text that stands alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                words = [word_hashes(t) for t in part["text"]]
                copies = [xxhash.xxh3_128_digest(w.tobytes()) if len(w) or empty_together else None for w in words]
                some = [i for i, w in enumerate(words) if len(w)]
                small, bands = [None] * len(part), [None] * len(part)
                if some:
                    signed = signatures([weight_units(fold_shingles(words[i])) for i in some])
                    keys = band_hashes(signed).view(np.int64)
                    for k, i in enumerate(some):
                        small[i], bands[i] = (signed[k] & np.uint32(255)).astype(np.uint8).tobytes(), keys[k]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "copy": copies, "small": small, "bands": bands})

    return rows.mapInPandas(sign, f"id {kind}, copy binary, small binary, bands array<long>")


def _not_far_apart(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, a_small, b_small) without those whose signatures rule out THRESHOLD."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                left = np.frombuffer(b"".join(batch["a_small"]), np.uint8).reshape(-1, COORDINATES)
                right = np.frombuffer(b"".join(batch["b_small"]), np.uint8).reshape(-1, COORDINATES)
                near = (left == right).mean(axis=1) >= THRESHOLD - SLACK
                yield batch.loc[near, ["a", "b"]]

    return rows.mapInPandas(check, f"a {dict(rows.dtypes)['a']}, b {dict(rows.dtypes)['b']}")


def _units(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, units): exact weight units of the texts whose ids are among ``ids``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                units = [np.sort(weight_units(shingle_hashes(t))).tobytes() for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "units": units})

    return rows.join(ids, "id", "left_semi").mapInPandas(split, f"id {kind}, units binary")


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard is THRESHOLD or more."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [
                weighted_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= THRESHOLD - 1e-9
                for x, y in zip(batch["a_units"], batch["b_units"])
            ]
            yield batch.loc[np.array(near, bool), ["a", "b"]]

    one = units.withColumnsRenamed({"id": "a", "units": "a_units"})
    other = units.withColumnsRenamed({"id": "b", "units": "b_units"})
    kind = dict(pairs.dtypes)["a"]
    return pairs.join(one, "a").join(other, "b").mapInPandas(check, f"a {kind}, b {kind}")


def contract(links: DataFrame) -> DataFrame:
    """(node, label): label = least node of its component, for all nodes in ``links`` (a, b).

    The links become stars step by step: every node points its larger
    neighbours at its least one, then its smaller ones at the least.  What is
    left once nothing changes are the edges from each node to its component's
    least; a star takes one step, a chain about the logarithm of its length.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = stored(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        same = nxt.count() == edges.count() and nxt.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = nxt
        if same:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stored(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")


def _pivots(members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """((bucket, a, a_label) of the buckets that still hold several classes, members with their labels).

    The first pivot of a bucket is its least id, the next DRAWS are members of
    its largest class.
    """
    if labels is None:
        low = members.groupBy("bucket").agg(F.min("rep").alias("a")).withColumn("a_label", F.col("a"))
        return low, members.withColumn("label", F.col("rep"))
    now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    drawn = lambda: F.array_distinct(F.array(*[
        F.min_by(F.struct(F.col("rep").alias("a"), F.col("label").alias("a_label")), F.xxhash64("rep", "bucket", F.lit(DRAWS + i)))
        for i in range(DRAWS)
    ]))
    classes = now.groupBy("bucket", "label").agg(F.count("*").alias("n"), drawn().alias("p"))
    largest = classes.groupBy("bucket").agg(F.count("*").alias("classes"), F.max(F.struct("n", "label", "p")).alias("m"))
    fresh = largest.where("classes > 1").select("bucket", "m.p")
    return fresh.select("bucket", F.inline("p")), now


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the texts in buckets that still hold several classes; the pivots have tried all pairs of a bucket of two."""
    now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    several = several.where("n > 2 AND low != high").select("bucket")
    return now.join(several, "bucket", "left_semi").select(F.col("rep").alias("id"), "label").distinct()


def _rarity(texts: DataFrame) -> bytes:
    """Occurrences of the units by folded hash, as RARITY_SLOTS 64-bit numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            for raw in batch["units"]:
                np.add.at(n, _rarity_slot(np.frombuffer(raw, np.uint64)), 1)
        slots = np.flatnonzero(n)
        yield pd.DataFrame({"slot": slots, "n": n[slots]})

    table = texts.select("units").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(RARITY_SLOTS, np.int64)
    out[table["slot"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out.tobytes()


def _rarity_slot(units: np.ndarray) -> np.ndarray:
    return (units & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)


def rare_units(units: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, their places in the common order) of which a text at THRESHOLD shares one; those that no other text has are left out."""
    seen = rarity[_rarity_slot(units)]
    order = np.lexsort((units, seen))[: len(units) - int(np.ceil(THRESHOLD * len(units) - 1e-6)) + 1]
    place = np.flatnonzero(seen[order] > 1)
    return units[order[place]], place


def _remaining_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes among ``texts`` (id, label, units), each pair at THRESHOLD among them.

    They share a rare unit.  Where several classes meet in a unit, the texts
    outside its largest class are joined with all of its texts; a pair stays if
    what follows the shared unit in both could still make up the threshold,
    which holds at the first unit that a true pair shares.
    """
    kind, raw = dict(texts.dtypes)["id"], _rarity(texts)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity = np.frombuffer(raw, np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                units = [np.frombuffer(u, np.uint64) for u in part["units"]]
                found = [rare_units(u, rarity) for u in units]
                times = [len(f[0]) for f in found]
                if sum(times):
                    yield pd.DataFrame({
                        "unit": np.concatenate([f[0] for f in found]).view(np.int64), "id": np.repeat(part["id"].to_numpy(), times),
                        "label": np.repeat(part["label"].to_numpy(), times), "size": np.repeat([len(u) for u in units], times),
                        "left": np.repeat([len(u) for u in units], times) - np.concatenate([f[1] for f in found]),
                    })

    rare = stored(texts.mapInPandas(split, f"unit long, id {kind}, label {kind}, size long, left long"), "rare-units")
    classes = rare.groupBy("unit", "label").agg(F.count("*").alias("n"))
    top = classes.groupBy("unit").agg(F.count("*").alias("classes"), F.max(F.struct("n", "label")).alias("m"))
    rare = rare.join(top.where("classes > 1").select("unit", F.col("m.label").alias("top")), "unit")
    names = lambda c: {n: f"{c}_{n}" for n in ("id", "label", "size", "left")}
    one = rare.where("label != top").withColumnsRenamed(names("a"))
    other = rare.withColumnsRenamed(names("b")).withColumnRenamed("top", "b_top")
    least, most = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    enough = F.least("a_left", "b_left") >= F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.col("a_size") + F.col("b_size")) - 1e-6
    once = F.expr("b_label = b_top OR a_id < b_id")
    pairs = one.join(other, "unit").where("a_label != b_label").where(once & enough & (least >= THRESHOLD * most - 1e-6))
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def _merge(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """The labels with the classes that ``found`` links made one."""
    if labels is None:
        return contract(found)
    end = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    between = found.join(end("a"), "a", "left").join(end("b"), "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")
    )
    step = contract(between)  # between classes: as small as the round's news
    known = labels.withColumnRenamed("label", "old").join(step.withColumnsRenamed({"node": "old"}), "old", "left")
    known = known.select("node", F.coalesce("label", "old").alias("label"))
    fresh = step.join(labels.select("node"), "node", "left_anti")
    return stored(known.unionByName(fresh), "labels")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", empty_together: bool = False
) -> DataFrame:
    """(id, class_id, copy_of): class_id = least id of the class, copy_of = least id with the same words (may be the row's own)."""
    signed = stored(_signed(docs, id_col, text_col, empty_together), "signed")
    reps = signed.where("copy IS NOT NULL AND id IS NOT NULL").groupBy("copy").agg(F.min("id").alias("rep"), F.min_by(F.struct("small", "bands"), "id").alias("s"))
    reps = stored(reps.select("copy", "rep", "s.small", "s.bands"), "representatives")
    buckets = reps.where("bands IS NOT NULL").select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(buckets.join(shared, "bucket").select("bucket", "rep"), "buckets")
    busy = members.select("rep").distinct()
    small = reps.select("rep", "small").join(busy, "rep", "left_semi")
    units = stored(_units(docs, busy.withColumnRenamed("rep", "id"), id_col, text_col).groupBy("id").agg(F.min("units").alias("units")), "units")

    def linked(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(small.withColumnsRenamed({"rep": "a", "small": "a_small"}), "a").join(
            small.withColumnsRenamed({"rep": "b", "small": "b_small"}), "b"
        )
        return stored(_verified(_not_far_apart(sized), units), "found")

    labels = None
    for _ in range(2):  # the first pivots, then those of the largest classes
        pivots, now = _pivots(members, labels)
        labels = _merge(labels, linked(now.join(pivots, "bucket").where("label != a_label").select("a", F.col("rep").alias("b")).distinct()))
    rest = stored(units.join(_unsettled(members, labels), "id"), "unsettled")
    found = linked(_remaining_pairs(rest))
    if not found.isEmpty():
        labels = _merge(labels, found)

    reps = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    out = signed.select("id", "copy").join(reps.select("copy", "rep", "label"), "copy", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("class_id"), F.coalesce("rep", "id").alias("copy_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: the one of least id of every class, all columns as they were; rows without an id stay."""
    classes = near_duplicates(docs, id_col, text_col)
    gone = classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
