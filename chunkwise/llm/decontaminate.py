"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents fall into size classes by powers of two of their number of distinct
shingles (see ``text_hash``).  A document's signature has ``BINS`` bins per
shingle of its class' upper bound and keeps the least hash of every bin, so a
shingle that a document shares with a short item is in the signature with
probability ``HIT`` at least, however long the document.  An item is a
candidate where enough of its shingles are in the signature: the containment
threshold turned into a number of hits, less five standard deviations.  Items
of fewer than ``TINY`` shingles skip that test.  Every candidate is verified by
exact containment: the share of the item's distinct shingles that the document
has must be ``THRESHOLD`` or more.

The documents are scanned once.  A bit filter of fixed size over the items'
shingles lets only shingles that some item may have leave the scan, as
(document, shingle, in signature); they meet the items in a join on the shingle
and partial aggregates count them.

Null and empty texts have no shingles and match nothing; an item of one to four
words matches only a text of exactly these words.  Repeated rows and repeated
ids are told apart by their text; pairs come out once.  Empty tables give no
pairs.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.storage import key_filter, load_filter, passes
from chunkwise.llm.text_hash import shingle_hashes

THRESHOLD = 0.8
BINS = 4  # bins per shingle of the size class' upper bound
HIT = 0.88  # least chance that a document's shingle is the least of its bin: (1 - e^(-1/BINS)) * BINS, rounded down
TINY = 12
ROWS_OUT = 2000


def signature_mask(sorted_hashes: np.ndarray) -> np.ndarray:
    """Which of a document's distinct hashes (ascending) are the least of their bin."""
    n = len(sorted_hashes)
    if not n:
        return np.zeros(0, bool)
    bits = max(4, int(n - 1).bit_length()) + (BINS - 1).bit_length()
    bins = sorted_hashes >> np.uint64(64 - bits)
    first = np.ones(n, bool)
    first[1:] = bins[1:] != bins[:-1]
    return first


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_key, shingle): distinct shingles of every item row."""
    kind = items.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t)).view(np.int64) for t in batch["text"]]
            at = np.repeat(np.arange(len(batch)), [len(h) for h in hashes])
            out = batch[["item", "item_key"]].iloc[at].reset_index(drop=True)
            yield out.assign(shingle=np.concatenate([*hashes, np.zeros(0, np.int64)]))

    rows = items.select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("item_key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(split, f"item {kind}, item_key long, shingle long").distinct()


def find_contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """(document, text hash, item, n_shared, n_item, containment) of every document that holds an item."""
    wanted = item_shingles(items, item_col, item_text_col)
    bits = key_filter(wanted.select("shingle"))
    kind = docs.schema[id_col].dataType.simpleString()

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = load_filter(bits)
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                part = batch.iloc[at : at + ROWS_OUT]
                rows, shingles, signed = [], [], []
                for i, text in enumerate(part["text"]):
                    hashes = np.sort(shingle_hashes(text))
                    near = passes(table, hashes)
                    if near.any():
                        distinct = np.ones(len(hashes), bool)
                        distinct[1:] = hashes[1:] != hashes[:-1]
                        hashes, near = hashes[distinct], near[distinct]
                        rows.append(np.full(int(near.sum()), i))
                        shingles.append(hashes[near].view(np.int64))
                        signed.append(signature_mask(hashes)[near])
                if rows:
                    out = part[["id", "key"]].iloc[np.concatenate(rows)].reset_index(drop=True)
                    yield out.assign(shingle=np.concatenate(shingles), signed=np.concatenate(signed))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    hits = rows.mapInPandas(probe, f"id {kind}, key long, shingle long, signed boolean")
    # Exact copies of a row give the same hits again, so distinct shingles are counted.
    pairs = hits.join(wanted, "shingle").groupBy("id", "key", "item", "item_key").agg(
        F.size(F.collect_set("shingle")).alias("n_shared"),
        F.size(F.collect_set(F.when(F.col("signed"), F.col("shingle")))).alias("n_signed"),
    )
    sizes = wanted.groupBy("item", "item_key").agg(F.count("*").cast("int").alias("n_item"))
    pairs = pairs.join(
        sizes.withColumnsRenamed({"item": "i", "item_key": "k"}), F.col("item").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("k"))
    ).drop("i", "k")
    expected = F.ceil(F.col("n_item") * threshold) * HIT
    needed = F.when(F.col("n_item") < TINY, 0).otherwise(F.greatest(F.lit(1), F.floor(expected - 5 * F.sqrt(expected * (1 - HIT)))))
    found = pairs.where(F.col("n_signed") >= needed).where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9)
    return found.select("id", "key", "item", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def contained_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item id, n_shared, n_item, containment), one row per pair of ids (the best of repeated rows)."""
    found = find_contained(docs, items, id_col=id_col, item_col=item_col, **options)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("b")
    out = found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(best)
    return out.select(id_col, item_col, "b.n_shared", "b.n_item", "b.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, all columns as they were."""
    found = find_contained(docs, items, id_col=id_col, text_col=text_col, **options).select("id", "key").distinct()
    marked = docs.withColumn("__key", F.xxhash64(text_col))
    same = marked[id_col].eqNullSafe(found["id"]) & (marked["__key"] == found["key"])
    return marked.join(found, same, "left_anti").select(*docs.columns)
