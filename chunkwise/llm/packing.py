"""Packing documents into training sequences: bounded-space online best-fit.

A document's ids (with the end id) are one piece if they fit into a sequence;
only longer ones are cut, into full sequences, with the remainder as the first
piece.  Pieces arrive in batches of bounded size, the longest of a batch first; each goes into the open sequence that it
fills best, found in a bitset with one bit per amount of free space.  A fixed
number of sequences is open; when one more is needed the fullest is closed.

Tokenisation happens in the scan; only the pieces' places (a few numbers each)
are shuffled, dealt by a scrambled row number so that no key can be hot.  Each
task packs its share with ``open_bins`` lists of bounded size and forgets a
piece once it is placed.

A null text counts as empty: its document is the end id alone.  Equal rows are
packed each; null ids stay null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.text_hash import mix
from chunkwise.llm.tokens import encoder

SEQUENCE = 1024
OPEN_BINS = 16384  # above what one batch can open, so that only bins left by earlier batches are closed


class BestFit:
    """Online best-fit over bins of ``size`` with at most ``open_bins`` open at a time."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.open_bins = size, open_bins
        self.free_bits = 0  # bit f is set while an open bin has f free places
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open, self.made = 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.open_bins:  # the fullest closes
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.open -= 1
            free, number = self.size, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
        else:
            self.open -= 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_bits &= ~(1 << free)
        return number


def cut_lengths(n: int, size: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: the remainder first, then full sequences."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    size: int = SEQUENCE, open_bins: int = OPEN_BINS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, seen = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out, source = [], []
            for i, text in enumerate(batch["text"]):
                data, start = enc.encode(text) + tail, 0
                for piece, length in enumerate(cut_lengths(len(data) // 4, size)):
                    out.append((piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                    source.append(i)
                    start += length
            table = pd.DataFrame(out, columns=["piece", "start", "length", "ids_crc32"])
            table.insert(0, "id", batch["id"].array.take(np.array(source, np.int64)))
            table["deal"] = mix(np.arange(seen, seen + len(table), dtype=np.uint64)).astype(np.int64)
            seen += len(table)
            yield table

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, task = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:  # a bounded look-ahead: the pieces of a batch go longest first
            batch = batch.sort_values(["length", "deal"], ascending=[False, True], ignore_index=True)
            placed = [bins.place(n) for n in batch["length"]]
            batch["sequence_id"] = [task + b for b, _ in placed]
            batch["offset"] = [o for _, o in placed]
            yield batch.drop(columns="deal")

    pieces = rows.mapInPandas(cut, f"{names}, deal long").repartition("deal").sortWithinPartitions("deal")
    out = pieces.mapInPandas(pack, f"{names}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
