"""Verbatim passage location: which documents contain which passages, and where.

A join on rolling fingerprints finds the candidates and an exact search settles
them.  Passages fall into classes by length, class ``c`` from ``2^c`` code points
on.  A class hashes every run of ``k = 2^(c-1)`` code points (``k = 1`` for class
0), rolling from each length to its double; the key of a passage is the least
hash in its first ``2^c`` code points, and a document has the least hash of every
stretch of ``2^c`` code points.  So a document that holds a passage holds its key,
and there are only about four keys to ``2^c`` code points.  Keys meet in an
equi-join; the pairs that meet are searched with ``instr``.  Nothing but the
numbers of the classes comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_CHARS = 1 << 20  # characters hashed at a time, whatever the size of a batch

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[: len(values) - span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def text_keys(text: str, classes: list[int]) -> dict[int, np.ndarray]:
    """Per class the distinct least hashes of all stretches of ``2^class`` code points; none for shorter texts."""
    hashes = _mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    out, k = {}, 1
    for c in sorted(classes):
        size = 1 << c
        if len(text) < size:
            break
        while 2 * k <= size // 2:  # the hash of 2k code points from those of its halves
            hashes, k = _mixed(hashes[: len(hashes) - k] * _ODD + hashes[k:]), 2 * k
        out[c] = np.unique(_least(hashes, size - k + 1)).view(np.int64)
    return out


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about PIECE_CHARS characters of text, a row at least."""
    held = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + PIECE_CHARS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _keys_of(rows: DataFrame, classes: list[int], heads: bool) -> DataFrame:
    """``rows`` (with text) and a row per key: class and key.  ``heads``: the one key of each text's own class."""
    fields = [f for f in rows.schema.fields if f.name != "text"]
    kept, at = [i for i, c in enumerate(rows.columns) if c != "text"], rows.columns.index("text")
    names = [*[f.name for f in fields], "cls", "key"]

    def keyed(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        line, cls, key = [], [], []
        for i, text in enumerate(piece.column(at).to_pylist()):
            if heads:
                own = len(text).bit_length() - 1
                found = text_keys(text[: 1 << own], [own])
            else:
                found = text_keys(text, classes)
            for c, keys in found.items():
                line.append(np.full(len(keys), i)), cls.append(np.full(len(keys), c, np.int32)), key.append(keys)
        if not line:
            return None
        lines = pa.array(np.concatenate(line))
        columns = [piece.column(c).take(lines) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cls)), pa.array(np.concatenate(key))], names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, at):
                out = keyed(piece)
                if out is not None:
                    yield out

    return rows.mapInArrow(make, T.StructType([*fields, T.StructField("cls", T.IntegerType()), T.StructField("key", T.LongType())]))


def locate_passages(docs: DataFrame, passages: DataFrame, doc_key: str = "doc_id", passage_key: str = "item_id") -> DataFrame:
    """(doc_key, passage_key, start_char, passage_len, passage) for every passage found in a document.

    ``start_char`` is the 0-based code-point offset of the first occurrence.  A
    null text holds nothing, a null passage is nowhere, an empty one in every
    document at 0.  Repeated rows of either side give repeated rows.
    """
    texts = docs.select(F.col(doc_key).alias("dk"), "text").where("text IS NOT NULL")
    wanted = passages.select(F.col(passage_key).alias("pk"), F.col("text").alias("passage")).where("passage IS NOT NULL")
    worded = wanted.where("passage <> ''")
    size = F.length("passage").cast("double")
    classes = [r.cls for r in worded.select(F.floor(F.log2(size) + 1e-12).cast("int").alias("cls")).distinct().collect()]  # at most 31
    found = texts.select("dk", "text", F.xxhash64("text").alias("th"))
    heads = _keys_of(worded.select("pk", "passage", F.col("passage").alias("text")), classes, True)
    # keys of repeated rows meet once
    met = _keys_of(found.dropDuplicates(["dk", "th"]), classes, False).join(heads.dropDuplicates(["pk", "passage"]), ["cls", "key"])
    met = met.select(F.col("dk").alias("mk"), F.col("th").alias("mh"), F.col("pk").alias("ik"), "passage").distinct()
    repeats = worded.groupBy(F.col("pk").alias("rk"), F.col("passage").alias("rp")).agg(F.count("*").cast("int").alias("times"))
    met = met.join(repeats, F.col("ik").eqNullSafe(F.col("rk")) & (F.col("passage") == F.col("rp")))
    at = F.expr("instr(text, passage)").cast("long") - 1
    held = found.join(met, F.col("dk").eqNullSafe(F.col("mk")) & (F.col("th") == F.col("mh"))).withColumn("start_char", at).where("start_char >= 0")
    held = held.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    everywhere = wanted.where("passage = ''").select("pk", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    empty = texts.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(16)).cast("int")).join(everywhere, "salt")
    columns = lambda start, length, text: [F.col("dk").alias(doc_key), F.col("pk").alias(passage_key), start.alias("start_char"), length.alias("passage_len"), text.alias("passage")]
    rows = held.withColumnRenamed("ik", "pk").select(*columns(F.col("start_char"), F.length("passage"), F.col("passage")))
    return rows.unionByName(empty.select(*columns(F.lit(0).cast("long"), F.lit(0), F.lit(""))))
