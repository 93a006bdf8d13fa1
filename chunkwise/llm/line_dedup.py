"""Line dedup by chunks of lines.

From every line a chunk runs forwards, and to every line one runs backwards, over
as many lines as it takes to reach ``MIN_LINES`` lines and ``MIN_WORDS`` words;
blank lines start no chunk forwards and end none backwards.  Where a chunk lies
thus depends on its own lines only, so a passage gets the same chunks whatever
surrounds it, and every line with words of a passage of that many lines and words
is covered by a chunk inside it.  A line of ``LONG_LINE`` words or more is also a
chunk of its own, so a passage on a single line is found, in texts of one line as well.

A chunk that occurs more than once among all documents stays where it comes
first (by document id, then text hash, then line) and its lines go everywhere
else.  Chunks with equal hashes are compared byte by byte with the first one
before anything is removed.  No content is lost: a removed line still stands in
an earlier document or further up.

The first scan counts chunk hashes (aggregated map-side); a bit filter of fixed
size over the repeated ones lets only these chunks leave the second scan with
their text.  Then an aggregate finds each chunk's first place and a join, whose
skewed keys Spark splits, marks the other ones.

Null and empty texts stay as they are.  Rows with the same id and text count as
one document and are cleaned alike.  A text whose lines all go becomes empty.
All other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chunkwise.llm.storage import key_filter, load_filter, passes, stored
from chunkwise.llm.text_hash import mix

MIN_LINES = 2
MIN_WORDS = 10
LONG_LINE = 50  # words from which a line is a chunk of its own
ROWS_OUT = 2000
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ROLL), -1, 1 << 64))


def line_chunks(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, number of lines) of a text's chunks, each place once."""
    n = len(lines)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, n)
    count = np.fromiter((len(x.split()) for x in lines), np.int64, n)
    words, line = np.concatenate([[0], np.cumsum(count)]), np.arange(n)
    end = np.maximum(np.searchsorted(words, words[:-1] + MIN_WORDS), line + MIN_LINES)  # forwards from each line
    start = np.minimum(np.searchsorted(words, words[1:] - MIN_WORDS, "right"), line + 2 - MIN_LINES) - 1  # backwards to each
    ahead, behind = (count > 0) & (end <= n), (count > 0) & (start >= 0)
    alone = line[count >= LONG_LINE]
    first, last = np.concatenate([line[ahead], start[behind], alone]), np.concatenate([end[ahead], line[behind] + 1, alone + 1])
    places = np.unique(first * (n + 1) + last)
    first, last = places // (n + 1), places % (n + 1)
    power, back = np.cumprod(np.full(n, _ROLL, np.uint64)), np.cumprod(np.full(n, _BACK, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)])
    out = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return out, first, last - first


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_OUT):
            yield batch.iloc[at : at + ROWS_OUT]


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, first, size) of every chunk that has to go; ``key`` is the text's hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").isNotNull())

    def hashes_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            found = [line_chunks(t.split("\n"))[0] for t in part["text"]]
            yield pd.DataFrame({"chunk": np.concatenate(found).view(np.int64)})

    counts = rows.select("text").mapInPandas(hashes_only, "chunk long").groupBy("chunk").agg(F.count("*").alias("n"))
    bits = key_filter(counts.where("n > 1").select("chunk"))

    def with_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = load_filter(bits)
        for part in _parts(batches):
            row, chunk, first, size, body = [], [], [], [], []
            for i, text in enumerate(part["text"]):
                lines = text.split("\n")
                found, at, length = line_chunks(lines)
                near = np.flatnonzero(passes(table, found))
                row += [i] * len(near)
                chunk.append(found[near].view(np.int64))
                first.append(at[near])
                size.append(length[near])
                body += ["\n".join(lines[at[k] : at[k] + length[k]]) for k in near]
            if row:
                out = part[["id", "key"]].iloc[row].reset_index(drop=True)
                yield out.assign(chunk=np.concatenate(chunk), first=np.concatenate(first), size=np.concatenate(size), body=body)

    schema = f"id {kind}, key long, chunk long, first long, size long, body string"
    places = stored(rows.mapInPandas(with_text, schema), "line-chunks")
    order = F.struct("id", "key", "first")
    firsts = places.groupBy("chunk").agg(F.min(order).alias("kept"), F.min_by("body", order).alias("kept_body"), F.count("*").alias("n"))
    later = places.join(firsts.where("n > 1"), "chunk").where(F.col("body") == F.col("kept_body"))
    return later.where(~order.eqNullSafe(F.col("kept"))).select("id", "key", "first", "size")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The documents without repeated chunks, all columns kept; ``removed_col`` adds the number of removed lines."""
    gone = repeated_chunks(docs, id_col, text_col)
    per_doc = gone.groupBy(F.col("id").alias("__gone_id"), F.col("key").alias("__gone_key")).agg(
        F.collect_set(F.struct("first", "size")).alias("__gone")
    )
    marked = docs.withColumn("__text_key", F.xxhash64(text_col))
    same = marked[id_col].eqNullSafe(per_doc["__gone_id"]) & (marked["__text_key"] == per_doc["__gone_key"])
    joined = marked.join(per_doc, same, "left").select(*docs.columns, "__gone")
    where = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *([StructField(removed_col, LongType())] if removed_col else [])])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, places in zip(batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = text.split("\n") if places else []
                stays = np.ones(len(lines), bool)
                for g in places or ():
                    stays[g["first"] : g["first"] + g["size"]] = False
                texts.append("\n".join(x for x, s in zip(lines, stays) if s) if places else text)
                removed.append(int(len(lines) - stays.sum()))
            columns = batch.columns[:-1]
            columns[where] = pa.array(texts, pa.string())
            if removed_col:
                columns.append(pa.array(removed, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(rewrite, schema)
