"""Token-id files: a corpus as flat unsigned integers with 64-bit document offsets.

Layout of a folder: for every shard, ``tokens-N.bin`` (the ids of its documents
one after the other; unsigned 16 bit where the vocabulary fits, else 32 bit),
``offsets-N.bin`` (64-bit, one more than documents: where each starts inside
the shard) and ``ids-N.bin`` (64-bit document ids; the smallest 64-bit number
stands for null).  ``manifest.json`` has the type and, per shard, its numbers
of documents and tokens and their prefix sums (the shard's bases).  Shards and
the documents inside follow ascending document id, nulls first; rows that share
an id keep some order among themselves.

Texts are tokenised once, in the scan; only ids are shuffled.  Shard bounds are
quantiles of the ids; an id so frequent that several bounds fall on it is dealt
over all their shards.  A shard is written under a name of its own attempt and
then moved, so a task that runs again is harmless.  A null text counts as
empty: such a document holds the end id alone.  An empty table gives a folder
without shards.  Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.llm.tokens import encoder, vocabulary_size

NULL_ID = -(1 << 63)
ROWS_OUT = 1000  # rows per batch that leaves a task
MANIFEST = "shard int, docs long, tokens long"


def _place(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _put(fs, path: str, data: bytes) -> None:
    attempt = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(attempt) as out:
        out.write(data)
    fs.move(attempt, path)


def _shard_bounds(docs: DataFrame, id_col: str, shards: int) -> np.ndarray:
    """Ascending ids that separate the shards; one column is read."""
    share = [i / shards for i in range(1, shards)]
    cuts = docs.approxQuantile(id_col, share, min(0.01, 0.1 / shards)) if share else []
    return np.array(cuts, dtype=np.float64)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[dict]:
    """Write the files and return the manifest's shards, in order."""
    width = np.dtype("<u2" if max(vocabulary_size(tokenizer_path), end_id + 1) <= 1 << 16 else "<u4")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bounds = _shard_bounds(rows, "id", shards)
    tail = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, seen = encoder(tokenizer_path), 0
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                part = batch.iloc[at : at + ROWS_OUT]
                ids = part["id"].astype("Int64")
                key = ids.fillna(NULL_ID).to_numpy(np.int64)
                low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                order = np.arange(seen, seen + len(part))
                seen += len(part)
                data = [np.frombuffer(enc.encode(t) + tail, "<u4").astype(width).tobytes() for t in part["text"]]
                yield pd.DataFrame({"shard": low + order % (high - low + 1), "id": ids.array, "data": data})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _place(folder)
        shard, ids, sizes, parts = None, [], [], []

        def close() -> pd.DataFrame:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            _put(fs, f"{root}/ids-{shard}.bin", np.array(ids, "<i8").tobytes())
            _put(fs, f"{root}/offsets-{shard}.bin", offsets.tobytes())
            out.close()
            fs.move(attempt, f"{root}/tokens-{shard}.bin")
            return pd.DataFrame({"shard": [shard], "docs": [len(ids)], "tokens": [int(offsets[-1])]})

        for batch in batches:
            for s, i, data in zip(batch["shard"], batch["id"].astype("Int64").fillna(NULL_ID), batch["data"]):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard, ids, sizes = int(s), [], []
                    attempt = f"{root}/tokens-{shard}.bin.{TaskContext.get().taskAttemptId()}"
                    out = fs.open_output_stream(attempt, buffer_size=1 << 20)
                out.write(data)
                ids.append(int(i))
                sizes.append(len(data) // width.itemsize)
        if shard is not None:
            yield close()

    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    encoded = rows.mapInPandas(encode, "shard int, id long, data binary")
    dealt = encoded.repartition(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first())
    # The manifest: one row per shard, whatever the number of documents.
    manifest, docs_before, tokens_before = [], 0, 0
    for r in sorted(dealt.mapInPandas(write, MANIFEST).collect()):
        manifest.append({"shard": r.shard, "docs": r.docs, "tokens": r.tokens, "doc_base": docs_before, "token_base": tokens_before})
        docs_before, tokens_before = docs_before + r.docs, tokens_before + r.tokens
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"type": width.str, "shards": manifest}).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, root = _place(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """One shard's arrays: memory-mapped on a local or mounted file system, else read whole offsets and ranged tokens."""

    def __init__(self, folder: str, shard: int, kind: str):
        fs, root = _place(folder)
        self.kind = np.dtype(kind)
        with fs.open_input_stream(f"{root}/ids-{shard}.bin") as f:
            self.ids = np.frombuffer(f.read(), "<i8")
        with fs.open_input_stream(f"{root}/offsets-{shard}.bin") as f:
            self.offsets = np.frombuffer(f.read(), "<i8")
        path = f"{root}/tokens-{shard}.bin"
        if isinstance(fs, pafs.LocalFileSystem):
            self.file = pa.memory_map(path) if self.offsets[-1] else pa.BufferReader(b"")
        else:
            self.file = fs.open_input_file(path)

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> np.ndarray:
        first, last = int(self.offsets[i]), int(self.offsets[i + 1])
        size = self.kind.itemsize
        self.file.seek(first * size)
        return np.frombuffer(self.file.read_buffer((last - first) * size), self.kind)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    manifest = read_manifest(folder)
    kind = manifest["type"]
    schema = "id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, base in zip(batch["shard"], batch["token_base"]):
                shard = Shard(folder, int(number), kind)
                for at in range(0, len(shard), 10 * ROWS_OUT):
                    part = range(at, min(at + 10 * ROWS_OUT, len(shard)))
                    ids = pd.array(shard.ids[part.start : part.stop], "Int64")
                    ids[ids == NULL_ID] = pd.NA
                    yield pd.DataFrame({
                        "id": ids, "start": base + shard.offsets[part.start : part.stop],
                        "n_tokens": np.diff(shard.offsets[part.start : part.stop + 1]),
                        "ids_crc32": [zlib.crc32(shard[i].astype("<u4").tobytes()) for i in part],
                    })

    shards = [(s["shard"], s["token_base"]) for s in manifest["shards"]]
    table = spark.createDataFrame(shards, "shard int, token_base long")
    return table.repartition(max(1, len(shards))).mapInPandas(read, schema)
