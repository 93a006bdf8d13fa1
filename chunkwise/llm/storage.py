"""Shared storage for intermediate tables and files of the llm operators.

Everything goes below ``spark.checkpoint.dir``; only a local session that has
not set it gets a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_WORDS = 1 << 18  # 64-bit words of a key filter: 2 MB whatever the data


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder as a URI; raises on a cluster that names none."""
    from chunkwise.session import checkpoint_dir

    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark).rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/llm-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write as Parquet into shared storage and read back: cuts lineage, keeps column pruning."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_filter(keys: DataFrame) -> bytes:
    """Fixed-size bit filter (2 MB) over the only column of ``keys`` (64-bit hashes).

    Each key sets one bit of ``FILTER_WORDS`` x 64.  The bits are or-ed by an
    aggregate whose groups are the filter's words, so what reaches the driver
    is at most the filter itself.  A key that was added always passes
    ``passes``; others pass by chance and have to be joined away.
    """
    import numpy as np

    key = F.col(keys.columns[0])
    bit = F.shiftright(key, 18).bitwiseAND(F.lit(63)).cast("int")
    words = (
        keys.select(key.bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int").alias("word"), F.expr("1L").alias("one"), bit.alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits"))
    )
    out = np.zeros(FILTER_WORDS, np.int64)
    table = words.toPandas()
    out[table["word"].to_numpy(dtype=np.int64)] = table["bits"].to_numpy(dtype=np.int64)
    return out.tobytes()


def passes(bits, keys):
    """Boolean array: which of the unsigned 64-bit ``keys`` may have been added."""
    import numpy as np

    word = bits[(keys & np.uint64(FILTER_WORDS - 1)).astype(np.int64)]
    return (word >> ((keys >> np.uint64(18)) & np.uint64(63))) & np.uint64(1) != 0


def load_filter(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, np.uint64)
