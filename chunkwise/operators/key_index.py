"""Keys of a growing table in buckets beside it, so that an append reads only the buckets it touches.

Next to the table at ``path`` lies ``path.keys``: its distinct keys, partitioned
by a hash of the first key column.  The number of buckets is raised fourfold
whenever they hold more than ``BUCKET_KEYS`` keys on average, so a bucket stays as large as
it is however much the table grows (a new generation is written whole and used
once it is complete).

An append is safe against failures at any point: its keys are first written as
*pending*, then the rows are appended to the table, then the keys enter their
buckets.  Pending keys found later belong to an append that did not finish; only
then the table itself is read, to see which of them arrived.  Appends run one at
a time.  A table that has no index yet gets it from its rows; one that was
changed by other means needs ``rebuild``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_KEYS = 1_000_000
FIRST_BITS = 4
PRUNED = 1000  # more touched buckets than these are not listed in a filter


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.root = f"{self.path}.keys"
        self.bits = self._generation()
        if self.bits is None or not (self.empty or self._exists(self.path)):  # no index, or of a table that is gone
            self.rebuild()
        self._settle_pending()

    # ------------------------------------------------------------- folders --

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _folders(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _generation(self) -> int | None:
        """Bits of the newest generation that was written whole."""
        whole = [int(n[1:]) for n in self._folders(self.root) if n[0] == "g" and self._exists(f"{self.root}/{n}/_SUCCESS")]
        return max(whole, default=None)

    def _table(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self._exists(self.path) else None

    def _bucket(self, bits: int):
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(1 << bits)).cast("int").alias("bucket")

    def _write(self, keys: DataFrame, bits: int, mode: str) -> int:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # by ranges: a large bucket is written by several tasks, small ones share a task
        bucketed = keys.select(*self.keys, self._bucket(bits)).repartitionByRange(parts, "bucket", *self.keys)
        bucketed.write.mode(mode).partitionBy("bucket").parquet(f"{self.root}/g{bits}")
        return bits

    # -------------------------------------------------------------- reading --

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """The keys, of all buckets or of some; unread buckets are pruned by their folders."""
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        rows = self.spark.read.schema(schema.add("bucket", T.IntegerType())).parquet(f"{self.root}/g{self.bits}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def absent(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not stored; reads the buckets that ``rows`` touch, nothing of the table."""
        if self.empty:
            return rows
        touched = rows.select(self._bucket(self.bits)).distinct().limit(PRUNED + 1).collect()
        known = self.stored([r.bucket for r in touched] if len(touched) <= PRUNED else None)
        return rows.join(known.select(*self.keys), list(self.keys), "left_anti")

    # -------------------------------------------------------------- writing --

    def append(self, rows: DataFrame) -> None:
        """Append ``rows`` (with absent, distinct keys; stored or checkpointed) to the table and their keys to the index."""
        name = f"{self.root}/pending/{uuid.uuid4().hex}"
        rows.select(*self.keys).write.parquet(name)
        rows.write.mode("append").parquet(self.path)
        self._commit(self.spark.read.parquet(name), name)

    def _commit(self, keys: DataFrame, pending: str) -> None:
        if not self._exists(f"{self.root}/schema"):
            keys.limit(0).write.mode("overwrite").parquet(f"{self.root}/schema")
        self._write(keys, self.bits, "append")
        counted = keys.agg(F.count("*").alias("n"))
        counted.coalesce(1).write.mode("append").parquet(f"{self.root}/counts")
        fs, where = self._fs(pending)
        fs.delete(where, True)
        total = self.spark.read.parquet(f"{self.root}/counts").agg(F.sum("n")).first()[0]
        bits = self._bits_for(total, self.bits)
        if bits > self.bits:
            self.bits = self._write(self.stored().select(*self.keys).distinct(), bits, "overwrite")

    @staticmethod
    def _bits_for(total: int, bits: int) -> int:
        while total > BUCKET_KEYS << bits:
            bits += 2
        return bits

    def _settle_pending(self) -> None:
        for name in self._folders(f"{self.root}/pending"):
            path = f"{self.root}/pending/{name}"
            table = self._table()
            keys = self.spark.read.parquet(path) if self._exists(f"{path}/_SUCCESS") else None
            if keys is not None and table is not None:
                arrived = self.absent(keys.join(table.select(*self.keys), list(self.keys), "left_semi"))
                self._commit(arrived.checkpoint(eager=True), path)
            else:  # it stopped before any row was appended
                fs, where = self._fs(path)
                fs.delete(where, True)

    def rebuild(self) -> None:
        """The index anew from the table's rows."""
        table = self._table()
        fs, where = self._fs(self.root)
        fs.delete(where, True)
        if table is None:
            self.bits = FIRST_BITS
            self._mark_empty()
            return
        keys = table.select(*self.keys).distinct()
        total = keys.count()
        keys.limit(0).write.parquet(f"{self.root}/schema")
        self.spark.createDataFrame([(total,)], "n long").coalesce(1).write.parquet(f"{self.root}/counts")
        self.bits = self._write(keys, self._bits_for(total, FIRST_BITS), "overwrite")

    def _mark_empty(self) -> None:
        """A first generation without keys; the schema follows with the first append."""
        fs, where = self._fs(f"{self.root}/g{self.bits}/_SUCCESS")
        fs.create(where).close()

    @property
    def empty(self) -> bool:
        return not self._exists(f"{self.root}/schema")
