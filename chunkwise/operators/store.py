"""The chunk and product stores: idempotent appends and schema migrations.

Insert-if-absent: within a batch the first row per key (by an explicit stable
order) wins; rows whose key is already stored are skipped, never updated.
The anti-join runs before embedding, so no row is embedded twice, and a
re-run or a replayed streaming batch appends nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.operators.categorize import UNCATEGORIZED
from chunkwise.operators.key_index import KeyIndex
from chunkwise.session import cut_lineage

PRODUCT_KEY = ("product_id",)
CHUNK_KEY = ("document_name", "chunk_id")

STAGE1_TO_STAGE2 = {"id": "contract_id", "file_name": "document_name", "chunk_index": "chunk_id", "content": "text"}


def first_per_key(batch: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order`` (then by the row's values, so the pick is total).

    A ``min`` over a struct is combined map-side before the shuffle, so a key
    repeated across a large share of the batch never lands whole in one task.
    """
    rest = [c for c in batch.columns if c not in keys]
    ords = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    packed = F.struct(*ords, *[F.col(f"`{c}`") for c in rest])
    best = batch.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*batch.columns)


def new_rows(batch: DataFrame, target: DataFrame | None, keys: tuple[str, ...], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target`` (first per key inside the batch)."""
    rows = first_per_key(batch, keys, order) if order is not None else batch.dropDuplicates(list(keys))
    if target is None:
        return rows
    return rows.join(target.select(*keys), list(keys), "left_anti")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when it does not exist yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return None
    return spark.read.parquet(path)


def append_if_absent(
    batch: DataFrame,
    path: str,
    keys: tuple[str, ...],
    order: list[Column] | None = None,
    embed_fn=None,
) -> int:
    """Append the absent rows of ``batch`` to the parquet table at ``path``; returns rows appended.

    ``embed_fn(df) -> df`` runs on the absent rows only.  Which keys are stored
    is read from the buckets of the table's key index that the batch touches
    (``key_index``), not from the table; appends run one at a time.  The new
    rows are checkpointed before the write.
    """
    spark = batch.sparkSession
    index = KeyIndex(spark, path, keys)
    rows = first_per_key(batch, keys, order) if order is not None else batch.dropDuplicates(list(keys))
    fresh = index.absent(cut_lineage(rows))
    if embed_fn is not None:
        fresh = embed_fn(fresh)
    fresh = cut_lineage(fresh)
    n = fresh.count()
    if n:
        target = read_store(spark, path)
        index.append(fresh.select(*(target.columns if target is not None else fresh.columns)))
    return n


def contract_key(doc: Column, chunk_id: Column) -> Column:
    """Surrogate ``contract_id``: 60 bits of md5(document_name '#' chunk_id), stable across runs."""
    return F.conv(F.substring(F.md5(F.concat(doc, F.lit("#"), chunk_id.cast("string"))), 1, 15), 16, 10).cast("long")


def sql_contract_key(doc: str, chunk_id: str) -> str:
    return f"CAST(('0x' || substring(md5(concat({doc}, '#', CAST({chunk_id} AS VARCHAR))), 1, 15)) AS BIGINT)"


def migrate_up(table: DataFrame) -> DataFrame:
    """Stage 1 -> 2: rename columns, add ``category`` (default ['Uncategorized']) and ``page`` (NULL).

    A table without ``file_name`` is already Stage 2 and is returned unchanged.
    """
    if "file_name" not in table.columns:
        return table
    out = table.withColumnsRenamed({k: v for k, v in STAGE1_TO_STAGE2.items() if k in table.columns})
    if "category" not in out.columns:
        out = out.withColumn("category", F.array(F.lit(UNCATEGORIZED)))
    if "page" not in out.columns:
        out = out.withColumn("page", F.lit(None).cast("int"))
    return out


def migrate_down(table: DataFrame) -> DataFrame:
    """Stage 2 -> 1: drop ``page`` and ``category``, rename back; rows are kept."""
    out = table.drop("page", "category")
    back = {v: k for k, v in STAGE1_TO_STAGE2.items() if v in out.columns}
    return out.withColumnsRenamed(back)


def table_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Schema probe: which stored tables exist and which columns they have."""
    rows = []
    for name, path in paths.items():
        df = read_store(spark, path)
        rows.append((name, df is not None, ",".join(df.columns) if df is not None else None))
    return spark.createDataFrame(rows, "table string, exists boolean, columns string")
