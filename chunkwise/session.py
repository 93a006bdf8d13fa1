"""Session helpers.

The library never creates a session behind a caller's back: operators use the
session of their input DataFrame.  ``get_spark`` exists for tests, the bench
and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "chunkwise") -> SparkSession:
    """Local/test session with AQE on and the UI off."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("CHUNKWISE_MASTER", "local[*]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHUNKWISE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Only when it is unset (local tests) a scratch folder is created and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="chunkwise-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Explicit number of partitions for CPU-heavy per-row work on the input texts; unset: dealt where the files are too few.
INPUT_PARTITIONS = "chunkwise.input.partitions"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to the number of partitions that the session asks for, or as the scan split it.

    A file may be a single row group, which one task reads whatever its size;
    a table of fewer files than the cluster has cores is therefore dealt anew.
    """
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    if n:
        return df.repartition(int(n))
    few = len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*df.columns) if few else df
