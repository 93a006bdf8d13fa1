"""Corpus statistics over the chunk table (lateral unnest of the category array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest_categories(chunks: DataFrame, col: str = "category") -> DataFrame:
    """``FROM chunks, unnest(category) AS cat`` -> one row per (chunk, category)."""
    return chunks.select(F.explode(F.col(col)).alias("cat"))


def category_list(chunks: DataFrame) -> DataFrame:
    """Distinct non-empty categories, sorted (partial + final aggregate)."""
    cats = unnest_categories(chunks)
    return (
        cats.filter(F.col("cat").isNotNull() & (F.col("cat") != ""))
        .distinct()
        .withColumnRenamed("cat", "category")
        .orderBy("category")
    )


def category_histogram(chunks: DataFrame, top: int | None = 10) -> DataFrame:
    """(category, n) by count descending, ties by name; the ``top`` largest only."""
    hist = unnest_categories(chunks).groupBy("cat").agg(F.count("*").alias("n"))
    ordered = hist.orderBy(F.col("n").desc(), F.col("cat").asc())
    if top is not None:
        ordered = ordered.limit(top)
    return ordered.withColumnRenamed("cat", "category")


def corpus_status(products: DataFrame | None, chunks: DataFrame | None, top: int = 10) -> DataFrame:
    """One status row: table presence, row counts, distinct categories, top categories.

    Status is ``offline`` when either table is missing (counts are then 0 and
    the category keys are NULL), as in the reference's status probe.  Counts
    and the top-k list come from one aggregate over a tagged union; the top-k
    list holds at most ``top`` rows.
    """
    present = products if products is not None else chunks
    top_type = "array<struct<category:string,count:long>>"
    if products is None or chunks is None:
        spark = present.sparkSession if present is not None else None
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.getActiveSession()
        return spark.createDataFrame(
            [("offline", False, 0, 0, None, None)],
            "status string, tables_initialized boolean, product_count long, contract_count long, "
            f"category_count long, top_categories {top_type}",
        )
    empty_cat = F.lit(None).cast("string")
    empty_n = F.lit(None).cast("long")
    rows = products.select(F.lit(0).alias("kind"), empty_cat.alias("cat"), empty_n.alias("n")).unionByName(
        chunks.select(F.lit(1).alias("kind"), empty_cat.alias("cat"), empty_n.alias("n"))
    )
    has_category = "category" in chunks.columns
    if has_category:
        hist = unnest_categories(chunks).groupBy("cat").agg(F.count("*").alias("n"))
        best = hist.orderBy(F.col("n").desc(), F.col("cat").asc()).limit(top)
        rows = rows.unionByName(hist.select(F.lit(2).alias("kind"), "cat", "n")).unionByName(
            best.select(F.lit(3).alias("kind"), "cat", "n")
        )
    kind = F.col("kind")
    ordered = F.array_sort(
        F.collect_list(F.when(kind == 3, F.struct((-F.col("n")).alias("neg_n"), F.col("cat").alias("cat"))))
    )
    return rows.agg(
        F.count_if(kind == 0).alias("product_count"),
        F.count_if(kind == 1).alias("contract_count"),
        F.count_if((kind == 2) & F.col("cat").isNotNull()).alias("category_count"),
        F.transform(ordered, lambda s: F.struct(s["cat"].alias("category"), (-s["neg_n"]).alias("count"))).alias(
            "top_categories"
        ),
    ).select(
        F.lit("online").alias("status"),
        F.lit(True).alias("tables_initialized"),
        "product_count",
        "contract_count",
        (F.col("category_count") if has_category else F.lit(0).cast("long")).alias("category_count"),
        (F.col("top_categories") if has_category else F.lit(None).cast(top_type)).alias("top_categories"),
    )


SKETCH_BITS = 14  # registers of a sketch: 2^14, a standard error of 0.8 %


def distinct_sketches(rows: DataFrame, **columns) -> DataFrame:
    """One row about an append: its number of rows and a mergeable distinct-count sketch per named column.

    An array column counts its elements.  Sketches have a fixed size whatever
    the rows and are combined map-side.
    """
    aggregates = [F.count("*").alias("n_rows")]
    for name, column in columns.items():
        arrays = rows.select(column.alias("c")).schema["c"].dataType.typeName() == "array"
        flat = rows.select(F.explode(column).alias("c")) if arrays else rows.select(column.alias("c"))
        aggregates.append((name, flat))
    out = rows.agg(aggregates[0])
    for name, flat in aggregates[1:]:
        one = flat.agg(F.hll_sketch_agg("c", SKETCH_BITS).alias(name))
        out = out.withColumn("k", F.lit(0)).join(F.broadcast(one.withColumn("k", F.lit(0))), "k").drop("k")  # one row each
    return out


def append_sketches(rows: DataFrame, path: str, ingest: str, **columns) -> None:
    """Store the sketches of one append beside the table it went to; the same ``ingest`` again replaces its row."""
    distinct_sketches(rows, **columns).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/ingest={ingest}")


def distinct_across_ingests(sketches: DataFrame, *names: str) -> DataFrame:
    """One row: rows of all appends and, per sketch, the estimated number of distinct values over all of them.

    Reads the sketches only, never the appended rows.
    """
    estimates = [F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names]
    return sketches.agg(F.count("*").alias("ingests"), F.sum("n_rows").alias("n_rows"), *estimates)
