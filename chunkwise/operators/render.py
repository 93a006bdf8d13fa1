"""Rendering of retrieved rows into the context strings handed to an answer model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_SEPARATOR = "\n\n"
CALL_SEPARATOR = "\n\n---\n\n"


def contract_row_text() -> Column:
    """``# {doc} (chunk {i}, page {page or 'N/A'}) [Categories: a, b]\\n{text}\\n``."""
    page = F.when(F.coalesce(F.col("page"), F.lit(0)) == 0, F.lit("N/A")).otherwise(F.col("page").cast("string"))
    return F.concat(
        F.lit("# "), F.col("document_name"),
        F.lit(" (chunk "), F.col("chunk_id").cast("string"),
        F.lit(", page "), page,
        F.lit(") [Categories: "), F.array_join(F.coalesce(F.col("category"), F.array().cast("array<string>")), ", "),
        F.lit("]\n"), F.col("text"), F.lit("\n"),
    )


def product_row_text() -> Column:
    """``# {id}\\nProduct Details:{name}\\n\\n{description}\\n``."""
    return F.concat(
        F.lit("# "), F.col("product_id").cast("string"),
        F.lit("\nProduct Details:"), F.col("product_name"),
        F.lit("\n\n"), F.col("description"), F.lit("\n"),
    )


def ordered_concat(df: DataFrame, group_cols: list[str], order_col: str, text: Column, sep: str, out: str) -> DataFrame:
    """Per group, the texts joined by ``sep`` in ``order_col`` order (groups are top-k sized)."""
    return df.groupBy(*group_cols).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), text.alias("t")))),
                        lambda s: s["t"]),
            sep,
        ).alias(out),
        F.count("*").alias("n_rows"),
    )


def render_context(retrieved: DataFrame, kind: str = "contracts", group_cols: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(group..., context, n_rows) from ranked rows (needs ``rank``)."""
    text = contract_row_text() if kind == "contracts" else product_row_text()
    return ordered_concat(retrieved, list(group_cols), "rank", text, CONTEXT_SEPARATOR, "context")
