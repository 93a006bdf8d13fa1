"""Exact order statistics of groups of numbers, whatever their size.

A number is found by its rank, ``DIGIT`` bits at a time from the top: each round
counts the next bits of those numbers that share the bits found so far.  What
reaches the driver is at most ``2 ** DIGIT`` counts a round and wanted number;
no group is sorted or held by one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 11


def order_keys(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def key_values(keys: np.ndarray) -> np.ndarray:
    """The doubles of ``order_keys``."""
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def order_statistics(rows: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The number at each (group, rank from 0) of ``rows`` (group int, key long: see ``order_keys``), which should be stored."""
    found = {w: (0, w[1]) for w in set(wanted)}  # bits so far, rank among the numbers that have them
    place = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    left = 64
    while left and found:
        known, left = left, max(left - DIGIT, 0)
        prefix = F.lit(0).cast("long") if known == 64 else F.shiftrightunsigned(place, known)
        digit = F.shiftrightunsigned(place, left).bitwiseAND(F.lit((1 << (known - left)) - 1))
        asked = rows.sparkSession.createDataFrame(sorted({(g, bits) for (g, _), (bits, _) in found.items()}), "group int, bits long")
        counts = (
            rows.select("group", prefix.alias("bits"), digit.alias("digit"))
            .join(F.broadcast(asked), ["group", "bits"]).groupBy("group", "bits", "digit").count().collect()
        )
        table: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in counts:
            table.setdefault((r["group"], r["bits"]), []).append((r["digit"], r["count"]))
        for (group, rank), (bits, rest) in found.items():
            for number, n in sorted(table[group, bits]):
                if rest < n:
                    break
                rest -= n
            found[group, rank] = ((bits << (known - left)) | number, rest)
    return {w: float(key_values(np.array([bits - (1 << 63)], np.int64))[0]) for w, (bits, _) in found.items()}


def quantiles(rows: DataFrame, shares: list[float]) -> dict[int, list[float]]:
    """Per group of ``rows`` (group int, key long) the quantiles of its numbers, between two of them in proportion."""
    sizes = {r["group"]: r["count"] for r in rows.groupBy("group").count().collect()}
    places = {g: [(n - 1) * s for s in shares] for g, n in sizes.items()}
    ends = [(g, int(end)) for g, at in places.items() for p in at for end in (np.floor(p), np.ceil(p))]
    values = order_statistics(rows, ends)
    return {
        g: [values[g, int(np.floor(p))] + (values[g, int(np.ceil(p))] - values[g, int(np.floor(p))]) * (p - np.floor(p)) for p in at]
        for g, at in places.items()
    }
