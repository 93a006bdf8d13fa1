"""Centroid clustering (Lloyd's rounds on integer vectors) over Hilbert-ordered zone maps.

Vectors become integers, ``floor(SCALE * x)``, and are written once as blocks of
``BLOCK`` neighbours along a Hilbert curve, each with its zone map: the least and
greatest value per component.  The curve runs through the ``CURVE_DIMS``
components of greatest variance with ``CURVE_BITS`` bits each; ranges of the curve
(and of the ids, so that equal vectors spread) are the partitions.

Every round reads the blocks.  A block's reference is the centroid nearest to the
middle of its box.  ``distance(x, c) - distance(x, reference)`` is linear in
``x``, so its least value over the box is exact and cheap; a centroid for which
that is above 0 is farther than the reference for all of the block, and drops
out.  The vectors meet the candidates that are left in one exact matrix product
per block.  Tasks send sums per centroid only; the driver holds the centroids.

Kept are vectors with exactly ``dims`` components, none null or non-finite; also
left out is a vector with a component beyond +-``LIMIT`` after scaling, whose
squared distances would not fit a long.  Repeated rows are vectors of their own
(equal ids of first centroids are ordered by their components, null ids come
last).  Fewer than ``k`` kept vectors make as many centroids; none, or an empty
table, an empty result.  Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.storage import stored

SCALE = 256
LIMIT = 1 << 27
FLOAT_LIMIT = 1 << 22  # up to here 64-bit floats hold every sum of up to 512 products
BLOCK = 64
CURVE_DIMS, CURVE_BITS = 15, 4


# ------------------------------------------------------------ the curve ------


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``grid`` (values of ``bits`` bits, bits x columns under 64)."""
    x = [grid[:, i].astype(np.int64) for i in range(grid.shape[1])]
    # Undo the curve's turns from the top bit down: an upper half flips the first axis, a lower one swaps.
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(len(x)):
            upper = (x[i] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(upper, below, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):  # Gray code across the axes
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(grid), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(grid), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def _curve(values: np.ndarray, dims: list[int], low: list[float], width: list[float]) -> np.ndarray:
    cells = 1 << CURVE_BITS
    scaled = (values[:, dims] - np.array(low)) / np.array(width) * cells
    return hilbert_keys(np.clip(np.floor(scaled), 0, cells - 1).astype(np.int64), CURVE_BITS)


# ------------------------------------------------------------ the blocks -----


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v): the kept vectors as integers."""
    v = F.col(vec_col)
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), scaled.alias("v"))
    near = F.forall("v", lambda x: F.abs(x) <= LIMIT)
    return rows.where(near).select("id", F.transform("v", lambda x: x.cast("int")).alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def zone_blocks(ints: DataFrame, dims: int) -> DataFrame:
    """(ids, v, low, high): stored blocks of vectors along the curve with their boxes (32-bit integers)."""
    facts = ints.agg(*[f(F.get("v", i)).alias(f"{n}{i}") for i in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    spread = [facts[f"s{i}"] or 0.0 for i in range(dims)]
    widest = sorted(sorted(range(dims), key=lambda i: -spread[i])[:CURVE_DIMS])
    low = [(facts[f"m{i}"] or 0.0) - 2 * spread[i] for i in widest]
    width = [max(4 * spread[i], 1.0) for i in widest]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dims).astype("<i4")
            raw = pa.array([row.tobytes() for row in v], pa.binary())
            key = pa.array(_curve(v, widest, low, width), pa.int64())
            yield pa.RecordBatch.from_arrays([key, batch.column("id"), raw], ["key", "id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, dims)
            starts = np.arange(0, len(v), BLOCK)
            low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
            ids = pa.ListArray.from_arrays(pa.array([*starts, len(v)], pa.int32()), batch.column("id"))
            raw = lambda parts: pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, raw(v[s : s + BLOCK] for s in starts), raw(low), raw(high)], ["ids", "v", "low", "high"])

    kind = ints.schema["id"].dataType.simpleString()
    keyed = ints.mapInArrow(place, f"key long, id {kind}, v binary")
    parts = int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").select("id", "v")
    return stored(ordered.mapInArrow(cut, f"ids array<{kind}>, v binary, low binary, high binary"), "zones")


# ----------------------------------------------------------- assignments -----


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be the nearest one somewhere in each box: a boolean row per box."""
    middle = (low + high) / 2.0
    c = centroids.astype(np.float64)
    square = (centroids * centroids).sum(axis=1)
    reference = ((middle * middle).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * middle @ c.T).argmin(axis=1)
    out = np.empty((len(low), len(centroids)), bool)
    for r in np.unique(reference):
        boxes = reference == r
        apart = centroids - centroids[r]
        # greatest x . apart over the box: the higher corner where apart is positive
        reach = high[boxes] @ np.maximum(apart, 0).T + low[boxes] @ np.minimum(apart, 0).T
        out[boxes] = square - square[r] - 2 * reach <= 0
    return out


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``centroids``, squared distance) of each vector's nearest centroid, the first of equal ones; exact."""
    if max(np.abs(v).max(), np.abs(centroids).max()) <= FLOAT_LIMIT and v.shape[1] <= 512:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)
    else:
        d = np.stack([((v - one) ** 2).sum(axis=1) for one in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(v)), best].astype(np.int64)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(block of the batch, vectors, cluster, distance, number of candidates)."""
    dims = centroids.shape[1]
    boxes = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64) for c in ("low", "high")]
    possible = candidates(*boxes, centroids)
    for i, raw in enumerate(batch.column("v").to_pylist()):
        v = np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)
        numbers = np.flatnonzero(possible[i])
        best, distance = nearest(v, centroids[numbers])
        yield i, v, numbers[best], distance, len(numbers)


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the means of their vectors; empty ones stay."""
    k, dims = centroids.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, v, cluster, _, _ in _assigned(batch, centroids):
                    n += np.bincount(cluster, minlength=k)
                    np.add.at(sums, cluster, v)
        used = np.flatnonzero(n)
        total = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * dims, pa.int32()), pa.array(sums[used].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64()), total], ["cluster", "n", "sums"])

    parts = blocks.select("v", "low", "high").mapInArrow(gather, "cluster long, n long, sums array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in whole.collect():  # one row per centroid
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return out


def first_centroids(ints: DataFrame, k: int, order: Column) -> np.ndarray:
    """The ``k`` first vectors by ``order`` (nulls last), ties by their components."""
    rows = ints.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: str = "2"
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, candidates), centroids) after ``rounds`` rounds and a last assignment.

    First centroids are the ``k`` vectors with the smallest sha256 of
    ``seed:id``.  ``candidates`` is the number of centroids that the vector's
    block was compared with.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance long, candidates int"
    ints = integer_vectors(vectors, id_col, vec_col, dims)
    spark = vectors.sparkSession
    centroids = first_centroids(ints, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    if not len(centroids):
        return spark.createDataFrame([], schema), np.zeros((0, dims), np.int64)
    blocks = zone_blocks(ints, dims)
    for _ in range(rounds):
        centroids = _round(blocks, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(_assigned(batch, centroids))
                cluster, distance = (np.concatenate([f[j] for f in found]) for j in (2, 3))
                seen = np.repeat([f[4] for f in found], [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").flatten(), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(seen, pa.int32())],
                    [id_col, "cluster", "distance", "candidates"])

    return stored(blocks.mapInArrow(assign, schema), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row per centroid
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    rows = [(c, s, sum(sums.values()), sha[c]) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")  # a row per centroid, whatever the data
