"""Voronoi cells of a vector table and the shuffle that brings queries to them.

Shared by the exact join (``search.knn_join``) and the approximate index
(``ivf``).  The vectors of a table are dealt to the nearest of a bounded number
of pivots; *parts* of at most about ``PART_ROWS`` rows are what a task holds at a
time: neighbouring small cells together, a large cell in slices by a hash of the
keys.  A query goes once to every part that holds a cell it has to visit; the
vectors are shuffled once, and copied only for parts that more than
``QUERIES_A_TASK`` queries visit, once per so many queries.  The driver holds the
pivots and a few numbers per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 1 << 15  # vectors a task holds at a time; every query is sent once to each part that it visits
CELL_ROWS = 4096  # vectors a cell should have, as long as MAX_CELLS allows it
MAX_CELLS = 2048
QUERIES_A_TASK = 1 << 14
CHUNK = 256  # queries scored at a time
BLOCK_ROWS = 4096  # vectors they are scored against at a time


@dataclass
class Cells:
    """Pivots and, per cell, its number of rows and least and greatest distance to the pivot."""

    pivots: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self):
        between = distances(self.pivots, self.pivots)
        # Walk from pivot to nearest pivot not yet walked to, so that small cells share a part with neighbours.
        order, left = [0], np.ones(len(self.pivots), bool)
        left[0] = False
        while left.any():
            order.append(int(np.where(left, between[order[-1]], np.inf).argmin()))
            left[order[-1]] = False
        self.between = between
        self.first, self.slices = np.zeros(len(order), np.int64), np.ones(len(order), np.int64)
        part, held = 0, 0
        for cell in order:
            rows = int(self.n[cell])
            if held and held + rows > PART_ROWS:
                part, held = part + 1, 0
            self.first[cell], self.slices[cell] = part, max(1, -(-rows // PART_ROWS))
            part, held = (part + int(self.slices[cell]), 0) if rows >= PART_ROWS else (part, held + rows)

    def floors(self, d: np.ndarray) -> np.ndarray:
        """Least distance that a row of each cell can have to queries at distances ``d`` from the pivots."""
        near = d.argmin(axis=1)
        own = d[np.arange(len(d)), near][:, None]
        apart = self.between[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            side = np.where(apart > 0, (d * d - own * own) / (2 * apart), 0.0)
        return np.maximum.reduce([d - self.high, self.low - d, side, np.zeros_like(d)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def pivot_rows(rows: DataFrame, keys: tuple[str, ...], cells: int, vec_col: str = "vec") -> np.ndarray:
    """Vectors of ``cells`` rows in the order of a hash of their keys."""
    picked = rows.select(vec_col, F.xxhash64(*keys).alias("h")).orderBy("h", vec_col).limit(cells).collect()
    return np.unique(np.array([r[0] for r in picked], np.float64), axis=0)


def placed(rows: DataFrame, pivots: np.ndarray, vec_col: str = "vec") -> DataFrame:
    """``rows`` with ``cell`` (nearest pivot) and ``r`` (distance to it); rows with a null or non-finite component go."""
    dims = pivots.shape[1]
    at = rows.columns.index(vec_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at), dims)
            sound = np.isfinite(x).all(axis=1)
            x = x[sound]
            cell, r = np.zeros(len(x), np.int32), np.zeros(len(x))
            for s in range(0, len(x), CHUNK):
                d = distances(x[s : s + CHUNK], pivots)
                cell[s : s + CHUNK] = d.argmin(axis=1)
                r[s : s + CHUNK] = d.min(axis=1)
            kept = batch.filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell), pa.array(r)], schema=pa.schema(
                [*kept.schema, pa.field("cell", pa.int32()), pa.field("r", pa.float64())]))

    fields = [*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())]
    return rows.mapInArrow(place, T.StructType(fields))


def cell_facts(rows: DataFrame, pivots: np.ndarray) -> Cells:
    """Cells of placed rows; the driver gets a row per cell."""
    n, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for c in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect():
        n[c["cell"]], low[c["cell"]], high[c["cell"]] = c["n"], c["low"], c["high"]
    return Cells(pivots, n, low, high)


Reach = Callable[[np.ndarray, np.ndarray | None], np.ndarray]  # (queries, their limits) -> bool per query and cell
Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # numbers of queries and rows, values
Score = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], Found]  # (queries, their vectors, reach, limits)
Scorer = Callable[[pa.RecordBatch, np.ndarray], Score]  # (rows of a part, their cells)


class Rows:
    """Vectors in the order of their cells, in blocks for ``least``; ``at`` are their places in the part."""

    def __init__(self, x: np.ndarray, cell: np.ndarray, at: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.x, self.cell, self.at = x[order], cell[order], at[order]
        self.square = (self.x * self.x).sum(axis=1)
        self.blocks = []
        start = 0
        for end in [*(np.flatnonzero(np.diff(self.cell)) + 1).tolist(), len(cell)]:  # the ends of cells
            if self.blocks and end - self.blocks[-1][0] <= BLOCK_ROWS:
                start = self.blocks.pop()[0]  # small cells share a block
            self.blocks += [(s, min(s + BLOCK_ROWS, end)) for s in range(start, end, BLOCK_ROWS)]
            start = end
        self.held = [np.unique(self.cell[s:e]) for s, e in self.blocks]

    def least(self, q: np.ndarray, seen: np.ndarray, k: int, limit: np.ndarray, slack: float = 0.0) -> Found:
        """Per query the ``k`` least squared distances to rows of the cells it has ``seen``, with all others up to ``slack`` above them or ``limit``."""
        own, limit = (q * q).sum(axis=1), limit.copy()
        who, which, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for (s, e), held in zip(self.blocks, self.held):
            some = seen[:, held]
            asks = np.flatnonzero(some.any(axis=1))
            if not len(asks):
                continue
            near = self.square[s:e] + own[asks][:, None] - 2.0 * (q[asks] @ self.x[s:e].T)
            if not some[asks].all():
                near[~seen[asks][:, self.cell[s:e]]] = np.inf
            free = np.flatnonzero(np.isinf(limit[asks]))
            if e - s > k and len(free):
                limit[asks[free]] = np.partition(near[free], k - 1, axis=1)[:, k - 1]
            most = np.minimum(limit[asks] + slack, np.finfo(np.float64).max)
            i, j = np.nonzero(near <= most[:, None])
            if not len(i):
                continue
            who, which, value = np.append(who, asks[i]), np.append(which, j + s), np.append(value, near[i, j])
            order = np.lexsort((value, who))
            who, which, value = who[order], which[order], value[order]
            count = np.bincount(who, minlength=len(q))
            full = np.flatnonzero(count >= k)
            limit[full] = np.minimum(limit[full], value[(np.cumsum(count) - count)[full] + k - 1])
            kept = value <= (limit + slack)[who]
            who, which, value = who[kept], which[kept], value[kept]
        return who, which, value


def _routed(asked: DataFrame, cells: Cells, reach: Reach, dims: int) -> DataFrame:
    """A row of ``asked`` per part that it visits."""
    qvec, limit = asked.columns.index("qvec"), asked.columns.index("theta")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(s, CHUNK)
                seen = reach(matrix(piece.column(qvec), dims), piece.column(limit).to_numpy(zero_copy_only=False))
                who, cell = np.nonzero(seen & (cells.n > 0))
                slices = cells.slices[cell]
                who = np.repeat(who, slices)
                part = np.repeat(cells.first[cell], slices) + np.arange(len(who)) - np.repeat(np.cumsum(slices) - slices, slices)
                pairs = np.unique(np.stack([who, part]), axis=1)
                visited = piece.take(pa.array(pairs[0]))
                yield pa.RecordBatch.from_arrays([*visited.columns, pa.array(pairs[1].astype(np.int32))], schema=pa.schema(
                    [*visited.schema, pa.field("part", pa.int32())]))

    return asked.mapInArrow(route, T.StructType([*asked.schema.fields, T.StructField("part", T.IntegerType())]))


def visit(
    asked: DataFrame, rows: DataFrame, cells: Cells, reach: Reach, score: Scorer, keys: tuple[str, ...], out: str = "distance", report: dict | None = None
) -> DataFrame:
    """(qid, keys..., ``out``): what ``score`` returns for every query and part that it visits.

    ``asked`` has qid, qvec, theta (the limit handed to ``reach``) and may have
    qcat; ``rows`` are placed rows with keys, vec or code, cell, r and maybe cat.
    ``score`` gets the rows of a part once and returns what finds them for
    queries.  With ``report`` the number of visits is put into it.
    """
    dims = cells.pivots.shape[1]
    routed = _routed(asked, cells, reach, dims)
    visits = routed.groupBy("part").agg(F.count("*").alias("n"))
    if report is not None:
        report["visits"] = report.get("visits", 0) + int(visits.agg(F.sum("n")).first()[0] or 0)
    # parts with too many visitors for a task: as many copies as needed
    copies = visits.where(F.col("n") > QUERIES_A_TASK).select("part", F.ceil(F.col("n") / QUERIES_A_TASK).cast("int").alias("copies"))
    place = F.array(*[F.lit(int(x)) for x in cells.first]), F.array(*[F.lit(int(x)) for x in cells.slices])
    slice_of = F.pmod(F.xxhash64(*keys), F.get(place[1], F.col("cell"))).cast("int")
    held = rows.withColumn("part", F.get(place[0], F.col("cell")) + slice_of).join(copies, "part", "left")
    held = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    come = routed.join(copies, "part", "left")
    come = come.withColumn("copy", F.pmod(F.xxhash64("qid"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    both = held.withColumn("asks", F.lit(0)).unionByName(come.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    # a part's vectors come first, then its queries stream past them, those of a category together
    ordered = both.repartition("part", "copy").sortWithinPartitions("part", "copy", "asks", *(["qcat"] if "qcat" in asked.columns else []))
    names, kinds = ordered.columns, {f.name: f.dataType for f in ordered.schema.fields}
    schema = T.StructType([T.StructField("qid", kinds["qid"]), *[T.StructField(c, kinds[c]) for c in keys], T.StructField(out, T.DoubleType())])

    def answer(part_rows: pa.RecordBatch, found: Score, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in range(0, queries.num_rows, CHUNK):
            piece = queries.slice(s, CHUNK)
            q = matrix(piece.column("qvec"), dims)
            theta = piece.column("theta").to_numpy(zero_copy_only=False)
            who, which, value = found(piece, q, reach(q, theta), theta)
            if len(who):
                ids, which = piece.column("qid").take(pa.array(who)), pa.array(which)
                yield pa.RecordBatch.from_arrays([ids, *[part_rows.column(c).take(which) for c in keys], pa.array(value, pa.float64())], ["qid", *keys, out])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, pending, ready = None, [], None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names)
            part, copy, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "copy", "asks"))
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(copy) != 0) | (np.diff(asks) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, batch.num_rows]):
                if s == e:
                    continue
                if (part[s], copy[s]) != held_key:
                    held_key, pending, ready = (part[s], copy[s]), [], None
                if not asks[s]:
                    pending.append(batch.slice(s, e - s))
                    continue
                if ready is None and pending:
                    whole = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
                    ready, pending = (whole, score(whole, whole.column("cell").to_numpy(zero_copy_only=False))), []
                if ready is not None:
                    yield from answer(*ready, batch.slice(s, e - s))

    return ordered.mapInArrow(stream, schema)
