"""One JSON document a file, read by many tasks.

``json_elements`` returns the objects that stand in arrays which are values of the
root object (``{"file": [{...}, ...], ...}``, ``{"data": [{...}, ...]}``) as JSON
text with their key and place.  A file is cut into byte ranges, each from one ``}``
to another.  Whether a range starts inside a string, and how deep, depends on all
before it, so a first pass counts per range the quotes (their parity does not depend
on the start) and the change of depth for both cases; window sums over the ranges, a
few numbers each, settle the starts.  A second pass reads the elements that start
in each range, past its end where one is not complete.  A range that starts inside
an array does not know the array's key and first place; a window over the ranges'
last keys and counts fills them in.

Memory is bounded by a range and an element.  Key and place are those of the file's
text: a key that is written twice continues as a second array from place 0.  A root
that is not an object, or values that are no arrays, give no elements.  A file whose
brackets or quotes do not close raises ``ValueError``; other faults inside an element
are left to whoever parses it.  Empty files give nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwise.session import cut_lineage

RANGE_BYTES = 32 << 20
READ_ON = 1 << 20
BATCH_ROWS, BATCH_CHARS = 2000, 2 << 20  # of the elements that a task passes on at a time
_STRING = re.compile(rb'"(?:[^"\\]++|\\.)*+("?)', re.S)
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+("?)|[{}\[\]]', re.S)
_REST = re.compile(rb'(?:[^"\\]++|\\.)*+("?)', re.S)
_ESCAPED = re.compile(rb"\\.", re.S)
_COLON = re.compile(rb"\s*+:")
_SPACE = re.compile(rb"\s*+")


def _open(path: str):
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    fs, root = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(root)


def _past_brace(file, at: int, size: int) -> tuple[int, bytes]:
    """Where the bytes after the first ``}`` at or behind ``at`` start, and the bytes read up to there."""
    got = b""
    while at + len(got) < size:
        file.seek(at + len(got))
        block = file.read(min(READ_ON, size - at - len(got)))
        found = block.find(b"}")
        if found >= 0:
            got += block[: found + 1]
            return at + len(got), got
        got += block
    return size, got


def _range(file, start: int, end: int, size: int) -> tuple[bytes, int]:
    """The bytes of a range between its braces, and where they end in the file."""
    file.seek(start)
    data = file.read(end - start)
    if start:
        found = data.find(b"}")
        if found < 0:
            return b"", end
        data = data[found + 1 :]
    if end >= size:
        return data, size
    stop, tail = _past_brace(file, end, size)
    return data + tail, stop


def depth_change(data: bytes, in_string: bool) -> int:
    at = _REST.match(data).end() if in_string else 0
    bare = _STRING.sub(b"", data[at:])
    return bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def elements(data: bytes, in_string: bool, depth: int, more: Callable[[], bytes]) -> Iterator[tuple[str | None, str | None]]:
    """(key, None) and (None, element) of a range in order; ``more`` gives bytes behind the range, none at the file's end."""
    size = len(data)
    at = _REST.match(data).end() if in_string else 0
    while at < size:
        m = _TOKEN.search(data, at)
        if not m or m.start() >= size:
            return
        kind = m[0][:1]
        if kind == b'"':
            while depth == 1 and not m[1] and (block := more()):
                data += block
                m = _TOKEN.match(data, m.start())
            if depth == 1:
                while _SPACE.match(data, m.end()).end() == len(data) and (block := more()):
                    data += block
                if _COLON.match(data, m.end()):
                    yield json.loads(m[0]), None
            at = m.end()
        elif kind == b"{" and depth == 2:
            inside, at = 1, m.end()
            while inside:
                t = _TOKEN.search(data, at)
                if t is None or (t[0][:1] == b'"' and not t[1]):
                    block = more()
                    if not block:
                        raise ValueError("an object of the JSON document does not end")
                    data += block
                    continue
                inside += 1 if t[0] in (b"{", b"[") else -1 if t[0] in (b"}", b"]") else 0
                at = t.end()
            yield None, data[m.start() : at].decode("utf-8")
        else:
            depth += 1 if kind in (b"{", b"[") else -1
            at = m.end()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples():
            with _open(r.path) as file:
                data, _ = _range(file, r.start, r.stop, r.size)
            quotes = _ESCAPED.sub(b"", data).count(b'"')
            out.append((r.path, r.size, r.start, r.stop, quotes % 2, depth_change(data, False), depth_change(data, True)))
        yield pd.DataFrame(out, columns=["path", "size", "start", "stop", "odd", "outside", "inside"])


def _elements_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            with _open(r.path) as file:
                data, at = _range(file, r.start, r.stop, r.size)

                def more() -> bytes:
                    nonlocal at
                    file.seek(at)
                    block = file.read(min(READ_ON, r.size - at))
                    at += len(block)
                    return block

                key, place, rows, held = None, 0, [], 0
                for new, element in elements(data, bool(r.in_string), r.depth, more):
                    if element is None:
                        key, place = new, 0
                    else:
                        rows.append((r.path, r.start, key, place, element))
                        place += 1
                        held += len(element)
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=["path", "start", "key", "place", "element"])
                        rows, held = [], 0
                rows.append((r.path, r.start, key, place, None))  # the range's last key, elements behind it
                yield pd.DataFrame(rows, columns=["path", "start", "key", "place", "element"])


def json_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, key, place, element): the objects in the arrays of every file's root object, place from 0."""
    listing = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = listing.select("path", "size", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + range_bytes, "size"))
    n = listing.agg(F.coalesce(F.sum(F.ceil(F.col("size") / range_bytes)), F.lit(0))).first()[0]
    tasks = max(1, min(int(n), 20_000))
    schema = "path string, size long, start long, stop long, odd long, outside long, inside long"
    sums = cut_lineage(ranges.repartition(tasks).mapInPandas(_summaries, schema))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    known = known.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    ends = known.groupBy("path").agg(F.sum("change").alias("depth"), (F.sum("odd") % 2).alias("odd"))
    broken = ends.where("depth <> 0 or odd <> 0").select("path").limit(3).collect()
    if broken:
        raise ValueError(f"brackets or quotes do not close in {', '.join(r.path for r in broken)}")
    found = known.select("path", "size", "start", "stop", "in_string", "depth").repartition(tasks).mapInPandas(
        _elements_of, "path string, start long, key string, place long, element string"
    )
    found = cut_lineage(found)
    # Per range: the key that holds at its start and how many of its elements came before.
    marks = found.where("element is null").select("path", "start", "key", "place")
    upto = Window.partitionBy("path").orderBy("start")
    marks = marks.withColumn("array", F.count("key").over(upto)).withColumn("held", F.last("key", True).over(upto))
    marks = marks.withColumn("sum", F.sum("place").over(Window.partitionBy("path", "array").orderBy("start")))
    carried = marks.select("path", "start", F.lag("held").over(upto).alias("held"), F.coalesce(F.lag("sum").over(upto), F.lit(0)).alias("earlier"))
    known_key = found.where("element is not null and key is not null").select("path", "key", "place", "element")
    rest = found.where("element is not null and key is null").join(carried, ["path", "start"])
    rest = rest.select("path", F.col("held").alias("key"), (F.col("place") + F.col("earlier")).alias("place"), "element")
    return known_key.unionAll(rest.where("key is not null"))


def write_json_arrays(rows: DataFrame, key: str, path: str, per_file: int = 1000) -> None:
    """The JSON texts in column ``element`` -> files ``{key: [null, element, ...]}`` of about ``per_file`` elements each.

    The null gives every element the same leading comma, so a file is written row by row.
    """
    n = max(1, -(-rows.count() // per_file))
    numbers = rows.sparkSession.range(n).select(F.col("id").alias("file"))
    head = numbers.select("file", F.lit(0).alias("part"), F.lit("{" + json.dumps(key) + ": [null").alias("value"))
    tail = numbers.select("file", F.lit(2).alias("part"), F.lit("]}").alias("value"))
    middle = rows.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("file"), F.lit(1).alias("part"), F.concat(F.lit(", "), "element").alias("value")
    )
    lines = head.unionAll(middle).unionAll(tail).repartition("file").sortWithinPartitions("file", "part")
    lines.select("file", "value").write.partitionBy("file").text(path)
