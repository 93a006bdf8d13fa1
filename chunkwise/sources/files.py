"""File sources and sinks: product CSV, text corpora, annotation JSON, QA JSON, snapshots."""

from __future__ import annotations

import json
import logging
import os
import re
import uuid
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.session import cut_lineage
from chunkwise.sources.json_elements import RANGE_BYTES, json_elements

# The catalogue CSV header.
PRODUCT_CSV_SCHEMA = T.StructType([
    T.StructField("ProductID", T.IntegerType()),
    T.StructField("ProductName", T.StringType()),
    T.StructField("ProductBrand", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Price (INR)", T.DoubleType()),
    T.StructField("NumImages", T.IntegerType()),
    T.StructField("Description", T.StringType()),
    T.StructField("PrimaryColor", T.StringType()),
])

SPLITS_A_TASK, BYTES_A_TASK = 64, 64 << 20  # most that a task reads of a text corpus in a store that only Spark reads
LOT_FILES, LOT_BYTES, LOTS_A_TASK = 256, 4 << 20, 16  # files that leave a task together, a larger one alone; lots a task
# what java.net.URI quotes in a path, as _metadata.file_name shows it
QUOTED = "[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

ANNOTATION_STRUCT = "array<struct<category:string,start_char:int,end_char:int,text:string>>"


# ------------------------------------------------------------------ S1 -----


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV -> store schema; a malformed number aborts the read (FAILFAST)."""
    raw = (
        spark.read.schema(PRODUCT_CSV_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return raw.select(
        F.col("ProductID").alias("product_id"),
        F.col("ProductName").alias("product_name"),
        F.col("ProductBrand").alias("product_brand"),
        F.col("Gender").alias("gender"),
        F.col("`Price (INR)`").cast("decimal(10,2)").alias("price_inr"),
        F.col("NumImages").alias("num_images"),
        F.col("Description").alias("description"),
        F.col("PrimaryColor").alias("primary_color"),
    )


def write_products_csv(products: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store-schema products -> catalogue CSV with the reference header."""
    out = products.select(
        F.col("product_id").alias("ProductID"),
        F.col("product_name").alias("ProductName"),
        F.col("product_brand").alias("ProductBrand"),
        F.col("gender").alias("Gender"),
        F.col("price_inr").cast("double").alias("Price (INR)"),
        F.col("num_images").alias("NumImages"),
        F.col("description").alias("Description"),
        F.col("primary_color").alias("PrimaryColor"),
    )
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


# ------------------------------------------------------------------ S2 -----


def read_text_corpus(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """One row per ``*.txt`` file of ``directory`` (not recursive, empty files left out): (document_name, text).

    The files are those of the folder now; tasks list and read them, the driver
    holds none of their names.  Only of a store that pyarrow does not open,
    Spark's reader lists the files on the driver.

    ``\\r\\n`` and ``\\r`` become ``\\n`` (Python text mode does the same, and
    every offset depends on it).  A missing directory raises.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"corpus directory not found: {directory}")
    where = fs.makeQualified(jvm_path)
    where = where.toUri().getPath() if where.toUri().getScheme() == "file" else where.toString()
    raw = _listed_texts(spark, where, glob) if _opened_by_pyarrow(where) else _scanned_texts(spark, directory, glob)
    return raw.select(
        "document_name",
        F.regexp_replace(F.col("value"), "\r\n?", "\n").alias("text"),
    )


def _scanned_texts(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", glob).text(directory, wholetext=True)
    # Spark adds spark.sql.files.openCostInBytes to every file, so that a split holds a handful of small ones
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    raw = raw.coalesce(max(spark.sparkContext.defaultParallelism, -(-raw.rdd.getNumPartitions() // SPLITS_A_TASK), -(-size // BYTES_A_TASK)))
    return raw.select(F.col("_metadata.file_name").alias("document_name"), "value")


def _listed_texts(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """The files' texts, read by tasks from a stored listing that one task wrote."""
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()  # as pathGlobFilter has it
    lots = cut_lineage(spark.range(0, 1, 1, 1).mapInArrow(_lots_fn(directory, pattern), "names array<string>"))
    n = lots.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // LOTS_A_TASK))
    return lots.repartition(max(1, min(n, tasks))).mapInArrow(_texts_fn(directory), "document_name string, content binary").select(
        "document_name", F.col("content").cast("string").alias("value")
    )


def _opened_by_pyarrow(directory: str) -> bool:
    from pyarrow import fs as pafs

    try:
        fs, root = _fs_and_root(directory)
        return fs.get_file_info(root).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException):  # a scheme it does not know, a client library that is not there
        return False


def _files_of(directory: str):
    """(name, bytes) of the files of a folder; a local one is never held as a whole."""
    from pyarrow import fs as pafs

    fs, root = _fs_and_root(directory)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(root) as entries:
            yield from ((e.name, e.stat().st_size) for e in entries if e.is_file())
    else:
        yield from ((i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File)


def _lots_fn(directory: str, pattern: str):
    def lots(batches):
        wanted, names, held = re.compile(pattern, re.S), [], 0
        passed_on = lambda: pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], ["names"])
        for _ in batches:
            for name, size in _files_of(directory):
                hidden = name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")
                if hidden or not size or not wanted.fullmatch(name):  # as Spark's file sources do
                    continue
                if names and (len(names) == LOT_FILES or held + size > LOT_BYTES):
                    yield passed_on()
                    names, held = [], 0
                names.append(name)
                held += size
        if names:
            yield passed_on()

    return lots


def _texts_fn(directory: str):
    def texts(batches):
        fs, root = _fs_and_root(directory)
        quoted = re.compile(QUOTED)
        for batch in batches:
            for names in batch.column(0).to_pylist():
                contents = []
                for name in names:
                    with fs.open_input_stream(f"{root}/{name}") as file:
                        contents.append(file.read())
                names = [quoted.sub(lambda m: quote(m[0], safe=""), n) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["document_name", "content"])

    return texts


def invalid_utf8_count(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """Files whose bytes are not valid UTF-8 (the reference would raise on them)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return raw.select(F.count_if(~F.is_valid_utf8(F.col("content").cast("string"))).alias("invalid_files"))


# ------------------------------------------------------------------ S5 -----


def _fs_and_root(directory: str):
    """A pyarrow filesystem for the folder URI (local path, file://, hdfs://, s3://, gs://...)."""
    from pyarrow import fs as pafs

    if "://" not in directory:
        return pafs.LocalFileSystem(), os.path.abspath(directory)
    return pafs.FileSystem.from_uri(directory)


def _write_files_fn(directory: str):
    def write(batches):
        fs, root = _fs_and_root(directory)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            sizes = []
            for name, text in zip(pdf["file_name"].tolist(), pdf["text"].tolist()):
                target = f"{root}/{name}"
                tmp = f"{target}.{TaskContext.get().taskAttemptId()}.part"
                with fs.open_output_stream(tmp) as out:
                    out.write((text or "").encode("utf-8"))
                fs.move(tmp, target)  # a retried task rewrites the same file
                sizes.append(len(text or ""))
            if sizes:
                yield pd.DataFrame({"file_name": pdf["file_name"], "n_chars": sizes})

    return write


def materialize_corpus(docs: DataFrame, directory: str, name_col: str = "file_name", replace: bool = False) -> int:
    """Write each row's ``text`` to ``directory/<name with .pdf -> .txt>``; returns files written.

    Names that the folder already holds are left out (an anti-join with its
    listing), so a half-finished run is completed; ``replace`` writes them anew.
    Tasks write straight into the shared folder through pyarrow's filesystems
    (local, HDFS, object stores) under a temporary name that is then moved.
    """
    from pyarrow import fs as pafs

    rows = docs.select(F.replace(F.col(name_col), F.lit(".pdf"), F.lit(".txt")).alias("file_name"), "text")
    fs, root = _fs_and_root(directory)
    if not replace and fs.get_file_info(root).type == pafs.FileType.Directory:
        listing = docs.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(directory)
        rows = rows.join(listing.select(F.col("_metadata.file_name").alias("file_name")), "file_name", "left_anti")
    out = rows.mapInPandas(_write_files_fn(directory), "file_name string, n_chars long")
    return int(out.agg(F.count("*")).first()[0])


# ------------------------------------------------------------------ S3 -----


def read_annotations(spark: SparkSession, path: str, on_missing: str = "empty", range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """Annotation file ``{file: [{category, start_char, end_char, text?}, ...]}`` -> span rows.

    ``path`` is such a file or a folder of them; each is read in ranges by many tasks.
    ``on_missing='empty'`` returns None for a missing file (ingestion then marks
    every chunk Uncategorized); ``'error'`` raises.  A missing ``text`` is ``''``.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        if on_missing == "error":
            raise FileNotFoundError(path)
        return None
    found = json_elements(spark, path, range_bytes)
    spans = found.select(
        F.col("key").alias("document_name"),
        F.col("place").cast("int").alias("ann_pos"),
        F.from_json("element", ANNOTATION_STRUCT[len("array<"):-1]).alias("a"),
    )
    return spans.select(
        "document_name",
        "ann_pos",
        F.col("a.category").alias("category"),
        F.col("a.start_char").alias("start_char"),
        F.col("a.end_char").alias("end_char"),
        F.coalesce(F.col("a.text"), F.lit("")).alias("text"),
    )


def write_annotation_map(spans: DataFrame, directory: str) -> str:
    """Span rows -> a new folder below ``directory`` (returned) of ``{file: [span, ...], ...}`` documents, one per task.

    Rows are ordered by document and start over all files, so a document with very
    many spans is spread over several; tasks write as the rows come.
    """
    folder = f"{directory.rstrip('/')}/{uuid.uuid4().hex}"
    order = ("document_name", "start_char", "end_char", "category")
    lines = spans.select(*order, F.to_json(F.struct("category", "start_char", "end_char", "text")).alias("span"))
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("document_name", "span")

    def write(batches):
        fs, root = _fs_and_root(folder)
        fs.create_dir(root, recursive=True)
        target = f"{root}/part-{TaskContext.get().partitionId():05}.json"
        tmp = f"{root}/_{TaskContext.get().taskAttemptId()}.part"
        last, n = None, 0
        with fs.open_output_stream(tmp) as out:
            out.write(b"{")
            for pdf in batches:
                for name, span in zip(pdf["document_name"].tolist(), pdf["span"].tolist()):
                    lead = ",\n" if name == last else ("" if last is None else "],\n") + json.dumps(name) + ": ["
                    out.write((lead + span).encode("utf-8"))
                    last, n = name, n + 1
            out.write(b"]}" if last is not None else b"}")
        fs.move(tmp, target)
        yield pd.DataFrame({"n": [n]})

    lines.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def write_annotations(spans: DataFrame, path: str, mode: str = "overwrite", window: int = 4000) -> None:
    """Span rows -> JSON lines of (``document_name``, ``annotations``).

    One line per document and ``window``-character range of span starts, so a
    document with very many spans is split over bounded lines (the reader
    flattens all lines of a document back together).
    """
    grouped = spans.groupBy("document_name", F.floor(F.col("start_char") / F.lit(window)).alias("_w")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start_char", "end_char", "category", "text"))),
            lambda a: F.struct(a["category"].alias("category"), a["start_char"].alias("start_char"),
                               a["end_char"].alias("end_char"), a["text"].alias("text")),
        ).alias("annotations")
    ).drop("_w")
    grouped.write.mode(mode).json(path)


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read back what ``write_annotations`` wrote (scales: one JSON object per line)."""
    schema = f"document_name string, annotations {ANNOTATION_STRUCT}"
    lines = spark.read.schema(schema).json(path)
    return lines.select("document_name", F.posexplode("annotations").alias("ann_pos", "a")).select(
        "document_name", "ann_pos", "a.category", "a.start_char", "a.end_char",
        F.coalesce(F.col("a.text"), F.lit("")).alias("text"),
    )


# ------------------------------------------------------------------ S4 -----

QA_SCHEMA = (
    "data array<struct<title:string, paragraphs:array<struct<qas:array<struct<id:string, question:string,"
    " answers:array<struct<text:string, answer_start:int>>>>>>>>"
)


def read_qa_corpus(spark: SparkSession, path: str, multiline: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Nested QA JSON -> (title, qa_id, question, answer_text, answer_start) with declared schema.

    ``multiline=True`` reads one JSON document per file (the published layout), in
    ranges by many tasks; ``False`` reads one ``{"data": [...]}`` object per line.
    """
    if multiline:
        entry = QA_SCHEMA[len("data array<"):-1]
        found = json_elements(spark, path, range_bytes).where(F.col("key") == "data")
        return qa_rows(found.select(F.array(F.from_json("element", entry)).alias("data")))
    return qa_rows(spark.read.schema(QA_SCHEMA).json(path))


def qa_rows(raw: DataFrame) -> DataFrame:
    docs = raw.select(F.explode("data").alias("d"))
    paras = docs.select(F.coalesce(F.col("d.title"), F.lit("")).alias("title"), F.explode("d.paragraphs").alias("p"))
    qas = paras.select("title", F.explode("p.qas").alias("q"))
    ans = qas.select(
        "title",
        F.coalesce(F.col("q.id"), F.lit("")).alias("qa_id"),
        F.coalesce(F.col("q.question"), F.lit("")).alias("question"),
        F.explode("q.answers").alias("a"),
    )
    return ans.select(
        "title", "qa_id", "question",
        F.coalesce(F.col("a.text"), F.lit("")).alias("answer_text"),
        F.col("a.answer_start").alias("answer_start"),
    )


# ----------------------------------------------------------------- S10 -----


def save_snapshot(df: DataFrame, root: str, mode_name: str, stamp: str) -> bool:
    """Evaluation snapshot under ``root/mode=<mode>/ts=<YYYY-MM-DD_HH-MM>``; failures are reported, not raised."""
    try:
        df.write.mode("overwrite").json(f"{root.rstrip('/')}/mode={mode_name}/ts={stamp}")
        return True
    except Exception as exc:  # the reference logs and continues
        logging.getLogger("chunkwise").warning("snapshot failed: %s", exc)
        return False


def read_snapshots(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All saved snapshots as one table, with their ``mode`` and ``ts`` (partition columns: a filter on them prunes)."""
    return spark.read.schema(f"{schema}, mode string, ts string").json(root.rstrip("/"))
