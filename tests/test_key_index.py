"""Bucketed keys beside a table: what an append reads, growth, failures."""

import pytest
from pyspark.sql import functions as F

from chunkwise.operators import key_index
from chunkwise.operators.store import append_if_absent


def _rows(spark, low, high):
    return spark.range(low, high).selectExpr("concat('d', id div 3) AS doc", "id AS n", "concat('text ', id) AS text")


KEYS = ("doc", "n")


def test_appends_equal_insert_if_absent_over_generations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "BUCKET_KEYS", 5)
    monkeypatch.setattr(key_index, "FIRST_BITS", 1)
    path = str(tmp_path / "store")
    assert append_if_absent(_rows(spark, 0, 90), path, KEYS) == 90
    assert append_if_absent(_rows(spark, 60, 150).union(_rows(spark, 60, 150)), path, KEYS, order=[F.col("text")]) == 60
    assert append_if_absent(_rows(spark, 0, 150), path, KEYS) == 0
    assert append_if_absent(_rows(spark, 0, 0), path, KEYS) == 0
    index = key_index.KeyIndex(spark, path, KEYS)
    assert index.bits > 3 and index.stored().count() == 150 == spark.read.parquet(path).count()
    index.rebuild()
    assert index.stored().count() == 150 and append_if_absent(_rows(spark, 140, 160), path, KEYS) == 10


def test_a_batch_reads_its_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "BUCKET_KEYS", 50)
    path, read = str(tmp_path / "store"), []
    batch = spark.createDataFrame([("d1", 3, "x"), ("new", 1, "y")], "doc string, n long, text string")
    for high in (500, 8_000):
        append_if_absent(_rows(spark, 0, high), path, KEYS)
        index = key_index.KeyIndex(spark, path, KEYS)
        fresh = index.absent(batch)
        assert [r.doc for r in fresh.collect()] == ["new"]
        touched = {r.bucket for r in batch.select(index._bucket(index.bits)).collect()}
        files = index.stored(sorted(touched)).inputFiles()
        assert f"{path}/part" not in fresh._jdf.queryExecution().executedPlan().toString()
        sizes = index.stored(sorted(touched)).count()
        read.append(sizes)
        assert files and "PartitionFilters: [bucket" in index.stored(sorted(touched))._jdf.queryExecution().executedPlan().toString()
    assert read[1] < 4 * max(read[0], 50)  # sixteen times the keys, buckets of the same size


def test_a_table_that_was_deleted_starts_anew(spark, tmp_path):
    path = tmp_path / "store"
    assert append_if_absent(_rows(spark, 0, 9), str(path), KEYS) == 9
    for f in path.iterdir():
        f.unlink()
    path.rmdir()
    assert append_if_absent(_rows(spark, 0, 9), str(path), KEYS) == 9


def test_a_table_without_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "store")
    _rows(spark, 0, 30).write.parquet(path)
    assert append_if_absent(_rows(spark, 20, 40), path, KEYS) == 10
    assert spark.read.parquet(path).count() == 40


@pytest.mark.parametrize("stop", ["pending", "rows", "keys"])
def test_an_append_that_stops_anywhere_is_made_good(spark, tmp_path, monkeypatch, stop):
    path = str(tmp_path / "store")
    append_if_absent(_rows(spark, 0, 20), path, KEYS)

    def broken(self, rows):
        name = f"{self.root}/pending/half"
        rows.select(*self.keys).write.parquet(name)
        if stop != "pending":
            rows.write.mode("append").parquet(self.path)
        if stop == "keys":
            self._write(self.spark.read.parquet(name), self.bits, "append")
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(key_index.KeyIndex, "append", broken)
        with pytest.raises(OSError):
            append_if_absent(_rows(spark, 10, 30), path, KEYS)
    assert append_if_absent(_rows(spark, 10, 30), path, KEYS) == (10 if stop == "pending" else 0)
    stored = spark.read.parquet(path)
    assert stored.count() == 30 == stored.select(*KEYS).distinct().count()
    assert key_index.KeyIndex(spark, path, KEYS).stored().distinct().count() == 30
