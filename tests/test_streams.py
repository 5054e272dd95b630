"""Streams that are stopped half way and started again."""

import pytest
from pyspark.sql import functions as F

from linesmith.sources.storage import Committed
from linesmith.streaming import jobs as J


def folder_of(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "id string, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema("id string, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


LEDGER = "id string, status string, retry_count int, retry_after long"


def said(df):
    return {r.id: (r.status, r.retry_count, r.retry_after) for r in df.collect()}


def test_a_restarted_ledger_goes_on_from_its_last_version(spark, tmp_path):
    ledger = spark.createDataFrame([("a", "pending", 0, None), ("b", "scheduled", 5, 90), ("c", "scheduled", 1, 200), ("d", "pending", 2, None)], LEDGER)
    path, now = f"{tmp_path}/ledger", F.lit(100)
    first = said(J.write_back(folder_of(spark, tmp_path, "in", [("a", True), ("b", False), ("c", True)]), ledger, now, path))
    assert first == {"a": ("committed", 0, None), "b": ("failed", 5, None), "c": ("scheduled", 1, 200), "d": ("pending", 2, None)}
    stream = spark.readStream.schema("id string, ok boolean").parquet(f"{tmp_path}/in")
    assert said(J.write_back(stream, ledger, now, path)) == first  # nothing new has come
    again = folder_of(spark, tmp_path, "in", [("a", False), ("d", False)])
    assert said(J.write_back(again, ledger, now, path)) == first | {"d": ("scheduled", 3, 100 + 480)}  # what is committed is not due


def test_a_batch_that_fails_half_way_is_made_good(spark, tmp_path, monkeypatch):
    ledger = spark.createDataFrame([("a", "pending", 0, None), ("b", "pending", 0, None)], LEDGER)
    path, now = f"{tmp_path}/ledger", F.lit(100)
    source = folder_of(spark, tmp_path, "in", [("a", False)])
    spark.createDataFrame([("b", True)], "id string, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole, calls = Committed.write, []

    def fails(self, df, number):
        calls.append(number)
        if number == 2:
            df.write.parquet(f"{self._folder}/data/2-half")  # written, but never committed
            raise OSError("lost")
        whole(self, df, number)

    monkeypatch.setattr(Committed, "write", fails)
    with pytest.raises(Exception):
        J.write_back(source, ledger, now, path)
    monkeypatch.undo()
    versions = Committed(spark, path)
    assert calls == [0, 1, 2] and versions.numbers() == [0, 1]
    assert said(J.write_back(source, ledger, now, path)) == {"a": ("scheduled", 1, 220), "b": ("committed", 0, None)}


def test_readers_see_whole_batches_only(spark, tmp_path):
    kept = Committed(spark, f"{tmp_path}/batches")
    assert kept.numbers() == [] and kept.read_all("id int").count() == 0
    kept.write(spark.range(3).selectExpr("CAST(id AS INT) AS id"), 0)
    kept.write(spark.range(5).selectExpr("CAST(id AS INT) AS id"), 1)
    with pytest.raises(Exception):
        kept.write(spark.range(9).selectExpr("CAST(raise_error('x') AS INT) AS id"), 2)
    spark.range(7).write.parquet(f"{tmp_path}/batches/data/3-half")
    kept.write(spark.range(2).selectExpr("CAST(id AS INT) AS id"), 1)  # repeated
    assert kept.numbers() == [0, 1] and kept.read_all("id int").count() == 5
