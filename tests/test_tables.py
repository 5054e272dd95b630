"""Sources and sinks that need a place to write to."""

import pandas as pd
from pyspark.sql import functions as F

from linesmith import registry
from linesmith.functions import text as X
from linesmith.operators import catalog
from linesmith.operators import tables as T
from linesmith.operators import training as R
from linesmith.operators.sync import catalog_sync

from .conftest import SF


def test_jdbc_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V"))
    rows.write.jdbc(url, "T", properties=options)
    got = T.read_jdbc(spark, url, "T", "K", (0, 100), 4, **options)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("V")).first()[0] == 9900


def test_labelled_text_folders(spark, tmp_path):
    rows = spark.createDataFrame([("A", "one"), ("B", "two"), ("A", "three")], "class string, description string")
    T.write_labelled_text(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert {(r["class"], r["value"]) for r in back.collect()} == {("A", "one"), ("B", "two"), ("A", "three")}


def test_sync_refuses_a_small_source(spark):
    empty = spark.createDataFrame([], "item_id long, desc_id long, description string, item_modified long, desc_modified long")
    try:
        catalog_sync(empty, empty.drop("description"))
    except ValueError:
        return
    raise AssertionError("a small source was taken")


def test_balance_takes_new_rows_first(spark):
    pdf = pd.DataFrame({"uid": range(30), "class": ["A"] * 20 + ["B"] * 6 + ["C"] * 4, "new": [i % 5 == 0 for i in range(30)]})
    got = R.balanced(spark.createDataFrame(pdf), "class", F.col("new"), "uid", "s").toPandas()
    assert got["class"].value_counts().to_dict() == {"A": 6, "B": 6, "C": 4}
    assert set(got[got["class"] == "A"].uid) >= {0, 5, 10, 15}


def test_not_in_as_sql_has_it(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    for values in ([], [1], [1, 1, 9], [1, None], [None]):
        table = spark.createDataFrame([(v,) for v in values], "k long")
        want = spark.sql("SELECT * FROM {r} WHERE k NOT IN (SELECT k FROM {t})", r=rows, t=table)
        assert sorted(map(str, T.not_in(rows, table, "k").collect())) == sorted(map(str, want.collect())), values


def test_items_without_description_are_found_without_a_broadcast_of_all_descriptions(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["j04_j05_j06_sql_joins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan  # only the row of counts is sent to all


def test_short_dictionaries_do_not_shuffle_the_rows(spark, monkeypatch):
    names = spark.createDataFrame([("ACME", "ACME INC")], "key string, clean_name string")
    rows = spark.createDataFrame([(1, "acme"), (2, "other"), (3, None)], "k long, mfr string")
    before, said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1 << 17, 0):  # broadcast and shuffled
            monkeypatch.setattr(catalog.at_hand, "__defaults__", (most,))
            out = catalog.clean_names(rows, names, "mfr")
            said.append("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString())
            assert {(r.k, r.clean_name, r.was_cleaned) for r in out.collect()} == {(1, "ACME INC", True), (2, "other", False), (3, None, False)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert said == [False, True]


def test_alphanumeric_of_any_text(spark):
    texts = ["", "a-B 9/.", "é1", "\x00a\x7f", "日本5", None, "x\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", X.alphanumeric(F.col("c")).alias("x"))
    assert all(r.x == (r.c and "".join(ch for ch in r.c if ch.isascii() and ch.isalnum())) for r in df.collect())
