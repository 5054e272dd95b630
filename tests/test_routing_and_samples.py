"""Routing, totals with null classes, acceptance and samples: typed by hand, or against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linesmith.operators import cascade as C
from linesmith.operators import catalog as K
from linesmith.operators import evaluation as E
from linesmith.operators import training as T

LINES = "line_id int, description string, class string, class_conf double, lot_class string, rental_class string, rental_ind string, mfr_ai string, category_id string"
# description, class, confidence, lot and rental verdicts, rental by automation, known manufacturer; then category, confidence, rental, step
BRANCHES = [
    ("STEEL BOLT M8", "MATERIAL", 99.0, None, None, None, None, "MATERIAL", 99.0, "N", "EXTRACT"),
    ("STEEL BOLT M8", "MATERIAL", 40.0, None, "RENTAL", "N", None, "MATERIAL", 40.0, "Y", "EXTRACT"),  # extracted whatever the confidence
    ("LOT OF BOLTS", "MATERIAL", 90.0, "LOT", "RENTAL", None, "NULL", "LOT", 90.0, "N", "EXTRACT"),  # a lot is no rental by the model
    ("LOT OF BOLTS", "MATERIAL", 90.0, "LOT", None, "Y", None, "LOT", 90.0, "Y", "EXTRACT"),
    ("LOT OF BOLTS", "MATERIAL", 90.0, "MATERIAL", None, None, None, "MATERIAL", 90.0, "N", "EXTRACT"),  # the model has the last word
    ("LOT OF BOLTS", "MATERIAL", 90.0, "LOT", None, None, "ACME", "LOT", 90.0, "N", "RC-AI"),  # the manufacturer is known
    ("LOT OF BOLTS", "MATERIAL", 90.0, "LOT", None, None, "LOT", "LOT", 90.0, "N", "EXTRACT"),
    ("LOT OF BOLTS", "MATERIAL", 90.0, "LOT", None, None, "undefined", "LOT", 90.0, "N", "EXTRACT"),
    ("BOLTS", "MATERIAL", 90.0, "LOT", None, None, None, "MATERIAL", 90.0, "N", "EXTRACT"),  # does not say lot
    ("PILOT LAMP", "BAD", 96.0, "LOT", None, None, None, "LOT", 96.0, "N", "EXTRACT"),
    ("PILOT LAMP", "BAD", 94.0, "LOT", "RENTAL", None, None, "BAD", 94.0, "N", "DS1"),
    ("SOMETHING", "BAD", 95.0, None, "RENTAL", None, None, "BAD", 95.0, "Y", "DS1"),
    ("FREIGHT COST", "FREIGHT", 96.0, None, "RENTAL", None, None, "FREIGHT", 96.0, "Y", "RC-AI"), ("FREIGHT COST", "FREIGHT", 94.9, None, None, None, None, "FREIGHT", 94.9, "N", "DS1"),
    ("SERVICE", "SERVICE", 99.0, None, "RENTAL", None, None, "SERVICE", 99.0, "N", "RC-AI"), ("SERVICE", "SERVICE", 99.0, None, None, "Y", None, "SERVICE", 99.0, "Y", "RC-AI"),
    ("!a!", "MATERIAL", 50.0, None, None, None, None, "BAD", 100.0, "N", "DS1"), (None, "MATERIAL", 50.0, None, "RENTAL", None, None, "BAD", 100.0, "N", "DS1"),
    ("* Adjustments *", "MATERIAL", 50.0, None, None, None, None, "AP ADJUSTMENT", 100.0, "N", "RC-AI"), ("x yz", None, None, None, None, None, None, None, None, "N", "DS1"),
]


def test_classification(spark):
    lines = spark.createDataFrame([(i, *b[:7], "1") for i, b in enumerate(BRANCHES)], LINES)
    got = {r.line_id: (r.category, r.category_conf, r.rental, r.next_step) for r in C.classified(lines).collect()}
    assert got == {i: b[7:] for i, b in enumerate(BRANCHES)}


def test_lots_take_their_route(spark):
    lines = spark.createDataFrame([(0, "LOT OF A", "MATERIAL", 90.0, "LOT", None, None, None, "1"), (1, "LOT OF A", "MATERIAL", 90.0, "LOT", None, None, "ACME", "1"), (2, "LOT OF A", "MATERIAL", 90.0, "LOT", None, None, None, "1.2"), (3, "A BOLT", "MATERIAL", 90.0, "LOT", None, None, None, "1")], LINES)
    got = {r.line_id: (r.route, r.fields, "WEB" in r.stages) for r in C.lots_routed(C.route(C.classified(lines))).collect()}
    assert got == {0: ("lot", ["mfr"], False), 1: ("default", ["mfr", "part", "unspsc"], True), 2: ("generic", ["mfr", "unspsc"], True), 3: ("default", ["mfr", "part", "unspsc"], True)}


def test_totals_with_a_null_class(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), (None, None), (None, None)], "t string, p string")
    got = {(r.t, r.p, r.all_true, r.all_pred): r.n for r in E.confusion(rows, "t", "p").collect()}
    n, y = False, True
    assert got == {("a", "a", n, n): 1, ("a", None, n, n): 1, (None, None, n, n): 2, ("a", None, n, y): 2, (None, None, n, y): 2, (None, "a", y, n): 1, (None, None, y, n): 3, (None, None, y, y): 4}
    report = {r["class"]: (r.support, round(r.precision, 3), r.recall) for r in E.class_report(rows, "t", "p").collect()}
    assert report == {"a": (2, 1.0, 0.5), None: (2, 0.667, 1.0)}


def test_a_field_that_a_model_lacks_is_not_accepted(spark):
    model = lambda **a: spark.createDataFrame(list(a.items()), "field string, accuracy double")
    old, minima = model(mfr=80.0, part=70.0), {"mfr": 75, "part": 60}
    said = lambda new: tuple(E.accepted(new, old, minima).first())
    assert said(model(mfr=81.0, part=71.0)) == (True, True) and said(model(mfr=81.0)) == (False, False) and said(model(mfr=76.0, part=71.0)) == (True, False)


@pytest.mark.parametrize("n", [0, 1, 50, 399, 400, 1000])
def test_samples_equal_a_plain_choice(spark, n):
    rows = [(i, "x" if i % 5 else "y") for i in range(500)] + [(900, None), (901, "z")]
    got = T.stratified_sample(spark.createDataFrame(rows, "id int, s string"), "s", {"x": n, "y": 7}, "id", "seed").collect()
    number = lambda i: int(hashlib.md5(f"seed{i}".encode()).hexdigest()[:8], 16)
    by = defaultdict(list)
    for i, s in sorted(rows, key=lambda r: (number(r[0]), r[0])):
        by[s].append(i)
    assert sorted(r.id for r in got) == sorted(by["x"][:n] + by["y"][:7])


def test_balance_takes_new_rows_first(spark):
    rows = [(i, "big", i < 30) for i in range(300)] + [(1000 + i, "small", False) for i in range(40)] + [(2000, None, True)]
    got = T.balanced(spark.createDataFrame(rows, "id int, c string, new boolean"), "c", T.F.col("new"), "id", "s").collect()
    big = [r.id for r in got if r.c == "big"]
    assert len(got) == 81 and len(big) == 40 and set(range(30)) <= set(big)
    one = spark.createDataFrame([(1, "a", True)], "id int, c string, new boolean")
    assert T.balanced(one, "c", T.F.col("new"), "id", "s").count() == 1 and T.balanced(one.where("false"), "c", T.F.col("new"), "id", "s").count() == 0


def test_the_whole_record(spark):
    columns = "line_id long, mfr string, part string, unspsc string, upc string, own_part string, conf_mfr double, conf_part double, conf_unspsc double, code_from string, stage_name string, sub_stage string, failed boolean, status string, category string, category_id string, category_conf double, stage_category string, verified string, is_mfr_clean boolean, route string, fields array<string>, mfr_from string"
    every, tail = ["mfr", "part", "unspsc"], ("MATERIAL", "1", 97.0, "C", "Y", True)
    rows = [
        (1, "ACME", None, "39101112", "123", None, 90.4, 10.0, 88.0, "SEMANTIC", "WEB", "TOP", False, "RC-AI", *tail, "default", every, None),
        (2, None, "P", None, None, "AK1", 1.0, 2.0, 3.0, None, "TUNED", "TOP", False, "RC-AI", *tail, "lot", ["mfr"], None),
        (3, "ACME", None, None, None, None, 100.0, None, None, None, None, None, False, "RC-AI", "LOT", None, 80.0, "L", "N", None, "default", every, "RPA"),
        (4, None, None, None, None, None, None, None, None, None, None, None, False, "DS1", None, None, None, None, "Y", None, "default", every, None),
    ]
    got = {r.line_id: r.asDict() for r in C.final_record(spark.createDataFrame(rows, columns), F.lit(7)).collect()}
    some = lambda i, *names: tuple(got[i][n] for n in names)
    assert some(1, "mfr", "stage_mfr", "conf_mfr", "part", "stage_part", "conf_stage_part", "conf_part") == ("ACME", "WEB - TOP", 90, "UNDEFINED", "UNDEFINED", "WEB - TOP", 10)
    assert some(1, "unspsc", "stage_unspsc", "conf_stage_unspsc") == ("39101112", "SEMANTIC - TOP", "SEMANTIC - TOP")  # a code taken from another stage
    assert some(1, "upc", "stage_upc", "own_part", "stage_own_part", "category_id", "conf_category", "stage_category", "source_url", "end_time") == ("123", "WEB - TOP", "UNDEFINED", "UNDEFINED", "1", 97, "C", "UNDEFINED", 7)
    assert some(2, "mfr", "stage_mfr", "part", "stage_part", "conf_part", "own_part") == ("LOT", "TUNED - TOP", None, None, None, "AK1")  # a field that is not wanted is not written
    assert some(3, "mfr", "stage_mfr", "conf_mfr", "conf_stage_mfr", "part", "upc", "step", "status") == ("ACME", "RPA", 100, "RPA", None, None, None, "RC-AI")
    assert some(4, "mfr", "conf_mfr", "status", "verified", "category", "conf_category", "step") == (None, 0, "DS1", "N", "UNDEFINED", 0, None)


def test_known_numbers_leave_first(spark):
    items = spark.createDataFrame([("AK1", None), (None, "12345678"), ("AK", "1"), ("AK1", "12345678")], "own_part_num string, upc string")
    lines = spark.createDataFrame([(1, "AK1", None), (2, None, "12345678"), (3, "AK", "1"), (4, "AK1", "12345678"), (5, None, None), (6, "AK2", "99999999")], "line_id long, own_part_num string, upc string")
    assert sorted(r.line_id for r in K.known_keys(lines, items).collect()) == [1, 2, 4]  # numbers that are not valid are not looked up
    lines = lines.selectExpr("*", "'X1' AS description", "'SERVICE' AS class", "99.0D AS class_conf", "CAST(null AS string) AS lot_class", "CAST(null AS string) AS rental_class", "'N' AS rental_ind", "CAST(null AS string) AS mfr_ai", "'1' AS category_id")
    none = lambda open_: open_.selectExpr("line_id", "CAST(null AS string) AS mfr", "CAST(null AS string) AS part", "CAST(null AS string) AS unspsc", "0D AS conf_mfr", "0D AS conf_part", "0D AS conf_unspsc").limit(0)
    dictionary = spark.createDataFrame([], "key string, name string, clean_name string, parent_name string, beginning boolean, tier int")
    got = {r.line_id: (r.status, r.category, r.conf_mfr) for r in C.resolved_lines(lines, [("SEMANTIC", none)], None, dictionary, items=items).collect()}
    assert got == {i: ("RC-RPA", None, None) if i in (1, 2, 4) else ("DS1", "BAD", 100) for i in range(1, 7)}
