"""Names in texts by the automaton, the dictionary's precedence, and pairwise similarity: typed by hand."""

import pytest

from pyspark.sql import functions as F

from linesmith.operators import catalog as K
from linesmith.operators import phrases as P
from linesmith.operators import vectors as V

MANUFACTURERS = "unclean_name string, clean_name string, parent_name string, match_indicator string, ordinal long"
ROWS = [
    ("LEVITON MANUFACTURING", "LEVITON", "LEVITON GROUP", None, 1), ("3M", "3M COMPANY", None, "b ", 2), ("T&B", "THOMAS & BETTS", "ABB", "", 3), ("t & b", "TEE BEE", "ABB", None, 4),
    ("S STRUT", "STRUT CO", None, "B", 5), ("GE", "GENERAL ELECTRIC", "GE", None, 6), (None, "NO SPELLING", None, None, 7), ("NO CLEAN", None, None, None, 8), ("OLD", "OLD", None, "N", 9), ("  ", "BLANK", None, None, 10),
]


def dictionary(spark, rows=ROWS):
    return K.manufacturer_dictionary(spark.createDataFrame(rows, MANUFACTURERS))


def test_dictionary(spark):
    got = {r.key: (r.clean_name, r.parent_name, r.beginning, r.tier) for r in dictionary(spark).collect()}
    assert got == {
        "LEVITONMANUFACTURING": ("LEVITON", "LEVITON GROUP", False, 0), "LEVITON": ("LEVITON", "LEVITON GROUP", False, 1), "LEVITONGROUP": ("LEVITON GROUP", "LEVITON GROUP", False, 2),
        "3M": ("3M COMPANY", None, True, 0), "3MCOMPANY": ("3M COMPANY", None, False, 1),
        "TB": ("TEE BEE", "ABB", False, 0),  # both spellings have this key: the later one wins
        "THOMASBETTS": ("THOMAS & BETTS", "ABB", False, 1), "TEEBEE": ("TEE BEE", "ABB", False, 1), "ABB": ("ABB", "ABB", False, 2),
        "SSTRUT": ("STRUT CO", None, True, 0), "STRUTCO": ("STRUT CO", None, False, 1), "GE": ("GENERAL ELECTRIC", "GE", False, 0), "GENERALELECTRIC": ("GENERAL ELECTRIC", "GE", False, 1),
    }


def test_a_clean_name_with_the_key_of_a_spelling_wins(spark):
    rows = [("A.C.M.E", "OTHER", None, "B", 1), ("X", "ACME", "P-1", None, 2), ("Y", "Z", "A C M E", None, 3), ("A.C.M.E", "LAST", None, None, 4)]
    got = {r.key: (r.clean_name, r.beginning, r.tier) for r in dictionary(spark, rows).collect()}
    assert got["ACME"] == ("A C M E", False, 2)
    assert {r.key: r.clean_name for r in dictionary(spark, rows[:2]).collect()}["ACME"] == "ACME"
    assert {r.key: r.clean_name for r in dictionary(spark, [rows[0], rows[3]]).collect()}["ACME"] == "LAST"


CASES = [
    ("LEVITON SWITCH 5A", {("LEVITON", "LEVITON")}),  # a clean name alone
    ("BREAKER BY LEVITON GROUP", {("LEVITON GROUP", "LEVITON GROUP")}),  # a parent alone; the clean name inside goes
    ("Leviton-Manufacturing switch", {("Leviton-Manufacturing", "LEVITON")}),
    ("3M TAPE", {("3M", "3M COMPANY")}), ("TAPE 3M", set()), ("TAPE 3M COMPANY", {("3M COMPANY", "3M COMPANY")}),
    ("S-STRUT CLAMP", {("S-STRUT", "STRUT CO")}), ("A S-STRUT CLAMP", set()),
    ("CLAMP T&B 5", {("T&B", "TEE BEE")}), ("CLAMP T & B, GE", {("T & B", "TEE BEE"), ("GE", "GENERAL ELECTRIC")}),
    ("LAMP X/GE 4", {("GE", "GENERAL ELECTRIC")}),  # embedded
    ("LAMP X/GE/4", set()),  # separators on both sides
    ("LAMP X/GE ABB", {("ABB", "ABB")}),  # embedded goes beside a whole word
    ("GEAR", set()), ("", set()), (" ,; ", set()), ("GE " * 300, {("GE", "GENERAL ELECTRIC")}),
]


@pytest.mark.parametrize("shard", [P.SHARD, 3])
def test_names_in_texts(spark, shard):
    texts = spark.createDataFrame([(t,) for t, _ in CASES] + [(None,), (CASES[0][0],)], "description string")
    got: dict = {t: set() for t, _ in CASES}
    for r in P.names_in_texts(texts, dictionary(spark), shard).collect():
        got[r.description].add((r.name, r.clean_name))
    assert got == dict(CASES)


def test_names_in_texts_of_an_empty_dictionary(spark):
    texts = spark.createDataFrame([("GE",)], "description string")
    assert P.names_in_texts(texts, dictionary(spark).where("false")).count() == 0


@pytest.mark.parametrize("shard", [P.SHARD, 2])
def test_names_as_spelled_anywhere(spark, shard):
    texts = spark.createDataFrame([(1, "abcab"), (2, ""), (3, None), (4, "cab")], "id int, t string")
    names = spark.createDataFrame([("ab",), ("bca",), ("",), (None,), ("cab",), ("ab",)], "n string")
    assert sorted((r.id, r.n) for r in P.texts_with(texts, names, "t", "n", shard).collect()) == [(1, "ab"), (1, "bca"), (1, "cab"), (4, "ab"), (4, "cab")]


@pytest.mark.parametrize("options", [{}, {"broadcast_ids": 0}, {"item_block": 2, "text_block": 2}])
def test_nearest_description(spark, options):
    nan, inf = float("nan"), float("inf")
    texts = spark.createDataFrame([("a", [3.0, 4.0]), ("zero", [0.0, 0.0]), ("none", None), ("long", [1.0, 0.0, 0.0]), ("odd", [nan, 1.0]), ("hole", [None, 1.0]), ("unasked", [1.0, 1.0])], "description string, vec array<double>")
    items = spark.createDataFrame([(11, [4.0, 3.0]), (12, [-3.0, -4.0]), (13, [8.0, 6.0]), (21, None), (22, [inf, 1.0]), (31, [0.0, 0.0]), (99, [1.0, 1.0])], "desc_id long, vec array<float>")
    descriptions = spark.createDataFrame([(1, 11, "x"), (1, 12, "y"), (1, 13, "z"), (1, 14, "no vector"), (2, 22, "v"), (2, 21, "u"), (3, 31, "w"), (5, 99, "unasked")], "item_id long, desc_id long, description string")
    want = {("a", 1): (11, "x", 0.96), ("a", 2): (21, "u", None), ("a", 3): (31, "w", 0.0), ("a", 4): (None, None, None), ("zero", 1): (11, "x", 0.0), **{(t, 1): (11, "x", None) for t in ("none", "long", "odd", "hole", "new")}}
    got = V.nearest_description(spark.createDataFrame(list(want), "description string, item_id long"), descriptions, texts, items, **options).collect()
    assert len(got) == len(want)
    assert {(r.description, r.item_id): (r.desc_id, r.item_description, None if r.similarity is None else round(r.similarity, 9)) for r in got} == want


def test_vectors_are_thinned_out_before_they_move(spark):
    found = spark.createDataFrame([("a", 1)], "description string, item_id long")
    vectors = spark.range(1000).selectExpr("id AS desc_id", "id AS item_id", "array(CAST(id AS DOUBLE)) AS vec", "CAST(id AS STRING) AS description")
    plan = V.nearest_description(found, vectors, vectors, vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("strategy=broadcast") == 2


def test_long_texts_are_not_broadcast_by_their_number(spark, monkeypatch):
    """Few ids of many bytes in all are shuffled: the driver would have to hold them."""
    texts = ["a" * 2000, "b" * 2000]
    found = spark.createDataFrame([(t, 1) for t in texts], "description string, item_id long")
    descriptions = spark.createDataFrame([(5, 1, "d")], "desc_id long, item_id long, description string")
    vectors = spark.createDataFrame([(t, [1.0, float(i)]) for i, t in enumerate(texts)], "description string, vec array<double>")
    items = spark.createDataFrame([(5, [1.0, 0.0])], "desc_id long, vec array<double>")
    sent, real = [], F.broadcast
    monkeypatch.setattr(V.F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    monkeypatch.setattr(V, "BROADCAST_BYTES", 1000)
    got = V.nearest_description(found, descriptions, vectors, items).collect()
    assert {(r.description, r.desc_id, round(r.similarity, 6)) for r in got} == {(texts[0], 5, 1.0), (texts[1], 5, round(0.5**0.5, 6))}
    assert ["item_id"] in sent and ["description"] not in sent
