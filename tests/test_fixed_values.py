"""Values and rules typed by hand from the documented behaviour, apart from the queries' own SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesmith.functions import text as X
from linesmith.operators import cascade as C
from linesmith.operators import catalog as K
from linesmith.operators import evaluation as E
from linesmith.operators.matching import texts_with


def test_points_of_searched_results(spark):
    rows = [("Exact", "Strong", "Very High"), ("Likely", "Partial", "High"), ("Possible", "Possible", "Medium"), ("Not Detected", "No Match", "Low"), ("Mismatch", "Exact", "Exact"), (None, "exact", "other")]
    d = spark.createDataFrame(rows, "m string, p string, d string")
    got = [tuple(r) for r in d.select(X.word_points(F.col("m"), X.MFR_WORDS), X.word_points(F.col("p"), X.PART_WORDS), X.word_points(F.col("d"), X.DESCR_WORDS)).collect()]
    assert got == [(40, 20, 20), (30, 15, 15), (20, 5, 5), (0, 0, 0), (-10, 25, 25), (0, 0, 0)]


def candidate(**over):
    row = dict(line_id=1, cand_no=1, mfr="ACME", part="AB12345", descr="d", unspsc="39101112", source="s", priority_match=True, mfr_match="Exact", part_match="Exact", descr_match="Exact", generic=False)
    return row | over


COLUMNS = "line_id long, cand_no int, mfr string, part string, descr string, unspsc string, source string, priority_match boolean, mfr_match string, part_match string, descr_match string, generic boolean"


def test_scores_of_searched_results(spark):
    rows = [candidate(), candidate(line_id=2, generic=True), candidate(line_id=3, part="A-1", priority_match=False), candidate(line_id=4, source=" None "), candidate(line_id=5, mfr=None, part="", unspsc=None)]
    known = spark.createDataFrame([("ACME",)], "key string")
    got = {r.line_id: r for r in C.ranked_candidates(spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS), known).collect()}
    # one priority source: 10; part: 25 + 10 (seven characters) + 10 (alphanumeric) + 25 + 10; name: 40 + 10 + 25 + 10; code: 2 * (25 + 10)
    assert (got[1].conf_part, got[1].conf_mfr, got[1].conf_unspsc) == (80, 85, 70)
    assert got[1].confidence == pytest.approx(0.45 * 80 + 0.45 * 85 + 0.1 * 70)
    assert got[2].confidence == 70
    assert got[3].conf_part == 25 + 0 + 0 + 25 + 5
    assert 4 not in got
    assert (got[5].conf_part, got[5].conf_mfr, got[5].conf_unspsc, got[5].confidence) == (0, 0, 0, 0)


def test_special_cases(spark):
    d = spark.createDataFrame([(1, "1.2"), (2, "1.1"), (3, "1"), (4, None)], "line_id long, category_id string")
    got = {r.line_id: (r.route, r.stages, r.fields) for r in C.route(d).collect()}
    every = ["CLASSIFY", "SEMANTIC", "COMPLETE", "VALIDATOR", "TUNED", "WEB"]
    assert got[1] == ("generic", ["SEMANTIC", "VALIDATOR", "TUNED", "WEB"], ["mfr", "unspsc"])
    assert got[2] == ("lot", ["SEMANTIC", "COMPLETE"], ["mfr"])
    assert got[3] == got[4] == ("default", every, ["mfr", "part", "unspsc"])


def test_final_record_follows_the_clean_flag(spark):
    columns = "line_id long, mfr string, part string, unspsc string, conf_mfr double, conf_part double, conf_unspsc double, stage_name string, sub_stage string, failed boolean, status string, category string, verified string, is_mfr_clean boolean, route string"
    base = (None, "P", None, 90.5, 80.0, None, "WEB", "TOP", False, "RC-AI", "MATERIAL", "Y")
    rows = [(1, "ACME", *base[1:], True, "default"), (2, "ACME", *base[1:], False, "default"), (3, "ACME", *base[1:], None, "default"), (4, *base, False, "lot"), (5, *base, None, "default"), (6, "ACME", *base[1:7], True, *base[8:], True, "default"), (7, "BRAND 1", *base[1:10], "LOT", "Y", True, "default")]
    rows[5] = (6, "ACME", "P", None, 90.5, 80.0, None, "WEB", "TOP", True, "RC-AI", "MATERIAL", "Y", True, "default")
    rows[6] = (7, "ACME", "P", None, 90.5, 80.0, None, "WEB", "TOP", False, "RC-AI", "LOT", "Y", True, "default")
    got = {r.line_id: (r.mfr, r.status, r.verified) for r in C.final_record(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: ("ACME", "RC-AI", "Y"), 2: ("ACME", "DS1", "N"), 3: ("ACME", "RC-AI", "Y"), 4: ("LOT", "RC-AI", "Y"), 5: ("UNDEFINED", "RC-AI", "Y"), 6: ("ACME", "AI_ERROR", "Y"), 7: ("ACME", "RC-AI", "N")}


def test_prompts_of_the_three_attempts(spark):
    rows = [(i, "BOLT 5MM", [("ACME INC", "ACM")], [("x", "A", "1", "39101112"), ("y", None, None, None), ("z", "B", "2", "3"), ("w", "C", "3", "4")]) for i in (1, 2, 3)] + [(9, "NUT", [], [])]
    d = spark.createDataFrame(rows, "attempt int, text string, aliases array<struct<official:string,alias:string>>, examples array<struct<description:string,mfr:string,part:string,unspsc:string>>")
    got = {r.attempt: r.p.split("\n") for r in d.select("attempt", C.few_shot(F.col("text"), F.col("aliases"), F.col("examples"), F.col("attempt")).alias("p")).collect()}
    head = ["Manufacturer Alias to Official ManufacturerName Dictionary (use Official ManufacturerName if applicable to Input Description):", "ACM -> ACME INC", ""]
    shown = [f"'{d}' -> {dict(ManufacturerName=m, PartNumber=p, UNSPSC=u)}" for d, m, p, u in (("x", "A", "1", "39101112"), ("y", "", "", ""), ("z", "B", "2", "3"))]
    assert got[1] == [*head, "Examples (find patterns to use for extraction):", *shown, "", "Input Description (for extraction):", "BOLT 5MM"]
    assert got[2] == [*head, "Examples (for reference only):", *shown, "", "Input Description (for extraction):", "BOLT 5MM"]
    assert got[3] == [*head, "Input Description:", "BOLT 5MM"]
    assert got[9] == ["Input Description:", "NUT"]


def test_accents_of_all_scripts(spark):
    texts = ["Việt Nam đường", "ﬁne ½ ℡ ² Ａ", "Þór ß Æ Ø", "日本 á", "", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.remove_accents(F.col("t")).alias("p")).collect()]
    assert got == ["Viet Nam uong", "fine 12 TEL 2 A", "Thor ss AE O", " a", "", None]


def test_category_trees_of_any_depth(spark):
    chain = [(f"c{i}", f"n{i}", f"c{i - 1}" if i else None) for i in range(12)]
    d = spark.createDataFrame([*chain, ("r1", "ring", "r2"), ("r2", "ring", "r1"), ("o", "orphan", "gone")], "category_id string, category_name string, parent_id string")
    paths = {r.category_id: (r.path, r.depth) for r in K.category_paths(d).collect()}
    assert paths["c11"] == (" > ".join(f"n{i}" for i in range(12)), 12) and paths["o"] == ("orphan", 1) and "r1" not in paths
    tree = d.where("category_id NOT LIKE 'r%'")
    assert K.descendants(tree).where("parent_id = 'c0'").count() == 11
    with pytest.raises(ValueError):
        K.descendants(d)
    asked = spark.createDataFrame([("N0", None), ("n1", "N0"), ("n1", None), ("n2", "zz")], "category_name string, parent_name string")
    assert [r.category_id for r in K.category_ids(asked, tree).orderBy("category_name", F.desc_nulls_last("parent_name")).collect()] == ["c0", "c1", None, None]


def test_names_in_texts_by_equality(spark):
    t = spark.createDataFrame([("abcd",), ("xab",), ("a",), ("",), (None,), ("aaaa",)], "t string")
    n = spark.createDataFrame([("abc",), ("ab",), ("a",), ("bcd",), ("",), (None,), ("aaaaa",), ("ab",)], "n string")
    got = sorted(tuple(r) for r in texts_with(t, n, "t", "n").collect())
    assert got == [("a", "a"), ("aaaa", "a"), ("abcd", "a"), ("abcd", "ab"), ("abcd", "abc"), ("abcd", "bcd"), ("xab", "a"), ("xab", "ab")]


def test_false_decisions_keep_every_id(spark):
    d = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, False, True), (5, False, False), (6, None, True)], "uid long, t boolean, p boolean")
    assert sorted((r.uid, r.kind) for r in E.false_ids(d, F.col("t"), F.col("p"), "uid").collect()) == [(2, "fn"), (3, "fp"), (4, "fp")]
    r = E.binary_report(d, F.col("t"), F.col("p")).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (1, 1, 2, 1) and r.precision == pytest.approx(1 / 3) and r.recall == 0.5


def test_duplicate_lines_with_nulls(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, None, None)], "line_id long, k string, j string")
    got = {r.line_id: (r.first_line, r.others) for r in K.duplicate_lines(d, ["k", "j"]).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    assert K.duplicate_lines(d.where("false"), ["k", "j"]).count() == 0


def test_hashed_neighbours_find_nearly_all_pairs(spark):
    from linesmith.operators import vectors as V
    from linesmith.plans.vector_plans import item_vectors, mixed_queries
    from linesmith.sources.fixtures import Fixtures

    from .conftest import SF

    t = Fixtures(spark, SF)
    q, v = mixed_queries(t).toPandas(), item_vectors(t).select("desc_id", "vec").toPandas()
    unit = lambda s: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.stack(s.to_numpy()).astype(float))
    score = unit(q.vec) @ unit(v.vec).T
    want = {(int(q.query_id[i]), int(v.desc_id[j])) for i, j in zip(*np.nonzero(score >= 0.755))}
    got = {(r.query_id, r.desc_id) for r in V.hashed_neighbours(mixed_queries(t), item_vectors(t), 0.755).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 400


def test_verdicts_by_clean_names_and_ownership(spark):
    d = spark.createDataFrame([("ACMEINC", "ACME", "BIG"), ("BETA", "BETA", "BIG"), ("BIG", "BIG", None), ("GENWIRE", "GENERIC WIRE", None)], "key string, clean_name string, parent_name string")
    rows = [(1, "ACME INC", "ACME", "A-1", "A1"), (2, "ACME INC", "BETA", "A-1 B", "Z"), (3, "ACME INC", "OTHER", "", "x"), (4, "", "ACME", None, None), (5, "X", "GEN WIRE", "A", "A"), (6, "GENERIC WIRE", "ACME", "A", "A"), (7, "ACME INC", None, "A", "AB")]
    t = spark.createDataFrame([(i, m, p, 1, a, b, 1, "39101112", "39101199", 1) for i, m, p, a, b in rows], "line_id long, mfr_label string, mfr_pred string, mfr_conf int, part_label string, part_pred string, part_conf int, unspsc_label string, unspsc_pred string, unspsc_conf int")
    got = {(r.line_id, r.field): r.match for r in E.verdicts(t, d).collect()}
    assert [got[i, "mfr"] for i in range(1, 8)] == ["yes", "yes", "no", "skip", "no", "skip", "no"]
    assert [got[i, "part"] for i in range(1, 8)] == ["yes", "no", "skip", "skip", "skip", "skip", "yes"]
    assert all(got[i, "unspsc"] == "yes" for i in range(1, 8))


def test_training_sets_need_rows_enough(spark):
    from linesmith.operators import training as R

    rows = spark.createDataFrame([(i, f"text {i}", "NEW" if i % 2 else "FT_PROGRESS", "Y", "a") for i in range(40)], "desc_id long, description string, train_version string, active string, answer string")
    line = len('{"messages":[{"role":"system","content":"S"},{"role":"user","content":"text 11"},{"role":"assistant","content":"a"}]}') + 1
    assert R.fine_tune_set(rows, "S", F.col("answer"), "s", least=21).count() == 0
    assert R.fine_tune_set(rows, "S", F.col("answer"), "s", least=20).count() == 20
    few = R.fine_tune_set(rows, "S", F.col("answer"), "s", least=20, most_bytes=5 * line)
    assert few.count() == 5
    sent = R.in_progress(rows.select("desc_id", "train_version"), few)
    assert sent.where("train_version = 'FT_PROGRESS'").count() == 25
    assert R.after_training(sent, True, 2026).where("train_version = '2026-1'").count() == 25
    assert R.after_training(sent, False, 2026).where("train_version = 'NEW'").count() == 40
    prepared = spark.createDataFrame([(1, "NEW"), (2, "USED")], "uid long, version string")
    assert R.enough_new(prepared, 1).count() == 2 and R.enough_new(prepared, 2).count() == 0
