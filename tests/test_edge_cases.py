"""Empty tables, nulls and further columns with clashing names, for operators outside of the corpus part."""

import pytest
from pyspark.sql import functions as F

from linesmith.functions import text as X
from linesmith.operators import cascade as C
from linesmith.operators import catalog as K
from linesmith.operators import evaluation as E
from linesmith.operators import matching as M
from linesmith.operators import tables as T
from linesmith.operators import training as R
from linesmith.operators import vectors as V
from linesmith.streaming import jobs as J

MANUFACTURERS = "unclean_name string, clean_name string, parent_name string, match_indicator string, ordinal long"
ITEMS = "item_id long, own_part_num string, mfr_part_num string, mfr_name string, upc string, unspsc string, source_name string"
RESULTS = "line_id long, stage_no int, stage_name string, mfr string, part string, unspsc string, conf_mfr double, conf_part double, conf_unspsc double, is_invalidated boolean"


def frame(spark, schema, rows=()):
    return spark.createDataFrame(list(rows), schema)


def dictionary(spark, rows=()):
    return K.manufacturer_dictionary(frame(spark, MANUFACTURERS, rows))


def test_dictionary_of_nothing_and_of_nulls(spark):
    assert dictionary(spark).count() == 0
    d = dictionary(spark, [("ACME CO", "ACME", None, None, 1), ("ACME CO", "ACME TWO", None, "", 2), ("X", "Y", "Z", "N", 3)])
    assert {(r.key, r.clean_name) for r in d.collect()} == {("ACMECO", "ACME TWO"), ("ACME", "ACME"), ("ACMETWO", "ACME TWO")}


@pytest.mark.parametrize("texts", [[], [(None,)], [("",)], [("   ",)], [(None,), ("ACME AB-1234",), ("ACME AB-1234",)]])
def test_names_and_parts_in_odd_texts(spark, texts):
    d = dictionary(spark, [("ACME", "ACME INC", None, None, 1)])
    t = frame(spark, "description string", texts)
    found = M.names_in_texts(t, d).collect()
    assert [(r.description, r.clean_name) for r in found] == ([("ACME AB-1234", "ACME INC")] if ("ACME AB-1234",) in texts else [])
    items = frame(spark, ITEMS, [(1, None, "AB-1234", "ACME", None, "39101112", "IDEA"), (2, None, None, None, None, None, None)])
    descs = frame(spark, "item_id long, desc_id long, description string", [(1, 1, "ACME AB-1234")])
    vectors = frame(spark, "description string, vec array<double>", [("ACME AB-1234", [1.0, 0.0])]), frame(spark, "desc_id long, vec array<double>", [(1, [0.9, 0.1])])
    best = M.complete_match(t, items, descs, d, *vectors)
    assert best.count() == len(found)
    assert M.complete_match(t, items.where("false"), descs.where("false"), dictionary(spark), *(v.where("false") for v in vectors)).count() == 0


def test_cascade_of_nothing_and_of_nulls(spark):
    lines = C.route(frame(spark, "line_id long, category_id string, conf_mfr string", [(1, "1", "clash"), (2, None, None)]))
    answer = lambda rows: lambda open_: frame(spark, "line_id long, mfr string, part string, unspsc string, conf_mfr double, conf_part double, conf_unspsc double", rows)
    nothing = C.run_cascade(lines, [("SEMANTIC", answer([])), ("COMPLETE", answer([]))])
    assert nothing.count() == 0
    got = C.run_cascade(lines, [("SEMANTIC", answer([(1, None, None, None, None, None, None)])), ("COMPLETE", answer([(1, "A", "P1234", "39101112", 99.0, 99.0, 99.0), (2, "A", "P1234", None, 99.0, 99.0, None)]))]).collect()
    assert {(r.line_id, r.stage_no, r.status) for r in got} == {(1, 2, "RC-AI"), (2, 2, "DS1")}
    assert C.run_cascade(lines.where("false"), [("SEMANTIC", answer([]))]).count() == 0


def test_consolidation_of_nothing_and_of_nulls(spark):
    assert C.consolidated(frame(spark, RESULTS)).count() == 0
    rows = [(1, 1, "SEMANTIC", None, None, None, None, None, None, None), (1, 2, "COMPLETE", "NULL", "", " ", 10.0, 10.0, 10.0, False), (1, 3, "WEB", "A", "P", "39101112", 50.0, 50.0, 90.0, True), (1, 4, "TUNED", "A", "P", None, 60.0, 10.0, 0.0, False)]
    got = {r.stage_no: (r.unspsc, r.conf_mfr, r.conf_part, r.conf_unspsc) for r in C.consolidated(frame(spark, RESULTS, rows)).collect()}
    assert got == {1: (None, 0, 0, 0), 2: (None, 10, 10, 10), 3: ("39101112", 50, 50, 90), 4: (None, 60, 10, 0)}  # an invalid result lends nothing


def test_lent_codes_need_both_limits(spark):
    one = lambda n, stage, mfr, part, code, conf: (1, n, stage, mfr, part, code, 50.0, 50.0, conf, False)
    run = lambda *rows: {r.stage_no: (r.unspsc, r.conf_unspsc, r.code_from) for r in C.consolidated(frame(spark, RESULTS, rows)).collect()}
    strict = run(one(1, "SEMANTIC", "A", "P", "39101112", 10.0), one(2, "COMPLETE", "A", "P", None, 0.0))
    assert strict[2] == ("39101112", 10, "SEMANTIC")
    native = run(one(1, "SEMANTIC", "A", "P", "39101112", 80.0), one(2, "COMPLETE", "B", "Q", "40101112", 75.0), one(3, "TUNED", "C", "R", None, 0.0), one(4, "WEB", "D", "S", None, 0.0))
    assert native[3] == ("39101112", 80, "SEMANTIC")  # below the limit of 95 for tuned answers: the most confident code of all
    assert native[4] == ("39101112", 80, "SEMANTIC")
    weak = run(one(1, "SEMANTIC", "A", "P", "39101112", 60.0), one(2, "COMPLETE", "B", "Q", "40101112", 72.0), one(4, "WEB", "D", "S", None, 0.0))
    assert weak[4] == ("40101112", 72, "COMPLETE")


def test_tables_of_nothing(spark):
    docs = frame(spark, "id string, state struct<a:int,b:int>, seen array<int>", [("x", (1, 2), None), (None, None, [1])])
    none = frame(spark, "id string, v int")
    assert sorted((r.id or "", r.seen or []) for r in T.patch_paths(docs, none, "id", {"state.c": "v"}, {"seen": "v"}, []).collect()) == [("", [1]), ("x", [])]
    assert T.upsert(docs.where("false").select("id", F.lit(1).alias("v")), none, "id", "v").count() == 0
    assert T.merge_rows(none, none, "id").count() == T.insert_missing(none, none, "id").count() == 0
    assert K.category_paths(frame(spark, "category_id string, category_name string, parent_id string")).count() == 0
    assert K.descendants(frame(spark, "category_id string, category_name string, parent_id string")).count() == 0
    assert K.byte_budget(none, F.lit(1), ["id"], 10).count() == 0
    assert T.lemmatised(frame(spark, "id long, t string", [(1, None), (2, "")]), frame(spark, "token string, lemma string"), "id", "t").count() == 1


def test_sync_of_nothing(spark):
    rows = "item_id long, desc_id long, item_modified long, desc_modified long"
    assert K.snapshot_diff(frame(spark, rows), frame(spark, rows)).count() == 0
    got = K.snapshot_diff(frame(spark, rows, [(1, 1, None, None)]), frame(spark, rows, [(2, 2, 1, 1)])).collect()
    assert {(r.item_id, r.action) for r in got} == {(1, "create"), (2, "delete")}
    same = K.snapshot_diff(frame(spark, rows, [(1, 1, None, None), (2, 2, 5, 5)]), frame(spark, rows, [(1, 1, 3, 3), (2, 2, 5, None)])).collect()
    assert {(r.item_id, r.action, r.needs_embedding) for r in same} == {(1, "keep", False), (2, "keep", False)}


def test_vectors_of_nothing_and_zero(spark):
    q, v = frame(spark, "query_id long, vec array<double>"), frame(spark, "desc_id long, item_id long, vec array<double>")
    assert V.similar_items(q, v).count() == V.hashed_neighbours(q, v, 0.7).count() == 0
    q = frame(spark, "query_id long, vec array<double>", [(1, [1.0, 0.0])])
    v = frame(spark, "desc_id long, item_id long, vec array<double>", [(1, 1, [2.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 2, [0.0, 1.0])])
    assert [(r.item_id, r.desc_id, r["rank"]) for r in V.similar_items(q, v).collect()] == [(1, 1, 1)]
    assert {r.desc_id for r in V.hashed_neighbours(q, v, 0.7).collect()} == {1, 2}


def test_searched_results_that_are_no_json(spark):
    good = '[{"ManufacturerName": "Açme", "PartNumber": "AB12345", "Source": "s", "ManufacturerMatch": "Exact"}]'
    rows = [(1, None), (2, ""), (3, "no"), (4, "[]"), (5, "```json\n" + good + "\n```"), (6, good[:40])]
    got = C.searched_candidates(frame(spark, "line_id long, results string", rows)).collect()
    assert [(r.line_id, r.cand_no, r.mfr, r.priority_match) for r in got if r.mfr] == [(5, 1, "Acme", False)]
    best = C.best_searched(frame(spark, "line_id long, results string", rows), dictionary(spark)).where("mfr IS NOT NULL").collect()
    assert [(r.line_id, r.mfr, r.is_mfr_clean) for r in best] == [(5, "Acme", False)]


def test_attempts_without_a_passing_answer(spark):
    schema = "line_id long, attempt int, description string, answer string, tokens array<struct<token:string,logprob:double>>"
    ok = '{"ManufacturerName": "ACME", "PartNumber": "AB-1", "UNSPSC": "39101112"}'
    rows = [(1, 1, "x AB1 y", None, []), (1, 2, "x AB1 y", ok, [("AB-1", -0.1)]), (2, 1, "other", ok, []), (3, 4, "AB1", ok, []), (4, 1, None, ok, None)]
    got = C.first_passing(frame(spark, schema, rows), dictionary(spark)).collect()
    assert [(r.line_id, r.attempt, r.conf_part, r.conf_mfr) for r in got] == [(1, 2, 90, 0)]


def test_evaluation_of_nothing(spark):
    schema = "line_id long, mfr_label string, mfr_pred string, mfr_conf int, part_label string, part_pred string, part_conf int, unspsc_label string, unspsc_pred string, unspsc_conf int"
    v = E.verdicts(frame(spark, schema, [(1, *[None] * 9)]), dictionary(spark))
    assert {r.match for r in v.collect()} == {"skip"}
    assert E.verdicts(frame(spark, schema), dictionary(spark)).count() == 0
    assert E.binary_report(frame(spark, "t boolean"), F.col("t"), F.col("t")).first().precision == 0
    assert E.class_report(frame(spark, "t string, p string", [(None, "a"), ("a", None)]), "t", "p").count() >= 1


def test_streams_rules_with_nulls(spark):
    schema = "id string, status string, updated_s long, resets map<int,struct<stuck_status:string,reset_at:long>>"
    got = {r.id: r for r in J.stalled(frame(spark, schema, [("a", None, None, {}), ("b", "processing", 1, {}), ("c", "queued", None, {})]), F.lit(10_000)).collect()}
    assert got["b"].status == "pending" and got["b"].resets[1].stuck_status == "processing" and got["a"].status is None and not got["c"].was_reset
    ledger = frame(spark, "id string, status string, retry_count long, retry_after long", [("a", "pending", 5, None), ("b", "pending", 0, None), ("c", "done", 0, None)])
    step = {r.id: (r.status, r.retry_count, r.retry_after) for r in J.ledger_step(ledger, frame(spark, "id string, ok boolean", [("a", False), ("b", False), ("b", True), ("zz", True)]), F.lit(100)).collect()}
    assert step == {"a": ("failed", 5, None), "b": ("scheduled", 1, 220), "c": ("done", 0, None)}


def test_texts_of_nothing(spark):
    d = frame(spark, "t string", [(None,), ("",)])
    got = d.select(X.remove_accents(F.col("t")), X.clean_description(F.col("t")), X.json_outcome(F.col("t")), X.effective_length(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, None, "empty", 0), ("", "", "empty", 0)]


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", F.concat(F.lit("Q"), "quality").alias("class"))
    model = R.train_text_classifier(rows.where("doc_id % 4 <> 0"))
    got = R.classify_texts(model, rows.where("doc_id % 4 = 0").drop("class")).join(rows.select("doc_id", "class"), "doc_id")
    assert got.agg(F.avg((F.col("class") == F.col("class_pred")).cast("int"))).first()[0] > 0.9
    assert R.classify_texts(model, frame(spark, "doc_id long, text string", [(1, None), (2, " ")])).select("class_pred").distinct().first()[0] == "BAD"
