"""Answers among the tokens that spell them: each rule by hand, and all runs tried one by one."""

import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linesmith.functions.spans import probability, span
from linesmith.operators.cascade import token_confidence


@pytest.mark.parametrize(
    "tokens, answer, at",
    [
        (['{"part": "', "AB", "-12", '"}'], "AB-12", (1, 2)),  # the same text
        (['{"', 'x": "', "AB", '-12"', "}"], "AB-12", (2, 3)),  # with a quote at the edge
        (['": ', '"', " ", "AB", '"'], "AB", (1, 3)),  # edges before it belong to the run
        (["20 ", "'"], "20'", (0, 1)),  # but for white space
        (["20", "'"], "20 '", (0, 1)),
        (["ab", "-c"], "AB-C", (0, 1)),  # but for case
        (["a b"], "AB", None),  # not for both
        (["a/4", '\\"', " BOLT"], 'a/4" BOLT', (0, 2)),  # an escaped quote inside
        (["O", "\\", "'", "NEIL"], "O'NEIL", (0, 3)),  # escaped over two tokens
        (["AB", "\\", '"', "x"], "AB", (0, 0)),  # the run ends before the backslash
        (["5", '\\"'], '5"', None),  # a quote at the edge is never part of it
        (["xAB", "AB", "AB"], "AB", (1, 1)),  # the first that stands alone
        (["AB", "C"], "ABCD", None),
        (["a" + " " * 20, "b", "ab"], "ab", (0, 1)),  # blanks at the end do not count as length
        (["a" + " " * 20 + "b", "c", "abc"], "abc", (2, 2)),  # a run that has outgrown the answer
        ([], "A", None),
        (["A"], "", None),
        (["A"], " ", None),
    ],
)
def test_rules(tokens, answer, at):
    assert span(tokens, answer) == at


def all_runs(tokens, answer):
    """The definition, run by run."""
    words = "".join(answer.split())
    for first in range(len(tokens)):
        for last in range(first, len(tokens)):
            said = "".join(tokens[first : last + 1]).replace('\\"', '"').replace("\\'", "'").strip(' \n"')
            if said and ("".join(said.split()) == words or (len(said) == len(answer) and said.lower() == answer.lower())):
                return first, last
            if len(said) > len(answer) + 10:
                break
    return None


SOME = st.text(alphabet="aAb \n\"'\\", max_size=4)


@settings(max_examples=3000, deadline=None)
@given(st.lists(SOME, max_size=8), SOME)
def test_every_run(tokens, answer):
    if answer and not answer.rstrip().endswith("\\"):
        assert span(tokens, answer) == all_runs(tokens, answer)


def test_probabilities():
    assert probability(["A", "B", "C"], [-0.1, 0.7, -9.0], "AB") == round((math.exp(-0.1) + 1) / 2, 2)
    assert probability(["A", "B"], [math.nan, None], "AB") == 0.0
    assert probability(["A"], [-1.0], None) == 0.0


def test_work_is_linear_in_the_tokens():
    start = time.time()
    assert span(["x1 "] * 200_000 + ["AB", "-7"], "AB-7") == (200_000, 200_001)
    assert time.time() - start < 20


def test_rows(spark):
    rows = spark.createDataFrame([(1, "AB", [("A", -0.1), ("b", -0.3)]), (2, None, [("A", -0.1)]), (3, "A", None), (4, "A", [(None, None), ("A", None)])], "line_id long, answer string, tokens array<struct<token: string, logprob: float>>")
    got = {r.line_id: r.conf for r in token_confidence(rows.withColumn("answers", F.lit(1))).collect()}
    assert got == {1: round((math.exp(-0.1) + math.exp(-0.3)) / 2, 2) * 100, 2: 0.0, 3: 0.0, 4: 0.0}


def test_plain_runs_are_told_without_python(spark):
    """Where the expression tells something it is what the run of tokens says, and it tells the plain ones."""
    from linesmith.functions.spans import plain_confidences

    draw, rows = random.Random(5), []
    parts = ["a", "A", "ab", "b-1", " ", "\n", '"', "\\", "B-1 ", "é", "", '", "part": "', "ab ab", "1", None]
    logs = [-0.1, -2.3, 0.5, None, float("nan"), math.log(0.125), math.log(0.5), -50.0]
    for _ in range(4000):
        tokens = [draw.choice(parts) for _ in range(draw.randint(0, 6))]
        answer = draw.choice([*(t for t in tokens if t), *parts])
        rows.append((answer, tokens, [draw.choice(logs) for _ in range(draw.choice((len(tokens), len(tokens), 1)))]))
    rows += [("X-1", ["{", "X-1", "}"], [0.0, -0.2, 0.0]), ("BRAND 1", ['{"m": "', "BRAND 1", '"'], [0.0, -0.1, 0.0])]
    df = spark.createDataFrame(rows, "a string, t array<string>, p array<double>").select("*", F.get(plain_confidences([F.lit("x"), F.col("a")], F.col("t"), F.col("p")), F.lit(1)).alias("c"))
    told = [(r, r.c) for r in df.collect() if r.c is not None]
    assert len(told) > 50 and {"X-1", "BRAND 1"} <= {r.a for r, _ in told}
    for r, c in told:
        assert c == round(probability([t or "" for t in r.t], r.p, r.a) * 100, 2), r


def test_first_passing_asks_python_only_where_it_must(spark):
    from linesmith.operators import cascade as C

    said = '{"ManufacturerName": "ACME", "PartNumber": "%s", "UNSPSC": "39101112"}'
    tokens = lambda part, *cut: [("{", -0.9), ("ACME", -0.1), (": ", -0.9), *((p, -0.2) for p in cut), (", ", -0.9), ("39101112", -0.3), ("}", -0.9)]
    rows = [(1, 1, "pipe X-12", said % "X-12", tokens("X-12", "X-12")), (2, 1, "pipe X-12", said % "X-12", tokens("X-12", "X-", "12")), (3, 2, "no such", said % "X-12", tokens("X-12", "X-12"))]
    answers = spark.createDataFrame(rows, "line_id long, attempt int, description string, answer string, tokens array<struct<token:string,logprob:double>>")
    names = spark.createDataFrame([("ACME", "ACME INC")], "key string, clean_name string")
    out = C.first_passing(answers, names)
    got = {r.line_id: (r.mfr, r.conf_mfr, r.conf_part, r.conf_unspsc) for r in out.collect()}
    assert got == {1: ("ACME INC", 90.0, 82.0, 74.0), 2: ("ACME INC", 90.0, 82.0, 74.0)}
    assert "MapInArrow" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.count("SortMergeJoin") == 0
