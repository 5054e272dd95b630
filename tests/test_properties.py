"""Equivalences that the operators rely on, held against plain Python on random input; and plans."""

import random
import re

from pyspark.sql import functions as F

from linesmith.functions import text as X
from linesmith.operators import matching as M
from linesmith.plans import matching_plans
from linesmith.sources.fixtures import Fixtures
from linesmith.sources.storage import stored

from .conftest import SF


def random_texts(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("AB019-/. X") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def plain_effective_length(s):
    n = len(s) - sum(s.count(c) for c in "-/.") - sum(len(m[0]) - 2 for m in re.finditer(r"(.)\1{2,}", s))
    capitals = sum("A" <= c <= "Z" for c in s)
    return n + (capitals >= 2) + (capitals >= 4) if s else 0


def plain_candidates(text):
    found = set()
    for k in X.CANDIDATE_CLASSES:
        for m in re.finditer(rf"(?<![{k}])[{k}]{{4,50}}(?![{k}])", text):
            s = m[0].strip("-/.")
            if plain_effective_length(s) >= 4 and re.search("[0-9]", s) and not re.match(X.EXCLUDED_PATTERN, s):
                found.add(s)
    return found


def test_candidates_are_maximal_runs(spark):
    df = spark.createDataFrame([(t,) for t in random_texts()], "t string").select("t", X.part_number_candidates(F.col("t")).alias("c"), X.effective_length(F.col("t")).alias("e"))
    for r in df.collect():
        assert set(r.c) == plain_candidates(r.t) and r.e == plain_effective_length(r.t)


def test_independent_candidates(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(seed=2)], "t string").select(X.part_number_candidates(F.col("t")).alias("c")).select("c", X.independent_candidates(F.col("c")).alias("u"))
    for r in df.collect():
        accepted = []
        for c in sorted({re.sub("[-/.]", "", x) for x in r.c}, key=len, reverse=True):
            if not any(c in a for a in accepted):
                accepted.append(c)
        assert set(r.u) == set(accepted)


def test_codes_compatible(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("012") for _ in range(6)), "".join(rng.choice("012") for _ in range(6))) for _ in range(400)] + [("391200", "391234"), ("391234", "391200"), ("391200", "391300")]

    def plain(a, b):
        i = 0
        while i < len(a) and a[i] == b[i]:
            i += 1
        return set(a[i:]) <= {"0"} or set(b[i:]) <= {"0"}

    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.codes_compatible(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == plain(r.a, r.b)


def test_rounding_is_half_to_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(F.rint("x").alias("r")).collect()
    assert [r.r for r in got] == [0.0, 2.0, 2.0]


def test_accents(spark):
    r = spark.createDataFrame([("Größe Ærø þing señor café €5",)], "t string").select(X.remove_accents(F.col("t")).alias("r")).first()
    assert r.r == "Grosse AEro thing senor cafe 5"


def test_names_meet_the_dictionary_by_an_equi_join(spark):
    texts, _, _, dictionary, *_ = matching_plans.inputs(Fixtures(spark, SF))
    plan = M.names_in_texts(texts, stored(dictionary))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_they_need(spark):
    lines = Fixtures(spark, SF).invoice_lines.select("line_id", "description")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan
