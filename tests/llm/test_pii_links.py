"""Links of the random field: numbers that resemble an entity are not taken for it, repeats in other spellings are."""

import numpy as np

from linesmith.llm import pii

from ..conftest import SF
from .test_by_brute_force import base_by_expressions

COLLIDING = [
    "card 4111111111111111 then order no 77771111111 and ref 1111111 done",
    "call +49 30 1234567 today, invoice 88881234567 and ref 1234567 due",
    "host 10.0.0.1 is up, version 10001 and 1.0.0.01 too, build 100.01 there",
]


def test_numbers_that_end_alike_are_no_entity(spark):
    rows = list(enumerate(COLLIDING)) + [(10 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for fitted_on in (docs.where("doc_id < 10"), docs):
        model = pii.fit(fitted_on)
        got = {r.doc_id: set(r.spans.split(",")) for r in pii.find_pii(docs.where("doc_id < 10"), model).collect()}
        assert got == {i: set(base_by_expressions(t)) for i, t in enumerate(COLLIDING)}
        text = {r.doc_id: r.text for r in pii.redact_pii(docs.where("doc_id < 10"), model).collect()}
        assert "77771111111 and ref 1111111" in text[0] and "invoice 88881234567 and ref 1234567" in text[1] and "version 10001" in text[2]


def test_five_hundred_colliding_numbers_and_planted_repeats(spark):
    """Numbers that share their last digits, length or digits without dots with an entity, against repeats in other spellings."""
    rng = np.random.default_rng(21)
    digits = lambda n: str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))
    rows, planted = [], {}
    for i in range(750):
        a, b, c = digits(3), digits(3), digits(4)
        card = next(n for n in iter(lambda: digits(16), "") if pii.luhn(n))
        ip = ".".join(str(rng.integers(10, 256)) for _ in range(4))
        phone, split = f"+1 ({a}) {b}-{c}", " ".join(card[k : k + 4] for k in range(0, 16, 4))
        entity, again, same = [
            (phone, f"{digits(4)}{b}{c}", False), (card, f"{digits(4)}{card[-7:]}", False), (ip, ip.replace(".", ""), False), (phone, f"{b}{c}", False), (card, card[:-1] + str((int(card[-1]) + 1) % 10), False), (phone, f"({digits(3)}) {b}-{c[::-1]}x", False),
            (phone, f"({a}) {b}-{c}", True), (f"+49 {a} {b}{c}", f"0{a} {b}{c}", True), (split, split.replace(" ", "."), True),
        ][i % 9]
        text = f"order {digits(6)} of {digits(8)} came, reach {entity} now " + "alpha beta " * 20 + "see "
        planted[i] = (len(text), len(text) + len(again), same)
        rows.append((i, f"{text}{again} there {digits(7)} end"))
    right = wrong = found = 0
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        lo, hi, same = planted[r.doc_id]
        base = set(base_by_expressions(rows[r.doc_id][1]))
        added = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s not in base]
        inside = [s < hi and e > lo for s, e in added]
        right += sum(inside) if same else 0
        wrong += len(inside) - (sum(inside) if same else 0)
        found += same and any(inside)
    assert right / max(1, right + wrong) >= 0.95 and found >= 0.9 * 250
