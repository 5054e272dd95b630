"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations only read the bits.

`rule_ledger` makes one row per document: its measurements and `failure_bits`, in which bit i is set if rule i fails;
`store_ledger` writes it to the shared folder, so that any number of policies and ablations read it. `apply_policy` turns a ledger into verdicts under one version of a policy (a set of rules), and `ablation` counts, in one
aggregation over the bits, what each rule of a policy rejects alone and together with others.

Cases: a null or empty text has no words and so fails the rule of too few words; repeated rows each keep their own row; an
empty table gives an empty ledger; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import Block, covered, mix, per_block, repeated, span_hash, window_hash

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")
#: Rule by bit; integer arithmetic only, so that every engine agrees.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "n_letters >= 20 AND 100 * n_capitals > 60 * n_letters",
}
#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91], _SMALL[97:123] = True, True
WINDOW = 5


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def _measure(b: Block) -> pa.RecordBatch:
    doc, n = b.doc, len(b.start)
    point = (b.data & 0xC0) != 0x80
    at = b.windows(WINDOW)
    own = mix(np.arange(1, b.n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = at[repeated(mix(window_hash(b.hash, at, WINDOW) ^ own[doc[at]]))]
    newline = np.flatnonzero(b.data == 10)
    edge = np.zeros(len(b.data) + 1, bool)
    edge[b.off] = True
    starts = np.unique(np.concatenate([b.off[:-1], newline + 1]))
    starts = starts[starts < len(b.data)]
    cut = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(b.word_byte, out=cut[1:])
    ends = np.append(starts[1:], len(b.data))
    ends = np.where((ends > starts) & (b.data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends
    real = cut[ends] > cut[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    line_doc = np.searchsorted(b.off, starts, "right") - 1
    line = mix(span_hash(b.data, starts, ends) ^ own[line_doc])
    order = np.argsort(line)
    later = np.zeros(len(line), bool)
    later[1:] = line[order][1:] == line[order][:-1]
    dup = np.bincount(line_doc[order][later], minlength=b.n)
    values = {
        "n_words": b.count,
        "word_chars": b.per_doc(b.word_byte & point),
        "n_symbols": b.per_doc(_SYMBOL[b.data]),
        "n_dup_lines": dup,
        "n_repeat_words": b.per_doc_words(covered(again, WINDOW, n)),
        "n_lines": np.bincount(line_doc, minlength=b.n),
        "n_letters": b.per_doc(_CAPITAL[b.data] | _SMALL[b.data]),
        "n_capitals": b.per_doc(_CAPITAL[b.data]),
    }
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(values[k].astype(np.int64)) for k in MEASURES)], ["doc_id", *MEASURES])


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failure_bits of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = rows.mapInArrow(per_block(_measure), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return seen.withColumn("failure_bits", bits.cast("long"))


def store_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table of the shared folder: every rule is evaluated once, whatever is then asked of it."""
    return stored(rule_ledger(docs, id_col, text_col))


def kept(policy: str) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with base_failed, and kept under a version of the policy."""
    base = ~kept("base")
    return ledger.withColumn("base_failed", base).withColumn("kept", ~base & kept(policy))


def compare_policies(ledger: DataFrame) -> DataFrame:
    """A row per version of the policy: documents, those it keeps, and those it keeps but `base` rejects or the other way round."""
    counts = [F.count(F.lit(1)).alias("n")]
    for p in POLICIES:
        counts += [F.count_if(kept(p)).alias(f"k_{p}"), F.count_if(kept(p) != kept("base")).alias(f"d_{p}")]
    stack = ", ".join(f"'{p}', k_{p}, d_{p}" for p in POLICIES)
    return ledger.agg(*counts).selectExpr("n AS documents", f"stack({len(POLICIES)}, {stack}) AS (policy, kept, unlike_base)")


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """A row per rule of the policy: rejected (by the whole policy), failed (the rule itself), alone (kept if only this rule went)."""
    m = mask(policy)
    hit = F.col("failure_bits").bitwiseAND(F.lit(m))
    names = POLICIES[policy]
    one = {r: 1 << list(RULES).index(r) for r in names}
    sums = [F.count_if(hit != 0).alias("rejected")]
    sums += [F.count_if(hit.bitwiseAND(F.lit(b)) != 0).alias(f"f_{r}") for r, b in one.items()]
    sums += [F.count_if(hit == b).alias(f"a_{r}") for r, b in one.items()]
    stack = ", ".join(f"'{r}', f_{r}, a_{r}" for r in names)
    return ledger.agg(*sums).selectExpr("rejected", f"stack({len(names)}, {stack}) AS (rule, failed, alone)")
