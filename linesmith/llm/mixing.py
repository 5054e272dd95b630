"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Only DataFrame functions are used. The corpus is summed up once to a table of cells (source, language, topic, or any other
dimensions) with partial sums before the shuffle. Each round rescales the cells' shares of all tokens to the targets of one
dimension after the other, until every marginal meets its target to `TOLERANCE` or `rounds` are over. A document is then kept
with the probability `p = r / max(r)`, where r is its cell's fitted share over its actual one: expected tokens are in the fitted
proportions, no document is repeated, and the sample is as large as that allows. The draw is a hash of the id and a seed, so it
does not depend on partitions or order.

As nothing is repeated, a value reaches a share of `most` times its actual one only if all else is thinned to a `most`th. A
larger target counts as infeasible: it is held to that share before the fitting, and what is cut goes to the other values of
the dimension in proportion to their targets. `achieved` and `marginals` report the target asked for, the one held to, what
the sample comes to, and the residual; they also show where targets of several dimensions contradict each other.

Targets, by dimension: a number t takes the observed shares to the power of t (1 keeps them, 0 makes them equal); a dict gives
the shares of values (scaled to those that occur; values not in it get the share 0).

Cases: a null value of a dimension is a value of its own, `(none)`; documents without tokens carry no weight, have the
probability of their cell (0 if no document of the cell has tokens); rows with the same id are drawn together; null ids are
drawn as one id; an empty table gives an empty result; columns of docs with the names that the operator makes are replaced by
its own in `sample_mixture` results only (`mixture` takes nothing but the dimensions from docs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

ROUNDS = 40
#: The largest distance of a marginal from its target at which the fit has converged.
TOLERANCE = 1e-14
#: The largest feasible ratio of a value's target to its actual share.
MOST = 4.0
#: Rounds in which what is cut of infeasible targets is dealt to the others, at most.
HOLDS = 12
#: Rounds of one plan; the cells are stored between plans.
_AT_ONCE = 5
NONE = "(none)"
Targets = dict[str, float | dict[str, float]]


def _targets(cells: DataFrame, name: str, target: float | dict[str, float], most: float) -> DataFrame:
    """The values of a dimension with their target shares (asked_) and what these are held to (target_)."""
    values = cells.groupBy(name).agg(F.sum("tokens").alias("m")).where("m > 0")
    if isinstance(target, dict):
        raw = F.lit(0.0)
        for value, share in target.items():
            raw = F.when(F.col(name) == value, F.lit(float(share))).otherwise(raw)
    else:
        raw = F.pow(F.col("m").cast("double"), F.lit(float(target)))
    values = stored(values.withColumn("raw", raw))
    # Sums over all values are single numbers, so no task has to hold the values of a dimension together.
    total, weight = values.agg(F.sum("m").cast("double"), F.sum("raw")).first()
    asked, bound = F.col("raw") / F.lit(weight or 1.0), F.col("m") / F.lit(total or 1.0) * F.lit(float(most))
    values = values.select(name, asked.alias("asked"), bound.alias("bound"))
    scale = 1.0
    for _ in range(HOLDS):
        over = F.col("asked") * F.lit(scale) > F.col("bound")
        cut, free = values.agg(F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("asked"))), F.lit(0.0))).first()
        before, scale = scale, (1 - cut) / free if free > 0 else scale
        if scale == before:
            break
    held = F.least(F.col("asked") * F.lit(scale), F.col("bound"))
    return values.select(name, F.col("asked").alias(f"asked_{name}"), held.alias(f"target_{name}"))


def _off(cells: DataFrame, targets: Targets) -> float:
    """The largest distance of a marginal from its target."""
    worst = 0.0
    for name in targets:
        by_value = cells.groupBy(name).agg(F.abs(F.sum("share") - F.max(f"target_{name}")).alias("off"))
        worst = max(worst, by_value.agg(F.max("off")).first()[0] or 0.0)
    return worst


def fit_cells(cells: DataFrame, targets: Targets, rounds: int = ROUNDS, most: float = MOST) -> DataFrame:
    """cells (the dimensions and tokens) with share (fitted), ratio (fitted over actual), probability, and the targets by dimension (asked_ and target_)."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    out = cells
    for name, target in targets.items():
        out = out.join(_targets(cells, name, target, most), name, "left")
    goals = [F.coalesce(f"{kind}_{n}", F.lit(0.0)).alias(f"{kind}_{n}") for n in targets for kind in ("asked", "target")]
    out = stored(out.select(*targets, "tokens", *goals, (F.col("tokens") / F.lit(total)).alias("share")))
    done = 0
    while done < rounds:
        for _ in range(min(_AT_ONCE, rounds - done)):
            for name in targets:
                own = F.sum("share").over(Window.partitionBy(name))
                out = out.withColumn("share", F.when(F.col("share") > 0, F.col("share") * F.col(f"target_{name}") / own).otherwise(F.lit(0.0)))
            done += 1
        out = stored(out)
        if _off(out, targets) < TOLERANCE:
            break
    out = out.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("share") * F.lit(total) / F.col("tokens")).otherwise(F.lit(0.0)))
    largest = out.agg(F.max("ratio")).first()[0]
    probability = F.round(F.col("ratio") / F.lit(largest), 9) if largest else F.lit(0.0)
    return out.withColumn("probability", probability)


def marginals(cells: DataFrame, targets: Targets) -> DataFrame:
    """What fitted cells come to: dimension, value, tokens, asked (the target), target (what it is held to), achieved (share of the expected sampled tokens), residual (achieved less asked)."""
    whole = cells.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    parts = []
    for name in targets:
        expected = F.sum(F.col("tokens") * F.col("probability")) / F.lit(whole) if whole else F.lit(0.0)
        held = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"), F.max(f"asked_{name}").alias("asked"), F.max(f"target_{name}").alias("target"), expected.alias("achieved"))
        parts.append(held.select(F.lit(name).alias("dimension"), F.col(name).alias("value"), "tokens", "asked", "target", "achieved", (F.col("achieved") - F.col("asked")).alias("residual")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit(NONE)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _with_dims(docs: DataFrame, n_tokens: Column, dims: dict[str, Column]) -> DataFrame:
    made = {f"__{n}": F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in dims.items()}
    return docs.withColumns(made | {"__tokens": F.greatest(F.coalesce(n_tokens.cast("long"), F.lit(0)), F.lit(0))})


def _cells(rows: DataFrame, targets: Targets, rounds: int, most: float) -> DataFrame:
    cells = rows.groupBy(*(F.col(f"__{n}").alias(n) for n in targets)).agg(F.sum("__tokens").alias("tokens"))
    return stored(fit_cells(stored(cells), targets, rounds, most))


def mixture(docs: DataFrame, n_tokens: Column, dims: dict[str, Column], targets: Targets, rounds: int = ROUNDS, most: float = MOST, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Every row: doc_id, the dimensions, n_tokens, probability, and whether it is sampled."""
    rows = _with_dims(docs, n_tokens, dims)
    cells = _cells(rows, targets, rounds, most).select(*(F.col(n).alias(f"__{n}") for n in targets), "probability")
    slim = rows.select(F.col(id_col).alias("doc_id"), "__tokens", *(f"__{n}" for n in targets))
    out = slim.join(cells, [f"__{n}" for n in targets], "left")
    sampled = draw(F.col("doc_id"), seed) < F.col("probability")
    return out.select("doc_id", *(F.col(f"__{n}").alias(n) for n in targets), F.col("__tokens").alias("n_tokens"), "probability", sampled.alias("sampled"))


def achieved(docs: DataFrame, n_tokens: Column, dims: dict[str, Column], targets: Targets, rounds: int = ROUNDS, most: float = MOST) -> DataFrame:
    """The marginals of the mixture of docs, with their residuals."""
    return marginals(_cells(_with_dims(docs, n_tokens, dims), targets, rounds, most), targets)


def sample_mixture(docs: DataFrame, n_tokens: Column, dims: dict[str, Column], targets: Targets, rounds: int = ROUNDS, most: float = MOST, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The sampled rows of docs, with their columns."""
    rows = _with_dims(docs, n_tokens, dims)
    cells = _cells(rows, targets, rounds, most).select(*(F.col(n).alias(f"__{n}") for n in targets), F.col("probability").alias("__p"))
    out = rows.join(cells, [f"__{n}" for n in targets], "left")
    return out.where(draw(F.col(id_col), seed) < F.col("__p")).select(*docs.columns)
