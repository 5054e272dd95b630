"""Evaluation: verdicts by field, metrics, confusion tables and acceptance gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesmith.functions import text as X

from .catalog import relationship


# Names that are no manufacturer, so that they are not compared.
NOT_COMPARED = ("GENERIC - OTHER", "GENERIC CONDUIT", "GENERIC CONDUIT FITTINGS", "GENERIC CONDUIT/CONDUIT FITTINGS", "GENERIC LIGHTING", "GENERIC WIRE")


def verdicts(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """line_id, field, match (yes, no, skip) and conf. rows: *_label, *_pred and *_conf of mfr, part and unspsc.

    Names match if they are equal, or if their clean forms are prefix or suffix of one another or related by ownership; listed
    generic names are skipped. Parts are compared without marks, and skipped if either name is generic. Codes are compared by
    six digits. An empty label is skipped.
    """
    d = dictionary.select("key", "clean_name", "parent_name")
    for side in ("label", "pred"):
        c = d.select(F.col("key").alias(f"__k_{side}"), F.col("clean_name").alias(f"__c_{side}"), F.col("parent_name").alias(f"__p_{side}"))
        rows = rows.join(c, X.name_key(F.col(f"mfr_{side}")) == F.col(f"__k_{side}"), "left").withColumn(f"__c_{side}", F.coalesce(f"__c_{side}", f"mfr_{side}"))
    label, pred = F.col("mfr_label"), F.col("mfr_pred")
    fits = lambda a, b: F.coalesce(X.prefix_or_suffix(a, b), F.lit(False))
    related = relationship(F.col("__c_label"), F.col("__c_pred"), F.col("__p_label"), F.col("__p_pred")) != "NOT_EQUIVALENT"
    listed = F.coalesce(label.isin(*NOT_COMPARED), F.lit(False)) | F.coalesce(pred.isin(*NOT_COMPARED), F.lit(False))
    empty = F.coalesce(label, F.lit("")) == ""
    mfr = F.when(listed, "skip").when(F.coalesce(label == pred, F.lit(False)) & ~empty, "yes").when(empty, "skip").when(fits(F.col("__c_label"), F.col("__c_pred")) | related, "yes").otherwise("no")
    generic = F.lit(False)
    for c in (label, pred, F.col("__c_pred")):
        generic = generic | F.coalesce(F.contains(F.upper(c), F.lit("GENERIC")), F.lit(False))
    bare = lambda c: F.regexp_replace(F.trim(c), "[^A-Za-z0-9 ]", "")
    part = F.when(generic | (F.coalesce(bare(F.col("part_label")), F.lit("")) == ""), "skip").when(fits(bare(F.col("part_label")), bare(F.col("part_pred"))), "yes").otherwise("no")
    code = X.code_match(F.col("unspsc_label"), F.col("unspsc_pred"), 6)
    one = lambda name, match: F.struct(F.lit(name).alias("field"), match.alias("match"), F.col(f"{name}_conf").alias("conf"))
    return rows.select("line_id", F.explode(F.array(one("mfr", mfr), one("part", part), one("unspsc", code))).alias("v")).select("line_id", "v.*")


def percent(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.round(n * 100.0 / d, 2)).otherwise(0.0)


def field_metrics(v: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """tp, tn, fp, fn, skipped and the usual ratios (percent) of every field; a value counts as given if its confidence reaches the threshold."""
    limit = F.create_map(*(F.lit(x) for p in thresholds.items() for x in p))[F.col("field")]
    yes, given = F.col("match") == "yes", F.col("conf") >= limit
    no = F.col("match") == "no"
    m = v.groupBy("field").agg(F.count_if(yes & given).alias("tp"), F.count_if(no & ~given).alias("tn"), F.count_if(no & given).alias("fp"), F.count_if(yes & ~given).alias("fn"), F.count_if(F.col("match") == "skip").alias("skipped"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return m.withColumns({"accuracy": percent(tp + tn, tp + tn + fp + fn), "precision": percent(tp, tp + fp), "recall": percent(tp, tp + fn), "f1": percent(2 * tp, 2 * tp + fp + fn)})


def accepted(new: DataFrame, current: DataFrame, minima: dict[str, float]) -> DataFrame:
    """Whether every field with a minimum reaches it, and whether it beats the current model's; a field that a model lacks fails."""
    spark = new.sparkSession
    least = spark.createDataFrame([(f, float(x)) for f, x in minima.items()], "field string, least double")
    j = least.join(new.select("field", F.col("accuracy").alias("a")), "field", "left").join(current.select("field", F.col("accuracy").alias("b")), "field", "left")
    reached = lambda test: F.bool_and(F.coalesce(test, F.lit(False)))
    return j.agg(reached(F.col("a") >= F.col("least")).alias("good"), reached(F.col("a") > F.col("b")).alias("better"))


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts by true and predicted class, with totals: all_true and all_pred tell a total from the class null."""
    all_ = lambda c: F.grouping(c).cast("boolean")
    return rows.cube(truth, pred).agg(F.count(F.lit(1)).alias("n"), all_(truth).alias("all_true"), all_(pred).alias("all_pred"))


def class_report(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """precision, recall, f1 and support of every class, null being one; a ratio without cases is 0."""
    one, none = F.lit(1).alias, F.lit(0).alias
    hit = F.col(truth).eqNullSafe(F.col(pred)).cast("int").alias("hit")
    each = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), one("support"), hit, none("said")), F.struct(F.col(pred).alias("class"), none("support"), none("hit"), one("said")))).alias("c"))
    j = each.groupBy("c.class").agg(*(F.sum(f"c.{c}").alias(c) for c in ("support", "hit", "said")))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    hit, said, support = F.col("hit"), F.col("said"), F.col("support")
    return j.select("class", "support", F.round(ratio(hit, said), 6).alias("precision"), F.round(ratio(hit, support), 6).alias("recall"), F.round(ratio(2 * hit, said + support), 6).alias("f1"))


def macro_gate(report: DataFrame, least: float, current: float) -> DataFrame:
    """Macro F1 and whether it reaches a minimum and the current model's."""
    m = report.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))
    return m.withColumn("passed", (F.col("macro_f1") >= least) & (F.col("macro_f1") >= current))


def binary_report(rows: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """Counts of a binary decision and its ratios (0 where there is nothing to divide by)."""
    counts = rows.agg(*(F.count_if(c).alias(n) for n, c in (("tp", truth & pred), ("tn", ~truth & ~pred), ("fp", ~truth & pred), ("fn", truth & ~pred))))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})


def false_ids(rows: DataFrame, truth: Column, pred: Column, key: str) -> DataFrame:
    """The ids of all false decisions, one row each: kind is fp or fn."""
    return rows.where(truth != pred).select(key, F.when(pred, "fp").otherwise("fn").alias("kind"))
