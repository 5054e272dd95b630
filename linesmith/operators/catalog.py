"""Catalog lookups, manufacturer names and their owners, category trees, snapshot differences, and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesmith.functions import text as X

from linesmith.sources.storage import stored

from .tables import first_per_key


def lookup_parts(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (column c; those with separators are left aside) with the catalog rows of the same separator-free number."""
    keyed = items.withColumn("__bare", X.remove_separators(F.col("mfr_part_num")))
    plain = candidates.where(~F.rlike("c", F.lit("[-/.]"))).distinct()
    return plain.join(keyed, F.col("c") == F.col("__bare")).drop("__bare")


def known_keys(lines: DataFrame, items: DataFrame, key: str = "line_id") -> DataFrame:
    """The keys of lines whose own part number or UPC is valid and the catalog has. Only valid numbers are shuffled, so nulls and blanks make no hot key."""
    has = lambda column, valid: lines.where(valid(F.col(column))).select(key, column).join(items.where(valid(F.col(column))).select(column), column, "left_semi").select(key)
    return has("own_part_num", X.is_own_part_number).unionByName(has("upc", X.is_upc)).distinct()


def known_already(lines: DataFrame, items: DataFrame, key: str = "line_id") -> DataFrame:
    """lines with `known`: a valid own part number or UPC that the catalog has."""
    return lines.join(known_keys(lines, items, key).withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def manufacturer_dictionary(rows: DataFrame) -> DataFrame:
    """The dictionary by normalised name: clean name, parent, and whether it counts only at the beginning of a text.

    Rows whose indicator is N, or without a spelling or a clean name, are left out; names are trimmed and upper-cased. Spellings
    come first (of a repeated one the last row in order of ordinal tells, at the place of its first), then clean names that are no
    spelling (their first row tells), then parents that are neither. Of names with the same key the one that comes last wins.
    """
    said = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    indicator = F.upper(F.trim(F.coalesce("match_indicator", F.lit(""))))
    rows = rows.where(F.coalesce("match_indicator", F.lit("")) != "N").select(said("unclean_name").alias("spelling"), said("clean_name").alias("clean_name"), said("parent_name").alias("parent_name"), (indicator == "B").alias("beginning"), "ordinal")
    rows = rows.where("spelling IS NOT NULL AND clean_name IS NOT NULL")
    place, row = F.min("ordinal").alias("place"), F.struct("ordinal", "clean_name", "parent_name", "beginning")
    spellings = rows.groupBy(F.col("spelling").alias("name")).agg(place, F.max(row).alias("r")).select("name", "r.clean_name", "r.parent_name", "r.beginning", F.lit(0).alias("tier"), "place")
    first = F.min(F.struct("ordinal", "parent_name")).alias("r")
    clean = rows.groupBy(F.col("clean_name").alias("name")).agg(place, first).join(spellings.select("name"), "name", "left_anti")
    clean = clean.select("name", F.col("name").alias("clean_name"), "r.parent_name", F.lit(False).alias("beginning"), F.lit(1).alias("tier"), "place")
    parents = rows.where("parent_name IS NOT NULL").groupBy(F.col("parent_name").alias("name")).agg(place)
    parents = parents.join(spellings.select("name"), "name", "left_anti").join(clean.select("name"), "name", "left_anti")
    parents = parents.select("name", F.col("name").alias("clean_name"), F.col("name").alias("parent_name"), F.lit(False).alias("beginning"), F.lit(2).alias("tier"), "place")
    every = spellings.unionByName(clean).unionByName(parents).withColumn("key", X.name_key(F.col("name")))
    return first_per_key(every, ["key"], [F.desc("tier"), F.desc("place"), F.desc("name")]).select("key", "name", "clean_name", "parent_name", "beginning", "tier")


#: The longest dictionary that is broadcast; a longer one is shuffled with the rows.
KNOWN_NAMES = 1 << 17


def at_hand(table: DataFrame, most: int = KNOWN_NAMES) -> DataFrame:
    """A table with one row per key, to be joined to many rows: written once, and broadcast if it is short. The engine's estimate of a dictionary is far off, and names are few and so hot keys."""
    table = stored(table)
    return F.broadcast(table) if table.count() <= most else table


def clean_names(rows: DataFrame, dictionary: DataFrame, name: str) -> DataFrame:
    """rows with clean_name (the name itself if unknown) and was_cleaned."""
    d = at_hand(dictionary.select(F.col("key").alias("__key"), F.col("clean_name").alias("__clean")))
    out = rows.join(d, X.name_key(F.col(name)) == F.col("__key"), "left")
    return out.withColumn("clean_name", F.coalesce("__clean", name)).withColumn("was_cleaned", F.col("__clean").isNotNull()).drop("__key", "__clean")


def relationship(a: Column, b: Column, parent_a: Column, parent_b: Column) -> Column:
    """DIRECT, PARENT (b owns a), CHILD (a owns b), SIBLING or NOT_EQUIVALENT."""
    same = lambda x, y: F.coalesce(X.name_key(x) == X.name_key(y), F.lit(False))
    return F.when(same(a, b), "DIRECT").when(same(parent_a, b), "PARENT").when(same(a, parent_b), "CHILD").when(same(parent_a, parent_b), "SIBLING").otherwise("NOT_EQUIVALENT")


def snapshot_diff(source: DataFrame, index: DataFrame) -> DataFrame:
    """What brings an index up to date. Both have item_id, desc_id, item_modified and desc_modified; source also what is embedded."""
    i = index.select("item_id", "desc_id", F.col("item_modified").alias("__im"), F.col("desc_modified").alias("__dm"), F.lit(True).alias("__i"))
    s = source.select("item_id", "desc_id", "item_modified", "desc_modified", F.lit(True).alias("__s"))
    out = s.join(i, ["item_id", "desc_id"], "full_outer")
    gone, new = F.col("__s").isNull(), F.col("__i").isNull()
    newer = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))  # noqa: E731  a time that is not known is not newer
    action = F.when(gone, "delete").when(new, "create").when(newer("desc_modified", "__dm"), "update_description").when(newer("item_modified", "__im"), "update_item").otherwise("keep")
    return out.select("item_id", "desc_id", action.alias("action"), (~gone & (new | newer("desc_modified", "__dm"))).alias("needs_embedding"))


def unique_descriptions(rows: DataFrame) -> DataFrame:
    """One row per item and cleaned description, the first by description id as text."""
    return first_per_key(rows.withColumn("cleaned", X.clean_description(F.col("description"))), ["item_id", "cleaned"], [F.col("desc_id").cast("string").asc()])


def prefer_primary(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    return primary.unionByName(secondary.join(primary, key, "left_anti"))


def category_paths(categories: DataFrame) -> DataFrame:
    """category_id, root, path and depth of every category, level by level from the roots (without parent, or with an unknown one).

    There are as many rounds as levels; each is stored, so that the plan stays small. A ring of categories has no root, so none
    of it is reached.
    """
    known = categories.select(F.col("category_id").alias("parent_id")).distinct()
    level = stored(categories.join(known, "parent_id", "left_anti").select("category_id", F.col("category_id").alias("root"), F.col("category_name").alias("path"), F.lit(1).alias("depth")))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("category_id").alias("parent_id"), "root", F.col("path").alias("__up"), F.col("depth").alias("__depth"))
        level = stored(categories.join(up, "parent_id").select("category_id", "root", F.concat_ws(" > ", "__up", "category_name").alias("path"), (F.col("__depth") + 1).alias("depth")))
        out = out.unionByName(level)
    return out


def descendants(categories: DataFrame) -> DataFrame:
    """parent_id and category_id for every category and each of its descendants, at any depth."""
    step = categories.where("parent_id IS NOT NULL").select("parent_id", "category_id")
    level = stored(step)
    out = level
    while not level.isEmpty():
        below = step.select(F.col("parent_id").alias("__at"), F.col("category_id").alias("__below"))
        level = stored(level.join(below, F.col("category_id") == F.col("__at")).select("parent_id", F.col("__below").alias("category_id")))
        if not level.where("parent_id = category_id").isEmpty():
            raise ValueError("the categories form a ring")
        out = out.unionByName(level)
    return out


def category_ids(names: DataFrame, categories: DataFrame) -> DataFrame:
    """names (category_name, parent_name) with category_id: of a category without parent if parent_name is null, else of one below
    the parent of that name (the first by id, as the id of equal names too); null if there is none. Case does not count."""
    c = categories.select(F.upper("category_name").alias("__name"), "category_id", "parent_id")
    parents = c.groupBy(F.col("__name").alias("__parent")).agg(F.min("category_id").alias("__pid"))
    keyed = c.groupBy("__name", F.coalesce("parent_id", F.lit("")).alias("__under")).agg(F.min("category_id").alias("category_id"))
    asked = names.join(parents, F.upper("parent_name") == F.col("__parent"), "left").withColumn("__at", F.when(F.col("parent_name").isNull(), "").otherwise(F.col("__pid")))
    return asked.join(keyed, (F.upper("category_name") == F.col("__name")) & (F.col("__at") == F.col("__under")), "left").select(*names.columns, "category_id")


def bad_parent(parent: Column) -> Column:
    """The id under which the store keeps subcategories of BAD (6): 6, a dot and the additional parent."""
    return F.concat(F.lit("6."), parent)


def requeued(jobs: DataFrame, failed_logs: DataFrame) -> DataFrame:
    """The newest job of each line whose log failed, pending again."""
    wanted = failed_logs.select(X.job_id(F.col("id")).alias("id"))
    newest = first_per_key(jobs.join(wanted, "id", "left_semi"), ["line_id"], [F.desc("created_no"), F.asc("id")])
    return newest.withColumn("status", F.lit("pending"))


def next_jobs(jobs: DataFrame, priorities: DataFrame, n: int) -> DataFrame:
    """The next n pending jobs: by priority, then age."""
    out = jobs.where("status = 'pending'").join(priorities, "request_id", "left")
    return out.orderBy(F.desc_nulls_last("priority"), "created_no", "id").limit(n)


def request_progress(jobs: DataFrame) -> DataFrame:
    """Jobs, those done, and whether all are, by request."""
    out = jobs.groupBy("request_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("done", "error")).alias("processed"))
    return out.withColumn("done", F.col("total") == F.col("processed"))


def duplicate_lines(lines: DataFrame, keys: list[str], key: str = "line_id") -> DataFrame:
    """Every line with the first line that agrees with it in all keys (nulls agree) and how many others do.

    Groups can be large, so their lines stay rows: sizes are summed up before the shuffle and joined back.
    """
    made = {f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys}
    rows = lines.select(key, *keys).withColumns(made)
    groups = rows.groupBy(*made).agg(F.min(key).alias("first_line"), (F.count(F.lit(1)) - 1).alias("others"))
    return rows.join(groups, [*made]).select(key, *keys, "first_line", "others")


def byte_budget(rows: DataFrame, size: Column, order: list[str], budget: int, parts: int = 64) -> DataFrame:
    """The longest prefix of rows, in a given total order, whose sizes sum up to the budget at most.

    Two levels of prefix sums: rows are dealt to ranges of the first order column; sums of ranges before give each range its
    offset, so no task sums up more than a range.
    """
    sized = rows.withColumn("__size", size)
    ranged = sized.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged)
    totals = ranged.groupBy("__part").agg(F.sum("__size").alias("__total"))
    before = totals.withColumn("__before", F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    own = F.sum("__size").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "__part").where(F.col("__before") <= budget).withColumn("__sum", own + F.col("__before")).where(F.col("__sum") <= budget).drop("__size", "__part", "__before", "__sum")
