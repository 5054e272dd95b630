"""Reading, changing and assembling tables. A change is a new snapshot: every function returns the DataFrame to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A scan of a database table in ranges of a numeric key, which replaces paging."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.options(**options).load()


def select_documents(docs: DataFrame, columns: list[str] | None = None, where: Column | None = None, order: list[Column] | None = None, top: int | None = None) -> DataFrame:
    out = docs if where is None else docs.where(where)
    out = out.orderBy(*order) if order else out
    out = out if top is None else out.limit(top)
    return out.select(*columns) if columns else out


def count_documents(docs: DataFrame, where: Column) -> DataFrame:
    return docs.agg(F.count_if(where).alias("n"))


def catalog(items: DataFrame, descriptions: DataFrame, active_only: bool = True) -> DataFrame:
    """Items with their descriptions that are not empty, active ones alone if asked."""
    d = descriptions.where("description IS NOT NULL AND description <> ''")
    return items.join(d.where("active = 'Y'") if active_only else d, "item_id")


def found(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids, key, "left_semi")


def missing(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.join(rows, key, "left_anti")


def not_in(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows whose key is NOT IN the values of the same column, as SQL has it: a null among them leaves no row, and a null key only stays beside no values at all.

    SQL's own form broadcasts all values; here they are shuffled, and what is broadcast is one row of counts.
    """
    counts = values.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(key).isNull()).alias("__nulls"))
    left = rows.join(values.where(F.col(key).isNotNull()).select(key), key, "left_anti").select(*rows.columns)
    return left.crossJoin(F.broadcast(counts)).where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull())).drop("__n", "__nulls")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order (which must be total for a definite result)."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def insert_new(store: DataFrame, docs: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """What is appended, and the ids that were there already or came twice."""
    ranked = docs.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    known = store.select(key).distinct().withColumn("__known", F.lit(True))
    marked = ranked.join(known, key, "left")
    fresh = F.col("__known").isNull() & (F.col("__r") == 1)
    return marked.where(fresh).drop("__r", "__known"), marked.where(~fresh).select(key)


def upsert(store: DataFrame, docs: DataFrame, key: str, version: str) -> DataFrame:
    """The newest document of every id; of equal versions the incoming one."""
    both = store.withColumn("__new", F.lit(0)).unionByName(docs.withColumn("__new", F.lit(1)))
    return first_per_key(both, [key], [F.desc(version), F.desc("__new")]).drop("__new")


def patch_nested(docs: DataFrame, patches: DataFrame, key: str, struct: str, fields: list[str], drop: list[str] | None = None) -> DataFrame:
    """Sets fields of a struct from a table of patches (columns key and fields), and drops others, for the ids that are patched."""
    p = patches.select(key, F.struct(*fields).alias("__p"))
    out = docs.join(p, key, "left")
    patched = F.col(struct)
    for f in fields:
        patched = patched.withField(f, F.when(F.col("__p").isNotNull(), F.col(f"__p.{f}")).otherwise(F.col(f"{struct}.{f}")))
    return out.withColumn(struct, patched.dropFields(*drop) if drop else patched).drop("__p")


def patch_paths(docs: DataFrame, patches: DataFrame, key: str, replace: dict[str, str], append: dict[str, str], drop: list[str]) -> DataFrame:
    """Patches of documents at paths (column.field, or a column): values are set or added, values are appended to lists, fields are removed.

    replace and append name the columns of patches (one row per key) with the values. A path that is set need not exist in its
    struct, which then has it for all documents, null where nothing was set. A null list gets a list of the one value. Only
    patched documents change, but for a removed field, which all of them lose, as they share one schema.
    """
    out = docs.join(patches.select(key, F.struct(*{*replace.values(), *append.values()}).alias("__p")), key, "left")
    hit = F.col("__p").isNotNull()
    fields = {c: set(docs.schema[c].dataType.names) for c in docs.columns if hasattr(docs.schema[c].dataType, "names")}

    def at(path: str) -> Column:
        column, _, field = path.partition(".")
        known = not field or field in fields[column]
        return F.col(path) if known else F.lit(None)

    def put(df: DataFrame, path: str, value: Column) -> DataFrame:
        column, _, field = path.partition(".")
        return df.withColumn(column, F.col(column).withField(field, value) if field else value)

    for path, source in replace.items():
        out = put(out, path, F.when(hit, F.col(f"__p.{source}")).otherwise(at(path)))
    for path, source in append.items():
        one = F.array(F.col(f"__p.{source}"))
        out = put(out, path, F.when(hit, F.coalesce(F.concat(at(path), one), one)).otherwise(at(path)))
    for path in drop:
        column, _, field = path.partition(".")
        out = out.withColumn(column, F.col(column).dropFields(field)) if field else out.drop(column)
    return out.drop("__p")


def sparse_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str], audit: dict[str, Column] | None = None) -> DataFrame:
    """Each column is replaced where the update has a value; the audit columns are stamped on every row that is updated."""
    u = updates.select(key, F.struct(*columns).alias("__u"))
    out = target.join(u, key, "left")
    new = {c: F.coalesce(F.col(f"__u.{c}"), F.col(c)) for c in columns}
    new |= {c: F.when(F.col("__u").isNotNull(), v).otherwise(F.col(c)) for c, v in (audit or {}).items()}
    return out.withColumns(new).drop("__u")


def merge_rows(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the source's values that are not null win."""
    columns = [c for c in target.columns if c != key]
    s = source.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return target.join(s, key, "full_outer").select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def bulk_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets columns (to null too) for the keys of updates, which holds each key once."""
    u = updates.select(key, F.struct(*columns).alias("__u"))
    out = target.join(u, key, "left")
    return out.withColumns({c: F.when(F.col("__u").isNotNull(), F.col(f"__u.{c}")).otherwise(F.col(c)) for c in columns}).drop("__u")


def set_status(target: DataFrame, ids: DataFrame, key: str, column: str, value: str) -> DataFrame:
    return bulk_update(target, ids.select(key).distinct().withColumn(column, F.lit(value)), key, [column])


def insert_missing(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return target.unionByName(rows.join(target, key, "left_anti"))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    return target.where(~F.coalesce(condition, F.lit(False)))


def feed_items(feed: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of a supplier feed (part, name, upc, code) that the catalog lacks.

    The loose form keeps a row unless an item of its UPC has an own part number; the strict form drops it when part, name and
    UPC are all known.
    """
    if strict:
        return feed.join(items.select(F.col("mfr_part_num").alias("part"), F.col("mfr_name").alias("name"), "upc"), ["part", "name", "upc"], "left_anti")
    return feed.join(items.select("upc", "own_part_num"), "upc", "left").where("own_part_num IS NULL").drop("own_part_num").select(*feed.columns)


def feed_descriptions(feed: DataFrame, items: DataFrame, version: str, source: str) -> DataFrame:
    """Second step of the load: the descriptions of a feed (upc, code, part, desc_id, descr), each for every item of its UPC.

    Rows without a code, or with a part number of four characters or fewer, are left out.
    """
    rows = feed.where((F.length("part") > 4) & F.col("code").isNotNull()).select("upc", F.col("desc_id").alias("source_rec_id"), F.col("descr").alias("description"))
    out = rows.join(items.select("item_id", "upc"), "upc")
    return out.select("item_id", F.lit(source).alias("source_name"), "source_rec_id", "description", F.lit(version).alias("train_version"), F.lit("Y").alias("active"))


def log_documents(lines: DataFrame, request: Column, line: Column, parts: dict[str, list[str]]) -> DataFrame:
    """Nested log documents with the id request-line."""
    return lines.select(F.concat_ws("-", request, line).alias("id"), *(F.struct(*c).alias(n) for n, c in parts.items()))


def job_documents(requests: DataFrame, request: str = "request_id", ids: str = "ids") -> DataFrame:
    """A job per line of a request."""
    jobs = requests.select(request, F.size(ids).alias("total_ids_in_req"), F.explode(ids).alias("line_id"))
    return jobs.select(F.concat_ws("~", request, "line_id").alias("id"), request, "line_id", "total_ids_in_req", F.lit("pending").alias("status"))


def json_payload(*columns: str) -> Column:
    """JSON of the columns that are not null."""
    return F.to_json(F.struct(*columns))


def chat_records(rows: DataFrame, system: str, question: Column, answer: Column) -> DataFrame:
    """A line of chat-format JSON per row."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(F.to_json(F.struct(F.array(say("system", F.lit(system)), say("user", question), say("assistant", answer)).alias("messages"))).alias("value"))


def class_location(folder: str, label: Column, uid: Column) -> Column:
    return F.concat_ws("/", F.lit(folder), F.upper(label), F.concat(uid.cast("string"), F.lit(".txt")))


def class_manifest(rows: DataFrame, folder: str) -> DataFrame:
    """A row per class: how many files it has, and the first and last location. rows: uid, class."""
    place = rows.select("class", class_location(folder, F.col("class"), F.col("uid")).alias("location"))
    return place.groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.min("location").alias("first"), F.max("location").alias("last"))


def write_labelled_text(rows: DataFrame, path: str) -> None:
    """One folder of text files per class. rows: class, description."""
    rows.select("class", F.col("description").alias("value")).write.partitionBy("class").mode("overwrite").text(path)


def finished_status(status: Column) -> Column:
    """The store's states as the queue names them."""
    names = F.create_map(*(F.lit(x) for x in ("pending", "queued", "processing", "in_progress", "done", "completed", "error", "failed")))
    return names[status]


def without_vectors(df: DataFrame) -> DataFrame:
    """df without vectors and service columns (@...), its not-a-number values as null."""
    keep = [(n, t) for n, t in df.dtypes if not n.startswith("@") and t not in ("array<float>", "array<double>")]
    return df.select(*(F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")).alias(n) if t in ("float", "double") else F.col(f"`{n}`") for n, t in keep))


def lemmatised(rows: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key and text with every token replaced by its lemma, where the lexicon (token, lemma; one row per token) has one."""
    tokens = rows.select(key, F.posexplode(F.split(text, r"\s+")).alias("pos", "token"))
    found = tokens.join(lexicon.select("token", "lemma"), "token", "left").select(key, F.struct("pos", F.coalesce("lemma", "token").alias("t")).alias("s"))
    return found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), " ").alias(text))
