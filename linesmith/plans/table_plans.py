"""Queries of sources, sinks and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesmith.operators import tables as T
from linesmith.sources.fixtures import Fixtures

from .base import Plans

P = Plans()


@P.query("jobs", sql="SELECT id, status, (SELECT count(*) FROM jobs WHERE retry_count > 3) AS n_retried FROM jobs WHERE status = 'error' AND retry_count > 3 ORDER BY created_no DESC LIMIT 25")
def s01_s03_s04_select_and_count(t: Fixtures) -> DataFrame:
    top = T.select_documents(t.jobs, ["id", "status"], F.col("status").eqNullSafe("error") & (F.col("retry_count") > 3), [F.desc("created_no")], 25)
    return top.join(F.broadcast(T.count_documents(t.jobs, F.col("retry_count") > 3).withColumnRenamed("n", "n_retried")))


@P.query("items", "item_descriptions", sql="SELECT i.item_id, desc_id, d.description, active FROM items i JOIN item_descriptions d ON i.item_id = d.item_id WHERE description <> '' AND active = 'Y'")
def s05_active_catalog(t: Fixtures) -> DataFrame:
    return T.catalog(t.items.drop("source_name"), t.item_descriptions).select("item_id", "desc_id", "description", "active")


_IDS = "SELECT line_id + CASE WHEN line_id % 6 = 0 THEN 7 ELSE 0 END AS line_id FROM invoice_lines WHERE line_id % 3 = 0"


@P.query("invoice_lines", sql=f", ids AS ({_IDS}) SELECT line_id, 'found' AS what FROM invoice_lines WHERE line_id IN (SELECT line_id FROM ids) UNION ALL SELECT line_id, 'missing' FROM ids WHERE line_id NOT IN (SELECT line_id FROM invoice_lines)")
def s06_found_and_missing(t: Fixtures) -> DataFrame:
    lines = t.invoice_lines.select("line_id")
    ids = lines.where("line_id % 3 = 0").selectExpr("line_id + CASE WHEN line_id % 6 = 0 THEN 7 ELSE 0 END AS line_id")
    return T.found(lines, ids, "line_id").withColumn("what", F.lit("found")).unionByName(T.missing(lines, ids, "line_id").withColumn("what", F.lit("missing")))


@P.query(
    "jobs",
    sql="""SELECT id, created_no, 'new' AS what FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_no) AS r FROM (SELECT request_id || '' AS id, created_no FROM jobs)) WHERE r = 1 AND CAST(id AS BIGINT) % 2 = 0
      UNION ALL SELECT id, NULL, 'duplicate' FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_no) AS r FROM (SELECT request_id || '' AS id, created_no FROM jobs)) WHERE r > 1 OR CAST(id AS BIGINT) % 2 = 1""",
)
def s07_insert_reporting_duplicates(t: Fixtures) -> DataFrame:
    docs = t.jobs.select(F.col("request_id").cast("string").alias("id"), "created_no")
    new, old = T.insert_new(docs.where("CAST(id AS BIGINT) % 2 = 1"), docs, "id", [F.asc("created_no")])
    return new.withColumn("what", F.lit("new")).unionByName(old.withColumn("what", F.lit("duplicate")), allowMissingColumns=True)


@P.query(
    "jobs",
    sql="""SELECT request_id, created_no, status FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY v DESC, n DESC) AS r FROM (
      SELECT request_id, created_no, status, created_no AS v, 0 AS n FROM jobs WHERE created_no % 3 = 0 UNION ALL SELECT request_id, created_no, 'patched', created_no - 1, 1 FROM jobs WHERE created_no % 3 = 1)) WHERE r = 1""",
)
def s08_upsert(t: Fixtures) -> DataFrame:
    j = t.jobs.select("request_id", "created_no", "status", F.col("created_no").alias("v"))
    new = j.where("created_no % 3 = 1").withColumns({"status": F.lit("patched"), "v": F.col("created_no") - 1})
    return T.upsert(j.where("created_no % 3 = 0"), new, "request_id", "v").drop("v")


@P.query("jobs", sql="SELECT id, CASE WHEN created_no % 4 = 0 THEN 'reset' ELSE status END AS status, CASE WHEN created_no % 4 = 0 THEN 0 ELSE retry_count END AS retries FROM jobs")
def s09_patch_nested(t: Fixtures) -> DataFrame:
    docs = t.jobs.select("id", F.struct("status", "retry_count", "updated_s").alias("state"))
    patches = t.jobs.where("created_no % 4 = 0").select("id", F.lit("reset").alias("status"), F.lit(0).cast("long").alias("retry_count"))
    return T.patch_nested(docs, patches, "id", "state", ["status", "retry_count"], ["updated_s"]).select("id", "state.status", F.col("state.retry_count").alias("retries"))


@P.query("jobs", sql="SELECT id, CASE WHEN created_no % 4 = 0 THEN 'reset' ELSE status END AS status, CASE WHEN created_no % 4 = 0 THEN created_no END AS added, CAST(CASE WHEN created_no % 4 <> 0 THEN created_no % 3 WHEN created_no % 3 = 0 THEN 1 ELSE created_no % 3 + 1 END AS INT) AS n, CASE WHEN created_no % 4 = 0 THEN created_no WHEN created_no % 3 > 0 THEN 7 END AS last FROM jobs")
def s09_patch_paths(t: Fixtures) -> DataFrame:
    """Values set, added to a struct, appended to a list and removed at paths of documents."""
    lists = F.expr("CASE CAST(created_no % 3 AS INT) WHEN 0 THEN CAST(NULL AS array<bigint>) WHEN 1 THEN array(7L) ELSE array(6L, 7L) END")
    docs = t.jobs.select("id", F.struct("status", "updated_s").alias("state"), lists.alias("seen"))
    patches = t.jobs.where("created_no % 4 = 0").select("id", F.lit("reset").alias("s"), F.col("created_no").cast("long").alias("c"))
    out = T.patch_paths(docs, patches, "id", {"state.status": "s", "state.added": "c"}, {"seen": "c"}, ["state.updated_s"])
    return out.select("id", "state.*", F.coalesce(F.array_size("seen"), F.lit(0)).alias("n"), F.try_element_at("seen", F.lit(-1)).alias("last"))


@P.query(
    "invoice_lines",
    sql="""SELECT line_id, CASE WHEN line_id % 2 = 0 AND line_id % 4 <> 0 THEN 'M' || line_id ELSE mfr_name END AS mfr_name, CASE WHEN line_id % 2 = 0 AND line_id % 3 = 0 THEN 'P' ELSE mfr_part_num END AS mfr_part_num,
      CASE WHEN line_id % 2 = 0 THEN 'AI' ELSE 'load' END AS updated_by FROM invoice_lines""",
)
def s10_sparse_update(t: Fixtures) -> DataFrame:
    lines = t.invoice_lines.select("line_id", "mfr_name", "mfr_part_num", F.lit("load").alias("updated_by"))
    new = lines.where("line_id % 2 = 0").selectExpr("line_id", "CASE WHEN line_id % 4 <> 0 THEN concat('M', line_id) END AS mfr_name", "CASE WHEN line_id % 3 = 0 THEN 'P' END AS mfr_part_num")
    return T.sparse_update(lines, new, "line_id", ["mfr_name", "mfr_part_num"], {"updated_by": F.lit("AI")})


@P.query(
    "stage_results",
    sql="""SELECT line_id, CAST(coalesce(max(conf_mfr) FILTER (stage_no = 2), max(conf_mfr)) AS INT) AS conf_mfr, 'AI-' || coalesce(max(stage_name) FILTER (stage_no = 2), max(stage_name)) AS step_nm
      FROM stage_results WHERE (stage_no = 1 AND line_id % 3 <> 0) OR (stage_no = 2 AND line_id % 3 <> 1) GROUP BY line_id""",
)
def s11_merge_tracking(t: Fixtures) -> DataFrame:
    rows = t.stage_results.select("line_id", F.col("conf_mfr").cast("int").alias("conf_mfr"), F.concat(F.lit("AI-"), "stage_name").alias("step_nm"), "stage_no")
    old, new = rows.where("stage_no = 1 AND line_id % 3 <> 0").drop("stage_no"), rows.where("stage_no = 2 AND line_id % 3 <> 1").drop("stage_no")
    return T.merge_rows(old, new, "line_id")


@P.query("item_descriptions", sql="SELECT desc_id, CASE WHEN train_version = 'FT_PROGRESS' THEN '2026-1' WHEN item_id % 50 = 0 THEN 'HELD' ELSE train_version END AS train_version FROM item_descriptions")
def s12_s13_bulk_updates(t: Fixtures) -> DataFrame:
    d = t.item_descriptions.select("desc_id", "item_id", "train_version")
    held = T.set_status(d, d.where("item_id % 50 = 0"), "desc_id", "train_version", "HELD")
    done = d.where("train_version = 'FT_PROGRESS'").select("desc_id", F.lit("2026-1").alias("train_version"))
    return T.bulk_update(held, done, "desc_id", ["train_version"]).select("desc_id", "train_version")


@P.query("categories", sql="SELECT category_id, category_name FROM categories WHERE NOT (parent_id IS NOT NULL AND parent_id = '6') UNION ALL SELECT '7', 'NEW'")
def s14_s15_s23_dml(t: Fixtures) -> DataFrame:
    c = t.categories.select("category_id", "category_name", "parent_id")
    rows = c.sparkSession.createDataFrame([("7", "NEW", None), ("6", "TWICE", None)], c.schema)
    return T.delete_where(T.insert_missing(c, rows, "category_id"), F.col("parent_id") == "6").select("category_id", "category_name")


_FEED = "SELECT mfr_part_num AS part, mfr_name AS name, CASE WHEN item_id % 5 = 0 THEN 'U' || item_id ELSE upc END AS upc, unspsc AS code FROM items WHERE item_id % 2 = 0"


@P.query(
    "items",
    sql=f", feed AS ({_FEED}) SELECT 'loose' AS form, f.part, f.upc FROM feed f LEFT JOIN items i ON i.upc = f.upc WHERE i.own_part_num IS NULL UNION ALL SELECT 'strict', part, upc FROM feed f WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.mfr_part_num = f.part AND i.mfr_name = f.name AND i.upc = f.upc)",
)
def s16_catalog_load(t: Fixtures) -> DataFrame:
    feed = t.items.where("item_id % 2 = 0").selectExpr("mfr_part_num AS part", "mfr_name AS name", "CASE WHEN item_id % 5 = 0 THEN concat('U', item_id) ELSE upc END AS upc", "unspsc AS code")
    loose, strict = T.feed_items(feed, t.items), T.feed_items(feed, t.items, strict=True)
    return loose.select(F.lit("loose").alias("form"), "part", "upc").unionByName(strict.select(F.lit("strict").alias("form"), "part", "upc"))


@P.query("items", sql=f", feed AS ({_FEED}) SELECT i.item_id, 'FEED' AS source_name, 'D' || f.part AS source_rec_id, f.name || ' ' || f.part AS description, '2025-1' AS train_version, 'Y' AS active FROM feed f JOIN items i ON i.upc = f.upc WHERE length(f.part) > 4 AND f.code IS NOT NULL")
def s16_feed_descriptions(t: Fixtures) -> DataFrame:
    feed = t.items.where("item_id % 2 = 0").selectExpr("mfr_part_num AS part", "CASE WHEN item_id % 5 = 0 THEN concat('U', item_id) ELSE upc END AS upc", "unspsc AS code", "concat('D', mfr_part_num) AS desc_id", "concat(mfr_name, ' ', mfr_part_num) AS descr")
    return T.feed_descriptions(feed, t.items, "2025-1", "FEED")


@P.query("invoice_lines", sql="SELECT header_id || '-' || line_id AS id, description AS text, line_status AS status, '{' || array_to_string(list_filter(['\"item_id\":' || item_id, '\"upc\":\"' || upc || '\"'], lambda x: x IS NOT NULL), ',') || '}' AS payload FROM invoice_lines")
def s17_s19_log_documents(t: Fixtures) -> DataFrame:
    docs = T.log_documents(t.invoice_lines, F.col("header_id"), F.col("line_id"), {"line": ["description", "line_status"], "output": ["item_id", "upc"]})
    return docs.select("id", F.col("line.description").alias("text"), F.col("line.line_status").alias("status"), T.json_payload("output.item_id", "output.upc").alias("payload"))


@P.query("invoice_lines", sql="SELECT header_id || '~' || line_id AS id, CAST(count(*) OVER (PARTITION BY header_id) AS INT) AS total_ids_in_req, 'pending' AS status FROM invoice_lines")
def s18_job_documents(t: Fixtures) -> DataFrame:
    requests = t.invoice_lines.groupBy(F.col("header_id").alias("request_id")).agg(F.collect_list("line_id").alias("ids"))
    return T.job_documents(requests).select("id", "total_ids_in_req", "status")


@P.query(
    "items", "item_descriptions",
    sql="""SELECT '{"messages":[{"role":"system","content":"Extract."},{"role":"user","content":"' || description || '"},{"role":"assistant","content":"' || mfr_part_num || '"}]}' AS value
      FROM items JOIN item_descriptions USING (item_id) WHERE active = 'Y' AND train_version = 'NEW'""",
)
def s20_j02_chat_export(t: Fixtures) -> DataFrame:
    rows = T.catalog(t.items.drop("source_name"), t.item_descriptions).where("train_version = 'NEW'")
    return T.chat_records(rows, "Extract.", F.col("description"), F.col("mfr_part_num"))


@P.query("classifier_training", sql="SELECT class, count(*) AS files, min('docs/' || upper(class) || '/' || uid || '.txt') AS first, max('docs/' || upper(class) || '/' || uid || '.txt') AS last FROM classifier_training GROUP BY class")
def s21_p42_label_manifest(t: Fixtures) -> DataFrame:
    return T.class_manifest(t.classifier_training.select("uid", "class"), "docs")


@P.query("jobs", sql="SELECT id, updated_s, updated_s + retry_count AS ended_s FROM jobs WHERE updated_s >= 60000 - 3 * 14400")
def s22_p38_run_times(t: Fixtures) -> DataFrame:
    return t.jobs.where(F.col("updated_s") >= 60000 - 3 * 14400).select("id", "updated_s", (F.col("updated_s") + F.col("retry_count")).alias("ended_s"))


@P.query("jobs", sql="SELECT id, CASE status WHEN 'pending' THEN 'queued' WHEN 'processing' THEN 'in_progress' WHEN 'done' THEN 'completed' ELSE 'failed' END AS queue_status, CASE WHEN status = 'processing' THEN updated_s END AS started_s, CASE WHEN status = 'done' THEN updated_s END AS completed_s FROM jobs")
def s24_state_transitions(t: Fixtures) -> DataFrame:
    s = F.col("status")
    return t.jobs.select("id", T.finished_status(s).alias("queue_status"), F.when(s == "processing", F.col("updated_s")).alias("started_s"), F.when(s == "done", F.col("updated_s")).alias("completed_s"))


_LEXICON = "SELECT DISTINCT w AS token, left(w, 3) AS lemma FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) % 2 = 0"


@P.query(sql=f"WITH lex AS ({_LEXICON}), t AS (SELECT p_partkey, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS token FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)) SELECT p_partkey, string_agg(coalesce(lemma, t.token), ' ' ORDER BY pos) AS p_name FROM t LEFT JOIN lex ON lex.token = t.token GROUP BY p_partkey")
def p03_lemmatised(t: Fixtures) -> DataFrame:
    lexicon = t.part.select(F.explode(F.split("p_name", " ")).alias("token")).distinct().where("length(token) % 2 = 0").withColumn("lemma", F.left("token", F.lit(3)))
    return T.lemmatised(t.part.select("p_partkey", "p_name"), lexicon, "p_partkey", "p_name")


@P.query(sql="SELECT vec_id, label, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id AS DOUBLE) END AS amount, CASE WHEN vec_id % 3 <> 0 THEN '{\"label\":' || label || ',\"amount\":' || vec_id || '.0}' ELSE '{\"label\":' || label || '}' END AS doc FROM embeddings")
def p35_without_vectors(t: Fixtures) -> DataFrame:
    rows = t.embeddings.withColumns({"@search.score": F.lit(1.0), "amount": F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("vec_id").cast("double"))})
    plain = T.without_vectors(rows)
    return plain.withColumn("doc", T.json_payload("label", "amount"))


@P.query(sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') AS central, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AS in_window FROM events")
def p37_p38_times(t: Fixtures) -> DataFrame:
    from linesmith.functions import text as X

    ts = F.col("ts").cast("timestamp_ntz")
    as_of = F.lit("2024-01-13 15:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", X.utc_iso(ts).alias("iso"), F.date_format(X.central_time(ts), "yyyy-MM-dd HH:mm").alias("central"), X.in_days_before(ts, as_of, 3).alias("in_window"))
