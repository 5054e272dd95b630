"""Queries of lookups, names, trees, differences, jobs, sets and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesmith.functions import text as X
from linesmith.operators import catalog as C
from linesmith.operators.tables import first_per_key, not_in
from linesmith.sources.fixtures import Fixtures
from linesmith.sources.storage import stored

from .base import Plans
from .text_plans import _TEXTS, CANDIDATES

P = Plans()

_KEY = "regexp_replace(upper(trim({})), '[&\\-/\\\\_.,() ]', '', 'g')"


def key(c: str) -> str:
    return _KEY.format(c)


#: The dictionary in SQL, after the view of manufacturers.
DICTIONARY = f"""
, said AS (
  SELECT upper(trim(unclean_name)) AS name, upper(trim(clean_name)) AS clean_name, nullif(upper(trim(parent_name)), '') AS parent_name, upper(trim(coalesce(match_indicator, ''))) = 'B' AS beginning, ordinal
  FROM manufacturers WHERE coalesce(match_indicator, '') <> 'N' AND trim(unclean_name) <> '' AND trim(clean_name) <> ''),
t0 AS (SELECT name, clean_name, parent_name, beginning, 0 AS tier, min(ordinal) OVER (PARTITION BY name) AS place FROM said QUALIFY row_number() OVER (PARTITION BY name ORDER BY ordinal DESC) = 1),
t1 AS (SELECT clean_name AS name, clean_name, parent_name, false AS beginning, 1 AS tier, ordinal AS place FROM said WHERE clean_name NOT IN (SELECT name FROM t0) QUALIFY row_number() OVER (PARTITION BY clean_name ORDER BY ordinal) = 1),
t2 AS (SELECT parent_name AS name, parent_name AS clean_name, parent_name, false AS beginning, 2 AS tier, min(ordinal) AS place FROM said WHERE parent_name IS NOT NULL AND parent_name NOT IN (SELECT name FROM t0) AND parent_name NOT IN (SELECT name FROM t1) GROUP BY parent_name),
dictionary AS (SELECT {key('name')} AS key, name, clean_name, parent_name, beginning, tier FROM (FROM t0 UNION ALL FROM t1 UNION ALL FROM t2) QUALIFY row_number() OVER (PARTITION BY {key('name')} ORDER BY tier DESC, place DESC) = 1)"""


@P.query("invoice_lines", "items", sql=_TEXTS + CANDIDATES + ", plain AS (SELECT description, c FROM cands UNION SELECT description, regexp_replace(c, '[-/]', '', 'g') FROM cands UNION SELECT description, bare FROM cands) SELECT description, c, item_id FROM plain JOIN items ON c = regexp_replace(mfr_part_num, '[-/.]', '', 'g') WHERE NOT regexp_matches(c, '[-/.]')")
def j01_lookup_parts(t: Fixtures) -> DataFrame:
    texts = t.invoice_lines.select("description").distinct()
    cands = texts.select("description", F.explode(X.lookup_variations(X.part_number_candidates(F.col("description")))).alias("c"))
    return C.lookup_parts(cands, t.items).select("description", "c", "item_id")


@P.query(
    "invoice_lines", "items",
    sql="""SELECT line_id, (regexp_matches(coalesce(own_part_num, ''), '^AK[0-9]+$') AND own_part_num IN (SELECT own_part_num FROM items WHERE own_part_num IS NOT NULL)) OR (regexp_matches(coalesce(upc, ''), '^[0-9]{8,12}$') AND upc IN (SELECT upc FROM items)) AS known FROM invoice_lines""",
)
def j03_known_already(t: Fixtures) -> DataFrame:
    return C.known_already(t.invoice_lines, t.items).select("line_id", F.col("known"))


@P.query(
    "invoice_lines", "items", "item_descriptions",
    sql="""SELECT item_id, source_name, 'no description' AS what FROM items WHERE item_id NOT IN (SELECT item_id FROM item_descriptions) AND source_name IS NOT NULL
      UNION ALL SELECT i.item_id, i.source_name, 'own number' FROM invoice_lines l JOIN items i ON i.own_part_num = l.own_part_num
      UNION ALL SELECT i.item_id, d.train_version, 'version' FROM items i LEFT JOIN (SELECT DISTINCT item_id, train_version FROM item_descriptions) d ON d.item_id = i.item_id WHERE d.train_version IS NOT NULL""",
)
def j04_j05_j06_sql_joins(t: Fixtures) -> DataFrame:
    versions = stored(t.item_descriptions.select("item_id", "train_version").dropDuplicates())
    none = not_in(t.items, versions.select("item_id").distinct(), "item_id").where("source_name IS NOT NULL").select("item_id", "source_name", F.lit("no description").alias("what"))
    own = t.invoice_lines.select("own_part_num").join(t.items, "own_part_num").select("item_id", "source_name", F.lit("own number").alias("what"))
    version = t.items.select("item_id").join(versions, "item_id", "left").where("train_version IS NOT NULL").select("item_id", F.col("train_version").alias("source_name"), F.lit("version").alias("what"))
    return none.unionByName(own).unionByName(version)


@P.query("manufacturers", sql=DICTIONARY + " SELECT * FROM dictionary")
def w14_manufacturer_dictionary(t: Fixtures) -> DataFrame:
    return C.manufacturer_dictionary(t.manufacturers)


@P.query("manufacturers", "items", sql=DICTIONARY + f" SELECT item_id, coalesce(d.clean_name, mfr_name) AS clean_name, d.clean_name IS NOT NULL AS was_cleaned FROM items LEFT JOIN dictionary d ON d.key = {key('mfr_name')}")
def j07_clean_names(t: Fixtures) -> DataFrame:
    return C.clean_names(t.items, C.manufacturer_dictionary(t.manufacturers), "mfr_name").select("item_id", "clean_name", "was_cleaned")


_RELATION = "CASE WHEN a = b THEN 'DIRECT' WHEN ap = b THEN 'PARENT' WHEN a = bp THEN 'CHILD' WHEN ap = bp THEN 'SIBLING' ELSE 'NOT_EQUIVALENT' END"


@P.query(
    "items", "manufacturers",
    sql=f""", o AS (SELECT item_id, clean_name AS n, parent_name AS p FROM items JOIN manufacturers ON unclean_name = mfr_name),
      q AS (SELECT x.item_id, 'next' AS what, x.n AS a, y.n AS b, x.p AS ap, y.p AS bp FROM o x JOIN o y ON y.item_id = x.item_id + 1
        UNION ALL SELECT x.item_id, 'owner of next', x.n, y.p, x.p, NULL FROM o x JOIN o y ON y.item_id = x.item_id + 1 UNION ALL SELECT x.item_id, 'owner', x.p, y.n, NULL, y.p FROM o x JOIN o y ON y.item_id = x.item_id + 1)
      SELECT item_id, what, a, b, {_RELATION} AS relation FROM q""",
)
def j08_relationships(t: Fixtures) -> DataFrame:
    """The manufacturer of every item, and its owner, against those of the next item."""
    own = t.items.join(t.manufacturers, F.col("mfr_name") == F.col("unclean_name")).select("item_id", F.col("clean_name").alias("n"), F.col("parent_name").alias("p"))
    both = own.join(own.select((F.col("item_id") - 1).alias("item_id"), F.col("n").alias("m"), F.col("p").alias("q")), "item_id")
    none = F.lit(None).cast("string")
    pair = lambda what, a, b, ap, bp: F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), C.relationship(a, b, ap, bp).alias("relation"))
    n, p, m, q = (F.col(c) for c in "npmq")
    return both.select("item_id", F.explode(F.array(pair("next", n, m, p, q), pair("owner of next", n, q, p, none), pair("owner", p, m, none, q))).alias("r")).select("item_id", "r.*")


_DIFF = """, src AS (SELECT item_id, desc_id, day_no AS item_modified, day_no AS desc_modified FROM item_descriptions),
  idx AS (SELECT item_id, desc_id, CASE WHEN desc_id % 11 = 0 THEN item_modified - 1 ELSE item_modified END AS im, CASE WHEN desc_id % 7 = 0 THEN desc_modified - 1 ELSE desc_modified END AS dm FROM src WHERE desc_id % 13 <> 0
    UNION ALL SELECT item_id, -desc_id, 0, 0 FROM src WHERE desc_id % 97 = 0),
  diff AS (SELECT item_id, desc_id, CASE WHEN item_modified IS NULL THEN 'delete' WHEN im IS NULL THEN 'create' WHEN desc_modified > dm THEN 'update_description' WHEN item_modified > im THEN 'update_item' ELSE 'keep' END AS action,
    item_modified IS NOT NULL AND (im IS NULL OR desc_modified > dm) AS needs_embedding FROM src FULL JOIN idx USING (item_id, desc_id))"""


def index_tables(t: Fixtures) -> tuple[DataFrame, DataFrame]:
    """A source and an index that lags behind it."""
    src = t.item_descriptions.selectExpr("item_id", "desc_id", "day_no AS item_modified", "day_no AS desc_modified")
    old = src.where("desc_id % 13 <> 0").selectExpr("item_id", "desc_id", "CASE WHEN desc_id % 11 = 0 THEN item_modified - 1 ELSE item_modified END AS item_modified", "CASE WHEN desc_id % 7 = 0 THEN desc_modified - 1 ELSE desc_modified END AS desc_modified")
    ghosts = src.where("desc_id % 97 = 0").selectExpr("item_id", "-desc_id AS desc_id", "0L AS item_modified", "0L AS desc_modified")
    return src, old.unionByName(ghosts)


@P.query("item_descriptions", sql=_DIFF + " SELECT * FROM diff")
def j11_snapshot_diff(t: Fixtures) -> DataFrame:
    return C.snapshot_diff(*index_tables(t))


@P.query("item_descriptions", sql=_DIFF + " SELECT action, count(*) AS n, count(*) FILTER (needs_embedding) AS embedded FROM diff GROUP BY action")
def a15_sync_counts(t: Fixtures) -> DataFrame:
    return C.snapshot_diff(*index_tables(t)).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_embedding").alias("embedded"))


_CLEAN = r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(description), '[_*|=@^]', ' ', 'g'), '[\r\n]+', ' ', 'g'), ' "-.'), '\s+', ' ', 'g'))"""
UNIQUE = f", uniq AS (SELECT *, {_CLEAN} AS cleaned FROM item_descriptions QUALIFY row_number() OVER (PARTITION BY item_id, {_CLEAN} ORDER BY CAST(desc_id AS STRING)) = 1)"


@P.query("item_descriptions", sql=UNIQUE + " SELECT item_id, desc_id, cleaned FROM uniq")
def w08_unique_descriptions(t: Fixtures) -> DataFrame:
    return C.unique_descriptions(t.item_descriptions).select("item_id", "desc_id", "cleaned")


@P.query("jobs", "invoice_lines", sql="SELECT id, CASE WHEN l.line_id IS NULL THEN 'error' ELSE status END AS status, description FROM jobs j LEFT JOIN invoice_lines l ON l.line_id = j.line_id * 1000 + 1")
def j12_j13_jobs_with_lines(t: Fixtures) -> DataFrame:
    lines = t.invoice_lines.select("line_id", "description")
    jobs = t.jobs.withColumn("line_id", F.col("line_id") * 1000 + 1)
    return jobs.join(lines.withColumn("found", F.lit(True)), "line_id", "left").select("id", F.when(F.col("found").isNull(), "error").otherwise(F.col("status")).alias("status"), "description")


@P.query("jobs", sql="SELECT id, line_id, 'pending' AS status FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_no DESC, id) AS r FROM jobs WHERE status = 'error') WHERE r = 1".replace("line_id,", "request_id AS line_id,"))
def j14_requeue(t: Fixtures) -> DataFrame:
    jobs = t.jobs.withColumn("line_id", F.col("request_id"))
    logs = t.jobs.where("status = 'error'").select(X.log_id(F.col("id")).alias("id"))
    return C.requeued(jobs, logs).select("id", "line_id", "status")


@P.query(
    "categories",
    sql=""", tree(category_id, root, path, depth) AS (
      SELECT category_id, category_id, category_name, 1 FROM categories c WHERE parent_id IS NULL OR parent_id NOT IN (SELECT category_id FROM categories)
      UNION ALL SELECT c.category_id, root, path || ' > ' || c.category_name, depth + 1 FROM categories c JOIN tree ON c.parent_id = tree.category_id) SELECT * FROM tree""",
)
def j15_category_paths(t: Fixtures) -> DataFrame:
    return C.category_paths(t.categories)


@P.query("categories", sql=", d(parent_id, category_id) AS (SELECT parent_id, category_id FROM categories WHERE parent_id IS NOT NULL UNION ALL SELECT d.parent_id, c.category_id FROM d JOIN categories c ON c.parent_id = d.category_id) SELECT * FROM d")
def j15_descendants(t: Fixtures) -> DataFrame:
    return C.descendants(t.categories)


_ASKED = "SELECT DISTINCT lower(c.category_name) AS category_name, p.category_name AS parent_name FROM {categories} c LEFT JOIN {categories} p ON p.category_id = c.parent_id UNION ALL SELECT 'material', 'BAD' UNION ALL SELECT 'LOT', NULL"


@P.query("categories", sql=f", a AS ({_ASKED.format(categories='categories')}) SELECT category_name, parent_name, (SELECT min(c.category_id) FROM categories c WHERE upper(c.category_name) = upper(a.category_name) AND CASE WHEN a.parent_name IS NULL THEN c.parent_id IS NULL ELSE c.parent_id = (SELECT min(p.category_id) FROM categories p WHERE upper(p.category_name) = upper(a.parent_name)) END) AS category_id FROM a")
def j15_category_ids(t: Fixtures) -> DataFrame:
    return C.category_ids(t.spark.sql(_ASKED, categories=t.categories), t.categories)


_CASES = "CASE WHEN category_id = '1.2' THEN 'generic' WHEN category_id = '1.1' THEN 'lot' ELSE 'default' END"


@P.query(
    "invoice_lines",
    sql=f"SELECT line_id, {_CASES} AS route, CASE {_CASES} WHEN 'generic' THEN 'SEMANTIC,VALIDATOR,TUNED,WEB' WHEN 'lot' THEN 'SEMANTIC,COMPLETE' ELSE 'CLASSIFY,SEMANTIC,COMPLETE,VALIDATOR,TUNED,WEB' END AS stages, CASE {_CASES} WHEN 'generic' THEN 'mfr,unspsc' WHEN 'lot' THEN 'mfr' ELSE 'mfr,part,unspsc' END AS fields FROM invoice_lines",
)
def j16_special_cases(t: Fixtures) -> DataFrame:
    from linesmith.operators.cascade import route

    return route(t.invoice_lines).select("line_id", "route", F.array_join("stages", ",").alias("stages"), F.array_join("fields", ",").alias("fields"))


@P.query("items", sql="SELECT upc, mfr_name, 1 AS which FROM items WHERE item_id % 3 = 0 UNION ALL SELECT upc, mfr_name, 2 FROM items WHERE item_id % 2 = 0 AND item_id % 3 <> 0")
def j17_u01_prefer_primary(t: Fixtures) -> DataFrame:
    a, b = t.items.where("item_id % 3 = 0"), t.items.where("item_id % 2 = 0")
    pick = lambda d, n: d.select("upc", "mfr_name", F.lit(n).alias("which"))
    return C.prefer_primary(pick(a, 1), pick(b, 2), "upc")


@P.query("jobs", sql="SELECT request_id FROM jobs WHERE status = 'error' EXCEPT SELECT request_id FROM jobs WHERE retry_count = 6 AND status = 'done'")
def u02_set_difference(t: Fixtures) -> DataFrame:
    return t.jobs.where("status = 'error'").select("request_id").subtract(t.jobs.where("retry_count = 6 AND status = 'done'").select("request_id"))


@P.query("invoice_lines", sql="SELECT line_id, description, mfr_name, mfr_part_num, invoice_num, min(line_id) OVER w AS first_line, count(*) OVER w - 1 AS others FROM invoice_lines WINDOW w AS (PARTITION BY description, mfr_name, mfr_part_num, invoice_num)")
def a01_duplicate_lines(t: Fixtures) -> DataFrame:
    return C.duplicate_lines(t.invoice_lines, ["description", "mfr_name", "mfr_part_num", "invoice_num"])


@P.query(
    "invoice_lines", "items",
    sql="""SELECT 'status' AS what, line_status AS k, count(*) AS n, count(upc) AS filled FROM invoice_lines GROUP BY line_status UNION ALL SELECT 'source', source_name, count(*), count(own_part_num) FROM items GROUP BY source_name
      UNION ALL SELECT 'many', mfr_name, count(DISTINCT unspsc), count(*) FROM items GROUP BY mfr_name HAVING count(DISTINCT unspsc) > 1 UNION ALL SELECT DISTINCT 'size', CAST(p_size AS STRING), 0, 0 FROM items""",
)
def a02_a03_counts(t: Fixtures) -> DataFrame:
    row = lambda what, g, n, m: g.select(F.lit(what).alias("what"), F.col("k"), n.cast("long").alias("n"), m.cast("long").alias("filled"))
    status = t.invoice_lines.groupBy(F.col("line_status").alias("k")).agg(F.count(F.lit(1)).alias("a"), F.count("upc").alias("b"))
    source = t.items.groupBy(F.col("source_name").alias("k")).agg(F.count(F.lit(1)).alias("a"), F.count("own_part_num").alias("b"))
    many = t.items.groupBy(F.col("mfr_name").alias("k")).agg(F.countDistinct("unspsc").alias("a"), F.count(F.lit(1)).alias("b")).where("a > 1")
    sizes = t.items.select(F.col("p_size").cast("string").alias("k")).distinct()
    out = row("status", status, F.col("a"), F.col("b")).unionByName(row("source", source, F.col("a"), F.col("b"))).unionByName(row("many", many, F.col("a"), F.col("b")))
    return out.unionByName(row("size", sizes, F.lit(0), F.lit(0)))


@P.query("jobs", sql="SELECT request_id, count(*) AS total, count(*) FILTER (status IN ('done', 'error')) AS processed, count(*) = count(*) FILTER (status IN ('done', 'error')) AS done FROM jobs GROUP BY request_id")
def a11_request_progress(t: Fixtures) -> DataFrame:
    return C.request_progress(t.jobs)


@P.query("jobs", "priorities", sql="SELECT id, priority FROM jobs LEFT JOIN priorities USING (request_id) WHERE status = 'pending' ORDER BY priority DESC NULLS LAST, created_no, id LIMIT 40")
def t01_t02_next_jobs(t: Fixtures) -> DataFrame:
    return C.next_jobs(t.jobs, t.priorities, 40).select("id", "priority")


@P.query("item_descriptions", sql="SELECT desc_id FROM (SELECT desc_id, sum(octet_length(encode(description))) OVER (ORDER BY desc_id ROWS UNBOUNDED PRECEDING) AS s FROM item_descriptions) WHERE s <= 40000")
def w16_byte_budget(t: Fixtures) -> DataFrame:
    return C.byte_budget(t.item_descriptions.select("desc_id", "description"), F.octet_length("description"), ["desc_id"], 40000).select("desc_id")


@P.query("web_candidates", sql="SELECT line_id, mfr, part, min(cand_no) AS cand_no FROM web_candidates GROUP BY line_id, mfr, part")
def w15_keep_first(t: Fixtures) -> DataFrame:
    return first_per_key(t.web_candidates, ["line_id", "mfr", "part"], [F.asc("cand_no")]).select("line_id", "mfr", "part", "cand_no")


_HASH = "CAST('0x' || substr(md5('s' || {}), 1, 8) AS BIGINT)"


@P.query(
    "invoice_lines",
    sql=f"""SELECT line_id, category_id LIKE '1%' AS material, 'REVIEW' AS line_status FROM invoice_lines WHERE line_status = 'RC-AI'
      QUALIFY row_number() OVER (PARTITION BY category_id LIKE '1%' ORDER BY {_HASH.format('line_id')}, line_id) <= CASE WHEN category_id LIKE '1%' THEN 30 ELSE 10 END""",
)
def t03_t04_review_sample(t: Fixtures) -> DataFrame:
    from linesmith.operators.training import stratified_sample

    lines = t.invoice_lines.where("line_status = 'RC-AI'").withColumn("material", F.col("category_id").like("1%"))
    return stratified_sample(lines, "material", {True: 30, False: 10}, "line_id", "s").select("line_id", "material", F.lit("REVIEW").alias("line_status"))


@P.query("classifier_training", sql=f"SELECT uid, CASE WHEN {_HASH.format('uid')} % 100 < 80 THEN 'train' WHEN {_HASH.format('uid')} % 100 < 90 THEN 'validation' ELSE 'test' END AS part FROM classifier_training")
def t05_split(t: Fixtures) -> DataFrame:
    from linesmith.operators.training import split_part

    return t.classifier_training.select("uid", split_part(F.col("uid"), {"train": 80, "validation": 10, "test": 10}, "s").alias("part"))
