"""Queries of the text and code primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesmith.functions import text as T
from linesmith.sources.fixtures import Fixtures

from linesmith.operators.phrases import texts_with

from .base import Plans

P = Plans()

_CLEAN = r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(description), '[_*|=@^]', ' ', 'g'), '[\r\n]+', ' ', 'g'), ' "-.'), '\s+', ' ', 'g'))"""


@P.query("invoice_lines", sql=f"SELECT line_id, {_CLEAN} AS cleaned, 'x' AS mark FROM invoice_lines")
def p01_clean_description(t: Fixtures) -> DataFrame:
    return t.invoice_lines.select("line_id", T.clean_description(F.col("description")).alias("cleaned"), F.lit("x").alias("mark"))


def _model(c: str) -> str:
    c = f"replace(replace({c}, '$', ' dollars '), '%', ' percent ')"
    c = rf"replace(replace(regexp_replace(regexp_replace({c}, '([0-9])\.', '\1§', 'g'), '\.([0-9])', '§\1', 'g'), '.', ''), '§', '.')"
    return rf"""trim(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9\s.\-/''"]', '', 'g'), '\s+', ' ', 'g'))"""


@P.query("invoice_lines", sql=f"SELECT line_id, {_model('lower(description)')} AS for_class, {_model('description')} AS for_model FROM invoice_lines")
def p02_p04_clean_for_models(t: Fixtures) -> DataFrame:
    d = F.col("description")
    return t.invoice_lines.select("line_id", T.clean_for_classification(d).alias("for_class"), T.clean_for_model(d).alias("for_model"))


@P.query(
    "items",
    sql=r"""SELECT item_id, replace(replace(replace(mfr_part_num, '-', ''), '/', ''), '.', '') AS bare, regexp_replace(mfr_part_num, '[^a-zA-Z0-9]', '', 'g') AS alnum,
      regexp_replace(upper(trim(mfr_name)), '[&\-/\\_.,() ]', '', 'g') AS name_key, regexp_replace(mfr_part_num, '[-/=''"| ]', '', 'g') AS scrubbed FROM items""",
)
def p05_p06_p07_p09_p10_keys(t: Fixtures) -> DataFrame:
    n = F.col("mfr_part_num")
    rows = t.items.withColumns({c: F.trim(c) for c in ("mfr_part_num", "mfr_name")})
    return rows.select("item_id", T.remove_separators(n).alias("bare"), T.alphanumeric(n).alias("alnum"), T.name_key(F.col("mfr_name")).alias("name_key"), T.scrub_part_number(n).alias("scrubbed"))


@P.query(
    sql="""SELECT doc_id, regexp_replace(strip_accents(replace(replace(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o'), 'þ', 'th'), 'ð', 'd')), '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents""".replace("\\\\", "\\"),
)
def p08_remove_accents(t: Fixtures) -> DataFrame:
    return t.documents.select("doc_id", T.remove_accents(F.col("text")).alias("plain"))


@P.query(
    "invoice_lines",
    sql="""SELECT line_id, coalesce(upper(trim(mfr_name)) NOT IN ('', 'NULL'), false) AS has_mfr, coalesce(upper(trim(mfr_name)) NOT IN ('', 'NULL', 'UNDEFINED'), false) AS defined,
      coalesce(regexp_matches(own_part_num, '^AK[0-9]+$'), false) AS own_ok, coalesce(regexp_matches(upc, '^[0-9]{8,12}$'), false) AS upc_ok,
      CASE WHEN regexp_matches(upc, '^[0-9]{8}$') THEN upc ELSE '' END AS code, length(description) >= 3 AS long_enough FROM invoice_lines""",
)
def p11_p12_presence(t: Fixtures) -> DataFrame:
    return t.invoice_lines.select(
        "line_id", T.is_present(F.col("mfr_name")).alias("has_mfr"), T.is_defined(F.col("mfr_name")).alias("defined"), T.is_own_part_number(F.col("own_part_num")).alias("own_ok"),
        T.is_upc(F.col("upc")).alias("upc_ok"), T.unspsc_or_blank(F.col("upc")).alias("code"), (F.length("description") >= 3).alias("long_enough"),
    )


def eff(c: str) -> str:
    """Effective length in DuckDB, whose expressions have no back-references."""
    runs = f"coalesce(list_sum(list_transform(list_distinct(string_split({c}, '')), lambda ch: coalesce(list_sum(list_transform(regexp_extract_all({c}, '[' || ch || ']{{3,}}'), lambda m: length(m) - 2)), 0))), 0)"
    caps = f"length(regexp_replace({c}, '[^A-Z]', '', 'g'))"
    return f"CAST(CASE WHEN length({c}) > 0 THEN length(regexp_replace({c}, '[-/.]', '', 'g')) - {runs} + CASE WHEN {caps} >= 4 THEN 2 WHEN {caps} >= 2 THEN 1 ELSE 0 END ELSE 0 END AS INT)"


@P.query("invoice_lines", "items", sql=f"SELECT item_id, {eff('w')} AS eff, regexp_matches(w, '{T.EXCLUDED_PATTERN}') AS excluded FROM (SELECT DISTINCT item_id, unnest(string_split(description, ' ')) AS w FROM invoice_lines) WHERE w <> ''")
def p13_p14_part_number_tests(t: Fixtures) -> DataFrame:
    words = t.invoice_lines.select("item_id", F.explode(F.split("description", " ")).alias("w")).where("w <> ''").distinct()
    return words.select("item_id", T.effective_length(F.col("w")).alias("eff"), T.is_excluded(F.col("w")).alias("excluded"))


#: Candidates of every distinct text, for the SQL of this and other plans.
CANDIDATES = (
    ", runs AS (" + " UNION ALL ".join(f"SELECT description, unnest(regexp_extract_all(description, '[{k}]+')) AS run FROM texts" for k in T.CANDIDATE_CLASSES) + f"),\n"
    "trimmed AS (SELECT DISTINCT description, trim(run, '-/.') AS c FROM runs WHERE length(run) BETWEEN 4 AND 50),\n"
    f"cands AS (SELECT description, c, regexp_replace(c, '[-/.]', '', 'g') AS bare FROM trimmed WHERE {eff('c')} >= 4 AND regexp_matches(c, '[0-9]') AND NOT regexp_matches(c, '{T.EXCLUDED_PATTERN}')),\n"
    "bares AS (SELECT DISTINCT description, bare FROM cands),\n"
    "uipnc AS (SELECT description, bare FROM bares a WHERE NOT EXISTS (SELECT 1 FROM bares b WHERE b.description = a.description AND b.bare <> a.bare AND contains(b.bare, a.bare)))"
)
_TEXTS = ", texts AS (SELECT DISTINCT description FROM invoice_lines)"


@P.query(
    "invoice_lines",
    sql=_TEXTS + CANDIDATES + """
    SELECT t.description, coalesce((SELECT string_agg(c, ' ' ORDER BY c) FROM cands x WHERE x.description = t.description), '') AS candidates,
      coalesce((SELECT string_agg(v, ' ' ORDER BY v) FROM (SELECT c AS v FROM cands x WHERE x.description = t.description UNION SELECT regexp_replace(c, '[-/]', '', 'g') FROM cands x WHERE x.description = t.description
        UNION SELECT bare FROM cands x WHERE x.description = t.description)), '') AS variations,
      coalesce((SELECT string_agg(bare, ' ' ORDER BY bare) FROM uipnc x WHERE x.description = t.description), '') AS independent FROM texts t""",
)
def p15_p16_p17_p18_candidates(t: Fixtures) -> DataFrame:
    d = t.invoice_lines.select("description").distinct().withColumn("c", T.part_number_candidates(F.col("description")))
    said = lambda c: F.array_join(F.array_sort(c), " ")
    return d.select("description", said(F.col("c")).alias("candidates"), said(T.lookup_variations(F.col("c"))).alias("variations"), said(T.independent_candidates(F.col("c"))).alias("independent"))


_PHRASE = r"array_to_string(regexp_extract_all(unclean_name, '\w+'), '[\W_]+')"


@P.query(
    "invoice_lines", "manufacturers",
    sql=rf"""SELECT description, unclean_name, regexp_matches(description, '(?i)^' || {_PHRASE} || '([^\w]|$)') AS starts,
      regexp_matches(regexp_replace(description, '[^\w\s]', ' ', 'g'), '(?i)\b' || trim(regexp_replace(unclean_name, '[^\w\s]', ' ', 'g')) || '\b') AS holds,
      CASE WHEN pos = 0 THEN 'INVALID' WHEN (pos = 1 OR b IN (' ', '(', ')', ',', '.')) AND (a = '' OR a IN (' ', '(', ')', ',', '.')) THEN 'WHOLE_WORD'
        WHEN ((pos = 1 OR b IN (' ', '(', ')', ',', '.')) AND a IN ('-', '/', '.')) OR (b IN ('-', '/', '.') AND (a = '' OR a IN (' ', '(', ')', ',', '.'))) THEN 'EMBEDDED' ELSE 'INVALID' END AS boundary
      FROM (SELECT *, CASE WHEN pos > 1 THEN substr(description, CAST(pos - 1 AS BIGINT), 1) ELSE '' END AS b, substr(description, CAST(pos + length(hit) AS BIGINT), 1) AS a FROM (
        SELECT *, CASE WHEN hit = '' THEN 0 ELSE instr(description, hit) END AS pos FROM (
          SELECT description, unclean_name, regexp_extract(description, '(?i)' || {_PHRASE}) AS hit
          FROM (SELECT DISTINCT description FROM invoice_lines) JOIN manufacturers m ON contains(description, m.unclean_name))))""",
)
def p19_p20_p21_names_in_text(t: Fixtures) -> DataFrame:
    texts = t.invoice_lines.select("description").distinct()
    pairs = texts_with(texts, t.manufacturers.select("unclean_name"), "description", "unclean_name")
    d, n = F.col("description"), F.col("unclean_name")
    return pairs.select("description", "unclean_name", T.starts_with_phrase(d, n).alias("starts"), T.contains_name(d, n).alias("holds"), T.boundary_class(d, n).alias("boundary"))


@P.query(
    "items",
    sql="""SELECT a.item_id AS x, b.item_id AS y, starts_with(b.unspsc, rtrim(a.unspsc, '0')) OR starts_with(a.unspsc, rtrim(b.unspsc, '0')) AS compatible,
      CASE WHEN left(a.unspsc, 6) = left(b.unspsc, 6) THEN 'yes' ELSE 'no' END AS six, CASE WHEN left(a.unspsc, 2) = left(b.unspsc, 2) THEN 'yes' ELSE 'no' END AS two,
      starts_with(a.mfr_name, b.mfr_name) OR ends_with(a.mfr_name, b.mfr_name) OR starts_with(b.mfr_name, a.mfr_name) OR ends_with(b.mfr_name, a.mfr_name) AS fits,
      CAST(rint(((a.item_id % 100) / 100.0 - 0.55) / (1 - 0.55) * 100) AS BIGINT) AS points
      FROM items a JOIN items b ON b.item_id = a.item_id + 1""".replace("rint(", "round_even(").replace("* 100) AS", "* 100, 0) AS"),
)
def p22_p23_p26_p27_codes(t: Fixtures) -> DataFrame:
    a, b = t.items.alias("a"), t.items.alias("b")
    x, y = F.col("a.unspsc"), F.col("b.unspsc")
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(
        F.col("a.item_id").alias("x"), F.col("b.item_id").alias("y"), T.codes_compatible(x, y).alias("compatible"), T.code_match(x, y, 6).alias("six"), T.code_match(x, y, 2).alias("two"),
        T.prefix_or_suffix(F.col("a.mfr_name"), F.col("b.mfr_name")).alias("fits"), T.similarity_points((F.col("a.item_id") % 100) / 100.0).cast("long").alias("points"),
    )


@P.query(
    "items",
    sql="""SELECT item_id, v, CASE WHEN ends_with(v, '0000') THEN 1 WHEN ends_with(v, '00') THEN 2 ELSE 3 END AS level FROM (
      SELECT DISTINCT item_id, unnest([unspsc, left(unspsc, 6) || '00', left(unspsc, 4) || '0000']) AS v FROM items)""",
)
def p25_code_variants(t: Fixtures) -> DataFrame:
    v = t.items.select("item_id", F.explode(T.code_variants(F.col("unspsc"))).alias("v"))
    return v.select("item_id", "v", T.code_level(F.col("v")).alias("level"))


def words_sql(c: str, points: dict[str, int]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{w}' THEN {p}" for w, p in points.items()) + " ELSE 0 END"


def points_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} < {below} THEN {p}" for below, p in T.PART_POINTS) + " ELSE 100 END"


@P.query(
    "web_candidates",
    sql=f"""SELECT line_id, cand_no, {words_sql('mfr_match', T.MFR_WORDS)} AS m, {words_sql('part_match', T.PART_WORDS)} AS p, {words_sql('descr_match', T.DESCR_WORDS)} AS d, {points_sql('length(part)')} AS l FROM web_candidates""",
)
def p28_p29_points(t: Fixtures) -> DataFrame:
    return t.web_candidates.select("line_id", "cand_no", T.word_points(F.col("mfr_match"), T.MFR_WORDS).alias("m"), T.word_points(F.col("part_match"), T.PART_WORDS).alias("p"), T.word_points(F.col("descr_match"), T.DESCR_WORDS).alias("d"), T.part_points(F.length("part")).alias("l"))


@P.query(
    "invoice_lines",
    sql="""SELECT line_id, CASE WHEN rental_ind = 'Y' THEN 'RENTAL - ' || description ELSE description END AS label,
      CASE WHEN coalesce(upper(trim(mfr_name)) NOT IN ('', 'NULL'), false) AND NOT contains(one, mfr_name) THEN mfr_name || ' ' || one ELSE one END AS augmented, left(one, 20) AS cut
      FROM (SELECT *, CASE WHEN coalesce(upper(trim(mfr_part_num)) NOT IN ('', 'NULL'), false) AND NOT contains(description, mfr_part_num) THEN mfr_part_num || ' ' || description ELSE description END AS one FROM invoice_lines)""",
)
def p24_p31_p32_labels(t: Fixtures) -> DataFrame:
    d = F.col("description")
    one = T.augmented_description(d, F.col("mfr_part_num"), F.lit(None).cast("string"))
    return t.invoice_lines.select("line_id", T.rental_label(d, F.col("rental_ind")).alias("label"), T.augmented_description(d, F.col("mfr_part_num"), F.col("mfr_name")).alias("augmented"), F.substring(one, 1, 20).alias("cut"))


@P.query("jobs", sql="SELECT regexp_replace(id, '~([^~]*)$', '-\\1') AS log_id, id AS job_id, string_split(id, '~')[-1] AS suffix FROM jobs")
def p36_ids(t: Fixtures) -> DataFrame:
    log = T.log_id(F.col("id"))
    return t.jobs.select(log.alias("log_id"), T.job_id(log).alias("job_id"), F.element_at(F.split("id", "~"), -1).alias("suffix"))


@P.query("items", sql="SELECT item_id, left(b, n) AS gram FROM (SELECT item_id, b, unnest(range(6, least(30, length(b)) + 1)) AS n FROM (SELECT item_id, lower(regexp_replace(mfr_part_num, '[-/.]', '', 'g')) AS b FROM items))")
def p43_edge_ngrams(t: Fixtures) -> DataFrame:
    return t.items.select("item_id", F.explode(T.edge_ngrams(F.col("mfr_part_num"))).alias("gram"))


_ANSWER = "CASE CAST(item_id % 4 AS INT) WHEN 0 THEN '```json ' || '{\"part\": \"' || mfr_part_num || '\"}' || ' ```' WHEN 1 THEN '{\"part\": \"' || mfr_part_num WHEN 2 THEN '' ELSE 'none found' END"


@P.query("items", sql="SELECT item_id, CASE CAST(item_id % 4 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' WHEN 2 THEN 'empty' ELSE 'invalid' END AS outcome, CASE WHEN item_id % 4 = 0 THEN mfr_part_num END AS part FROM items")
def p34_json_answers(t: Fixtures) -> DataFrame:
    a = t.items.withColumn("answer", F.expr(_ANSWER))
    return a.select("item_id", T.json_outcome(F.col("answer")).alias("outcome"), F.get_json_object(T.fenced_json(F.col("answer")), "$.part").alias("part"))
