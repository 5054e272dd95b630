"""Procurement tables derived from the driver's star schema.

Each view is one statement of SQL that Spark and DuckDB read alike; `{name}` stands for a base table or another view. Spark
gets them as DataFrames, the SQL of a query gets them as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

VIEWS: dict[str, str] = {
    "brands": "SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INT) AS n FROM {part}",
    "manufacturers": """
        SELECT form || n AS unclean_name, 'BRAND ' || n || ' MFG' AS clean_name, 'GROUP ' || (n % 5) AS parent_name,
          CASE WHEN n % 7 = 0 THEN 'B' WHEN n % 11 = 0 THEN 'N' END AS match_indicator, CAST(n * 3 + o AS BIGINT) AS ordinal
        FROM {brands} CROSS JOIN (SELECT 'BRAND ' AS form, 0 AS o UNION ALL SELECT 'BRAND-', 1 UNION ALL SELECT 'BR', 2) f""",
    "items": """
        SELECT p_partkey AS item_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'AK' || p_partkey END AS own_part_num,
          upper(left(p_type, 3)) || '-' || (100000 + p_partkey) || '/' || p_size AS mfr_part_num,
          CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'BRAND ' WHEN 1 THEN 'BRAND-' ELSE 'BR' END || CAST(substr(p_brand, 7) AS INT) AS mfr_name,
          lpad(CAST(p_partkey AS STRING), 12, '0') AS upc,
          '39' || (10 + p_size % 20) || (10 + p_partkey % 7) || CASE WHEN p_partkey % 5 = 0 THEN '00' ELSE CAST(10 + p_partkey % 90 AS STRING) END AS unspsc,
          CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'IDEA' WHEN 1 THEN 'TRD_SVC' ELSE 'OTHER' END AS source_name, p_name, p_size
        FROM {part}""",
    "item_descriptions": """
        SELECT l_partkey * 100000 + l_suppkey AS desc_id, l_partkey AS item_id, source_name,
          mfr_name || CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN ' ' WHEN 1 THEN '_' WHEN 2 THEN '  ' ELSE ' * ' END || upper(p_name) || ' ' || mfr_part_num
            || CASE WHEN l_suppkey % 3 = 0 THEN ' SIZE ' || p_size ELSE '' END AS description,
          CASE CAST((l_partkey + l_suppkey) % 3 AS INT) WHEN 0 THEN 'NEW' WHEN 1 THEN 'FT_PROGRESS' ELSE '2025-1' END AS train_version,
          CASE WHEN (l_partkey + l_suppkey) % 10 = 0 THEN 'N' ELSE 'Y' END AS active, (l_partkey * 7 + l_suppkey) % 100 AS day_no
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) p JOIN {items} i ON i.item_id = p.l_partkey""",
    "numbered_lines": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus,
          l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_id,
          (l_orderkey + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) % 8 AS kind
        FROM {lineitem}""",
    "invoice_lines": """
        SELECT line_id, 'INV' || l_orderkey AS invoice_num, l_orderkey AS header_id, item_id, kind,
          CASE CAST(kind AS INT)
            WHEN 0 THEN mfr_name || ' ' || upper(p_name) || ' ' || mfr_part_num || ' SIZE ' || p_size
            WHEN 1 THEN mfr_name || ', ' || upper(p_name) || ' ' || replace(replace(mfr_part_num, '-', ''), '/', '')
            WHEN 2 THEN upper(p_name) || ' ' || mfr_part_num
            WHEN 3 THEN mfr_name || ' ' || upper(p_name) || ' ' || mfr_part_num || ' FOR BRAND ' || (1 + item_id % 25)
            WHEN 4 THEN upper(p_name) || ' BY ' || mfr_name
            WHEN 5 THEN 'LOT OF ' || upper(p_name) || ' | ' || p_size || '@50% *'
            WHEN 6 THEN left(upper(p_name), 2)
            ELSE 'ADJUSTMENTS' END AS description,
          CASE CAST(line_id % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'NULL' WHEN 2 THEN ' ' ELSE mfr_name END AS mfr_name,
          CASE CAST(line_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' ELSE mfr_part_num END AS mfr_part_num,
          CASE WHEN line_id % 6 = 0 THEN own_part_num WHEN line_id % 6 = 1 THEN 'AK' WHEN line_id % 6 = 2 THEN 'X' || item_id END AS own_part_num,
          CASE WHEN line_id % 11 = 0 THEN upc WHEN line_id % 11 = 1 THEN '12AB' END AS upc,
          CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS rental_ind,
          CASE WHEN l_linestatus = 'F' THEN 'DS1' WHEN l_returnflag = 'A' THEN 'RC-AI' ELSE 'AI' END AS line_status,
          CASE CAST(line_id % 4 AS INT) WHEN 0 THEN '1.1' WHEN 1 THEN '1.2' WHEN 2 THEN '6' ELSE '1' END AS category_id, unspsc
        FROM {numbered_lines} n JOIN {items} i ON i.item_id = n.l_partkey""",
    # Vectors of texts: of the driver's ones, by the text's length and a letter, so that like texts often share one; some have none.
    "text_vectors": """
        SELECT description, embedding AS vec FROM (SELECT DISTINCT description, CAST((length(description) * 17 + ascii(substr(description, 5, 1)) * 3) % 520 AS BIGINT) AS vec_id FROM {invoice_lines}) t JOIN {embeddings} e ON e.vec_id = t.vec_id""",
    "description_vectors": """
        SELECT desc_id, embedding AS vec FROM (SELECT desc_id, CAST((length(description) * 17 + ascii(substr(description, 5, 1)) * 3) % 520 AS BIGINT) AS vec_id FROM {item_descriptions}) t JOIN {embeddings} e ON e.vec_id = t.vec_id""",
    "categories": """
        SELECT 'R' || r_regionkey AS category_id, r_name AS category_name, CAST(NULL AS STRING) AS parent_id FROM {region}
        UNION ALL SELECT 'R' || n_regionkey || '.' || n_nationkey, n_name, 'R' || n_regionkey FROM {nation}
        UNION ALL SELECT '1', 'MATERIAL', NULL UNION ALL SELECT '1.1', 'GENERIC', '1' UNION ALL SELECT '1.2', 'LOT', '1'
        UNION ALL SELECT '6', 'BAD', 'zzz' UNION ALL SELECT '6.1', 'UNCLEAR', '6' UNION ALL SELECT '6.1.1', 'EMPTY', '6.1'""",
    "jobs": """
        SELECT user_id || '~' || event_id AS id, user_id AS request_id, event_id AS line_id,
          CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
          event_id AS created_no, event_id % 7 AS retry_count, event_id * 60 AS updated_s
        FROM {events}""",
    "priorities": "SELECT DISTINCT user_id AS request_id, CAST(user_id % 4 AS INT) AS priority FROM {events} WHERE user_id % 10 = 0",
    "stage_results": """
        SELECT line_id, stage_no, CASE stage_no WHEN 1 THEN 'SEMANTIC' WHEN 2 THEN 'COMPLETE' WHEN 3 THEN 'TUNED' ELSE 'WEB' END AS stage_name,
          CASE WHEN (line_id + stage_no) % 5 = 0 THEN NULL ELSE 'BRAND ' || (line_id * stage_no) % 3 END AS mfr,
          CASE WHEN (line_id + stage_no) % 4 = 0 THEN NULL ELSE 'P-' || (line_id + stage_no * stage_no) % 3 END AS part,
          CASE WHEN (line_id + stage_no) % 6 = 0 THEN NULL ELSE '391' || (10000 + (line_id * stage_no) % 4) END AS unspsc,
          CAST((line_id * 13 + stage_no * 29) % 101 AS DOUBLE) AS conf_mfr, CAST((line_id * 7 + stage_no * 31) % 101 AS DOUBLE) AS conf_part,
          CAST((line_id * 3 + stage_no * 37) % 101 AS DOUBLE) AS conf_unspsc, (line_id + stage_no) % 7 = 0 AS is_invalidated
        FROM (SELECT DISTINCT line_id FROM {numbered_lines}) l CROSS JOIN (SELECT 1 AS stage_no UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s""",
    "web_candidates": """
        SELECT n.line_id, c AS cand_no, mfr_name AS mfr, CASE WHEN c = 3 THEN '' ELSE mfr_part_num END AS part, upper(p_name) AS descr, unspsc,
          CASE WHEN (line_id + c) % 6 = 0 THEN 'None' WHEN (line_id + c) % 7 = 0 THEN ' ' ELSE 'http://s' || (line_id + c) % 4 END AS source,
          (line_id + c) % 3 = 0 AS priority_match,
          CASE CAST((line_id + c) % 5 AS INT) WHEN 0 THEN 'Exact' WHEN 1 THEN 'Likely' WHEN 2 THEN 'Possible' WHEN 3 THEN 'Not Detected' ELSE 'Mismatch' END AS mfr_match,
          CASE CAST((line_id + 2 * c) % 5 AS INT) WHEN 0 THEN 'Exact' WHEN 1 THEN 'Strong' WHEN 2 THEN 'Partial' WHEN 3 THEN 'Possible' ELSE 'No Match' END AS part_match,
          CASE CAST((line_id + 3 * c) % 5 AS INT) WHEN 0 THEN 'Exact' WHEN 1 THEN 'Very High' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' ELSE 'Low' END AS descr_match,
          n.line_id % 4 = 1 AS generic
        FROM {numbered_lines} n JOIN {items} i ON i.item_id = n.l_partkey CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k""",
    "class_predictions": """
        SELECT l.doc_id AS uid, 'Q' || quality || CASE WHEN toxic = 1 THEN 'T' ELSE '' END AS true_class,
          'Q' || CASE WHEN n_chars > 300 THEN 1 ELSE 0 END || CASE WHEN n_chars % 11 = 0 THEN 'T' ELSE '' END AS pred_class, CAST(n_chars % 101 AS DOUBLE) AS confidence
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "classifier_training": """
        SELECT l.doc_id AS uid, text AS description, 'Q' || quality || 'T' || toxic AS class,
          CASE CAST(l.doc_id % 3 AS INT) WHEN 0 THEN '{"DESCRIPTION": "NEW"}' WHEN 1 THEN '{"DESCRIPTION": "2025-1", "LOT": "2025-2"}' END AS version_json,
          CASE WHEN l.doc_id % 13 = 0 THEN 'N' ELSE 'Y' END AS active
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "labelled_eval": """
        SELECT line_id, CASE WHEN line_id % 17 = 0 THEN '-' ELSE mfr_name END AS mfr_label, CASE WHEN line_id % 5 = 0 THEN 'BRAND X' ELSE mfr_name END AS mfr_pred, line_id % 101 AS mfr_conf,
          mfr_part_num AS part_label, CASE WHEN line_id % 4 = 0 THEN replace(mfr_part_num, '-', '') WHEN line_id % 4 = 1 THEN 'Z9' ELSE mfr_part_num END AS part_pred, (line_id * 3) % 101 AS part_conf,
          unspsc AS unspsc_label, CASE WHEN line_id % 3 = 0 THEN left(unspsc, 6) || '99' WHEN line_id % 3 = 1 THEN '40111111' ELSE unspsc END AS unspsc_pred, (line_id * 7) % 101 AS unspsc_conf
        FROM {invoice_lines} WHERE kind < 4""",
}
_NAME = re.compile(r"\{(\w+)\}")


class Fixtures:
    """The tables and views of one folder as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.spark.sql(_json_safe(VIEWS[name]), **{n: getattr(self, n) for n in needs(VIEWS[name])})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS or n in BASE]


def _json_safe(sql: str) -> str:
    """Braces that are not names, doubled."""
    return re.sub(r"\{(\w+)\}|[{}]", lambda m: m[0] if m[1] else m[0] * 2, sql)


def with_views(*names: str) -> str:
    """`WITH ...` with the named views and all that they need, in order, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in needs(VIEWS[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m[1] if m[1] in VIEWS or m[1] in BASE else m[0], VIEWS[n])})" for n in order)
