"""All registered queries of the line-resolution engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linesmith.plans import cascade_plans, catalog_plans, line_plans, matching_plans, stream_plans, table_plans, text_plans, training_plans, vector_plans

_PLANS = (text_plans.P, table_plans.P, catalog_plans.P, vector_plans.P, training_plans.P, cascade_plans.P, matching_plans.P, line_plans.P, stream_plans.P)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for p in _PLANS for k, q in p.queries.items()}
SQL: dict[str, str] = {k: s for p in _PLANS for k, s in p.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["resolve_lines"](spark, sf_dir)
