"""Registration of queries: a function over the fixtures, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linesmith.sources.fixtures import Fixtures, with_views


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, *views: str, sql: str | None = None):
        """Registers a function under its name. sql may begin with further common table expressions (`, x AS (...) SELECT ...`)."""

        def add(fn: Callable[[Fixtures], DataFrame]):
            self.queries[fn.__name__] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
            if sql is not None:
                self.sql[fn.__name__] = f"{with_views(*views)}\n{sql}" if views else sql
            return fn

        return add
