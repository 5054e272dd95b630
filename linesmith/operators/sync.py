"""Catalog synchronisation as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .catalog import snapshot_diff, unique_descriptions


def catalog_sync(source: DataFrame, index: DataFrame, least_rows: int = 100_000) -> DataFrame:
    """The actions that bring the index up to date; refuses a source that is suspiciously small."""
    if source.count() < least_rows:
        raise ValueError(f"the source has fewer than {least_rows} rows")
    return snapshot_diff(unique_descriptions(source), index)
