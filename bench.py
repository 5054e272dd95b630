"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from linesmith import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("resolve_lines", "c12_catalog_sync", "c04_a06_semantic_match", "st3_write_back_ledger", "a12_field_metrics", "c07_consolidated", "c10_a07_a08_w13_web_candidates", "j11_snapshot_diff")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("linesmith-bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linesmith-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "lines_per_second": round(lines / took["resolve_lines"], 1)}))


if __name__ == "__main__":
    main()
