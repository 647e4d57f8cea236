"""Times the headline queries over BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gridweave.plans.corpus import STORED, Registry
from gridweave.plans.queries import QUERIES

#: The checks and plans of the reference's published times, and the heaviest text, place and graph work.
HEADLINE = (
    "m1_value_mismatch",
    "m2_type_mismatch",
    "m3_broken_ref",
    "m4_cable_mismatch",
    "m5_tb_conflict",
    "m6_voltage_mismatch",
    "m7_relay_mismatch",
    "m8_orphan",
    "m9_trip_path",
    "m10_lockout",
    "m11_ct_relay",
    "m12_dc_supply",
    "y5_plan_all",
    "x1_pattern_extract",
    "x2_label_category",
    "j1_nearest_component",
    "j6_label_pairs",
    "r2_dependency_graph",
    "r8_cable_list",
    "c5_classify",
    "b_block_components",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # starts the executors
    took = {}
    began = time.time()
    tables = Registry(spark, sf_dir)  # a scan fills the registry, the queries ask it
    for name in STORED:
        tables.raw(name)
    tables.components, tables.drawings  # noqa: B018
    took["registry_tables"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
