"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from chronolith.plans import catalogue  # noqa: E402

HEADLINE = [
    "c07_normal_thoroughfare", "l02_labels", "r03_roots_by_label", "r06_relations_by_members", "v05_geometry_comparison", "e03_final_times", "k07_version_cover", "k10_pruned", "k13_evolution_merge",
    "t01_compared_instants", "t03_allen_relations", "t09_events_before", "q07_snapshot_landmarks", "q10_snapshot_features", "g05_alive_by_year", "d02_range", "d08_shape_report", "i01_inferred", "x04_successive_links", "m04_change_quality",
]
#: Timed beside them, not in the sum: the flagship with a judging function and with one attribute that has half of all rows, and what is new.
BESIDE = ["k13_judged_merge", "k13_long_attribute", "q19_many_areas", "c44_overlapping_union", "i02_classes", "a18_labelled_paths", "i03_event_bounds", "s19_turtle_round_trip"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    place = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{place}/shared")
        .config("spark.sql.warehouse.dir", f"{place}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["g06_statements_by_graph"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first job starts the engine
    took = {}
    for name in HEADLINE + BESIDE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": {n: took[n] for n in HEADLINE}, "beside": {n: took[n] for n in BESIDE}, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
