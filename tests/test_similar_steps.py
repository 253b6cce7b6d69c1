"""Whether successive sources of a key are near, without links, against all links."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from chronolith.operators import linking
from chronolith.plans import catalogue, tables

SF = "/root/testdata/sf0.001"


def test_steps_against_all_links(spark):
    r = random.Random(3)
    rows = [(f"{k}.{n}", r.choice([1, 2, 3, 5]), f"k{k}", r.choice([r.uniform(-60, 60), float(r.randint(-30, 30))]), r.choice([r.uniform(-5, 5), 0.0])) for k in range(150) for n in range(r.randint(1, 6))]
    rows += [("e1", 1, "edge", 0.0, 0.0), ("e2", 2, "edge", 6.0, 8.0), ("e3", 3, "edge", 13.5, 14.0)]  # ten isn't less than ten
    rows += [("n1", 1, "none", float("nan"), 0.0), ("n2", 2, "none", float("nan"), 0.0), ("n3", 3, "none", None, 0.0), ("i1", 1, "far", float("inf"), 0.0), ("i2", 2, "far", float("inf"), 0.0)]
    rows += [("h1", 1, "huge", 1e18, 0.0), ("h2", 2, "huge", 1e18, 0.0), ("h3", 3, "huge", 1e25, 0.0), ("h4", 4, "huge", 3e25, 0.0), ("o", None, "k1", 0.0, 0.0), ("p", 1, None, 0.0, 0.0)]
    own = spark.createDataFrame(rows, "id string, ord int, key string, x double, y double")
    for most in (10.0, 0.0, 3.7):
        links = linking.successive_links(own, most).groupBy("key", "from_source", "to_source").agg(F.bool_or("similar"))
        got = sorted(map(tuple, linking.similar_steps(own, most).collect()))
        assert got == sorted(map(tuple, links.collect())) and len(got) > 200
        assert most == 0 or 20 < sum(x[3] for x in got) < len(got) - 20


def test_groups_of_sources_make_no_links(spark):
    for name in ("m05_groups_of_sources", "m06_single_groups"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "Generate explode(__a" not in plan


def test_addresses_are_those_of_their_sql(spark):
    frames = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "supplier")}
    want = spark.sql(tables.SQL["address"], **frames)
    got = tables.spark_table(spark, SF, "address")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
