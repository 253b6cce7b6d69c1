"""Queries that once read a part of their table."""

from __future__ import annotations

from chronolith.plans import catalogue


def test_instants_of_attributes_are_of_all_precisions(spark):
    sf = "/root/testdata/sf0.001"
    pairs = catalogue.QUERIES["t02_instants_of_attributes"](spark, sf)
    named = {x[0] for x in pairs.select("t1").union(pairs.select("t2")).distinct().collect()}
    orders = {x[0] % 5 for x in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    assert {int(x[1:]) % 5 for x in named} == orders and len(orders) == 5
    assert "precision" not in catalogue.ORACLES["t02_instants_of_attributes"].split("SELECT * FROM p")[0].split("x AS (")[1]
