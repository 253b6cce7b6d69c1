"""Rules that a driver makes are broadcast: a shuffle by their few classes or predicates would have a few large tasks."""

from __future__ import annotations

import pytest

from chronolith.plans import catalogue


@pytest.mark.parametrize("name", ["d01_domain", "d05_missing_property", "d06_mandatory_properties", "d07_domains_and_ranges"])
def test_no_shuffle_by_class_or_predicate_alone(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split("#")[0] + line.count("#") * "+" for line in plan.split("\n") if "hashpartitioning(" in line]
    assert keys and not [k for k in keys if k.rstrip("+") in ("class", "p", "__p", "__c", "__class") and k.endswith("+") and k.count("+") == 1], keys
    assert "BroadcastHashJoin" in plan
