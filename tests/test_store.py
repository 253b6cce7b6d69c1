"""The graph store under failed and rival writes, and the label index against the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolith.operators import labels
from chronolith.operators.graph_store import Conflict, GraphStore

SCHEMA = "s string, p string, o string, o_kind string, o_dtype string, g string"


def rows(spark, *graphs, o="x"):
    return spark.createDataFrame([(f"s{i}", "p", o, "uri", None, g) for g in graphs for i in range(3)], SCHEMA)


def held(store, **of):
    return sorted({(r.g, r.o) for r in store.read(**of).collect()})


def test_a_failed_write_changes_nothing(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    assert store.read().collect() == [] and store.snapshots() == []
    first = store.replace(rows(spark, "http://x/a b=1", "b"))
    broken = rows(spark, "http://x/a b=1", o="half").repartition(2).withColumn("o", F.when(F.col("s") == "s2", F.raise_error(F.lit("stop"))).otherwise(F.col("o")))
    with pytest.raises(Exception, match="stop"):
        store.replace(broken)
    assert held(store) == [("b", "x"), ("http://x/a b=1", "x")] and store.snapshots() == [first]
    second = store.replace(rows(spark, "b", o="y"), ["http://x/a b=1"])
    assert held(store) == [("b", "y")] and held(store, snapshot=first) == [("b", "x"), ("http://x/a b=1", "x")]
    store.append(rows(spark, "b", "c", o="z"))
    assert held(store, graphs=["b"]) == [("b", "y"), ("b", "z")] and store.read(["b"]).count() == 6
    assert store.restore(first) == second + 2 and held(store) == [("b", "x"), ("http://x/a b=1", "x")]
    assert store.vacuum() >= 3 and held(store) == [("b", "x"), ("http://x/a b=1", "x")] and len(store.snapshots()) == 1
    with pytest.raises(KeyError):
        store.read(snapshot=first)
    store.drop(["b", "http://x/a b=1"])
    assert store.read().collect() == []


def test_rival_writers(spark, tmp_path):
    a, b = (GraphStore(spark, f"file://{tmp_path}/r") for _ in "ab")
    a.replace(rows(spark, "a"))
    at, state = b._state()
    a.replace(rows(spark, "a", o="won"))
    with pytest.raises(Conflict):
        b._commit(state, at)
    assert held(b) == [("a", "won")]


def test_label_index(spark, tmp_path):
    names = ["Forêt noire", "la foret", "for et", "FORÊT", None, "", "fo", "Œuvre", "oeuvres", "abcabcabc", "a.c"] + [f"rue {i}" for i in range(50)]
    table = spark.createDataFrame(list(enumerate(names)) + [(0, "forêt double")], "key int, label string")
    index = labels.LabelIndex.build(table, "label", "key", f"file://{tmp_path}/i", buckets=7)
    for query in ("FORÊT", "oeuv", "œuvr", "abca", "cab", "fo", "", "nothing here", "rue 1", "a.c"):
        want = [(r.key, r.folded) for r in labels.search(table, query, "label", "key").collect()]
        assert [(r.key, r.folded) for r in index.search(query).collect()] == want, query
    plan = index.candidates("FORÊT")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:60]
