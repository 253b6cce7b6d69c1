"""Attributes that are cut into blocks give what one task gives."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from chronolith.operators import evolution

VERSIONS = "attr string, av string, begin int, end int, vid string"
CHANGES = "attr string, stamp int, precision int, cg string, makes array<string>, outdates array<string>"


def tables(spark, seed):
    r = random.Random(seed)
    versions, changes = [], []
    for k in range(160):
        begin = r.randrange(200)
        versions.append((r.choice(["hub", "hub", "b", "c"]), f"v{k}", None if k % 11 == 0 else begin, None if k % 13 == 0 else begin + r.choice([1, 3, 40]), str(r.randrange(3))))
    versions += [("lone", "v900", None, None, "1"), ("one", "v901", 5, 5, "1"), ("hub", "v902", None, None, "2")]
    for k in range(25):
        attr, av, *_ = r.choice(versions)
        changes.append((attr, r.randrange(200) if k % 7 else None, r.choice([None, 11]), f"c{k}", [av], []))
    return spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(changes, CHANGES)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_change_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(evolution, "BLOCK_ROWS", 12)
    versions, changes = tables(spark, seed)
    judge = lambda pairs: pairs.withColumn("same", F.col("v1") == F.col("v2"))
    for comparisons in (None, judge):
        plain = evolution.evolution(versions, changes, comparisons, long=10_000)
        cut = evolution.evolution(versions, changes, comparisons, long=40)
        assert "__block" not in cut.columns
        assert sorted(map(str, cut.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_long_attribute_lies_in_many_blocks(spark):
    versions = spark.range(4000).select(F.lit("hub").alias("attr"), F.col("id").cast("string").alias("av"), F.col("id").cast("int").alias("begin"), (F.col("id") + 2).cast("int").alias("end"), F.lit("x").alias("vid"))
    events = evolution.stated_and_virtual(versions, spark.createDataFrame([], CHANGES))
    sizes = [r["count"] for r in evolution.blocked(events, 16).groupBy("__block").count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_many_changes_of_one_stamp_are_not_compared_in_pairs(spark):
    """40,000 versions that begin at once, each stated twice; a comparison of all pairs takes minutes."""
    twice = spark.range(80_000).select(F.lit("hub").alias("attr"), (F.col("id") % 40_000).cast("string").alias("av"), F.lit(1).alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("vid"))
    events = evolution.stated_and_virtual(twice, spark.createDataFrame([], CHANGES))
    began = time.perf_counter()
    row = evolution.elementary_changes(events).where("side = 0").select("makes").first()
    assert [x["av"] for x in row["makes"]] == sorted(str(k) for k in range(40_000))
    assert time.perf_counter() - began < 20
