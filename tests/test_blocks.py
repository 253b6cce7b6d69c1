"""Pairs by blocks against plain joins, and plans in which no pair is shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import linking, temporal
from chronolith.operators.blocks import blocked, expanded


def test_blocks_hold_every_row_once(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(None, 50)], "g int, n int")
    own = blocked(rows, ["g"], "a", ["n"], 4)
    found = own.collect()
    assert all(len(x.a) <= 4 for x in found) and sorted(m.n for x in found for m in x.a) == list(range(51))
    ordered = sorted((x.a_block, [m.n for m in x.a]) for x in found if x.g == 1)
    assert max(ordered[0][1]) < min(ordered[1][1])
    other = own.select(F.col("g").alias("h"), F.col("a").alias("b"), F.col("a_block").alias("b_block"))
    pairs = expanded(own.join(other, F.col("g") == F.col("h")), "a", "b", ["g"])
    assert sorted((x.a.n, x.b.n) for x in pairs.collect()) == sorted((i, j) for i in range(50) for j in range(50) if i % 3 == j % 3)


def _addresses(spark):
    return spark.createDataFrame([(f"{k}", k % 3, f"k{k % 4}" if k % 9 else None, float(k), 0.0) for k in range(60)] + [("alone", 1, "own", 0.0, 0.0), ("nowhen", None, "k1", 0.0, 0.0)], "id string, ord int, key string, x double, y double")


def test_links_without_those_made_by_hand(spark):
    rows = _addresses(spark)
    links = linking.successive_links(rows)
    manual = links.where("cast(from_id as int) % 5 = 0").select("from_id", "to_id", F.lit(True).alias("to_keep"), F.lit("2024-02-02").cast("date").alias("creation_date"))
    manual = spark.createDataFrame(manual.collect(), manual.schema)
    flag = lambda x: linking.flagged(x, "auto", "2024-01-01")
    want = sorted(map(tuple, linking.with_manual(flag(links), manual).collect()))
    own = linking.with_manual(flag(linking.successive_links(rows, without=manual)), manual, apart=True)
    assert sorted(map(tuple, own.collect())) == want and len(want) > 100
    assert "from_id" not in "".join(x for x in own._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)


def test_exported_and_alone_need_no_links(spark):
    rows = _addresses(spark)
    links = linking.flagged(linking.successive_links(rows, ends=True), "auto", "2024-01-01")
    assert sorted(map(tuple, linking.exported(links).collect())) == sorted(map(tuple, linking.exported(links, rows).collect()))
    alone = sorted(x.id for x in linking.alone(rows).collect())
    assert alone == sorted(x.id for x in linking.unlinked(rows, links).collect()) and "alone" in alone and "nowhen" in alone
    assert "explode" not in linking.alone(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_instants_are_put_in_place_last(spark):
    rows = spark.createDataFrame([("g", f"t{k:04d}", k // 2, "day", None if k % 2 else "julian") for k in range(2300)], "grp string, t string, day int, precision string, calendar string")
    rows = rows.select("grp", "t", F.date_add(F.lit("2000-01-01").cast("date"), F.col("day")).cast("timestamp").alias("stamp"), "precision", "calendar")
    pairs = temporal.compared_instants(rows, "grp").select("t1", "t2")
    assert "explode" in pairs._jdf.queryExecution().optimizedPlan().toString()
    n, least = pairs.agg(F.count(F.lit(1)), F.count_distinct("t1")).first()
    assert n == 2 * (1150 * 1149 // 2) and least == 2298 and pairs.where("t1 >= t2").isEmpty()


def test_a_task_holds_few_pairs(spark):
    """The first block is cut into slices by a step of its own, so that a row of the step after it becomes few rows."""
    rows = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").alias("n"))
    a = blocked(rows, ["g"], "a", ["n"], 500)
    b = a.select(F.col("g").alias("h"), F.col("a").alias("b"), F.col("a_block").alias("b_block"))
    pairs = expanded(a.join(b, F.col("g") == F.col("h")), "a", "b", ["g"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in plan.split("\n") if "Generate" in x]
    assert len(steps) == 3 and "slice" in steps[-1], plan
    assert "REPARTITION_BY_NUM" in plan
    n, x, y = pairs.agg(F.count(F.lit(1)), F.sum(F.col("a.n")), F.sum(F.col("b.n"))).first()
    assert n == 2 * 3000 * 3000 and x == y == 3000 * sum(range(6000))
    assert blocked(rows.limit(0), ["g"], "a").count() == 0


def test_pairs_of_areas_are_not_one_task(spark):
    from chronolith.plans import catalogue

    pairs = catalogue.QUERIES["q19_many_areas"](spark, "/root/testdata/sf0.001")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
