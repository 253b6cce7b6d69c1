"""Similar names against the library's ratio on all pairs, and intervals against all pairs of a group."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from chronolith.operators import temporal
from chronolith.operators.similar_names import matching_ratio, similar_names
from chronolith.plans import catalogue

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def brute(names, least):
    own = sorted(set(names))
    return {(a, b): max(ratio(a, b), ratio(b, a)) for k, a in enumerate(own) for b in own[k + 1 :] if 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and max(ratio(a, b), ratio(b, a)) >= least}


def changed(r, name):
    letters = list(name)
    for _ in range(r.randint(1, 3)):
        at = r.randrange(len(letters) + 1)
        letters[at : at + r.randint(0, 1)] = r.choices("abé ", k=r.randint(0, 2))
    return "".join(letters)


def test_ratio_is_that_of_matching_blocks(spark):
    r = random.Random(2)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("abcd", "bcde"), ("abxcd", "abcd"), ("private Thread", "private volatile Thread"), ("aaaa", "aa"), (None, "a"), ("é日🎉x", "日🎉é")]
    pairs += [("".join(r.choices("abc", k=r.randint(0, 14))), "".join(r.choices("abc", k=r.randint(0, 14)))) for _ in range(150)]
    got = spark.createDataFrame(pairs, "l string, m string").select("l", "m", matching_ratio("l", "m").alias("x")).collect()
    assert all(x.x is None if x.l is None else abs(x.x - ratio(x.l, x.m)) < 1e-12 for x in got)


@pytest.mark.parametrize("least", [0.9, 0.8])
def test_no_similar_pair_is_missed(spark, least):
    r = random.Random(4)
    names = ["".join(r.choices("abcdefgh -", k=r.randint(0, 22))) for _ in range(60)] + ["aaaaaaaaaa", "aaaaaaaaaaa", "ab", "abc", "", "x"]
    names += [changed(r, n) for n in names for _ in range(3)]
    table = spark.createDataFrame([(n,) for n in names + names[:9]] + [(None,)], "name string").repartition(3)
    got = {(x.name, x.other): x.ratio for x in similar_names(table, least).collect()}
    want = brute(names, least)
    assert got.keys() == want.keys() and len(want) > 60 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert similar_names(table.limit(0), least).collect() == []


def test_query_of_names(spark):
    name = catalogue.QUERIES["c11_similar_names"]
    from chronolith.plans.tables import spark_table

    labels = [x.label.lower() for x in spark_table(spark, SF, "name").select("label").collect()]
    assert {(x.name, x.other) for x in name(spark, SF).collect()} == set(brute(labels, 0.9))


def test_meeting_intervals(spark):
    r = random.Random(8)
    rows = [(r.choice(["x", "x", "y"]), f"i{k}", b := r.randrange(300), b + r.choice([0, 0, 1, 2, 3, 5, 40, 200])) for k in range(160)] + [("x", "none", None, 4), ("x", "odd", 9, 3), ("y", "same", 5, 5), ("y", "again", 5, 5)]
    table = spark.createDataFrame(rows, "grp string, i string, begin int, end int")
    good = table.where("begin <= end")
    want = sorted(tuple(x) for x in temporal.compared_intervals(good, "grp").where("relation <> 'before'").collect())
    assert sorted(tuple(x) for x in temporal.meeting_intervals(table, "grp").collect()) == want and len(want) > 500
    assert temporal.meeting_intervals(table.limit(0), "grp").collect() == []


def test_turned_intervals_are_before_their_equals(spark):
    rows = spark.createDataFrame([("g", "a", 9, 3), ("g", "b", 9, 3), ("g", "c", 4, 4), ("g", "d", 4, 4)], "grp string, i string, begin int, end int")
    got = {(x.i1, x.i2): x.relation for x in temporal.compared_intervals(rows, "grp").collect()}
    assert got["a", "b"] == got["b", "a"] == "before" and got["c", "d"] == "equals"
