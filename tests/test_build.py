from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolith.build import Build
from chronolith.operators.reading import BOUNDS
from chronolith.service import Service
from chronolith.sources.config import Reading


def inputs(spark):
    make = spark.createDataFrame
    landmark = make([("s1", "a", "Thoroughfare", "R des Tournelles", "fr"), ("s2", "b", "Thoroughfare", "rue Tournelles", "fr"), ("s1", "n", "StreetNumber", "12 bis", None), ("s2", "m", "StreetNumber", "12b", None), ("s3", "z", "Thoroughfare", "rue Tournelles", "fr")], "g string, lm string, type string, label string, lang string")
    relation = make([("s1", "r1", "Belongs", "n", "a"), ("s2", "r2", "Belongs", "m", "b")], "g string, lr string, type string, locatum string, relatum string")
    version = make([("s1", "a", "a-name", "Name", "v1", "R des Tournelles", "fr", 1800, 1810), ("s2", "b", "b-name", "Name", "v2", "rue Tournelles", "fr", 1830, 1840), ("s3", "z", "z-name", "Name", "v3", "other", "fr", 1850, 1860)], "g string, lm string, attr string, attr_type string, av string, value string, lang string, begin int, end int")
    stamp = lambda c: F.make_date(F.col(c), F.lit(1), F.lit(1)).cast("timestamp_ntz").alias(c)
    version = version.select(*[stamp(c) if c in ("begin", "end") else c for c in version.columns])
    change = make([], "g string, attr string, stamp timestamp_ntz, precision int, cg string, makes array<string>, outdates array<string>")
    event_time = make([], "ev string, prop string, t timestamp_ntz, applied_to string, type string")
    registry = make([(g, "source", True, g, "fr") for g in ("s1", "s2", "s3")], "g string, role string, is_active boolean, label string, lang string")
    return {"landmark": landmark, "relation": relation, "version": version, "change": change, "event_time": event_time, "registry": registry}


def test_build_and_resume(spark, tmp_path):
    own = inputs(spark)
    build = Build(spark, str(tmp_path), own, excluded=["s3"])
    build.run()
    roots = {r.trace: r.root for r in build.table("landmark_roots").collect()}
    assert roots["a"] == roots["b"] and roots["n"] == roots["m"] and "z" not in roots
    facts = build.table("facts").collect()
    assert [sorted(r.traces) for r in facts] == [["v1", "v2"]]
    assert (facts[0].begin_before.year, facts[0].end_after.year) == (1800, 1840)
    assert {r.label for r in build.table("addresses").collect()} == {"12 bis, R des Tournelles", "12b, rue Tournelles"}
    bounds = {(r.prop, r.t.year) for r in build.table("event_times").collect()}
    assert bounds == {("hasTimeBefore", 1800), ("hasTimeAfter", 1840)}
    build.run("facts")
    assert build.table("facts").count() == 1
    with pytest.raises(ValueError):
        Build(spark, str(tmp_path), {"landmark": own["landmark"]})


def test_service(spark):
    make = spark.createDataFrame
    bounds = lambda *rows: make([(e, *[None if y is None else f"{y}-01-01" for y in ys]) for e, *ys in rows], "elem string, " + ", ".join(f"{b} string" for b in BOUNDS)).select("elem", *[F.col(b).cast("timestamp_ntz").alias(b) for b in BOUNDS])
    tables = {
        "registry": make([("f", "final", True, "Faits", "fr")], "g string, role string, is_active boolean, label string, lang string"),
        "code": make([("landmark", "Thoroughfare", "Voie", "fr"), ("landmark", "Thoroughfare", "Thoroughfare", "en")], "kind string, code string, label string, lang string"),
        "landmark": make([("f", "a", "Thoroughfare", "Rue Été", "fr"), ("f", "n", "StreetNumber", "12", None)], "g string, lm string, type string, label string, lang string"),
        "relation": make([("r", "Belongs", "n", "a")], "lr string, type string, locatum string, relatum string"),
        "version": make([("v1", "a", "Name", "Rue Été", 0.0, 0.0), ("v2", "a", "Geometry", "POINT (2 48)", 2.0, 48.0), ("v3", "a", "Geometry", "POINT (3 48)", 3.0, 48.0)], "av string, lm string, attr_type string, value string, x double, y double"),
        "landmark_bounds": bounds(("a", None, 1800, 1805, None, 1900, 1910)),
        "version_bounds": bounds(("v1", 1801, None, None, None, None, None), ("v2", 1801, None, None, 1850, None, None), ("v3", 1850, None, None, None, None, None)),
    }
    s = Service(tables, Reading(time_delay_years=10))
    assert s.graphs().first().label == "Faits" and s.types("landmark").first().label == "Voie"
    assert {r.label for r in s.landmarks("f").collect()} == {"Rue Été", "12 (Rue Été)"}
    assert [r.lm for r in s.search("f", "ETE").collect()] == ["n", "a"]
    (f,) = s.snapshot("1840-06-01").collect()
    assert (f.lm, f.names, f.geometry, f.exists_for_sure) == ("a", ["Rue Été"], "POINT (2 48)", True)
    square = lambda a, b: {"type": "Polygon", "coordinates": [[[a, 47], [b, 47], [b, 49], [a, 49], [a, 47]]]}
    assert s.snapshot("1840-06-01", square(1, 2.5)).count() == 1 and s.snapshot("1840-06-01", square(2.5, 4)).count() == 0
    assert s.snapshot("1700-01-01").count() == 0
    line = s.evolution("a").collect()
    assert [r.av for r in line] == ["v1", "v2", "v3"] and line[1].end.kind == "crisp" and line[0].end is None
    assert s.time_labels("a").first().app == "Date de création: entre 1er janvier 1800 et 1er janvier 1805"
