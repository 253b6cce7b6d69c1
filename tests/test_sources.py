from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chronolith.operators import graph, rooting
from chronolith.sources import config, events_json, files, states_json
from chronolith.streaming import incremental

EVENTS = {
    "source": {"uri": "http://s", "label": "S", "lang": "fr", "publisher": {"uri": "http://p", "label": "P"}},
    "events": [
        {
            "time": {"stamp": "1800-01-01", "calendar": "gregorian", "precision": "day"},
            "label": "first",
            "lang": "fr",
            "landmarks": [
                {"id": 1, "label": "Rue A", "lang": "fr", "type": "Thoroughfare", "changes": [{"on": "landmark", "type": "appearance"}, {"on": "attribute", "attribute": "name", "makes_effective": [{"value": "Rue A", "lang": "fr"}], "outdates": [{"value": "Rue Z", "lang": "fr"}]}]},
                {"id": 2, "label": "12", "type": "HouseNumber", "changes": []},
            ],
            "relations": [{"id": 1, "type": "Belongs", "locatum": 2, "relatum": [1], "changes": [{"on": "relation", "type": "appearance"}]}, {"id": 2, "type": "Along", "locatum": 2, "relatum": 1}],
        },
        {"label": "broken", "landmarks": "none"},
    ],
}
STATES = {
    "source": {"uri": "http://t"},
    "time": {"start": {"stamp": "1800"}, "end": {"stamp": "1810"}},
    "landmarks": [{"id": "a", "label": "Rue A", "lang": "fr", "type": "Thoroughfare", "attributes": {"name": {"value": "Rue A", "lang": "fr"}, "insee_code": {"value": "75"}}}, {"id": "b", "label": "1", "type": "StreetNumber", "time": {"start": {"stamp": "1805"}}}],
    "relations": [{"id": "r", "type": "Belongs", "locatum": "b", "relatum": ["a"]}, {"id": "q", "type": "Within", "locatum": "b", "relatum": "zz"}],
    "addresses": [{"id": "x", "label": "1, Rue A", "target": "b", "segments": ["b", "a"]}],
}


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(EVENTS))
    got = events_json.read(spark, str(tmp_path / "e.json"))
    assert {k: v.count() for k, v in got.items()} == {"event": 1, "landmark": 2, "change": 2, "version": 2, "relation": 2, "relation_change": 1, "source": 1, "rejected": 1}
    assert sorted(r.type for r in got["change"].collect()) == ["AttributeVersionTransition", "LandmarkAppearance"]
    assert {(r.side, r.value) for r in got["version"].collect()} == {("makesEffective", "Rue A"), ("outdates", "Rue Z")}
    lm = {r.label: r.lm for r in got["landmark"].collect()}
    assert {(r.locatum, r.relatum) for r in got["relation"].collect()} == {(lm["12"], lm["Rue A"])}


def test_states(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(STATES))
    got = states_json.read(spark, str(tmp_path / "s.json"))
    assert {k: v.count() for k, v in got.items()} == {"landmark": 2, "valid_time": 2, "version": 2, "relation": 2, "address": 2, "undefined": 1}
    starts = {r.start.stamp for r in got["valid_time"].collect()}
    assert starts == {"1800", "1805"} and {r.attr_type for r in got["version"].collect()} == {"Name", "InseeCode"}


def test_tables(spark, tmp_path):
    (tmp_path / "ban.csv").write_text("﻿id;numero;rep;nom_voie;code_postal;code_insee;nom_commune;lon;lat\n1;12;bis;Rue A;75004;75104;Paris;2.3;48.8\n2;13;;Rue A;75004;75104;Paris;2.4;48.8\n")
    got = files.address_file(files.read_csv(spark, str(tmp_path / "ban.csv"), files.BAN, ";"), "ban")
    assert got["landmark"].groupBy("type").count().count() == 4 and got["landmark"].count() == 5 and got["relation"].count() == 6
    assert "12bis Rue A, 75004 Paris" in {r.label for r in got["address"].collect()}
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::2154"}}, "features": [{"type": "Feature", "properties": {"n": "A"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"n": "A"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4.5]]}}, {"type": "Feature", "properties": {"n": None}, "geometry": None}]}))
    merged = {r.properties["n"]: r.wkt for r in files.merged_features(files.read_geojson(spark, str(tmp_path / "g.geojson")), "n").collect()}
    assert merged["A"] == "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4.5))"
    streets = spark.createDataFrame([("1", "Rue B", "1900-01-01", "", "3e, 4e")], "id string, name string, start string, end string, area string")
    city = files.street_nomenclature(streets, "city", "name", "start", "end", ["area"])
    assert city["relation"].count() == 2 and [r.type for r in city["event"].collect()] == ["LandmarkAppearance"]
    numbered = files.street_number_features(spark.createDataFrame([({"a": "12 bis rue X"}, "POINT (0 0)")], "properties map<string,string>, wkt string"), None, None, "a")
    assert tuple(numbered.first())[:2] == ("12 bis", "rue X")


def test_graphs(spark, tmp_path):
    quads = spark.createDataFrame([("g1", "a", "p", "b", "uri"), ("g2", "b", "p", 'x"y', "literal")], "g string, s string, p string, o string, o_kind string")
    path = str(tmp_path / "q")
    files.write_graph(quads, path)
    files.replace_graphs(quads.where("g = 'g2'").withColumn("o", F.lit("new")), path)
    assert sorted(r.o for r in files.read_graphs(spark, path).collect()) == ["b", "new"] and files.read_graphs(spark, path, ["g1"]).count() == 1
    files.write_lines(graph.n_quads(quads), str(tmp_path / "nq"))
    assert '<b> <p> "x\\"y" <g2> .' in {r.value for r in spark.read.text(str(tmp_path / "nq")).collect()}
    registry = spark.createDataFrame([], "g string, role string, is_active boolean, label string, lang string")
    for name, role in (("s1", "source"), ("s2", "source"), ("f", "final"), ("c", "construction")):
        registry = graph.registered(registry, name, role, name.upper(), "fr")
    registry = graph.activated(registry, False, ["s2"])
    rows = spark.createDataFrame([("s1", 1), ("s2", 2), ("f", 3)], "g string, v int")
    assert [r.v for r in graph.in_active_sources(rows, registry).collect()] == [1]
    assert [r.label for r in graph.final_graphs(registry, "fr").collect()] == ["F"] and graph.without_construction(registry).count() == 3
    with pytest.raises(ValueError):
        graph.registered(registry, "x", "nothing")


def test_rooting_keeps_known_roots(spark):
    lm = spark.createDataFrame([("1", "District", "a", "fr"), ("2", "District", "a", "fr"), ("3", "District", "a", None), ("4", "HouseNumber", "a", "fr")], "lm string, type string, hidden_label string, lang string")
    known = spark.createDataFrame([("District", "a", "fr", "R")], "type string, hidden_label string, hidden_lang string, root string")
    got = {r.trace: r.root for r in rooting.landmarks_by_label(lm, None, known).collect()}
    assert got["1"] == got["2"] == "R" and got["3"] != "R" and "4" not in got


def test_settings(tmp_path):
    store = config.Store(str(tmp_path / "c.json"))
    assert store.get() == config.Reading()
    new = {"default_lang": "en", "search_limit": 5, "time_delay_years": 1, "calendar": "gregorian"}
    assert store.put(new).search_limit == 5 and store.get().default_lang == "en"
    for bad in ({**new, "search_limit": 0}, {**new, "more": 1}, {"default_lang": "en"}):
        with pytest.raises(ValueError):
            store.put(bad)
    assert store.get().search_limit == 5 and store.reset() == config.Reading()


def test_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    row = lambda av, value, a, b: json.dumps({"attr": "x", "av": av, "value": value, "begin": f"{a}-01-01T00:00:00", "end": f"{b}-01-01T00:00:00", "arrived": "2024-01-01T00:00:00Z"})
    (source / "1.json").write_text(row("a", "v", 1800, 1810) + "\n" + row("a", "v", 1800, 1810) + "\n")
    incremental.start(spark, str(source), str(target)).awaitTermination()
    assert incremental.latest(spark, str(target)).count() == 1
    (source / "2.json").write_text(row("b", "w", 1830, 1840) + "\n")
    incremental.start(spark, str(source), str(target)).awaitTermination()
    got = sorted("".join(r.traces) for r in incremental.latest(spark, str(target)).collect())
    assert got == ["a", "b"] and incremental.latest(spark, str(target), ["x"]).count() == 2 and incremental.latest(spark, str(target), ["none"]).count() == 0
    events = spark.createDataFrame([("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 02:00:00", "view", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.total) for r in incremental.windowed_counts(events).collect()] == [(2, 3.0)]
