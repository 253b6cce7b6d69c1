"""Ontologies from files, project settings in three formats, lists of streets, collections and unknown systems."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolith.functions import geo
from chronolith.operators import inference
from chronolith.sources import config, files, ontology

TTL = """@prefix : <http://o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:owner a owl:FunctionalProperty, owl:ObjectProperty . :code a owl:DatatypeProperty . :near a owl:SymmetricProperty .
:partOf a owl:TransitiveProperty ; owl:inverseOf :hasPart ; rdfs:domain :Part ; rdfs:range :Whole .
:of rdfs:subPropertyOf :about .
:Thing owl:equivalentClass [ a owl:Class ; owl:unionOf ( :Part :Whole ) ] . :Both owl:intersectionOf ( :Part :Whole ) .
:Part rdfs:subClassOf :Piece . :House owl:hasKey ( :of :code ) .
"""
STATED = [("a", "partOf", "b"), ("b", "partOf", "c"), ("x", "owner", "p"), ("x", "owner", "q"), ("h1", "of", "p"), ("h2", "of", "q"), ("h1", "code", "7"), ("h2", "code", "7"), ("h2", "near", "h3")]


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(TTL)
    rows, bad = ontology.load(spark, [f"file://{tmp_path}/o.ttl", f"file://{tmp_path}/o.ttl"])
    assert bad.collect() == [] and {r.g for r in rows.select("g").collect()} == {"ontology"}
    rules = ontology.Rules(ontology.local_names(rows, ["http://o#"]))
    assert rules.keys() == [["of", "code"]] and rules.members("unionOf") == [("Thing", "Part"), ("Thing", "Whole")] and rules.members("intersectionOf") == [("Both", "Part"), ("Both", "Whole")]
    got, members = inference.reasoned(spark.createDataFrame(STATED, "s string, p string, o string"), **rules.for_inference())
    assert sorted(map(tuple, members.collect())) == [("h2", "h1"), ("q", "p")]
    found = {tuple(r) for r in got.collect()}
    assert {("a", "partOf", "c"), ("c", "hasPart", "a"), ("h1", "about", "p"), ("h3", "near", "h1"), ("b", "type", "Both"), ("a", "type", "Thing"), ("a", "type", "Piece"), ("x", "owner", "p")} <= found
    assert ("a", "type", "Both") not in found and not any("h2" in r or "q" in r for r in found)


SETTINGS = {
    "paths": {"tmp_folder": "../tmp"}, "labels": {"lang": "fr"}, "named_graphs": {g: g for g in config.GRAPHS},
    "comparison_settings": {"geom_similarity_coef": 0.8, "geom_buffer_radius": 12, "epsg_code": "EPSG:2154", "geom_crs_uri": "x"}, "namespaces": {"GRAPH": "http://g/", "RES": "http://r/"},
}


@pytest.mark.parametrize("kind", ["yaml", "json", "ini"])
def test_project_settings(tmp_path, kind):
    if kind == "yaml":
        text = "\n".join(f"{k}:\n" + "\n".join(f'  {a}: "{b}"' if isinstance(b, str) else f"  {a}: {b}" for a, b in v.items()) for k, v in SETTINGS.items())
    elif kind == "json":
        import json

        text = json.dumps(SETTINGS)
    else:
        text = "\n".join(f"[{k}]\n" + "\n".join(f"{a} = {b}" for a, b in v.items()) for k, v in SETTINGS.items())
    (tmp_path / f"c.{kind}").write_text(text)
    (tmp_path / "u.ini").write_text("[folders]\ndata_folder = %data\n")
    own = config.project(str(tmp_path / f"c.{kind}"), str(tmp_path / "u.ini"))
    assert own.comparison == config.Comparison(0.8, 12.0, 10.0, "EPSG:2154") and own.graph_uri("facts") == "http://g/facts" and own.user["folders"]["data_folder"] == "%data" and own.labels["lang"] == "fr"


@pytest.mark.parametrize("part, value", [("named_graphs", {"facts": "f"}), ("named_graphs", {g: "same" for g in config.GRAPHS}), ("comparison_settings", {"geom_similarity_coef": 2})])
def test_bad_settings(tmp_path, part, value):
    import json

    (tmp_path / "c.json").write_text(json.dumps(SETTINGS | {part: value}))
    with pytest.raises(ValueError):
        config.project(str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text(json.dumps({k: v for k, v in SETTINGS.items() if k != part}))
    with pytest.raises(ValueError):
        config.project(str(tmp_path / "d.json"))


def test_street_lists_need_their_columns(spark):
    rows = spark.createDataFrame([("1", "rue x")], "id string, typo_min string")
    with pytest.raises(ValueError, match="date_arret"):
        files.street_list(rows, "city", "current", "json")


def test_collections_and_unknown_systems(spark):
    nested = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[0,0],[10.5,-2.5]]}]}]}'
    rows = spark.createDataFrame([(nested,), ('{"type":"GeometryCollection","geometries":[]}',), ('{"type":"Point","coordinates":[3,4]}',), (None,)], "j string")
    got = [r[0] for r in rows.select(geo.geojson_to_wkt(F.col("j"))).collect()]
    assert got == ["GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (LINESTRING (0 0, 10.5 -2.5)))", "GEOMETRYCOLLECTION EMPTY", "POINT (3 4)", None]
    back = spark.createDataFrame([(w,) for w in got[:3]], "w string").select(geo.wkt_to_geojson(F.col("w"))).collect()
    assert [r[0] for r in back] == ['{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"LineString","coordinates":[[0,0],[10.5,-2.5]]}]}', '{"type":"GeometryCollection","geometries":[]}', '{"type":"Point","coordinates":[3,4]}']
    odd = spark.createDataFrame([("<http://www.opengis.net/def/crs/EPSG/0/9999> POINT (1 2)",)], "w string")
    with pytest.raises(Exception, match="unknown reference system"):
        odd.select(geo.literal_to_geojson(F.col("w"))).collect()
