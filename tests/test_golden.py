"""Golden cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolith.functions import geo, ids, text, times
from chronolith.operators import changes, evolution, linking, metrics, reading


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "kind", "lang", "normal", "simple"),
    [
        ("R des Tournelles", "thoroughfare", "fr", "Rue des Tournelles", "ruetournelles"),
        ("rue de l Echarpe", "thoroughfare", "fr", "Rue de l'Echarpe", "rueecharpe"),
        ("rue de l’Écharpe", "thoroughfare", "fr", "Rue de l'Écharpe", "rueecharpe"),
        ("st germain en laye", "area", "fr", "Saint-Germain-en-Laye", "saintgermainlaye"),
        ("La Ferté", "area", "fr", "La Ferté", "ferte"),
        ("12 bis", "number", None, "12b", "12b"),
        ("5 quater", "number", None, "5d", "5d"),
        ("12/14", "number", None, "12-14", "12-14"),
        ("12 BIS", "number", "fr", "12 bis", "12bis"),
        ("anything", "number", "en", None, None),
        (None, "area", "fr", None, None),
        ("Boulevart du Temple", "thoroughfare", "fr", "Boulevart du Temple", "boulevardtemple"),
    ],
)
def test_names(spark, name, kind, lang, normal, simple):
    got = text.normal_name(F.col("name"), F.col("kind"), F.col("lang"))
    assert one(spark, got, name=name, kind=kind, lang=lang) == normal
    assert one(spark, text.simplified_name(got, F.col("kind"), F.col("lang")), name=name, kind=kind, lang=lang) == simple


def test_compatible_numbers_hit_ter_first(spark):
    assert one(spark, text.normal_number(F.lit("5 quater"), compat=True)) == "5quac"


@pytest.mark.parametrize(("address", "number", "street"), [("12 bis rue de Rivoli", "12 bis", "rue de Rivoli"), ("place des Vosges", None, "place des Vosges"), ("7B rue X", "7B", "rue X")])
def test_addresses(spark, address, number, street):
    n, s = text.split_address(F.lit(address))
    assert (one(spark, n), one(spark, s)) == (number, street)


def test_cells_and_ratio(spark):
    assert one(spark, text.split_cell(F.lit("a , b"))) == ["a", "b"] and one(spark, text.split_cell(F.lit(""))) == []
    assert one(spark, text.block_ratio()(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(spark, text.levenshtein_ratio(F.lit(""), F.lit(""))) == 1.0


@pytest.mark.parametrize(
    ("raw", "stamp"),
    [("1904/4/5", "1904-04-05T00:00:00Z"), ("1789-07-14", "1789-07-14T00:00:00Z"), ("1789-07-14 1:02", "1789-07-14T01:02:00Z"), ("1789-07-14T01:02:03.5Z", "1789-07-14T01:02:03Z"), ("-52-1-2", "-0052-01-02T00:00:00Z"), ("soon", None)],
)
def test_stamps(spark, raw, stamp):
    assert one(spark, times.canonical_stamp(F.lit(raw))) == stamp


@pytest.mark.parametrize(("precision", "cut"), [("day", "1789-07-14"), ("month", "1789-07"), ("year", "1789"), ("decade", "178"), ("century", "17"), ("unitMillenium", "1"), ("millennium", "1")])
def test_truncation(spark, precision, cut):
    assert one(spark, times.truncated(F.lit("1789-07-14"), F.lit(precision))) == cut
    assert one(spark, times.truncated(F.lit("-1789-07-14"), F.lit("century"))) == "-17"


def test_calendars(spark):
    n = F.lit
    assert one(spark, times.day_number(n("1789-07-14").cast("date"))) == 653248
    assert str(one(spark, times.to_gregorian(n(1582), n(10), n(5), n("julian")))) == "1582-10-15"
    assert str(one(spark, times.to_gregorian(n(1), n(1), n(1), n("republican")))) == "1792-09-22"
    assert str(one(spark, times.date_of_julian_day(times.islamic_to_julian_day(n(1445), n(9), n(1))))) == "2024-03-11"
    assert str(one(spark, times.date_of_julian_day(times.hebrew_to_julian_day(n(5784), n(1), n(15))))) == "2024-04-23"
    assert str(one(spark, times.date_of_julian_day(times.hebrew_to_julian_day(n(5785), n(7), n(1))))) == "2024-10-03"
    assert one(spark, times.calendar_of(n("http://www.wikidata.org/entity/Q181974"))) == "republican"


def test_labels(spark):
    day = F.lit("1801-05-01").cast("timestamp_ntz")
    label = lambda p, lang: one(spark, times.time_label(day, F.lit(p), lang))
    assert [label(p, "fr") for p in ("millennium", "century", "decade", "year", "month", "day")] == ["2e millénaire", "19e siècle", "années 1800", "1801", "mai 1801", "1er mai 1801"]
    assert [label(p, "en") for p in ("millennium", "century", "decade", "year", "month", "day")] == ["2nd millennium", "19th century", "1800s", "1801", "May 1801", "May 01, 1801"]


def test_similarity(spark):
    box = lambda x1, y1, x2, y2: geo.envelope(F.lit(f"POLYGON (({x1} {y1}, {x2} {y1}, {x2} {y2}, {x1} {y2}, {x1} {y1}))"))
    assert one(spark, geo.box_iou(box(0, 0, 10, 10), box(0, 0, 10, 9))) == pytest.approx(0.9)
    assert one(spark, geo.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    p = lambda wkt: geo.centroid(repr(wkt))
    assert one(spark, geo.similar_points(p("POINT (0 0)"), p("POINT (10 0)"), 10.0)) is True


def test_projection(spark):
    uri, body = geo.split_literal(F.lit("<http://www.opengis.net/def/crs/EPSG/0/2154> POINT (651278.600083 6862856.041463)"))
    got = one(spark, geo.reprojected(geo.points(body)[0], "2154", "4326"))
    assert abs(got.x - 2.337) < 0.01 and abs(got.y - 48.864) < 0.01
    assert one(spark, geo.epsg_of(uri)) == "2154"
    assert one(spark, geo.geojson_to_wkt(F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'))) == "POLYGON ((0 0, 1 0, 1 1, 0 0))"
    assert one(spark, geo.wkt_to_geojson(F.lit("LINESTRING (0 0, 1.5 2)"))) == '{"type":"LineString","coordinates":[[0,0],[1.5,2]]}'


@pytest.mark.parametrize("area", [{"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}, {"type": "FeatureCollection", "features": []}, {"type": "Polygon", "coordinates": [[[0, 0], [200, 0], [1, 1], [0, 0]]]}])
def test_bad_areas(area):
    with pytest.raises(ValueError):
        geo.area_rings(area)


TRUTH = [  # t = 1850, low = 1830, high = 1870
    ("within_margin", None, None, 1860, 1840, False, True),
    ("at_margin", None, None, 1870, 1830, False, True),
    ("appearance_outside", None, None, 1871, 1840, False, False),
    ("disappearance_outside", None, None, 1840, 1829, False, False),
    ("missing_appearance", None, None, None, 1900, False, False),
    ("missing_disappearance", None, None, 1800, None, False, False),
    ("crisp", 1800, 1900, None, None, True, True),
]


def test_certainty(spark):
    year = lambda y: None if y is None else f"{y}-01-01"
    rows = [(n, year(a), None, year(fe), year(d), year(fb), None) for n, a, d, fe, fb, *_ in TRUTH]
    bounds = spark.createDataFrame(rows, "elem string, " + ", ".join(f"{b} string" for b in reading.BOUNDS)).select("elem", *[F.col(b).cast("timestamp_ntz").alias(b) for b in reading.BOUNDS])
    at = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    strict = {r.elem: r.sure for r in reading.landmarks_at(bounds, at(1850)).collect()}
    loose = {r.elem: r.sure for r in reading.landmarks_at(bounds, at(1850), at(1830), at(1870)).collect()}
    assert strict == {n: s for n, *_, s, _ in TRUTH} and loose == {n: s for n, *_, s in TRUTH}


def test_final_times(spark):
    rows = [("e", "hasTimeBefore", 1800), ("e", "hasTimeBefore", 1810), ("e", "hasTimeAfter", 1700), ("e", "hasTimeAfter", 1750), ("f", "hasTime", 1820), ("f", "hasTimeBefore", 1800)]
    c = spark.createDataFrame([(e, p, f"{y}-01-01") for e, p, y in rows], "ev string, prop string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    final = changes.final_times(c)
    assert sorted((r.ev, r.prop, r.t.year) for r in final.collect()) == [("e", "hasTimeAfter", 1750), ("e", "hasTimeBefore", 1800), ("f", "hasTime", 1820)]
    (fuzzy,) = changes.fuzzy_instants(final).collect()
    assert (fuzzy.ev, fuzzy.fuzzy_begin.year, fuzzy.fuzzy_end.year) == ("e", 1750, 1800)


def evolved(spark, versions, stated, same):
    v = spark.createDataFrame([("x", *row) for row in versions], "attr string, av string, begin int, end int")
    c = spark.createDataFrame([("x", y, 11, f"c{y}", [], []) for y in stated], "attr string, stamp int, precision int, cg string, makes array<string>, outdates array<string>")
    pairs = spark.createDataFrame([(a, b, s) for a, b, s in same] + [(b, a, s) for a, b, s in same] or [("-", "-", True)], "av1 string, av2 string, same boolean")
    out = evolution.evolution(v, c, pairs).orderBy("version").collect()
    return [("".join(r.traces), (r.begin_after, r.begin_before), (r.end_after, r.end_before)) for r in out]


AB = [("a", 1800, 1810), ("b", 1830, 1840)]


def test_evolution(spark):
    assert evolved(spark, AB, [], [("a", "b", True)]) == [("ab", (None, 1800), (1840, None))]
    assert evolved(spark, AB, [], [("a", "b", False)]) == [("a", (None, 1800), (1810, 1830)), ("b", (1810, 1830), (1840, None))]
    assert evolved(spark, AB, [1820], [("a", "b", True)]) == [("a", (None, 1800), (1820, 1820)), ("b", (1820, 1820), (1840, None))]
    two = [("a", 1800, 1810), ("b", 1830, 1840), ("d", 1830, 1840)]
    assert len(evolved(spark, two, [], [("a", "b", True), ("a", "d", False), ("b", "d", False)])) == 2
    three = [("a", 1800, 1810), ("b", 1810, 1820), ("c", 1820, 1830)]
    assert evolved(spark, three, [], [("a", "b", True), ("b", "c", True), ("a", "c", False)]) == [("abc", (None, 1800), (1830, None))]


def test_links_and_groups(spark):
    rows = spark.createDataFrame([("a1", 1, "k", 0.0, 0.0), ("a2", 2, "k", 3.0, 0.0), ("a3", 3, "k", 20.0, 0.0), ("b1", 1, "z", 0.0, 0.0), ("n", 1, None, 0.0, 0.0)], "id string, ord int, key string, x double, y double")
    links = linking.successive_links(rows)
    assert sorted((r.from_id, r.to_id, r.similar) for r in links.collect()) == [("a1", "a2", True), ("a2", "a3", False)]
    assert sorted(r.sources for r in linking.groups_of_sources(links).collect()) == [[1, 2], [3]]
    assert sorted(r.id for r in linking.unlinked(rows, links).collect()) == ["b1", "n"]
    ten = spark.createDataFrame([("a", 1, "k", 0.0, 0.0), ("b", 2, "k", 10.0, 0.0)], "id string, ord int, key string, x double, y double")
    assert [r.similar for r in linking.successive_links(ten).collect()] == [False]


def test_quality(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "label string, version string, source string")
    ref, mod = metrics.version_sources(rows(("l", "1", "a"), ("l", "2", "b"), ("m", "1", "a"))), metrics.version_sources(rows(("l", "x", "a"), ("l", "y", "b"), ("m", "x", "b")))
    got = {r.label: (r.right, r.iou) for r in metrics.version_quality(ref, mod).collect()}
    assert got == {"l": (True, 1.0), "m": (False, 0.0)}
    (all_,) = metrics.overall(metrics.version_quality(ref, mod)).collect()
    assert (all_.n_right, all_.n_wrong, all_.n_labels) == (1, 1, 2)
    schema = "label string, change string, day long, before_day long, after_day long"
    a = spark.createDataFrame([("l", "1", None, 20, 10)], schema)
    b = spark.createDataFrame([("l", "x", 15, None, None), ("q", "x", 1, None, None)], schema)
    assert sorted(tuple(r) for r in metrics.change_quality(a, b).collect()) == [("l", True, False, True), ("q", False, False, False)]


def test_terms(spark):
    assert one(spark, ids.is_valid_uri(F.lit("https://a/b"))) is True and one(spark, ids.is_valid_uri(F.lit("https://a/b> }"))) is False
    assert [one(spark, ids.boolean_of(F.lit(v))) for v in ("true", "1", "FALSE", "0", "x")] == [True, True, False, False, None]
    assert one(spark, ids.escaped_html(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"
