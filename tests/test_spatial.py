"""Spatial joins and overlays against plain loops over every pair."""

from __future__ import annotations

import math
import random
import re

import pytest

from chronolith.functions import geo
from chronolith.operators import reading, spatial
from chronolith.plans import catalogue

SF = "/root/testdata/sf0.001"


def text(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in [*q, q[0]]) + ")" for q in rings) + ")"


def star(r, cx, cy, radius, n):
    return [(cx + radius * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + radius * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def inside(rings, x, y):
    edges = [e for q in rings for e in zip(q, q[1:] + q[:1])]
    return sum((a[0] > x) != (b[0] > x) and y < a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in edges) % 2 == 1


def test_points_in_polygons(spark):
    r = random.Random(5)
    polygons = [(100, [box(0, 0, 10, 10), box(2, 2, 2, 2)]), (101, [box(-3, -3, 0.001, 0.002)]), (102, [[(0, 0), (5, 0), (9, 0)]])]
    for i in range(60):
        cx, cy, radius = r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.5, 3, 20, 40])
        polygons.append((i, [star(r, cx, cy, radius, r.randint(3, 40)), *([box(cx, cy, radius / 5, radius / 5)] if i % 2 else [])]))
    points = [(k, r.uniform(-90, 90), r.uniform(-90, 90), "a") for k in range(1500)] + [(9000 + i * 20 + j, float(i), float(j), "b") for i in range(-4, 12) for j in range(-4, 12)] + [(1, None, 1.0, "c"), (2, 3.0, 3.0, None), (2, 3.0, 3.0, None)]
    table = spark.createDataFrame(points, "poly_id long, x double, y double, edges string")
    areas = spark.createDataFrame([(i, text(*q)) for i, q in polygons] + [(500, None), (501, "POLYGON EMPTY"), (502, "POINT (1 1)")], "poly long, wkt string")
    want = sorted((k, i) for k, x, y, _ in points if x is not None for i, q in polygons if inside(q, x, y))
    joined = spatial.points_in_polygons(table, areas)
    assert sorted((x.poly_id, x.poly) for x in joined.collect()) == want and joined.columns == ["poly_id", "x", "y", "edges", "poly"]
    one = sorted(k for k, x, y, _ in points if x is not None and any(inside(q, x, y) for _, q in polygons))
    assert sorted(x.poly_id for x in spatial.points_within(table, areas).collect()) == one
    assert spatial.points_in_polygons(table, areas.limit(0)).collect() == [] and spatial.points_within(table, areas.limit(0)).collect() == []


def test_no_nested_loops(spark):
    plan = catalogue.QUERIES["q19_many_areas"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_area_with_hole(spark):
    hole = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 5.0), (4, 4.0, 4.0), (5, 6.0, 6.0)], "id int, x double, y double")
    assert sorted(x.id for x in reading.within_area(points, hole).collect()) == [2, 5]
    with pytest.raises(ValueError):
        geo.area_polygons({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]})


def area_of(polygons, every):
    """Area and middle by thin upright slices."""
    xs = [x for q in polygons for ring in q for x, _ in ring]
    low, high, n = min(xs), max(xs), 3000
    total, mx = 0.0, 0.0
    for k in range(n):
        x = low + (high - low) * (k + 0.5) / n
        marks = []
        for q in polygons:
            ys = sorted(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for ring in q for a, b in zip(ring, ring[1:] + ring[:1]) if (a[0] > x) != (b[0] > x))
            marks += [(y, 1 if i % 2 == 0 else -1) for i, y in enumerate(ys)]
        held, last = 0, 0.0
        for y, step in sorted(marks):
            if held >= (len(polygons) if every else 1):
                total += (y - last) * (high - low) / n
                mx += x * (y - last) * (high - low) / n
            held, last = held + step, y
    return total, mx / total if total else 0.0


def wkt_area(wkt):
    out = 0.0
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        q = [tuple(map(float, p.split())) for p in ring.split(",")]
        out += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:])) / 2
    return out


@pytest.mark.parametrize("every", [False, True])
def test_overlays(spark, every):
    r = random.Random(11)
    groups = {g: [[[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(3)]] for _ in range(2 if every else 9)] for g in range(5)}
    groups |= {7: [[star(r, 0, 0, 5, 25)], [star(r, 1, 1, 5, 25)]], 8: [[box(0, 0, 6, 6), box(1, 1, 4, 4)], [box(2, 2, 2, 2)], [box(0, 0, 1, 6)]], 9: [[box(0, 0, 2, 2)], [box(2, 0, 2, 2)], [box(0, 2, 4, 1)]], 10: [[box(0, 0, 1, 1)], [box(1, 1, 1, 1)]], 11: [[box(0, 0, 3, 3)]]}
    rows = [(g, text(*q)) for g, own in groups.items() for q in own] + [(3, text(*groups[3][0])), (12, None), (13, "POLYGON EMPTY"), (14, text([(0, 0), (1, 1), (2, 2)]))]
    shapes = spark.createDataFrame(rows, "g int, wkt string").repartition(3)
    got = {x.g: (x.area, x.x) for x in spatial.overlay_measures(shapes, every).collect()}
    whole = {x.g: x.wkt for x in spatial.dissolved(shapes, every).collect()}
    for g, own in groups.items():
        area, middle = area_of(own, every)
        if area < 1e-9:
            assert g not in got and g not in whole
            continue
        assert math.isclose(got[g][0], area, rel_tol=2e-3) and abs(got[g][1] - middle) < 0.02, g
        assert math.isclose(wkt_area(whole[g]), got[g][0], rel_tol=1e-9)
    assert set(got) == set(whole) <= set(groups)
    if not every:
        assert whole[9] == text([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]) and whole[11] == text(box(0.0, 0.0, 3.0, 3.0))
        assert wkt_area(whole[8]) == 36 - 16 + 4 and whole[8].count("((") == 2 and whole[10].startswith("MULTIPOLYGON")


def test_unions_of_kinds(spark):
    rows = [(1, text(box(0, 0, 10, 1))), (1, text(box(5, 0, 15, 1))), (1, "POINT (9 9)"), (2, "POINT (1 2)"), (2, "POINT (1 2)"), (3, "LINESTRING (0 0, 4 0)"), (3, "POINT (7 7)"), (4, None)]
    shapes = spark.createDataFrame(rows, "g int, wkt string")
    got = {x.g: x.wkt for x in spatial.unions(shapes).collect()}
    assert got[2] == "POINT (1 2)" and got[3] == "GEOMETRYCOLLECTION (LINESTRING (0 0, 4 0), POINT (7 7))" and got[1].startswith("GEOMETRYCOLLECTION (POINT (9 9), POLYGON") and 4 not in got
    middles = {x.g: (x.x, x.y) for x in spatial.middles(shapes).collect()}
    assert middles == {1: (10.0, 0.5), 2: (1.0, 2.0), 3: (2.0, 0.0)}  # summing the two boxes one by one would give 8.33


def test_middle_of_buffers(spark):
    points = [(1, 0, 0.0, 0.0), (1, 1, 6.0, 0.0), (2, 5, 1.0, 1.0), (2, 9, 50.0, 1.0), (3, 0, 2.0, 3.0), (4, 0, 0.0, 0.0), (4, 1, 4.0, 0.0), (4, 2, 2.0, 3.0), (5, 0, None, 1.0)]
    got = {x.g: (x.x, x.y) for x in spatial.points_near_all(spark.createDataFrame(points, "g int, ordinal int, x double, y double"), 5.0).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == (1.0, 1.0)
    assert all(math.isclose(a, b, abs_tol=1e-6) for g, want in ((1, (3.0, 0.0)), (3, (2.0, 3.0))) for a, b in zip(got[g], want))
    assert all(math.hypot(got[4][0] - x, got[4][1] - y) < 5 for x, y in ((0, 0), (4, 0), (2, 3)))


def test_rule_of_borders_is_that_of_rings(spark):
    """A point on a slanted edge: inside or outside by a ray to the right, as SQL has it."""
    area = {"type": "Polygon", "coordinates": [[[-100.5, -40.5], [80.5, -60.5], [120.5, 50.5], [0.5, 20.5], [-90.5, 70.5], [-100.5, -40.5]]]}
    points = spark.createDataFrame([(1, -65.93, 57.0), (2, -65.94, 57.0), (3, 0.0, 0.0)], "id int, x double, y double")
    ring = geo.area_rings(area)[0][:-1]
    want = sorted(x.id for x in points.where(geo.point_in_ring(points.x, points.y, ring)).collect())
    assert sorted(x.id for x in reading.within_area(points, area).collect()) == want == [2, 3]


def test_points_are_counted_without_pairs(spark):
    r = random.Random(3)
    points = spark.createDataFrame([(k, float(r.randrange(-30, 30)), float(r.randrange(-30, 30))) for k in range(700)] + [(900, None, 1.0)], "id long, x double, y double")
    shapes = [[box(-20.5, -20.5, 30, 30), box(-10.5, -10.5, 5, 5)], [star(r, 3, 3, 9, 12)], [box(60, 60, 1, 1)]]
    areas = spark.createDataFrame([(k, text(*shapes[k % 3])) for k in range(12)] + [(99, None)], "poly long, wkt string")
    want: dict[int, tuple[int, int]] = {}
    for x in spatial.points_in_polygons(points, areas).collect():
        n, first = want.get(x.poly, (0, x.id))
        want[x.poly] = (n + 1, min(first, x.id))
    own = spatial.points_by_polygon(points, areas, "id")
    assert {x.poly: (x.n, x.first) for x in own.collect()} == want and len(want) == 8 and sum(n for n, _ in want.values()) > 500
    assert spatial.points_by_polygon(points, areas.limit(0), "id").collect() == []


def test_buffers_pass_on_a_row_a_group(spark):
    """What circles share is bounded by a least value for each side; edges of all circles would be a row each, 64 to a point."""
    points = spark.createDataFrame([(k % 3, k, math.cos(k), math.sin(k)) for k in range(300)], "g int, ordinal int, x double, y double")
    rows = spatial.points_near_all(points, 5.0)
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    circles = points.select("g", spatial.F.concat(spatial.F.lit("POLYGON (("), spatial.F.concat_ws(", ", *[spatial.F.concat_ws(" ", (points.x + 5 * math.cos(2 * math.pi * k / 64)).cast("string"), (points.y + 5 * math.sin(2 * math.pi * k / 64)).cast("string")) for k in [*range(64), 0]]), spatial.F.lit("))")).alias("wkt")).where("ordinal < 9")
    few = {x.g: (x.x, x.y) for x in spatial.points_near_all(points.where("ordinal < 9"), 5.0).collect()}
    want = {x.g: (x.x, x.y) for x in spatial.overlay_measures(circles, every=True).collect()}
    assert few.keys() == want.keys() and all(math.isclose(a, b, abs_tol=1e-5) for g in want for a, b in zip(few[g], want[g]))
    assert len(rows.collect()) == 3
