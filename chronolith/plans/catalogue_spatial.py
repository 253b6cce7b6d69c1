"""Queries of spatial joins and dissolved geometries, each with its SQL; registered with those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import geo
from chronolith.operators import changes, reading, spatial
from chronolith.plans.catalogue import query
from chronolith.sources import files


def _s(c):
    return F.col(c).cast("string")


def _ring(*corners):
    """Text of a ring from columns of its corners; one step for all corners, as the code for each apart is too long to be compiled."""
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in [*corners, corners[0]]])
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def _box(x, y, w, h):
    return _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def _polygon(*rings):
    return F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rings), F.lit(")"))


# --- areas (C48, C49, Q19) -------------------------------------------------------------------------------------------------

_HOLED = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-100, -50], [60, -50], [60, 50], [-100, 50], [-100, -50]], [[-40, -20], [20, -20], [20, 20], [-40, 20], [-40, -20]]]}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [90, 0], [90, 10], [0, 10], [0, 0]]], [[[150, -80], [170, -80], [170, 80], [150, 80], [150, -80]]]]}},
    ],
}
_IN_HOLED = "((x >= -100 AND x < 60 AND y >= -50 AND y < 50 AND NOT (x >= -40 AND x < 20 AND y >= -20 AND y < 20)) OR (x >= 0 AND x < 90 AND y >= 0 AND y < 10) OR (x >= 150 AND x < 170 AND y >= -80 AND y < 80))"


@query(f"SELECT id FROM point WHERE {_IN_HOLED}")
def c48_area_with_hole(t):
    return reading.within_area(t("point"), _HOLED).select("id")


@query(f"SELECT DISTINCT concat(a.label, ', ', b.label) AS label FROM relation r JOIN landmark a ON locatum = a.lm AND a.type = 'StreetNumber' JOIN landmark b ON relatum = b.lm AND b.type = 'Thoroughfare' JOIN point p ON concat('lm', p.id) = a.lm WHERE r.type = 'Belongs' AND {_IN_HOLED}")
def q19_addresses_outside_hole(t):
    inside = reading.within_area(t("point"), _HOLED).select(F.concat(F.lit("lm"), _s("id")).alias("__lm"))
    return changes.addresses(t("relation"), t("landmark")).join(inside, F.col("target") == F.col("__lm"), "left_semi").select("label").distinct()


# parts give areas: a box with a slanted hole; sizes differ by a factor of twenty, so several grids are in use
_AREAS = "ar AS (SELECT p_partkey AS k, (p_partkey * 37) % 330 - 180 + 0.003 AS x0, (p_partkey * 53) % 150 - 85 + 0.0011 AS y0, CASE p_partkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 2 WHEN 2 THEN 12 ELSE 6 END AS w FROM part)"


def _areas(t):
    k = F.col("p_partkey")
    own = t("part").select(k.alias("poly"), (k * 37 % 330 - 180 + F.lit(0.003)).alias("x"), (k * 53 % 150 - 85 + F.lit(0.0011)).alias("y"), F.when(k % 4 == 0, 40).when(k % 4 == 1, 2).when(k % 4 == 2, 12).otherwise(6).alias("w")).repartition("poly")
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    m = (x + w / 2, y + w / 2)
    slanted = _ring((m[0] - w / 4, m[1]), (m[0], m[1] - w / 4), (m[0] + w / 4, m[1]), (m[0], m[1] + w / 4))
    return own.select("poly", _polygon(_box(x, y, w, w), slanted).alias("wkt"))


@query(f"WITH {_AREAS} SELECT id, k AS area FROM point JOIN ar ON x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + w AND abs(x - x0 - w / 2) + abs(y - y0 - w / 2) >= w / 4")
def q19_many_areas(t):
    return spatial.points_in_polygons(t("point"), _areas(t)).select("id", F.col("poly").alias("area"))


@query(f"WITH {_AREAS} SELECT k AS area, count(*) AS n, min(id) AS first FROM point JOIN ar ON x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + w AND abs(x - x0 - w / 2) + abs(y - y0 - w / 2) >= w / 4 GROUP BY k")
def c49_points_by_area(t):
    return spatial.points_by_polygon(t("point"), _areas(t), "id").withColumnRenamed("poly", "area")


# --- unions (C44, S12, M07) --------------------------------------------------------------------------------------------------

# boxes with whole corners, many of which overlap, some with a hole: the union of a group is a set of unit squares
_BOXES = """bx AS (SELECT c_custkey AS id, c_custkey % 40 AS k, (c_custkey * 7) % 31 AS x, (c_custkey * 11) % 23 AS y, 3 + c_custkey % 5 AS w, 3 + c_custkey % 3 AS h FROM customer),
  sq AS (SELECT DISTINCT k, x + a.i AS cx, y + b.i AS cy FROM bx JOIN range(0, 8) a(i) ON a.i < w JOIN range(0, 8) b(i) ON b.i < h WHERE NOT (id % 3 = 0 AND a.i = 1 AND b.i = 1))"""


def _boxes(t):
    k = F.col("c_custkey")
    own = t("customer").select(k.alias("id"), (k % 40).alias("g"), *[e.cast("double").alias(n) for n, e in (("x", k * 7 % 31), ("y", k * 11 % 23), ("w", 3 + k % 5), ("h", 3 + k % 3))])
    x, y, w, h = (F.col(c) for c in "xywh")
    return own.select("id", "g", F.when(F.col("id") % 3 == 0, _polygon(_box(x, y, w, h), _box(x + 1, y + 1, 1.0, 1.0))).otherwise(_polygon(_box(x, y, w, h))).alias("wkt"))


@query(f"WITH {_BOXES} SELECT k, CAST(count(*) AS DOUBLE) AS area, round(avg(cx + 0.5), 6) AS x, round(avg(cy + 0.5), 6) AS y FROM sq GROUP BY k")
def c44_overlapping_union(t):
    return spatial.overlay_measures(_boxes(t).select("g", "wkt")).select(F.col("g").alias("k"), F.round("area", 6).alias("area"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {_BOXES} SELECT k, CAST(count(*) AS DOUBLE) AS area, 0 AS overlaps FROM sq GROUP BY k")
def c44_dissolved_union(t):
    """The geometry itself: the area of the text is that of the union, and each ring crosses no other."""
    own = spatial.dissolved(_boxes(t).select("g", "wkt"))
    again = spatial.overlay_measures(own)
    rows = again.join(own.select(F.col("g").alias("__g"), geo.area("wkt").alias("plain")), F.col("g") == F.col("__g"))
    return rows.select(F.col("g").alias("k"), F.round("area", 6).alias("area"), F.when(F.abs(F.col("plain") - F.col("area")) > 1e-6, 1).otherwise(0).alias("overlaps"))


@query(f"WITH {_BOXES} SELECT 'd' || k AS name, min(id) AS first, CAST(count(DISTINCT id) AS BIGINT) AS parts, (SELECT CAST(count(*) AS DOUBLE) FROM sq WHERE sq.k = bx.k) AS area FROM bx GROUP BY k")
def s12_dissolved_features(t):
    rows = _boxes(t).select(F.col("id").alias("ordinal"), F.lit("crs").alias("crs"), F.create_map(F.lit("name"), F.concat(F.lit("d"), _s("g"))).alias("properties"), "wkt")
    return files.dissolved_features(rows, "name").select(F.col("properties")["name"].alias("name"), F.col("ordinal").alias("first"), F.size("geometries").cast("long").alias("parts"), F.round(geo.area("wkt"), 6).alias("area"))


@query("WITH p AS (SELECT id // 2 AS g, id, x / 10 AS px, y / 10 AS py FROM point), q AS (SELECT a.g, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS bz FROM p a JOIN p b ON a.g = b.g AND a.id < b.id) SELECT g, round(CASE WHEN sqrt(power(ax - bx, 2) + power(ay - bz, 2)) < 9.9 THEN (ax + bx) / 2 ELSE ax END, 6) AS x, round(CASE WHEN sqrt(power(ax - bx, 2) + power(ay - bz, 2)) < 9.9 THEN (ay + bz) / 2 ELSE ay END, 6) AS y FROM q")
def m07_middle_of_buffers(t):
    own = t("point").select(F.floor(F.col("id") / 2).alias("g"), F.col("id").alias("ordinal"), (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))
    pairs = own.groupBy(F.col("g").alias("__g")).count().where("count = 2")
    return spatial.points_near_all(own.join(pairs, F.col("g") == F.col("__g"), "left_semi"), 5.0).select("g", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
