"""Points in many polygons by cells, and dissolved unions of polygons.

Polygons are WKT texts whose rings all count by the even-odd rule, so holes are holes.  Nothing here compares all
pairs: a polygon becomes cells of a grid as fine as its own size asks for, edges of a union meet in cells or strips.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import geo
from chronolith.operators.blocks import blocked, expanded
from chronolith.operators.rounds import settled

#: A polygon is at most so many cells wide and high, but for one more where it lies across.
CELLS = 16
#: Positions of a union are equal when they agree to so many decimals.
DIGITS = 9
#: Strips of a union lean by this slope, so that upright edges have an upper and a lower side as well.
LEAN = 0.1234567


def edges_of(polygons: DataFrame, wkt: str = "wkt") -> DataFrame:
    """``polygons`` with a row for each edge (x1, y1, x2, y2) of each ring, closed where it isn't; edges without length drop out."""
    own = polygons.withColumn("__ring", F.explode(geo.rings(F.col(wkt)))).withColumn("__p", geo.points(F.col("__ring")))
    own = own.where(F.size("__p") > 2).withColumn("__p", F.when(F.element_at("__p", 1) == F.element_at("__p", -1), F.col("__p")).otherwise(F.concat("__p", F.slice("__p", 1, 1))))
    steps = F.explode(F.arrays_zip(F.slice("__p", F.lit(1), F.size("__p") - 1).alias("a"), F.slice("__p", F.lit(2), F.size("__p") - 1).alias("b")))
    kept = [c for c in polygons.columns if c != wkt]
    return own.withColumn("__e", steps).select(*kept, *[F.col(f"__e.{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "a"), (2, "b")) for c in "xy"]).where("x1 <> x2 or y1 <> y2")


def _rows_in_column(x1: Column, y1: Column, x2: Column, y2: Column, column: Column, size: Column) -> Column:
    """The rows of cells that an edge (x1 <= x2) touches in a column."""
    at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (y2 - y1) * (x - x1) / (x2 - x1))
    a, b = at(F.greatest(x1, column * size)), F.when(x1 == x2, y2).otherwise(at(F.least(x2, (column + 1) * size)))
    return F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))


def _beside(edges: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of edges lies to the right of a point: the rule, and the arithmetic, of ``geo.point_in_ring``."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def cells_of(polygons: DataFrame, level: int | None = None) -> DataFrame:
    """(poly, level, cx, cy, edges): cells of side 2^level that polygons (poly, wkt) cover.

    ``edges`` is null where a cell lies inside as a whole; in a cell of the border it holds the edges in or to the right
    of the cell, which decide for each point.  The level follows from a polygon's size unless one is given for all."""
    box = geo.envelope(F.col("wkt"))
    wide = F.greatest(F.col("__box.xmax") - F.col("__box.xmin"), F.col("__box.ymax") - F.col("__box.ymin"))
    own = polygons.select("poly", "wkt", box.alias("__box")).withColumn("__wide", wide).where("__wide > 0")
    own = own.select("poly", "wkt", (F.ceil(F.log2(F.col("__wide") / CELLS)).cast("int") if level is None else F.lit(level)).alias("level"))
    size = F.pow(F.lit(2.0), F.col("level"))
    e = edges_of(own).withColumn("size", size).withColumn("edge", F.struct("x1", "y1", "x2", "y2"))  # as the ring has it: turned, it would round otherwise
    up = F.col("y1") <= F.col("y2")
    e = e.select("poly", "level", "size", "edge", *[F.when(up, F.col(f"{c}{a}")).otherwise(F.col(f"{c}{b}")).alias(f"{c}{k}") for k, a, b in ((1, 1, 2), (2, 2, 1)) for c in "xy"])
    x1, y1, x2, y2, w = (F.col(c) for c in ("x1", "y1", "x2", "y2", "size"))
    e = e.withColumn("cy", F.explode(F.sequence(F.floor(y1 / w), F.floor(y2 / w)))).withColumn("columns", _rows_in_column(y1, x1, y2, x2, F.col("cy"), w))
    rows = e.groupBy("poly", "level", "size", "cy").agg(F.collect_list("edge").alias("edges"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
    border = rows.withColumn("cx", F.explode("columns")).select("poly", "level", "cx", "cy", F.filter("edges", lambda g: F.greatest(g["x1"], g["x2"]) >= F.col("cx") * F.col("size")).alias("edges"))
    # between two columns of the border all cells are alike: the middle of the first one decides
    gaps = rows.withColumn("__at", F.explode(F.sequence(F.lit(1), F.size("columns")))).where(F.col("__at") < F.size("columns"))
    gaps = gaps.withColumn("__low", F.element_at("columns", F.col("__at")) + 1).withColumn("__high", F.element_at("columns", F.col("__at") + 1) - 1).where("__low <= __high")
    inside = gaps.where(_beside(F.col("edges"), (F.col("__low") + 0.5) * w, (F.col("cy") + 0.5) * w))
    whole = inside.select("poly", "level", F.explode(F.sequence("__low", "__high")).alias("cx"), "cy", F.lit(None).cast("array<struct<x1: double, y1: double, x2: double, y2: double>>").alias("edges"))
    return border.unionByName(whole)


def _in_cell(points: DataFrame, x: str, y: str) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("__level"))
    return points.withColumn("__cx", F.floor(F.col(x) / size)).withColumn("__cy", F.floor(F.col(y) / size))


def _shapes(polygons: DataFrame) -> DataFrame:
    """Polygons (poly, wkt) with ``__shape``, equal for equal texts."""
    return settled(polygons.select("poly", "wkt"), "shapes").where("wkt is not null").select("poly", "wkt", F.md5("wkt").alias("__shape"))


def _shape_cells(shapes: DataFrame) -> DataFrame:
    once = settled(shapes.groupBy(F.col("__shape").alias("poly")).agg(F.any_value("wkt").alias("wkt")), "shapes")
    cells = settled(cells_of(once), "cells")
    return cells.select(F.col("poly").alias("__shape"), F.col("level").alias("__l"), F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("edges").alias("__edges"))


def _met() -> Column:
    return (F.col("__level") == F.col("__l")) & (F.col("__cx") == F.col("__x")) & (F.col("__cy") == F.col("__y"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of ``points`` with the polygons (poly, wkt) that hold them: an equi-join on cells, exact on borders.

    A border belongs to a polygon on its left and lower sides.  Points without coordinates are in none.  Each position
    meets each shape once, however many rows have it; the rows that stand there and the polygons of that shape are
    put in place last, by blocks."""
    shapes = _shapes(polygons)
    cells = _shape_cells(shapes)
    levels = [r[0] for r in cells.select("__l").distinct().collect()]  # powers of two between the least and the greatest size
    if not levels:
        return points.join(polygons.select("poly").limit(0), F.lit(False))
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.struct(*points.columns).alias("__row"), F.col(x).alias("__px"), F.col(y).alias("__py"))
    places = rows.select("__px", "__py").distinct().withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels])))
    held = _in_cell(places, "__px", "__py").join(cells, _met()).where(F.col("__edges").isNull() | _beside(F.col("__edges"), F.col("__px"), F.col("__py"))).select("__px", "__py", "__shape")
    held = held.join(blocked(rows, ["__px", "__py"], "__rows"), ["__px", "__py"]).select("__shape", "__rows")
    held = held.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__shape")  # few bytes that become many rows: not to be one task
    pairs = held.join(blocked(shapes.select("__shape", "poly"), ["__shape"], "__polys"), "__shape").select("__rows", "__polys")
    return expanded(pairs, "__rows", "__polys").select("__rows.__row.*", "__polys.poly")


def points_by_polygon(points: DataFrame, polygons: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """(poly, n, first): how many ``points`` each of the polygons (poly, wkt) holds, and their least ``value``; no row for
    one that holds none.  No pair of a point and a polygon is made: a cell that lies inside as a whole counts as one."""
    shapes = _shapes(polygons)
    cells = _shape_cells(shapes)
    levels = [r[0] for r in cells.select("__l").distinct().collect()]
    if not levels:
        return polygons.select("poly", F.lit(0).cast("long").alias("n")).join(points.select(F.col(value).alias("first")), F.lit(False))
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    places = known.groupBy(F.col(x).alias("__px"), F.col(y).alias("__py")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("first"))
    placed = settled(_in_cell(places.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels]))), "__px", "__py"), "places")
    sums = [F.sum("n").alias("n"), F.min("first").alias("first")]
    inside = placed.groupBy("__level", "__cx", "__cy").agg(*sums).join(cells.where("__edges is null"), _met()).select("__shape", "n", "first")
    border = placed.join(cells.where("__edges is not null"), _met()).where(_beside(F.col("__edges"), F.col("__px"), F.col("__py"))).select("__shape", "n", "first")
    found = inside.unionByName(border).groupBy("__shape").agg(*sums)
    return shapes.select("poly", "__shape").join(found, "__shape").groupBy("poly").agg(*sums)


def points_within(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of ``points`` that any of the polygons (poly, wkt) holds, each once: cells of one size for all."""
    level = polygons.select(F.ceil(F.log2(F.greatest((b := geo.envelope(F.col("wkt")))["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) / CELLS)).cast("int").alias("l")).agg(F.max("l")).first()[0]
    if level is None:
        return points.limit(0)
    cells = settled(cells_of(polygons, level), "cells").select(F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("edges").alias("__edges"))
    own = _in_cell(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__level", F.lit(level)), x, y)
    on = (F.col("__cx") == F.col("__x")) & (F.col("__cy") == F.col("__y")) & (F.col("__edges").isNull() | _beside(F.col("__edges"), F.col(x), F.col(y)))
    return own.join(cells, on, "left_semi").select(*points.columns)


# --- unions -----------------------------------------------------------------------------------------------------


def _pieces(shapes: DataFrame) -> DataFrame:
    """(g, size, x1, y1, x2, y2, own): edges of polygons (g, poly, wkt) cut where they meet, from left to right, each once.

    ``own`` lists the polygons that have a piece as an edge an odd number of times."""
    r = lambda c: F.round(c, DIGITS)
    e = edges_of(shapes.select("g", "poly", "wkt")).select("g", "poly", *[r(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")]).where("x1 <> x2 or y1 <> y2")
    left = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    e = e.select("g", "poly", *[F.when(left, F.col(f"{c}{a}")).otherwise(F.col(f"{c}{b}")).alias(f"{c}{k}") for k, a, b in ((1, 1, 2), (2, 2, 1)) for c in "xy"])
    # edges that coincide are one, with all their polygons
    e = e.groupBy("g", "x1", "y1", "x2", "y2").agg(F.collect_list("poly").alias("polys"))
    span = F.greatest(F.col("x2") - F.col("x1"), F.abs(F.col("y2") - F.col("y1")))
    size = e.groupBy(F.col("g").alias("__g")).agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.avg(span)))).alias("size"))
    e = settled(e.join(size, F.col("g").eqNullSafe(F.col("__g"))).drop("__g").withColumn("edge", F.struct("x1", "y1", "x2", "y2")), "union-edges")
    x1, y1, x2, y2, w = (F.col(c) for c in ("x1", "y1", "x2", "y2", "size"))
    cells = e.withColumn("cx", F.explode(F.sequence(F.floor(x1 / w), F.floor(x2 / w)))).withColumn("cy", F.explode(_rows_in_column(x1, y1, x2, y2, F.col("cx"), w))).select("g", "edge", "cx", "cy")
    a, b = cells, cells.select(F.col("g").alias("__g"), F.col("edge").alias("other"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"))
    on = F.col("g").eqNullSafe(F.col("__g")) & (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")) & (F.col("edge") < F.col("other"))
    pairs = a.join(b, on).select("g", "edge", "other").distinct()
    cuts = pairs.withColumn("at", F.expr(_MEETINGS)).where("size(at) > 0").select("g", F.explode(F.array("edge", "other")).alias("edge"), F.explode("at").alias("at"))
    p, q = F.col("edge"), F.col("at")
    inner = ~(((q["x"] == p["x1"]) & (q["y"] == p["y1"])) | ((q["x"] == p["x2"]) & (q["y"] == p["y2"])))
    cuts = cuts.where(inner).groupBy(F.col("g").alias("__g"), F.col("edge").alias("__edge")).agg(F.collect_set("at").alias("at"))
    far = lambda v: F.abs(v["x"] - F.col("x1")) + F.abs(v["y"] - F.col("y1"))
    end = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    stops = F.concat(F.array(end(1)), F.coalesce(F.transform(F.array_sort(F.transform("at", lambda v: F.struct(far(v).alias("d"), v["x"].alias("x"), v["y"].alias("y")))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))), F.array().cast("array<struct<x: double, y: double>>")), F.array(end(2)))
    met = e.join(cuts, F.col("g").eqNullSafe(F.col("__g")) & (F.col("edge") == F.col("__edge")), "left").withColumn("s", stops)
    steps = met.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("s") - 1))).select("g", "size", "polys", F.element_at("s", F.col("k")).alias("a"), F.element_at("s", F.col("k") + 1).alias("b"))
    swap = (F.col("a.x") > F.col("b.x")) | ((F.col("a.x") == F.col("b.x")) & (F.col("a.y") > F.col("b.y")))  # rounding may turn a short piece
    steps = steps.select("g", "size", "polys", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")).where("a <> b")
    one = steps.groupBy("g", "size", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).agg(F.flatten(F.collect_list("polys")).alias("polys"))
    odd = F.filter(F.array_distinct("polys"), lambda v: F.size(F.filter("polys", lambda u: u == v)) % 2 == 1)
    return one.select("g", "size", "x1", "y1", "x2", "y2", odd.alias("own")).where("size(own) > 0")


def _meetings() -> str:
    """Positions that ``edge`` and ``other`` share: an end of one on the other, or where they cross."""
    turn = lambda p, q, r: f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    a, b, c, d = ("edge.x1", "edge.y1"), ("edge.x2", "edge.y2"), ("other.x1", "other.y1"), ("other.x2", "other.y2")
    near = f"1e-{DIGITS} * greatest(abs(edge.x2 - edge.x1) + abs(edge.y2 - edge.y1), abs(other.x2 - other.x1) + abs(other.y2 - other.y1))"
    on = lambda p, q, r: f"(abs({turn(p, q, r)}) <= {near} AND {r[0]} BETWEEN least({p[0]}, {q[0]}) AND greatest({p[0]}, {q[0]}) AND {r[1]} BETWEEN least({p[1]}, {q[1]}) AND greatest({p[1]}, {q[1]}))"
    at = lambda r: f"named_struct('x', {r[0]}, 'y', {r[1]})"
    ends = ", ".join(f"CASE WHEN {on(p, q, r)} THEN {at(r)} END" for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))
    share = f"{turn(c, d, a)} / ({turn(c, d, a)} - {turn(c, d, b)})"
    across = f"CASE WHEN {turn(a, b, c)} * {turn(a, b, d)} < 0 AND {turn(c, d, a)} * {turn(c, d, b)} < 0 THEN named_struct('x', round(edge.x1 + (edge.x2 - edge.x1) * ({share}), {DIGITS}), 'y', round(edge.y1 + (edge.y2 - edge.y1) * ({share}), {DIGITS})) END"
    found = f"filter(array({ends}), v -> v IS NOT NULL)"
    return f"CASE WHEN size({found}) > 0 THEN array_distinct({found}) ELSE filter(array({across}), v -> v IS NOT NULL) END"


_MEETINGS = _meetings()


def overlay_border(polygons: DataFrame, every: bool = False) -> DataFrame:
    """(g, x1, y1, x2, y2): directed edges around the union of each group's polygons (g, wkt), the inside on their left;
    with ``every``, around what all of them have in common.

    Edges are cut where they meet.  A piece is on the border if some polygon (every one) covers one of its sides and none
    (not every one) the other; which ones do follows from the pieces above it in its strip, polygon by polygon."""
    shapes = polygons.where("wkt is not null").select("g", "wkt").distinct().withColumn("poly", F.md5("wkt"))
    lean = lambda k: F.col(f"x{k}") + LEAN * F.col(f"y{k}")
    ends = settled(_pieces(shapes), "union-pieces").withColumn("a", lean(1)).withColumn("b", lean(2))
    up = F.col("a") < F.col("b")
    own = ends.select("g", "size", "own", F.when(up, F.struct("x1", "y1", "x2", "y2")).otherwise(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))).alias("piece"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    p = F.col("piece")
    middles = own.select("g", "piece", ((F.col("a") + F.col("b")) / 2).alias("u"), ((p["y1"] + p["y2"]) / 2).alias("v"), F.col("size")).withColumn("strip", F.floor(F.col("u") / F.col("size")))
    strips = own.select(F.col("g").alias("__g"), F.explode(F.sequence(F.floor(F.col("a") / F.col("size")), F.floor(F.col("b") / F.col("size")))).alias("__strip"), F.col("piece").alias("__piece"), F.col("a").alias("__a"), F.col("b").alias("__b"), "own")
    q = F.col("__piece")
    above = q["y1"] + (q["y2"] - q["y1"]) * (F.col("u") - F.col("__a")) / (F.col("__b") - F.col("__a")) > F.col("v")
    on = F.col("g").eqNullSafe(F.col("__g")) & (F.col("strip") == F.col("__strip")) & (F.col("__a") <= F.col("u")) & (F.col("u") < F.col("__b")) & above & (F.col("piece") != F.col("__piece"))
    over = middles.join(strips, on).select("g", "piece", F.explode("own").alias("poly"), F.lit(1).alias("over"), F.lit(0).alias("at"))
    each = over.unionByName(own.select("g", "piece", F.explode("own").alias("poly"), F.lit(0).alias("over"), F.lit(1).alias("at")))
    each = each.groupBy("g", "piece", "poly").agg(F.sum("over").alias("over"), F.sum("at").alias("at"))
    upper, lower = F.col("over") % 2, (F.col("over") + F.col("at")) % 2
    if every:
        count = shapes.groupBy(F.col("g").alias("__n_g")).agg(F.count(F.lit(1)).alias("__n"))
        sides = each.groupBy("g", "piece").agg(F.sum(upper).alias("upper"), F.sum(lower).alias("lower")).join(count, F.col("g").eqNullSafe(F.col("__n_g")))
        sides = sides.select("g", "piece", *[(F.col(c) == F.col("__n")).cast("int").alias(c) for c in ("upper", "lower")]).where("upper <> lower")
    else:
        sides = each.groupBy("g", "piece").agg(F.max(upper).alias("upper"), F.max(lower).alias("lower")).where("upper <> lower")
    way = lambda a, b: F.when(F.col("upper") == 1, p[a]).otherwise(p[b])
    return sides.select("g", way("x1", "x2").alias("x1"), way("y1", "y2").alias("y1"), way("x2", "x1").alias("x2"), way("y2", "y1").alias("y2"))


def overlay_measures(polygons: DataFrame, every: bool = False) -> DataFrame:
    """(g, area, x, y): area and middle of the dissolved union of each group's polygons (g, wkt), or of what all share."""
    e = overlay_border(polygons, every)
    first = e.groupBy(F.col("g").alias("__g")).agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"))  # sums about a corner lose no digits
    e = e.join(first, F.col("g").eqNullSafe(F.col("__g"))).select("g", "x0", "y0", *[(F.col(f"{c}{k}") - F.col(f"{c}0")).alias(f"{c}{k}") for k in (1, 2) for c in "xy"])
    turn = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = e.groupBy("g", "x0", "y0").agg((F.sum(turn) / 2).alias("area"), *[(F.sum((F.col(f"{c}1") + F.col(f"{c}2")) * turn) / 6).alias(f"__{c}") for c in "xy"])
    return sums.where("area > 0").select("g", "area", (F.col("x0") + F.col("__x") / F.col("area")).alias("x"), (F.col("y0") + F.col("__y") / F.col("area")).alias("y"))


def ring_lists(edges: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed rings of directed edges, the inside on the left; where rings touch, each keeps to the sharpest left turn."""
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x1, y1, x2, y2 in sorted(edges):
        after.setdefault((x1, y1), []).append((x2, y2))
    out = []
    for start in sorted(after):
        while after.get(start):
            ring, at = [start], after[start].pop(0)
            while at != start:
                ways = after.get(at)
                if not ways:
                    break  # rounding left a gap: what there is of the ring stays
                back = math.atan2(ring[-1][1] - at[1], ring[-1][0] - at[0])
                turn = lambda w: (back - math.atan2(w[1] - at[1], w[0] - at[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                nxt = min(ways, key=turn)
                ways.remove(nxt)
                ring.append(at)
                at = nxt
            n = len(ring)
            bend = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])) > 1e-9 * (abs(b[0] - a[0]) + abs(b[1] - a[1])) * (abs(c[0] - b[0]) + abs(c[1] - b[1]))
            ring = [ring[i] for i in range(n) if bend(ring[i - 1], ring[i], ring[(i + 1) % n])]
            if len(ring) > 2:
                out.append(ring)
    return out


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    crossed = [(a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])]
    return sum(crossed) % 2 == 1


def multipolygon(rings: list[list[tuple[float, float]]]) -> str | None:
    """WKT of rings: those that run around an inside are shells, the others holes of the least shell around them."""
    shells = sorted([[r] for r in rings if signed_area(r) > 0], key=lambda s: signed_area(s[0]))
    for hole in (r for r in rings if signed_area(r) < 0):
        (ax, ay), (bx, by) = hole[0], hole[1]
        length = math.hypot(bx - ax, by - ay)
        x, y = (ax + bx) / 2 + (by - ay) / length * length * 1e-6, (ay + by) / 2 - (bx - ax) / length * length * 1e-6  # just within the hole
        own = next((s for s in shells if _holds(s[0], x, y)), None)
        if own:
            own.append(hole)
    text = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")"
    parts = sorted("(" + ", ".join(map(text, s)) + ")" for s in shells)
    return None if not parts else f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def dissolved(polygons: DataFrame, every: bool = False) -> DataFrame:
    """(g, wkt): the union of each group's polygons (g, wkt) as one geometry without inner borders, or what all share.

    The border is found by Spark; only putting a group's own border in order, which is one value in the end, is a step in
    Python.  A group without area has no row."""

    def stitched(rows: pd.DataFrame) -> pd.DataFrame:
        wkt = multipolygon(ring_lists(list(rows[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None))))
        return pd.DataFrame({"g": rows["g"].iloc[:1], "wkt": [wkt]})

    border = overlay_border(polygons, every)
    return border.groupBy("g").applyInPandas(stitched, f"g {border.schema['g'].dataType.simpleString()}, wkt string").where("wkt is not null")


def _areal(wkt: str = "wkt") -> Column:
    return geo.kind_of(F.col(wkt)).isin("POLYGON", "MULTIPOLYGON")


def unions(geometries: DataFrame) -> DataFrame:
    """(g, wkt): all geometries (g, wkt) of a group as one: polygons dissolved, others once each, several kinds in a collection."""
    own = geometries.where("wkt is not null").distinct()
    parts = own.where(~F.coalesce(_areal(), F.lit(False))).unionByName(dissolved(own.where(_areal())))
    all_ = parts.groupBy("g").agg(F.array_sort(F.collect_list("wkt")).alias("parts"))
    return all_.select("g", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join("parts", ", "), F.lit(")"))).alias("wkt"))


def middles(geometries: DataFrame) -> DataFrame:
    """(g, x, y): the middle of the union of each group's geometries (g, wkt): of its area if it has one, else of its
    lines by length, else of its positions."""
    own = geometries.where("wkt is not null").distinct()
    areas = settled(overlay_measures(own.where(_areal())).select("g", "x", "y"), "middles")
    rest = own.where(~F.coalesce(_areal(), F.lit(False))).join(areas.select(F.col("g").alias("__g")), F.col("g").eqNullSafe(F.col("__g")), "left_anti")
    rest = rest.groupBy("g").agg(F.collect_list("wkt").alias("__all")).withColumn("__c", geo.centroid_of_union("__all")).select("g", F.col("__c.x").alias("x"), F.col("__c.y").alias("y"))
    return areas.unionByName(rest.where("x is not null"))


def _common_of_circles(sides: int, radius: float):
    """A function of offsets (rows, sides) that gives area and middle of {z : n_k z <= offset_k}, n_k the normals of a circle's sides.

    The way along side k is what the other half-planes leave of its line; the ways of all sides are the border."""
    angle = 2 * np.pi * (np.arange(sides) + 0.5) / sides
    normal = np.stack([np.cos(angle), np.sin(angle)])
    along = np.stack([-normal[1], normal[0]])

    def measured(offsets: np.ndarray) -> np.ndarray:
        area, mx, my = (np.zeros(len(offsets)) for _ in range(3))
        for k in range(sides):
            x, y = offsets[:, k] * normal[0, k], offsets[:, k] * normal[1, k]
            room = offsets - np.outer(x, normal[0]) - np.outer(y, normal[1])
            lean = along[:, k] @ normal
            ahead, behind, level = lean > 1e-9, lean < -1e-9, np.abs(lean) <= 1e-9
            high, low = (room[:, ahead] / lean[ahead]).min(axis=1), (room[:, behind] / lean[behind]).max(axis=1)
            real = (high > low) & (room[:, level] >= -1e-12).all(axis=1)
            ax, ay, bx, by = (np.where(real, p + t * d, 0.0) for t in (low, high) for p, d in ((x, along[0, k]), (y, along[1, k])))
            turn = ax * by - bx * ay
            area, mx, my = area + turn / 2, mx + (ax + bx) * turn / 6, my + (ay + by) * turn / 6
        some = area > 1e-9 * radius * radius
        size = np.where(some, area, 1.0)
        return np.stack([np.where(some, area, np.nan), mx / size, my / size], axis=1)

    return measured


def points_near_all(points: DataFrame, radius: float, sides: int = 64) -> DataFrame:
    """(g, x, y): a point within a radius of all points (g, ordinal, x, y) of a group, the middle of what their circles
    share, or the first point where they share nothing.

    Circles are polygons of one form, so what a group's circles share is bounded, side by side, by the one of them that
    lies furthest back: a least value for each side is all that a group hands on, however many points it has."""
    own = points.where("x is not null and y is not null")
    corners = [2 * math.pi * (k + 0.5) / sides for k in range(sides)]
    first = own.groupBy(F.col("g").alias("__f")).agg(F.min_by(F.struct("x", "y"), "ordinal").alias("__p"), F.min("x").alias("__l"), F.max("x").alias("__r"), F.min("y").alias("__d"), F.max("y").alias("__u"))
    # positions about the first point keep their digits; groups that are wider than a circle share nothing
    about = own.join(first, F.col("g").eqNullSafe(F.col("__f"))).where((F.col("__r") - F.col("__l") < 2 * radius) & (F.col("__u") - F.col("__d") < 2 * radius))
    dx, dy = F.col("x") - F.col("__p.x"), F.col("y") - F.col("__p.y")
    offsets = about.groupBy("g").agg(F.array(*[F.min(dx * math.cos(a) + dy * math.sin(a)) + radius * math.cos(math.pi / sides) for a in corners]).alias("__o"))
    measured = _common_of_circles(sides, radius)

    @F.pandas_udf("area double, x double, y double")
    def shared(column: pd.Series) -> pd.DataFrame:
        rows = np.stack(column.to_numpy()) if len(column) else np.zeros((0, sides))
        return pd.DataFrame(np.concatenate([measured(rows[k : k + 1024]) for k in range(0, len(rows), 1024)]) if len(rows) else np.zeros((0, 3)), columns=["area", "x", "y"])

    common = offsets.select(F.col("g").alias("__g"), shared.asNondeterministic()("__o").alias("__m"))  # so that it runs once a row
    common = common.where("__m.area > 0 and not isnan(__m.area)").select("__g", F.col("__m.x").alias("__x"), F.col("__m.y").alias("__y"))
    return first.join(common, F.col("__f").eqNullSafe(F.col("__g")), "left").select(F.col("__f").alias("g"), *[F.coalesce(F.col(f"__p.{c}") + F.col(f"__{c}"), F.col(f"__p.{c}")).alias(c) for c in "xy"])
