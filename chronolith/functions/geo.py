"""Geometries as WKT text: points, envelopes, similarity, projections, predicates.  All are column expressions.

A geometry is read once into an array of points (struct x, y); what follows is arithmetic on arrays.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Lambert-93 (EPSG:2154) on GRS80
ELLIPSOID_A, ELLIPSOID_F = 6378137.0, 1 / 298.257222101
LATITUDE_0, LATITUDE_1, LATITUDE_2, LONGITUDE_0 = 46.5, 49.0, 44.0, 3.0
FALSE_EAST, FALSE_NORTH = 700000.0, 6600000.0
# fixed values: the forms of reference systems
CRS_PREFIX = "http://www.opengis.net/def/crs/"
CRS_NAMES = {"EPSG:4326": "EPSG/0/4326", "EPSG:3857": "EPSG/0/3857", "EPSG:2154": "EPSG/0/2154", "urn:ogc:def:crs:OGC:1.3:CRS84": "EPSG/0/4326", "urn:ogc:def:crs:EPSG::2154": "EPSG/0/2154", "urn:ogc:def:crs:EPSG::4326": "EPSG/0/4326"}

_E = math.sqrt(ELLIPSOID_F * (2 - ELLIPSOID_F))


def _t(lat: float) -> float:
    s = math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - _E * s) / (1 + _E * s)) ** (_E / 2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


_L1, _L2, _L0 = (math.radians(x) for x in (LATITUDE_1, LATITUDE_2, LATITUDE_0))
CONE_N = (math.log(_m(_L1)) - math.log(_m(_L2))) / (math.log(_t(_L1)) - math.log(_t(_L2)))
CONE_F = _m(_L1) / (CONE_N * _t(_L1) ** CONE_N)
CONE_R0 = ELLIPSOID_A * CONE_F * _t(_L0) ** CONE_N


def crs_uri(name: Column) -> Column:
    return F.concat(F.lit(CRS_PREFIX), F.create_map(*[F.lit(x) for p in CRS_NAMES.items() for x in p])[name])


def epsg_of(uri: Column) -> Column:
    """EPSG code of a reference system's URI; CRS84 counts as 4326; null if unknown."""
    code = F.regexp_extract(uri, r"/EPSG/\d+/(\d+)>?$", 1)
    return F.when(uri.rlike("CRS84>?$"), F.lit("4326")).when(code != "", code)


def split_literal(literal: Column) -> tuple[Column, Column]:
    """(URI of the reference system, WKT body); without a prefix, 4326."""
    uri = F.regexp_extract(literal, r"^\s*<([^>]+)>", 1)
    uri = F.when(uri == "", F.lit(CRS_PREFIX + "EPSG/0/4326")).when(uri.endswith("CRS84"), F.lit(CRS_PREFIX + "EPSG/0/4326")).otherwise(uri)
    return uri, F.trim(F.regexp_replace(literal, r"^\s*<[^>]+>\s*", ""))


def kind_of(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def points(wkt: Column) -> Column:
    """All positions of a WKT body, in order."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s+(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def rings(wkt: Column) -> Column:
    """Texts of the innermost parentheses: rings, lines or points."""
    return F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))


def envelope(wkt: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax)."""
    p = points(wkt)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.when(F.size(p) > 0, F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")))


def grown(box: Column, by: float) -> Column:
    """An envelope without area, widened by a radius; others as they are."""
    flat = (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"]) == 0
    side = lambda name, sign: F.when(flat, box[name] + sign * by).otherwise(box[name]).alias(name)
    return F.struct(side("xmin", -1), side("ymin", -1), side("xmax", 1), side("ymax", 1))


def box_area(b: Column) -> Column:
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["xmin"], b["xmin"]).alias("xmin"), F.least(a["ymin"], b["ymin"]).alias("ymin"), F.greatest(a["xmax"], b["xmax"]).alias("xmax"), F.greatest(a["ymax"], b["ymax"]).alias("ymax"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two envelopes."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def similar_polygons(a: Column, b: Column, coefficient: float = 0.8) -> Column:
    return box_iou(a, b) >= coefficient


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def similar_points(a: Column, b: Column, most: float) -> Column:
    return distance(a, b) <= most


# What follows takes column names and is written as SQL text, as its nested lambdas would cost hundreds of calls to
# build node by node.


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_NUMBER = r"-?\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?"
_SUMS = ("area", "ax", "ay", "length", "lx", "ly")
_ZERO = "named_struct(" + ", ".join(f"'{c}', 0.0D" for c in _SUMS) + ")"
_ADDED = "(s, m) -> named_struct(" + ", ".join(f"'{c}', s.{c} + m.{c}" for c in _SUMS) + ")"


def _points(wkt: str) -> str:
    pairs = f"regexp_extract_all({wkt}, '({_NUMBER})\\\\s+({_NUMBER})', 0)"
    return f"transform({pairs}, q -> named_struct('x', cast(split(q, '\\\\s+')[0] AS double), 'y', cast(split(q, '\\\\s+')[1] AS double)))"


def _parts(wkt: str) -> str:
    """Innermost parentheses in order: struct(p: positions, hole), a hole being a ring that isn't its polygon's first."""
    plain = f"regexp_replace({wkt}, '\\\\s*([(),])\\\\s*', '$1')"
    return f"transform(regexp_extract_all({plain}, '\\\\(*\\\\([^()]+\\\\)', 0), t -> named_struct('p', {_points('t')}, 'hole', NOT startswith(t, '((')))"


def _steps(p: str) -> str:
    """Consecutive positions: struct(a, b)."""
    return f"zip_with(slice({p}, 1, greatest(size({p}) - 1, 0)), slice({p}, 2, greatest(size({p}) - 1, 0)), (a, b) -> named_struct('a', a, 'b', b))"


def _areal(wkt: str) -> str:
    return f"endswith(upper(regexp_extract({wkt}, '^\\\\s*([A-Za-z]+)', 1)), 'POLYGON')"


def _moments(wkt: str) -> str:
    """struct(ox, oy, area, ax, ay, length, lx, ly): areas and lengths, and their moments about the first position (ox, oy)."""
    shifted = f"transform({_steps('part.p')}, s -> named_struct('x1', s.a.x - o.x, 'y1', s.a.y - o.y, 'x2', s.b.x - o.x, 'y2', s.b.y - o.y))"
    measured = f"transform({shifted}, s -> named_struct('x', s.x1 + s.x2, 'y', s.y1 + s.y2, 'c', s.x1 * s.y2 - s.x2 * s.y1, 'd', sqrt((s.x1 - s.x2) * (s.x1 - s.x2) + (s.y1 - s.y2) * (s.y1 - s.y2))))"
    each = f"transform({measured}, m -> named_struct('area', m.c / 2, 'ax', m.x * m.c / 6, 'ay', m.y * m.c / 6, 'length', m.d, 'lx', m.x * m.d / 2, 'ly', m.y * m.d / 2))"
    # rings may run either way: a polygon's first adds its area, holes take theirs away
    sign = f"CASE WHEN {_areal(wkt)} THEN signum(k.area) * CASE WHEN part.hole THEN -1 ELSE 1 END ELSE 0.0D END"
    signed = "named_struct(" + ", ".join(f"'{c}', k.{c}" + " * w" * (c in ("area", "ax", "ay")) for c in _SUMS) + ")"
    of_part = _let(f"aggregate({each}, {_ZERO}, {_ADDED})", "k", _let(sign, "w", signed))
    total = f"aggregate(transform(g, part -> {of_part}), {_ZERO}, {_ADDED})"
    placed = _let(total, "z", "named_struct('ox', o.x, 'oy', o.y, " + ", ".join(f"'{c}', z.{c}" for c in _SUMS) + ")")
    return _let(_parts(wkt), "g", f"CASE WHEN size(g) > 0 THEN {_let('g[0].p[0]', 'o', placed)} END")


def _middle(wkt: str) -> str:
    """The middle of a geometry of several positions, with its weights: struct(area, length, x, y)."""
    mean = lambda c: f"aggregate(p, 0.0D, (s, q) -> s + q.{c}) / size(p)"
    of = lambda c: f"'{c}', CASE WHEN m.area > 0 THEN m.o{c} + m.a{c} / m.area WHEN m.length > 0 THEN m.o{c} + m.l{c} / m.length ELSE {mean(c)} END"
    return _let(_points(wkt), "p", _let(_moments(wkt), "m", f"CASE WHEN size(p) = 1 THEN named_struct('area', 0.0D, 'length', 0.0D, 'x', p[0].x, 'y', p[0].y) WHEN size(p) > 1 THEN named_struct('area', m.area, 'length', m.length, {of('x')}, {of('y')}) END"))


def area(wkt: str) -> Column:
    """The area of polygons, less that of their holes; 0 of others."""
    return F.expr(_moments(wkt))["area"]


def centroid(wkt: str) -> Column:
    """The middle of a geometry: of its area if it has any, else of its length, else of its positions."""
    return F.expr(_let(_middle(wkt), "c", "CASE WHEN c IS NOT NULL THEN named_struct('x', c.x, 'y', c.y) END"))


def union_of(geometries: Column) -> Column:
    """Several geometries as one: the only one, or a collection of the different ones in order.  Overlaps are not dissolved."""
    own = F.array_distinct(F.filter(geometries, lambda g: g.isNotNull()))
    return F.when(F.size(own) == 1, own[0]).when(F.size(own) > 1, F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(own, ", "), F.lit(")")))


def centroid_of_union(geometries: str) -> Column:
    """The middle of several geometries: those of the highest dimension count, by area, by length, or each alike."""
    own = f"transform(array_distinct(filter({geometries}, v -> v IS NOT NULL)), v -> {_middle('v')})"
    total = lambda c: f"aggregate(g, 0.0D, (s, h) -> s + h.{c})"
    weighted = f"transform(g, h -> named_struct('w', CASE WHEN t.area > 0 THEN h.area WHEN t.length > 0 THEN h.length ELSE 1.0D END, 'x', h.x, 'y', h.y))"
    mean = lambda c: f"aggregate(r, 0.0D, (s, h) -> s + h.w * h.{c}) / aggregate(r, 0.0D, (s, h) -> s + h.w)"
    of = _let(f"named_struct('area', {total('area')}, 'length', {total('length')})", "t", _let(weighted, "r", f"named_struct('x', {mean('x')}, 'y', {mean('y')})"))
    return F.expr(_let(own, "g", f"CASE WHEN size(g) > 0 THEN {of} END"))


def _edges(wkt: str) -> str:
    """Edges of all parts; a position alone is an edge to itself."""
    return f"flatten(transform({_parts(wkt)}, part -> CASE WHEN size(part.p) = 1 THEN transform(part.p, q -> named_struct('a', q, 'b', q)) ELSE {_steps('part.p')} END))"


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def intersects(a: str, b: str) -> Column:
    """Whether two geometries share a position: their envelopes meet, and edges meet or one holds a position of the other."""
    turn = lambda p, q, r: f"signum(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
    near = lambda lo, hi, c: f"({c} BETWEEN least({lo}, {hi}) AND greatest({lo}, {hi}))"
    on = lambda e, q: f"({turn(e + '.a', e + '.b', q)} = 0 AND {near(e + '.a.x', e + '.b.x', q + '.x')} AND {near(e + '.a.y', e + '.b.y', q + '.y')})"
    across = f"({turn('e.a', 'e.b', 'f.a')} * {turn('e.a', 'e.b', 'f.b')} < 0 AND {turn('f.a', 'f.b', 'e.a')} * {turn('f.a', 'f.b', 'e.b')} < 0)"
    meet = f"({across} OR {on('e', 'f.a')} OR {on('e', 'f.b')} OR {on('f', 'e.a')} OR {on('f', 'e.b')})"
    crosses = "((s.a.y > q.y) <> (s.b.y > q.y) AND q.x < (s.b.x - s.a.x) * (q.y - s.a.y) / (s.b.y - s.a.y) + s.a.x)"
    holds = lambda wkt, edges, other: f"({_areal(wkt)} AND exists({_points(other)}, q -> size(filter({edges}, s -> coalesce({crosses}, false))) % 2 = 1))"
    exact = _let(f"named_struct('a', {_edges(a)}, 'b', {_edges(b)})", "g", f"(exists(g.a, e -> exists(g.b, f -> {meet})) OR {holds(a, 'g.a', b)} OR {holds(b, 'g.b', a)})")
    return F.when(boxes_meet(envelope(F.col(a)), envelope(F.col(b))), F.expr(exact)).otherwise(F.lit(False))


def line_between(a: Column, b: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), a["x"].cast("string"), F.lit(" "), a["y"].cast("string"), F.lit(", "), b["x"].cast("string"), F.lit(" "), b["y"].cast("string"), F.lit(")"))


def to_lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert-93 metres of degrees."""
    phi = F.radians(lat)
    s = F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - _E * s) / (1 + _E * s), F.lit(_E / 2))
    r = F.lit(ELLIPSOID_A * CONE_F) * F.pow(t, F.lit(CONE_N))
    theta = F.lit(CONE_N) * F.radians(lon - LONGITUDE_0)
    return FALSE_EAST + r * F.sin(theta), FALSE_NORTH + CONE_R0 - r * F.cos(theta)


def from_lambert93(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of Lambert-93 metres; the latitude by six unrolled steps, exact to the millimetre."""
    dx, dy = x - FALSE_EAST, F.lit(CONE_R0 + FALSE_NORTH) - y
    r = F.hypot(dx, dy)
    t = F.pow(r / F.lit(ELLIPSOID_A * CONE_F), F.lit(1 / CONE_N))
    lon = F.degrees(F.atan2(dx, dy) / CONE_N) + LONGITUDE_0

    def step(phi: Column, _: int) -> Column:
        s = F.sin(phi)
        return F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - _E * s) / (1 + _E * s), F.lit(_E / 2)))

    return lon, F.degrees(reduce(step, range(6), F.lit(math.pi / 2) - 2 * F.atan(t)))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * ELLIPSOID_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * ELLIPSOID_A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / ELLIPSOID_A), F.degrees(2 * F.atan(F.exp(y / ELLIPSOID_A)) - math.pi / 2)


def reprojected(p: Column, source: str, target: str) -> Column:
    """A point struct from one of 4326, 3857, 2154 to another."""
    forward = {"4326": lambda x, y: (x, y), "3857": to_mercator, "2154": to_lambert93}
    back = {"4326": lambda x, y: (x, y), "3857": from_mercator, "2154": from_lambert93}
    x, y = (p["x"], p["y"]) if source == target else forward[target](*back[source](p["x"], p["y"]))
    return F.struct(x.alias("x"), y.alias("y"))


def point_in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule against a constant ring; edges fold into one expression, so no row leaves the engine."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return F.pmod(crossings, F.lit(2)) == 1


def within(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """A point in a polygon: its envelope first, which also prunes scans, then the ring."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & point_in_ring(x, y, ring)


def geojson_to_wkt(geometry: Column) -> Column:
    """WKT of a GeoJSON geometry's text; a collection's members may be collections once more."""

    def collection(text: Column, member) -> Column:
        parts = F.from_json(F.get_json_object(text, "$.geometries"), "array<string>")
        inner = F.filter(F.transform(parts, member), lambda w: w.isNotNull())
        return F.when(F.size(inner) > 0, F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(inner, ", "), F.lit(")"))).otherwise(F.lit("GEOMETRYCOLLECTION EMPTY"))

    kind = lambda text: F.upper(F.get_json_object(text, "$.type")) == "GEOMETRYCOLLECTION"
    inner = lambda text: F.when(kind(text), collection(text, _simple_to_wkt)).otherwise(_simple_to_wkt(text))
    return F.when(kind(geometry), collection(geometry, inner)).otherwise(_simple_to_wkt(geometry))


def _simple_to_wkt(geometry: Column) -> Column:
    """WKT of the types that are nested arrays of positions."""
    kind = F.upper(F.get_json_object(geometry, "$.type"))
    text = F.get_json_object(geometry, "$.coordinates")
    pair = F.regexp_replace(text, r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)(?:\s*,[^\]]*)?\]", "$1 $2")
    body = F.replace(F.replace(F.regexp_replace(pair, r"\s*,\s*", ", "), F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    return F.concat(kind, F.lit(" "), F.when(kind == "POINT", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))


def wkt_to_geojson(wkt: Column) -> Column:
    """GeoJSON text of a WKT body (positions as they are); members of collections within a collection become its own."""
    members = F.regexp_extract_all(wkt, F.lit(r"(?:MULTI)?(?:POINT|LINESTRING|POLYGON)\s*\([^A-DF-Za-df-z]*\)"), F.lit(0))
    # what follows a member's last bracket belongs to the collection
    own = F.transform(members, lambda m: F.substring(m, F.lit(1), _end_of(m)))
    all_ = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(own, _simple_to_geojson), ","), F.lit("]}"))
    return F.when(kind_of(wkt) == "GEOMETRYCOLLECTION", all_).otherwise(_simple_to_geojson(wkt))


def _end_of(text: Column) -> Column:
    """Where the first bracket of a text closes."""
    steps = F.transform(F.split(text, ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    seek = lambda acc, x: F.struct((acc["at"] + F.when(acc["shut"], 0).otherwise(1)).alias("at"), (acc["depth"] + x).alias("depth"), (acc["shut"] | ((x == -1) & (acc["depth"] == 1))).alias("shut"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("shut"))
    return F.aggregate(steps, start, seek)["at"]


def literal_to_geojson(literal: Column) -> Column:
    """GeoJSON text of a literal with its reference system; one that isn't known is an error, not a guess."""
    uri, body = split_literal(literal)
    known = epsg_of(uri).isin("4326", "3857", "2154")
    return F.when(literal.isNull(), F.lit(None).cast("string")).when(F.coalesce(known, F.lit(False)), wkt_to_geojson(body)).otherwise(F.raise_error(F.concat(F.lit("unknown reference system: "), uri)))


def _simple_to_geojson(wkt: Column) -> Column:
    kinds = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[kind_of(wkt)]
    body = F.regexp_replace(wkt, r"^\s*[A-Za-z]+\s*", "")
    body = F.regexp_replace(body, r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)", "[$1,$2]")
    body = F.regexp_replace(F.replace(F.replace(body, F.lit("("), F.lit("[")), F.lit(")"), F.lit("]")), r"\s+", "")
    body = F.when(kind == "Point", F.regexp_replace(body, r"^\[\[|\]\]$", "")).otherwise(body)
    body = F.when(kind == "Point", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))


def area_polygons(area: dict) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a GeoJSON area, each a list of its outer ring and its holes, validated on the driver: polygons only, closed rings of four positions or more, degrees in range, 100 features and 10,000 positions at most."""
    features = area.get("features") if area.get("type") == "FeatureCollection" else [area]
    if not isinstance(features, list) or not 0 < len(features) <= 100:
        raise ValueError("an area has 1 to 100 features")
    out, count = [], 0
    for feature in features:
        shape = feature.get("geometry") if feature.get("type") == "Feature" else feature
        if not shape or shape.get("type") not in ("Polygon", "MultiPolygon") or not shape.get("coordinates"):
            raise ValueError("an area is made of polygons")
        for polygon in [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]:
            if not polygon:
                raise ValueError("a polygon has a ring")
            for ring in polygon:
                if len(ring) < 4 or list(ring[0]) != list(ring[-1]):
                    raise ValueError("a ring is closed and has four positions or more")
                for position in ring:
                    if len(position) != 2 or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in position) or abs(position[0]) > 180 or abs(position[1]) > 90:
                        raise ValueError("a position is a longitude and a latitude")
                count += len(ring)
                if count > 10_000:
                    raise ValueError("an area has 10,000 positions at most")
            out.append([[(float(x), float(y)) for x, y in ring] for ring in polygon])
    return out


def area_rings(area: dict) -> list[list[tuple[float, float]]]:
    """Outer rings of a GeoJSON area, validated."""
    return [polygon[0] for polygon in area_polygons(area)]


def polygon_wkt(rings: list[list[tuple[float, float]]]) -> str:
    """WKT of closed rings."""
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings) + ")"
