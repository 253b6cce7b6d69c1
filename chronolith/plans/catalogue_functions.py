"""Queries of scalar functions, sources and the algebra, each with its SQL; registered with those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import geo, ids, text, times
from chronolith.operators import graph
from chronolith.plans.catalogue import KIND_SQL, case, commune_sql, number_sql, query, rank_sql, simplified_sql, thoroughfare_sql, words_sql
from chronolith.sources import config, events_json, files, states_json


def _s(c):
    return F.col(c).cast("string")


# --- strings (C01-C16) ------------------------------------------------------------------------


@query("SELECT id, replace(label, ' ', '') AS label, replace(number, ' ', '') AS number FROM name")
def c01_without_spaces(t):
    return t("name").select("id", text.without_spaces(F.col("label")).alias("label"), text.without_spaces(F.col("number")).alias("number"))


@query(f"SELECT id, {simplified_sql('label')} AS plain, {simplified_sql('label', ' ')} AS spaced, {simplified_sql('label', '', False)} AS accented FROM name")
def c08_simplified_landmark(t):
    label = F.col("label")
    return t("name").select("id", text.simplified_landmark(label, False, False).alias("plain"), text.simplified_landmark(label, True, False).alias("spaced"), text.simplified_landmark(label, False, True).alias("accented"))


_LANG = "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'nl' ELSE 'fr' END"
_KIND = "CASE id % 3 WHEN 0 THEN 'thoroughfare' WHEN 1 THEN 'area' ELSE 'number' END"


def _kinds(t):
    k = F.col("id")
    return t("name").select("id", "label", F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "nl").otherwise("fr").alias("lang"), F.when(k % 3 == 0, "thoroughfare").when(k % 3 == 1, "area").otherwise("number").alias("kind"))


_NORMAL = f"CASE WHEN lang IS NULL AND kind = 'number' THEN {number_sql('label')} WHEN lang = 'fr' AND kind = 'number' THEN lower(label) WHEN lang = 'fr' AND kind = 'thoroughfare' THEN {thoroughfare_sql('label')} WHEN lang = 'fr' AND kind = 'area' THEN {commune_sql('label')} END"


@query(f"SELECT id, {_NORMAL} AS normal FROM (SELECT id, label, {_LANG} AS lang, {_KIND} AS kind FROM name)")
def c09_normal_by_kind(t):
    return _kinds(t).select("id", text.normal_name(F.col("label"), F.col("kind"), F.col("lang")).alias("normal"))


@query(f"SELECT id, normal, CASE WHEN lang IS NULL AND kind = 'number' THEN replace(normal, ' ', '') WHEN lang = 'fr' AND kind = 'number' THEN replace(normal, ' ', '') WHEN lang = 'fr' THEN {simplified_sql('normal')} END AS simplified FROM (SELECT *, {_NORMAL} AS normal FROM (SELECT id, label, {_LANG} AS lang, {_KIND} AS kind FROM name))")
def c10_normal_and_simplified(t):
    normal = text.normal_name(F.col("label"), F.col("kind"), F.col("lang"))
    return _kinds(t).select("id", normal.alias("normal"), text.simplified_name(normal, F.col("kind"), F.col("lang")).alias("simplified"))


@query("SELECT id, replace(replace(replace(label, 'R ', 'Rue '), 'St-', 'Saint-'), 'Forêt', 'Bois') AS out FROM name")
def c12_nested_replacements(t):
    return t("name").select("id", text.replaced_in_order(F.col("label"), {"R ": "Rue ", "St-": "Saint-", "Forêt": "Bois"}).alias("out"))


@query(f"SELECT lm AS s, 'label' AS p, {thoroughfare_sql('label')} AS o FROM landmark WHERE lang = 'fr' UNION ALL SELECT lm, 'label', label FROM landmark WHERE lang IS NULL")
def c14_rewritten_labels(t):
    fr = F.col("lang") == "fr"
    return t("landmark").select(F.col("lm").alias("s"), F.lit("label").alias("p"), F.when(fr, text.normal_thoroughfare(F.col("label"))).otherwise(F.col("label")).alias("o"))


@query("SELECT event_id, CASE WHEN b IN ('true', '1') THEN true WHEN b IN ('false', '0') THEN false END AS flag FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN 'false' WHEN 3 THEN '1' ELSE event_type END AS b FROM events)")
def c16_boolean_literals(t):
    k = F.col("event_id")
    return t("events").select("event_id", ids.boolean_of(F.when(k % 5 == 0, " True").when(k % 5 == 1, "0").when(k % 5 == 2, "FALSE ").when(k % 5 == 3, "1").otherwise(F.col("event_type"))).alias("flag"))


# --- times (C21-C32) ----------------------------------------------------------------------------------


@query("SELECT t, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN strftime(stamp, '%Y-%m-%d') END AS stamp, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN precision END AS precision FROM (SELECT *, cast(substr(t, 2) AS bigint) AS k FROM instant)")
def c21_instant_triples(t):
    k = F.substring("t", 2, 20).cast("long")
    own = times.instant(F.date_format("stamp", "yyyy-MM-dd"), F.when(k % 3 != 0, F.col("calendar")), F.when(k % 4 != 0, F.col("precision")))
    return t("instant").select("t", own["stamp"].alias("stamp"), own["precision"].alias("precision"))


@query("SELECT elem, strftime(app_crisp, '%Y-%m-%d') AS start, coalesce(strftime(dis_crisp, '%Y-%m-%d'), '2000-01-01') AS finish, CASE WHEN dis_crisp IS NULL THEN 'day' ELSE 'month' END AS precision FROM bound")
def c22_valid_time_defaults(t):
    of = lambda c, p: times.instant(F.date_format(c, "yyyy-MM-dd"), F.lit("gregorian"), F.lit(p))
    start, end = times.valid_time(of("app_crisp", "day"), of("dis_crisp", "month"), "2000-01-01")
    return t("bound").select("elem", start["stamp"].alias("start"), end["stamp"].alias("finish"), end["precision"].alias("precision"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') END AS stamp, CASE WHEN o_orderkey % 3 <> 0 THEN 'day' END AS precision FROM orders")
def c23_strict_dates(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    own = times.strict_gregorian(raw)
    return t("orders").select("o_orderkey", own["stamp"].alias("stamp"), own["precision"].alias("precision"))


_CUT = "CASE precision WHEN 'day' THEN strftime(g, '%Y-%m-%d') WHEN 'month' THEN strftime(g, '%Y-%m') WHEN 'year' THEN strftime(g, '%Y') WHEN 'decade' THEN substr(strftime(g, '%Y'), 1, 3) ELSE substr(strftime(g, '%Y'), 1, 2) END"


@query(
    f"""SELECT t, {_CUT} AS date FROM (SELECT t, precision, CASE WHEN calendar = 'julian' THEN cast(to_days(cast(d + (153 * m2 + 2) // 5 + 365 * y2 + y2 // 4 - 32083 - 2440588 AS int)) + DATE '1970-01-01' AS date) ELSE cast(stamp AS date) END AS g
    FROM (SELECT *, y + 4800 - (14 - m) // 12 AS y2, m + 12 * ((14 - m) // 12) - 3 AS m2 FROM (SELECT *, extract(year FROM stamp) AS y, extract(month FROM stamp) AS m, extract(day FROM stamp) AS d FROM instant)))"""
)
def c26_standardised_dates(t):
    return t("instant").select("t", times.standardised(F.date_format("stamp", "yyyy-MM-dd"), F.col("calendar"), F.col("precision")).alias("date"))


@query(f"SELECT a.t AS t, {rank_sql('b.precision')} > {rank_sql('a.precision')} AS other_is_finer, {rank_sql('a.precision')} > -1 AS finer_than_unknown FROM instant a JOIN instant b ON cast(substr(b.t, 2) AS bigint) = cast(substr(a.t, 2) AS bigint) // 2".replace("FROM instant a JOIN instant b", "FROM instant a JOIN instant AS b"))
def c28_finer_precisions(t):
    a, k = t("instant"), F.substring("t", 2, 20).cast("long")
    b = t("instant").select(k.alias("k"), F.col("precision").alias("other"))
    joined = a.withColumn("half", F.floor(k / 2)).join(b, F.col("half") == F.col("k"))
    return joined.select("t", times.more_precise(F.col("precision"), F.col("other")).alias("other_is_finer"), times.more_precise(F.lit("unheard"), F.col("precision")).alias("finer_than_unknown"))


@query(f"SELECT o_orderkey, {case('q', times.CALENDARS).replace(' ELSE q END', ' END')} AS calendar FROM (SELECT o_orderkey, CASE o_orderkey % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{q}{chr(39)}' for i, q in enumerate(times.CALENDARS))} ELSE 'Q1' END AS q FROM orders)")
def c29_calendar_names(t):
    k, q = F.col("o_orderkey") % 6, F.lit("Q1")
    for i, name in enumerate(times.CALENDARS):
        q = F.when(k == i, F.lit(name)).otherwise(q)
    return t("orders").select("o_orderkey", times.calendar_of(F.concat(F.lit("http://www.wikidata.org/entity/"), q)).alias("calendar"))


@query("SELECT elem, to_timestamp(floor((epoch_ms(app_begin) + epoch_ms(app_end)) / 2000.0))::TIMESTAMP AS middle, cast(extract(year FROM app_begin) AS bigint) AS y, cast(extract(month FROM app_begin) AS bigint) AS m, cast(extract(day FROM app_begin) AS bigint) AS d FROM bound WHERE app_begin IS NOT NULL AND app_end IS NOT NULL")
def c31_middles_and_parts(t):
    b = t("bound").where("app_begin is not null and app_end is not null")
    return b.select("elem", F.date_trunc("second", times.midpoint(F.col("app_begin"), F.col("app_end"))).cast("timestamp_ntz").alias("middle"), F.year("app_begin").cast("long").alias("y"), F.month("app_begin").cast("long").alias("m"), F.dayofmonth("app_begin").cast("long").alias("d"))


@query("SELECT o_orderkey, try_cast(d AS date) IS NOT NULL AND regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') AS valid FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-31') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%-m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d ') END AS d FROM orders)")
def c32_strict_iso_dates(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-'31'")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyyy-M-dd")).otherwise(F.date_format(d, "yyyy-MM-dd' '"))
    # a month of two digits reads the same in both patterns
    return t("orders").select("o_orderkey", times.is_iso_date(raw).alias("valid"))


# --- geometry (C40-C51) ------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'http://www.opengis.net/def/crs/EPSG/0/2154' ELSE 'http://www.opengis.net/def/crs/EPSG/0/4326' END AS crs, concat('POINT (', id, ' ', id % 7, ')') AS wkt FROM point")
def c40_split_literals(t):
    k = F.col("id")
    wkt = F.concat(F.lit("POINT ("), _s("id"), F.lit(" "), (k % 7).cast("string"), F.lit(")"))
    prefix = F.when(k % 3 == 0, "<http://www.opengis.net/def/crs/EPSG/0/2154> ").when(k % 3 == 1, "<http://www.opengis.net/def/crs/OGC/1.3/CRS84> ").otherwise("")
    crs, body = geo.split_literal(F.concat(prefix, wkt))
    return t("point").select("id", crs.alias("crs"), body.alias("wkt"))


_CRS = "CASE id % 5 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:2154' WHEN 2 THEN 'urn:ogc:def:crs:OGC:1.3:CRS84' WHEN 3 THEN 'EPSG:3857' ELSE 'EPSG:9' END"


@query(f"SELECT id, CASE WHEN id % 5 = 4 THEN NULL ELSE concat('http://www.opengis.net/def/crs/EPSG/0/', e) END AS uri, CASE WHEN id % 5 = 4 THEN NULL ELSE e END AS code FROM (SELECT id, CASE id % 5 WHEN 1 THEN '2154' WHEN 3 THEN '3857' ELSE '4326' END AS e FROM point)")
def c41_reference_systems(t):
    uri = geo.crs_uri(F.expr(_CRS))
    return t("point").select("id", uri.alias("uri"), geo.epsg_of(uri).alias("code"))


def _lshape(x, y, w):
    """An L of two boxes, w wide and 3 w high and wide, from (x, y)."""
    corner = lambda a, b: F.concat_ws(" ", (x + a * w).cast("string"), (y + b * w).cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(3, 0), corner(3, 1), corner(1, 1), corner(1, 3), corner(0, 3), corner(0, 0)), F.lit("))"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN x - 10 ELSE x END AS xmin, CASE WHEN id % 2 = 0 THEN y + 10 ELSE y + 2 END AS ymax FROM point")
def c43_grown_envelopes(t):
    x, y = F.col("x"), F.col("y")
    corner = lambda a, b: F.concat_ws(" ", (x + a).cast("string"), (y + b).cast("string"))
    wkt = F.when(F.col("id") % 2 == 0, F.concat(F.lit("POINT ("), corner(0, 0), F.lit(")"))).otherwise(F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(1, 0), corner(1, 2), corner(0, 0)), F.lit("))")))
    box = geo.grown(geo.envelope(wkt), 10.0)
    return t("point").select("id", box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))


@query("SELECT id % 20 AS k, round(sum(a * cx) / sum(a), 6) AS x, round(sum(a * cy) / sum(a), 6) AS y, round(cast(sum(a) AS double), 6) AS area, count(*) AS n FROM (SELECT DISTINCT id % 20 AS id, x, y, 5.0 * w * w AS a, x + 1.1 * w AS cx, y + 1.1 * w AS cy FROM (SELECT *, 1 + id % 4 AS w FROM point)) GROUP BY id % 20")
def c44_middle_of_union(t):
    own = t("point").select((F.col("id") % 20).alias("k"), _lshape(F.col("x"), F.col("y"), 1 + F.col("id") % 4).alias("wkt"))
    g = own.groupBy("k").agg(F.collect_set("wkt").alias("g")).withColumn("c", geo.centroid_of_union("g"))
    areas = own.distinct().select("k", geo.area("wkt").alias("a")).groupBy(F.col("k").alias("__k")).agg(F.sum("a").alias("area"))
    return g.join(areas, F.col("k") == F.col("__k")).select("k", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("area", 6).alias("area"), F.size("g").cast("long").alias("n"))


@query("SELECT id, round(x + 1.1 * w, 6) AS x, round(y + 1.1 * w, 6) AS y, round(cast(5.0 * w * w AS double), 6) AS area FROM (SELECT *, 1 + id % 4 AS w FROM point)")
def c50_middle_of_polygon(t):
    own = t("point").select("id", _lshape(F.col("x"), F.col("y"), 1 + F.col("id") % 4).alias("wkt"))
    return own.withColumn("c", geo.centroid("wkt")).select("id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round(geo.area("wkt"), 6).alias("area"))


@query("SELECT id, concat('LINESTRING (', id, '.0 0.0, ', id + 3, '.0 4.0)') AS line, 5.0 AS length FROM point".replace("5.0 AS", "cast(5.0 AS double) AS"))
def c50_line_and_length(t):
    a = F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    b = F.struct((F.col("id") + 3).cast("double").alias("x"), F.lit(4.0).alias("y"))
    return t("point").select("id", geo.line_between(a, b).alias("line"), geo.distance(a, b).alias("length"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 50 END AS k, x, y FROM point".replace("SELECT id,", "SELECT k, min(id) AS first, count(*) AS n FROM (SELECT id,").replace("FROM point", "FROM point) GROUP BY coalesce(k, -id), k"))
def c45_features_by_property(t):
    key = F.when(F.col("id") % 3 != 0, (F.col("id") % 50).cast("string"))
    rows = t("point").select(F.col("id").alias("ordinal"), F.lit("crs").alias("crs"), F.create_map(F.lit("k"), key).alias("properties"), F.concat(F.lit("POINT ("), _s("id"), F.lit(" 1)")).alias("wkt"))
    return files.merged_features(rows, "k", null_is_one_group=False).select(F.col("properties")["k"].cast("long").alias("k"), F.col("ordinal").alias("first"), F.size("geometries").cast("long").alias("n"))


@query("""SELECT id, CASE id % 3 WHEN 0 THEN concat('{"type":"Point","coordinates":[', id, ',2]}') WHEN 1 THEN concat('{"type":"LineString","coordinates":[[', id, ',1],[2,', id, ']]}') ELSE concat('{"type":"Polygon","coordinates":[[[0,0],[', id, ',0],[0,1],[0,0]]]}') END AS json FROM point""")
def c47_wkt_to_geojson(t):
    k = F.col("id")
    wkt = F.when(k % 3 == 0, F.concat(F.lit("POINT ("), _s("id"), F.lit(" 2)"))).when(k % 3 == 1, F.concat(F.lit("LINESTRING ("), _s("id"), F.lit(" 1, 2 "), _s("id"), F.lit(")"))).otherwise(F.concat(F.lit("POLYGON ((0 0, "), _s("id"), F.lit(" 0, 0 1, 0 0))")))
    return t("point").select("id", geo.wkt_to_geojson(wkt).alias("json"))


_SQUARE = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[a, -30], [a + 40, -30], [a + 40, 30], [a, 30], [a, -30]]]}} for a in (-100, 20)]}


@query("SELECT id FROM point WHERE y >= -30 AND y < 30 AND ((x >= -100 AND x < -60) OR (x >= 20 AND x < 60))")
def c48_area_of_features(t):
    inside = F.lit(False)
    for ring in geo.area_rings(_SQUARE):
        inside = inside | geo.within(F.col("x"), F.col("y"), ring[:-1])
    return t("point").where(inside).select("id")


@query("SELECT id, abs(x) <= 50 AND abs(y) <= 20 AS in_box, x - 5 <= 50 AND x + 5 >= -50 AND abs(y) <= 20 AS line_meets FROM point")
def c49_intersections(t):
    x, y = F.col("x"), F.col("y")
    at = lambda dx: F.concat_ws(" ", (x + dx).cast("string"), y.cast("string"))
    own = t("point").select("id", F.concat(F.lit("POINT ("), at(0), F.lit(")")).alias("p"), F.concat(F.lit("LINESTRING ("), at(-5), F.lit(", "), at(5), F.lit(")")).alias("l"), F.lit("POLYGON ((-50 -20, 50 -20, 50 20, -50 20, -50 -20))").alias("box"))
    return own.select("id", geo.intersects("p", "box").alias("in_box"), geo.intersects("l", "box").alias("line_meets"))


@query("SELECT lm, label AS v, lang, label IS NOT DISTINCT FROM upper(label) AND lang IS NOT DISTINCT FROM lang AS same, md5(concat_ws('|', 'Landmark', coalesce(label, '␀'), coalesce(lang, '␀'))) AS id FROM landmark")
def c51_terms(t):
    own = ids.term(F.col("label"), F.col("lang"))
    return t("landmark").select("lm", own["v"].alias("v"), own["lang"].alias("lang"), ids.same_term(own, ids.term(F.upper("label"), F.col("lang"))).alias("same"), ids.signature("Landmark", "label", "lang").alias("id"))


# --- sources and sinks (S03-S38) --------------------------------------------------------------------------------


def _quoted(c):
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


@query("SELECT lr, type, CASE WHEN many THEN 2 ELSE 1 END AS relata, true AS related FROM (SELECT concat('e', c_custkey) AS lr, CASE WHEN c_custkey % 2 = 0 THEN 'Along' ELSE 'Belongs' END AS type, c_custkey % 3 = 0 AS many FROM customer)".replace("CASE WHEN many THEN 2 ELSE 1 END", "cast(CASE WHEN many THEN 2 ELSE 1 END AS bigint)"))
def s03_event_relations(t):
    k = F.col("c_custkey")
    relatum = F.when(k % 3 == 0, '["2","3"]').otherwise('"2"')
    key = F.when(k % 4 == 0, "change").otherwise("changes")  # both spellings are read
    row = F.concat(F.lit('{"source":{"uri":'), _quoted(F.concat(F.lit("e"), k.cast("string"))), F.lit('},"events":[{"relations":[{"id":"1","type":'), _quoted(F.when(k % 2 == 0, "Along").otherwise("Belongs")), F.lit(',"locatum":"1","relatum":'), relatum, F.lit(',"'), key, F.lit('":[{"on":"relation","type":"appearance"}]}]}]}'))
    got = events_json.from_text(t("customer").select(row.alias("j")), "j")
    relation = got["relation"].groupBy("lr", "type").agg(F.count(F.lit(1)).alias("relata"))
    change = got["relation_change"].where("type = 'LandmarkRelationAppearance'").select(F.col("applied_to").alias("__lr"))
    # ids are digests of the source: name them back
    names = t("customer").select(F.concat(F.lit("e"), _s("c_custkey")).alias("name")).withColumn("__id", ids.signature("LandmarkRelation", ids.signature("Event", "name", F.lit(0)), F.lit("1")))
    joined = relation.join(change, F.col("lr") == F.col("__lr"), "left").join(names, F.col("lr") == F.col("__id"))
    return joined.select(F.col("name").alias("lr"), "type", "relata", F.col("__lr").isNotNull().alias("related"))


@query("SELECT concat('st', c_custkey) AS g, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'zz' END AS relatum, c_custkey % 2 = 1 AS undefined, 'Undefined' AS type FROM customer".replace("'Undefined' AS type", "cast(2 AS bigint) AS steps"))
def s05_state_relations(t):
    k = F.col("c_custkey")
    g = F.concat(F.lit("st"), k.cast("string"))
    row = F.concat(F.lit('{"source":{"uri":'), _quoted(g), F.lit('},"landmarks":[{"id":"a","label":"A","type":"StreetNumber"},{"id":"b","label":"B","type":"Thoroughfare"}],"relations":[{"id":"r","type":"Belongs","locatum":"a","relatum":"'), F.when(k % 2 == 0, "b").otherwise("zz"), F.lit('"}],"addresses":[{"id":"x","label":"A, B","target":"a","segments":["a","b"]}]}'))
    got = states_json.from_text(t("customer").select(row.alias("j")), "j")
    local = F.explode(F.array(F.lit("b"), F.lit("zz"))).alias("relatum")
    names = t("customer").select(g.alias("name"), local).withColumn("__lm", ids.signature("Landmark", "name", "relatum"))
    steps = got["address"].groupBy(F.col("g").alias("__g")).agg(F.count(F.lit(1)).alias("steps"))
    undefined = got["undefined"].select(F.col("lm").alias("__u"), F.lit(True).alias("__is"))
    joined = got["relation"].select("g", F.col("relatum").alias("lm")).join(names, F.col("lm") == F.col("__lm")).join(undefined, F.col("lm") == F.col("__u"), "left").join(steps, F.col("g") == F.col("__g"))
    return joined.select("g", "relatum", F.coalesce("__is", F.lit(False)).alias("undefined"), "steps")


def _streets(t):
    k = F.col("p_partkey")
    return t("part").select(F.col("p_name").alias("nom"), F.when(k % 2 == 0, "1901-02-03").alias("debut"), F.when(k % 3 == 0, "1950/1/2").otherwise("").alias("fin"), F.concat(F.col("p_brand"), F.lit(" , "), F.col("p_type")).alias("quartier"))


@query("SELECT DISTINCT p_name AS label, area FROM (SELECT p_name, p_brand AS area FROM part UNION ALL SELECT p_name, p_type FROM part)")
def s08_street_areas(t):
    got = files.street_nomenclature(_streets(t), "city", "nom", "debut", None, ["quartier"])
    names = got["landmark"].select("lm", "label")
    return got["relation"].join(names, F.col("locatum") == F.col("lm")).select("label", "area").distinct()


@query("SELECT p_name AS label, type, stamp, count(*) AS n FROM (SELECT p_name, 'LandmarkAppearance' AS type, '1901-02-03T00:00:00Z' AS stamp FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, 'LandmarkDisappearance', '1950-01-02T00:00:00Z' FROM part WHERE p_partkey % 3 = 0) GROUP BY ALL")
def s09_obsolete_streets(t):
    got = files.street_nomenclature(_streets(t), "city", "nom", "debut", "fin", ["quartier"])
    names = got["landmark"].select("lm", "label")
    return got["event"].join(names, F.col("applied_to") == F.col("lm")).groupBy("label", "type", "stamp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_name AS label FROM part")
def s10_column_names(t):
    rows = files.renamed(t("part").select(F.col("p_name").alias("nomvoie")), {"geojson": {"nomvoie": "nom"}, "csv": {"Dénomination": "nom"}}["geojson"])
    return files.street_nomenclature(rows.withColumn("quartier", F.lit("x")), "city", "nom", None, None, ["quartier"])["landmark"].select("label")


@query("SELECT number, street, count(*) AS n FROM (SELECT concat(p_size, ' bis') AS number, p_name AS street FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT cast(p_size AS varchar), p_name FROM part WHERE p_partkey % 2 = 1) GROUP BY ALL")
def s13_street_numbers(t):
    k = F.col("p_partkey")
    prop = lambda **c: F.create_map(*[x for n, v in c.items() for x in (F.lit(n), v)])
    one = t("part").where(k % 2 == 0).select(prop(a=F.concat(_s("p_size"), F.lit(" bis "), F.col("p_name"))).alias("properties"), F.lit("POINT (0 0)").alias("wkt"))
    two = t("part").where(k % 2 == 1).select(prop(n=_s("p_size"), s=F.col("p_name")).alias("properties"), F.lit("POINT (0 0)").alias("wkt"))
    return files.street_number_features(one, None, None, "a").unionByName(files.street_number_features(two, "n", "s")).groupBy("number", "street").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lm, concat('{"label":"', label, '"', CASE WHEN lang IS NULL THEN '' ELSE concat(',"lang":"', lang, '"') END, ',"type":"', type, '"}') AS json FROM landmark""")
def s14_descriptions(t):
    return t("landmark").select("lm", files.described(label=F.col("label"), lang=F.col("lang"), type=F.col("type")).alias("json"))


@query("SELECT family, side, count(*) AS n FROM (SELECT unnest(['street', 'square', 'quarter', 'arrondissement', 'commune']) AS family, o_orderkey, o_orderstatus FROM orders), (VALUES ('start'), ('end')) AS v(side) WHERE o_orderkey % 5 = CASE family WHEN 'street' THEN 0 WHEN 'square' THEN 1 WHEN 'quarter' THEN 2 WHEN 'arrondissement' THEN 3 ELSE 4 END GROUP BY ALL")
def s16_families(t):
    families = ["street", "square", "quarter", "arrondissement", "commune"]
    rows = t("orders")
    return files.of_families({f: rows.where(F.col("o_orderkey") % 5 == i).select(_s("o_orderkey").alias("landmarkId")) for i, f in enumerate(families)}).groupBy("family", "side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'ban' AS source, 'StreetNumber' AS type, count(*) AS n FROM part UNION ALL SELECT 'osm', 'StreetNumber', count(*) FROM customer UNION ALL SELECT 'city', 'Thoroughfare', count(DISTINCT p_name) FROM part")
def s17_entry_points(t):
    ban = t("part").select(_s("p_partkey").alias("id"), _s("p_size").alias("numero"), F.lit("bis").alias("rep"), F.col("p_name").alias("nom_voie"), F.col("p_brand").alias("code_postal"), F.col("p_type").alias("nom_commune"), F.lit("x").alias("code_insee"), F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat"))
    c = t("customer")
    numbers = c.select(F.lit("POINT (2 48)").alias("houseNumberGeomWKT"), _s("c_custkey").alias("houseNumberId"), F.col("c_name").alias("houseNumberLabel"))
    context = c.select(_s("c_custkey").alias("houseNumberId"), _s("c_nationkey").alias("streetId"), F.col("c_mktsegment").alias("streetName"), F.lit("1").alias("arrdtId"), F.lit("a").alias("arrdtName"), F.lit("i").alias("arrdtInsee"))
    got = files.landmarks_of({"ban": files.address_file(ban, "ban"), "osm": files.house_number_files(numbers, context, "osm"), "city": files.street_nomenclature(_streets(t), "city", "nom", None, None, ["quartier"])})
    return got.where("g = 'city' or type = 'StreetNumber'").groupBy(F.col("g").alias("source"), "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s, p, o, g FROM quad WHERE g IN ('g1', 'g2')")
def s19_graphs_on_disk(t):
    from chronolith.operators.rounds import scratch

    quads = t("quad")
    path = scratch(quads.sparkSession, "graphs")
    files.write_graph(quads, path)
    return files.read_graphs(quads.sparkSession, path, ["g1", "g2"]).select("s", "p", "o", "g")


def ids_of_run():
    import uuid

    return uuid.uuid4().hex


@query("""SELECT concat('{"lm":"', lm, '","label":"', label, '"', CASE WHEN lang IS NULL THEN '' ELSE concat(',"lang":"', lang, '"') END, '}') AS value FROM landmark""")
def s21_json_bindings(t):
    return files.as_json_lines(t("landmark").select("lm", "label", "lang"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, CAST(NULL AS varchar) AS unbound FROM events")
def s22_typed_bindings(t):
    own = F.from_json("props", "k bigint, absent string")
    return t("events").select("event_id", own["k"].alias("k"), own["absent"].alias("unbound"))


@query("SELECT s, p, CASE WHEN g = 'g1' THEN 'new' ELSE o END AS o, g FROM quad WHERE g <> 'g1' OR p = 'hasTime'")
def s26_replaced_graph(t):
    from chronolith.operators.rounds import scratch

    quads = t("quad")
    path = scratch(quads.sparkSession, "graphs")
    files.write_graph(quads, path)
    files.replace_graphs(quads.where("g = 'g1' and p = 'hasTime'").withColumn("o", F.lit("new")), path)
    return files.read_graphs(quads.sparkSession, path).select("s", "p", "o", "g")


def _registered(t):
    registry = t("landmark").sparkSession.createDataFrame([], "g string, role string, is_active boolean, label string, lang string")
    for g, role in (("g0", "source"), ("g1", "source"), ("g2", "construction"), ("g3", "final"), ("g2", "construction")):
        registry = graph.registered(registry, g, role, g.upper(), "fr")
    return registry


@query("SELECT g, lm, role, role_label FROM landmark JOIN (VALUES ('g0', 'source', 'G0'), ('g1', 'source', 'G1'), ('g2', 'construction', 'G2'), ('g3', 'final', 'G3')) AS v(rg, role, role_label) ON g = rg")
def s29_registered_graphs(t):
    own = _registered(t).select(F.col("g").alias("__g"), "role", F.col("label").alias("role_label"))
    return t("landmark").join(own, F.col("g") == F.col("__g")).select("g", "lm", "role", "role_label")


@query("SELECT g, lm, g <> 'g1' AND g = 'g0' AS active FROM landmark")
def s30_activated_graphs(t):
    own = graph.activated(graph.activated(_registered(t), True), False, ["g1"]).select(F.col("g").alias("__g"), "is_active")
    return t("landmark").join(own, F.col("g") == F.col("__g")).select("g", "lm", F.col("is_active").alias("active"))


@query("SELECT g, lm FROM landmark WHERE g <> 'g2'")
def s31_without_construction(t):
    return t("landmark").join(graph.without_construction(_registered(t)).select("g"), "g", "left_semi").select("g", "lm")


@query("SELECT lm, parent FROM landmark JOIN (VALUES ('StreetNumber', 'Number'), ('StreetNumber', 'Landmark'), ('StreetNumber', 'StreetNumber'), ('Number', 'Number'), ('Number', 'Landmark'), ('Thoroughfare', 'Landmark'), ('Thoroughfare', 'Thoroughfare'), ('Landmark', 'Landmark')) AS v(child, parent) ON type = child")
def s32_class_hierarchy(t):
    lm = t("landmark")
    closed = graph.closure_of_rules(lm.sparkSession, [("StreetNumber", "Number"), ("Number", "Landmark"), ("Thoroughfare", "Landmark")])
    return lm.join(closed, F.col("type") == F.col("child")).select("lm", "parent")


@query("SELECT 'g9' AS g, lm AS s, p, o FROM (SELECT lm, 'label' AS p, label AS o FROM landmark UNION ALL SELECT lm, 'type', type FROM landmark UNION ALL SELECT lm, 'lang', lang FROM landmark WHERE lang IS NOT NULL)")
def s33_typed_table_as_graph(t):
    rows = t("landmark").withColumn("g", F.lit("g9"))
    return graph.statements(rows, "lm", {"label": ("label", "literal"), "type": ("type", "uri"), "lang": ("lang", "literal")}).select("g", "s", "p", "o")


@query("SELECT s, p, o, g FROM quad WHERE g IN ('g0', 'g1') UNION ALL SELECT s, p, o, g FROM quad WHERE g = 'g2' AND s LIKE 'o1%'")
def s35_copied_graphs(t):
    quads = t("quad").select("s", "p", "o", "g")
    target = quads.where("g = 'g1'").withColumn("o", F.lit("old")).unionByName(quads.where("g = 'g2' and s like 'o1%'"))
    return graph.copied(quads, target, ["g0", "g1"]).select("s", "p", "o", "g")


@query("SELECT source, count(*) AS n, round(cast(sum(x) AS double), 3) AS x FROM (SELECT 'ban' AS source, 2.0 AS x FROM part UNION ALL SELECT 'osm', c_custkey % 10 + 1.0 FROM customer) GROUP BY source")
def s37_address_tables(t):
    ban = t("part").select(F.lit("ban").alias("source"), F.concat(_s("p_size"), F.lit("bis")).alias("number"), F.col("p_name").alias("street"), F.lit("POINT (2 48)").alias("wkt"))
    k = (F.col("c_custkey") % 10).cast("string")
    osm = t("customer").select(F.lit("osm").alias("source"), _s("c_custkey").alias("number"), F.col("c_name").alias("street"), F.concat(F.lit("LINESTRING ("), k, F.lit(" 0, "), (F.col("c_custkey") % 10 + 2).cast("string"), F.lit(" 0)")).alias("wkt"))
    rows = files.address_table([ban, osm])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query("SELECT lm, label, 15 AS search_limit FROM landmark WHERE lang = 'en' OR lang IS NULL".replace("15 AS", "cast(15 AS int) AS"))
def s38_settings(t):
    own = config.reading({"default_lang": "en", "search_limit": 15, "time_delay_years": 1, "calendar": "gregorian"})
    return t("landmark").where(F.col("lang").isNull() | (F.col("lang") == own.default_lang)).select("lm", "label", F.lit(own.search_limit).alias("search_limit"))


# --- algebra (A01-A33) --------------------------------------------------------------------------------------------


@query("SELECT a.s, a.o AS landmark, b.o AS stamp FROM quad a JOIN quad AS b ON a.s = b.s WHERE a.p = 'appliedTo' AND b.p = 'hasTime'")
def a01_basic_pattern(t):
    q = t("quad")
    of = lambda p, name: q.where(F.col("p") == p).select("s", F.col("o").alias(name))
    return of("appliedTo", "landmark").join(of("hasTime", "stamp"), "s")


@query("SELECT a.s, b.o AS landmark FROM (SELECT s FROM quad WHERE p = 'hasTime' AND o_dtype = 'string') a LEFT JOIN (SELECT s, o FROM quad WHERE p = 'appliedTo' AND o <> 'c1') b ON a.s = b.s")
def a03_left_outer(t):
    q = t("quad")
    return q.where("p = 'hasTime' and o_dtype = 'string'").select("s").join(q.where("p = 'appliedTo' and o <> 'c1'").select("s", F.col("o").alias("landmark")), "s", "left")


@query("SELECT s FROM instance WHERE s NOT IN (SELECT s FROM quad WHERE p = 'appliedTo')")
def a04_anti_join(t):
    return t("instance").join(t("quad").where("p = 'appliedTo'").select("s"), "s", "left_anti").select("s")


@query("SELECT a.s, a.o FROM quad a WHERE a.p = 'hasTime' AND NOT EXISTS (SELECT 1 FROM quad AS b WHERE b.s = a.s AND b.o = a.o AND b.o_dtype IN ('string', 'other'))")
def a05_minus(t):
    q = t("quad")
    return q.where("p = 'hasTime'").select("s", "o").join(q.where(F.col("o_dtype").isin("string", "other")).select("s", "o"), ["s", "o"], "left_anti")


@query("SELECT a.ev, a.t AS t1, b.t AS t2 FROM instant a JOIN instant AS b ON a.ev = b.ev WHERE a.t <> b.t AND a.stamp < b.stamp AND b.stamp <= a.stamp + INTERVAL 200 DAY")
def a06_theta_self_join(t):
    i = t("instant")
    a, b = i.alias("a"), i.alias("b")
    near = (F.col("a.t") != F.col("b.t")) & (F.col("a.stamp") < F.col("b.stamp")) & (F.col("b.stamp") <= F.col("a.stamp") + F.expr("INTERVAL 200 DAY"))
    return a.join(b, (F.col("a.ev") == F.col("b.ev")) & near).select(F.col("a.ev").alias("ev"), F.col("a.t").alias("t1"), F.col("b.t").alias("t2"))


@query("SELECT lm AS elem, label, 'landmark' AS kind FROM landmark UNION ALL SELECT av, value, 'version' FROM version")
def a07_union_branches(t):
    return t("landmark").select(F.col("lm").alias("elem"), "label", F.lit("landmark").alias("kind")).unionByName(t("version").select(F.col("av").alias("elem"), F.col("value").alias("label"), F.lit("version").alias("kind")))


@query("SELECT lm, code FROM landmark JOIN (VALUES ('Thoroughfare', 1), ('District', 2)) AS v(k, code) ON type = k")
def a08_inline_table(t):
    lm = t("landmark")
    return lm.join(lm.sparkSession.createDataFrame([("Thoroughfare", 1), ("District", 2)], "k string, code int"), F.col("type") == F.col("k")).select("lm", "code")


@query("SELECT lm, concat(type, ':', label) AS shown, n * 2 AS twice FROM landmark")
def a09_extension(t):
    return t("landmark").select("lm", F.concat_ws(":", "type", "label").alias("shown"), (F.col("n") * 2).alias("twice"))


@query("SELECT DISTINCT type, label FROM landmark")
def a10_distinct(t):
    return t("landmark").select("type", "label").distinct()


@query("SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM quad GROUP BY p")
def a11_counts(t):
    return t("quad").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


@query("SELECT o AS landmark, count(*) AS n FROM quad WHERE p = 'appliedTo' GROUP BY o HAVING count(*) > 3")
def a14_having(t):
    return t("quad").where("p = 'appliedTo'").groupBy(F.col("o").alias("landmark")).agg(F.count(F.lit(1)).alias("n")).where("n > 3")


@query("SELECT t, stamp FROM instant ORDER BY stamp DESC, t LIMIT 40")
def a15_top_k(t):
    return t("instant").select("t", "stamp").orderBy(F.desc("stamp"), "t").limit(40)


@query("SELECT elem, app_crisp FROM bound WHERE app_crisp IS NOT NULL ORDER BY app_crisp, elem LIMIT 1")
def a16_lookup(t):
    return t("bound").where("app_crisp is not null").select("elem", "app_crisp").orderBy("app_crisp", "elem").limit(1)


@query("WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM quad WHERE p = 'isPartOf'), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s AS child, o AS parent FROM c")
def a18_transitive_path(t):
    return graph.closure(t("quad").where("p = 'isPartOf'").select(F.col("s").alias("child"), F.col("o").alias("parent")), reflexive=False)


@query("SELECT a.s, b.o AS region, e.o AS either FROM quad a JOIN quad AS b ON a.o = b.s AND b.p = 'isPartOf' JOIN (SELECT s, o FROM quad WHERE p IN ('isPartOf', 'appliedTo')) e ON e.s = a.s WHERE a.p = 'isPartOf'")
def a19_sequence_and_alternative(t):
    q = t("quad")
    step = lambda a, b: q.where("p = 'isPartOf'").select(F.col("s").alias(a), F.col("o").alias(b))
    either = q.where(F.col("p").isin("isPartOf", "appliedTo")).select(F.col("s").alias("__s"), F.col("o").alias("either"))
    return step("s", "mid").join(step("mid2", "region"), F.col("mid") == F.col("mid2")).join(either, F.col("s") == F.col("__s")).select("s", "region", "either")


@query("SELECT DISTINCT type, label, md5(concat_ws('|', 'Landmark', type, label)) AS id FROM landmark")
def a20_ids_of_distinct_rows(t):
    return t("landmark").select("type", "label").distinct().select("type", "label", ids.signature("Landmark", "type", "label").alias("id"))


@query("SELECT elem, CASE WHEN app_crisp IS NOT NULL THEN 'known' WHEN app_begin IS NOT NULL THEN 'after' ELSE 'unknown' END AS state, coalesce(app_crisp > dis_crisp, app_begin > dis_end, false) AS odd FROM bound")
def a21_three_valued_logic(t):
    c = F.col
    return t("bound").select("elem", F.when(c("app_crisp").isNotNull(), "known").when(c("app_begin").isNotNull(), "after").otherwise("unknown").alias("state"), F.coalesce(c("app_crisp") > c("dis_crisp"), c("app_begin") > c("dis_end"), F.lit(False)).alias("odd"))


@query("SELECT ev, prop, t FROM candidate WHERE prop IN ('hasTime', 'hasTimeAfter')")
def a22_predicate_variable(t):
    return t("candidate").where(F.col("prop").isin("hasTime", "hasTimeAfter")).select("ev", "prop", "t")


@query("SELECT a.ev, a.t AS t1, b.t AS t2 FROM (SELECT *, dense_rank() OVER (PARTITION BY ev ORDER BY stamp) AS r FROM instant) a JOIN (SELECT *, dense_rank() OVER (PARTITION BY ev ORDER BY stamp) AS r FROM instant) b ON a.ev = b.ev AND b.r = a.r + 1")
def a24_next_by_time(t):
    return graph.following(t("instant"), "ev", "stamp", "t")


@query("SELECT a.id AS id1, b.id AS id2 FROM address a JOIN address AS b ON a.key = b.key WHERE a.ord = 0 AND b.ord = 1")
def a25_aliased_join(t):
    a = t("address")
    return a.where("ord = 0").select("key", F.col("id").alias("id1")).join(a.where("ord = 1").select("key", F.col("id").alias("id2")), "key").select("id1", "id2")


@query("SELECT id FROM address WHERE key NOT IN (SELECT key FROM address WHERE ord = 2 AND key IS NOT NULL)")
def a26_not_in(t):
    a = t("address")
    return a.join(a.where("ord = 2").select("key"), "key", "left_anti").select("id")


@query("SELECT id FROM address a WHERE NOT EXISTS (SELECT 1 FROM address AS b WHERE b.ord <> a.ord AND (b.key = a.key OR b.x = a.x AND b.y = a.y))")
def a27_not_exists_or(t):
    a = t("address")
    b = a.select(F.col("key").alias("k"), F.col("ord").alias("o"), F.col("x").alias("bx"), F.col("y").alias("by"))
    other = F.col("o") != F.col("ord")
    return a.join(b, (F.col("key") == F.col("k")) & other, "left_anti").join(b, (F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")) & other, "left_anti").select("id")


@query("SELECT DISTINCT key FROM address WHERE id NOT IN (SELECT id FROM address WHERE ord = 0 UNION SELECT id FROM address WHERE x > 50)")
def a28_not_in_union(t):
    a = t("address")
    gone = a.where("ord = 0").select("id").union(a.where("x > 50").select("id")).distinct()
    return a.join(gone, "id", "left_anti").select("key").distinct()


@query("SELECT id, CASE WHEN a.key IN (SELECT key FROM address WHERE ord = 2) THEN 'linked' ELSE 'new' END AS flag, coalesce(m.x, a.x) AS x FROM address a LEFT JOIN (SELECT key, min(x) AS x FROM address WHERE ord = 0 GROUP BY key) m ON m.key = a.key")
def a29_updates(t):
    a = t("address")
    marked = a.where("ord = 2").select(F.col("key").alias("__k")).distinct()
    values = a.where("ord = 0").groupBy(F.col("key").alias("__m")).agg(F.min("x").alias("__x"))
    return a.join(marked, F.col("key") == F.col("__k"), "left").join(values, F.col("key") == F.col("__m"), "left").select("id", F.when(F.col("__k").isNotNull(), "linked").otherwise("new").alias("flag"), F.coalesce("__x", "x").alias("x"))


@query("SELECT id, concat(key, '#', ord) AS label FROM address WHERE ord < 2")
def a30_generated_column_and_view(t):
    a = t("address").withColumn("label", F.concat_ws("#", "key", F.col("ord").cast("string")))
    return a.sparkSession.sql("SELECT id, label FROM {a} WHERE ord < 2", a=a)


@query("SELECT lm, CASE WHEN n % 7 = 0 THEN concat('known:', label) ELSE md5(concat_ws('|', 'Landmark', type, label)) END AS root FROM (SELECT *, min(n) OVER (PARTITION BY type, label) AS first, bool_or(n % 7 = 0) OVER (PARTITION BY type, label) AS k FROM landmark)".replace("CASE WHEN n % 7 = 0", "CASE WHEN k"))
def a31_probe_or_insert(t):
    from chronolith.operators import rooting

    lm = t("landmark")
    known = lm.where("n % 7 = 0").select("type", "label", F.concat(F.lit("known:"), "label").alias("root")).distinct()
    return rooting.rooted(lm, "lm", "Landmark", ["type", "label"], known).select("lm", "root")


@query("SELECT lr, array_to_string(list_sort(list(relatum)), '|') AS relata FROM relation GROUP BY lr")
def a32_grouped_lists(t):
    return t("relation").groupBy("lr").agg(F.array_join(F.array_sort(F.collect_list("relatum")), "|").alias("relata"))


@query("SELECT a.lm, upper(a.label) AS label, b.labels FROM landmark a JOIN (SELECT type, count(DISTINCT label) AS labels FROM landmark GROUP BY type) b ON a.type = b.type")
def a33_merge_map_group(t):
    lm = t("landmark")
    return lm.join(lm.groupBy("type").agg(F.count_distinct("label").alias("labels")), "type").select("lm", F.upper("label").alias("label"), "labels")


# --- administration (S24-S36) -----------------------------------------------------------------------------------


@query("SELECT s, CASE WHEN p = 'hasTime' THEN 'at' ELSE p END AS p, o, g FROM quad WHERE g <> 'g2' UNION ALL SELECT s, 'marked', 'yes', g FROM quad WHERE p = 'appliedTo' AND g <> 'g2'")
def s24_updates_in_turn(t):
    drop = lambda rows: rows.where("g <> 'g2'")
    mark = lambda rows: rows.unionByName(rows.where("p = 'appliedTo'").withColumn("p", F.lit("marked")).withColumn("o", F.lit("yes")))
    rename = lambda rows: rows.withColumn("p", F.when(F.col("p") == "hasTime", "at").otherwise(F.col("p")))
    return graph.updated(t("quad").select("s", "p", "o", "g"), drop, mark, rename)


@query("SELECT s, p, o, g, true AS existed FROM quad WHERE p = 'appliedTo'")
def s25_repository(t):
    quads = t("quad").select("s", "p", "o", "g")
    repository = graph.Repository(quads.sparkSession, f"r{ids_of_run()}").create()
    repository.put(quads)
    repository.clear()
    repository.put(quads.where("p = 'appliedTo'"))
    return repository.quads().select("s", "p", "o", "g", F.lit(repository.exists()).alias("existed"))


@query("SELECT lm, CASE n % 3 WHEN 0 THEN concat('http://www.w3.org/2000/01/rdf-schema#', lm) WHEN 1 THEN concat('odd:', lm) ELSE concat('http://x/', lm) END AS iri, CASE n % 3 WHEN 0 THEN concat('rdfs:', lm) WHEN 1 THEN concat('odd:', lm) ELSE concat('http://x/', lm) END AS short FROM landmark")
def s27_prefixes(t):
    name = F.concat(F.when(F.col("n") % 3 == 0, "rdfs:").when(F.col("n") % 3 == 1, "odd:").otherwise("http://x/"), "lm")
    iri = ids.expanded(name)
    return t("landmark").select("lm", iri.alias("iri"), ids.shortened(iri).alias("short"))


@query("SELECT 'off' AS rules, s, p, o FROM quad WHERE p = 'isPartOf' UNION ALL SELECT 'on', s, p, o FROM (SELECT s, p, o FROM quad WHERE p = 'isPartOf' UNION SELECT o, 'hasPart', s FROM quad WHERE p = 'isPartOf')")
def s28_rules_on_and_off(t):
    from chronolith.operators import inference

    quads = t("quad").where("p = 'isPartOf'")
    make = quads.sparkSession.createDataFrame
    rules = {"inverses": make([("isPartOf", "hasPart")], "p string, q string"), "supers": make([], "p string, q string"), "symmetrics": [], "transitives": []}
    off, on = inference.under(quads, None), inference.under(quads, rules)
    return off.select(F.lit("off").alias("rules"), "s", "p", "o").unionByName(on.select(F.lit("on").alias("rules"), "s", "p", "o"))


@query("SELECT type, count(*) AS n, min(label) AS first FROM landmark WHERE n > 10 GROUP BY type")
def s36_sql_over_views(t):
    lm = t("landmark")
    return lm.sparkSession.sql("SELECT type, count(*) AS n, min(label) AS first FROM {lm} WHERE n > {least} GROUP BY type", lm=lm, least=10)
