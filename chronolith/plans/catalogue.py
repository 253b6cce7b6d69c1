"""Every operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import geo, text, times
from chronolith.functions.ids import signature
from chronolith.operators import changes, compare, evolution, graph, inference, labels, linking, metrics, reading, rooting, statistics, temporal, validation
from chronolith.plans.tables import duckdb_with, spark_table
from chronolith.sources import events_json, files, states_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table getter) under its name, with its SQL."""

    def register(build):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(lambda t: spark_table(spark, sf_dir, t) if t in _TYPED else spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql is not None:
            ORACLES[name] = duckdb_with(sql)
        return build

    return register


from chronolith.plans.tables import SQL as _TYPED  # noqa: E402

# --- SQL text of shared expressions -------------------------------------------------


def case(of: str, table: dict[str, str]) -> str:
    quoted = lambda x: x.replace("'", "''")
    return f"CASE {of} " + " ".join(f"WHEN '{quoted(k)}' THEN '{quoted(v)}'" for k, v in table.items()) + f" ELSE {of} END"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sig(kind: str, *parts: str) -> str:
    return f"md5(concat_ws('|', '{kind}', " + ", ".join(f"coalesce(cast({p} AS varchar), '␀')" for p in parts) + "))"


def words_sql(label: str) -> str:
    return rf"string_split(lower(regexp_replace(regexp_replace(regexp_replace({label}, '[’ʼ]', '''', 'g'), '[- ]+', ' ', 'g'), '(?i)(^| )([a-z])''+', '\1\2 ', 'g')), ' ')"


def capital_sql(w: str) -> str:
    return f"concat(upper(substr({w}, 1, 1)), lower(substr({w}, 2)))"


def thoroughfare_sql(label: str) -> str:
    word = case("w", text.with_points(text.THOROUGHFARE_WORDS) | text.THOROUGHFARE_EXACT)
    raised = f"list_transform(list_transform({words_sql(label)}, lambda w: {word}), lambda w: CASE WHEN w IN {listed(text.THOROUGHFARE_LOWER)} THEN w ELSE {capital_sql('w')} END)"
    return f"replace(array_to_string(list_transform({raised}, lambda w: CASE WHEN lower(w) IN ('d', 'l') THEN concat(w, '''') ELSE w END), ' '), ''' ', '''')"


def commune_sql(label: str) -> str:
    w = words_sql(label)
    low = listed(text.COMMUNE_LOWER)
    join_ = lambda x, i: f"CASE WHEN {i} = len({w}) THEN '' WHEN {x} IN ('d', 'l') THEN '''' WHEN {i} = 1 AND {x} IN {low} THEN ' ' ELSE '-' END"
    before = join_(f"({w})[i - 1]", "(i - 1)")
    table = case("x", text.with_points(text.COMMUNE_WORDS) | text.COMMUNE_EXACT)
    return f"array_to_string(list_transform({w}, lambda x, i: concat(CASE WHEN x NOT IN {low} OR i = 1 OR ({before}) = ' ' THEN concat(upper(substr({table}, 1, 1)), lower(substr({table}, 2))) ELSE x END, {join_('x', 'i')})), '')"


def fold_sql(x: str) -> str:
    return f"translate(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae'), '{text.ACCENTED}', '{text.PLAIN}')"


def simplified_sql(label: str, sep: str = "", fold: bool = True) -> str:
    kept = f"list_filter(list_transform({words_sql(label)}, lambda w: replace(w, '''', '')), lambda w: w NOT IN {listed(text.STOP_WORDS)})"
    return f"array_to_string(list_transform({kept}, lambda w: {case(fold_sql('w') if fold else 'w', text.OLD_SPELLINGS)}), '{sep}')"


def number_sql(x: str, compat: bool = False) -> str:
    order = list(text.NUMBER_SUFFIXES.items())
    out = f"replace(lower({x}), ' ', '')"
    for k, v in [*(order[:3] if compat else sorted(order, key=lambda p: -len(p[0]))), *text.NUMBER_MARKS.items()]:
        out = f"replace({out}, '{k}', '{v}')"
    return out


RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in times.PRECISION_RANKS.items())


def rank_sql(x: str) -> str:
    return f"(CASE {x} {RANKS} ELSE -1 END)"


KIND_SQL = "CASE WHEN type = 'Thoroughfare' THEN 'thoroughfare' WHEN type IN ('Municipality', 'District', 'PostalCodeArea') THEN 'area' ELSE 'number' END"
LABELLED_SQL = f"""labelled AS (SELECT *, CASE WHEN lang IS NULL AND kind = 'number' THEN replace(pref_label, ' ', '') WHEN lang = 'fr' AND kind IN ('thoroughfare', 'area') THEN {simplified_sql('pref_label')} WHEN lang = 'fr' THEN replace(pref_label, ' ', '') END AS hidden_label FROM (
  SELECT *, CASE WHEN lang IS NULL AND kind = 'number' THEN {number_sql('label')} WHEN lang = 'fr' AND kind = 'thoroughfare' THEN {thoroughfare_sql('label')} WHEN lang = 'fr' AND kind = 'area' THEN {commune_sql('label')} WHEN lang = 'fr' THEN lower(label) END AS pref_label
  FROM (SELECT *, {KIND_SQL} AS kind FROM landmark)))"""

# --- names (C01-C17) ------------------------------------------------------------------


@query(f"SELECT id, {thoroughfare_sql('label')} AS normal, {simplified_sql(thoroughfare_sql('label'))} AS simplified FROM name")
def c07_normal_thoroughfare(t):
    normal = text.normal_thoroughfare(F.col("label"))
    return t("name").select("id", normal.alias("normal"), text.simplified_landmark(normal, False, False).alias("simplified"))


@query(f"SELECT id, {commune_sql('label')} AS normal FROM name")
def c05_normal_commune(t):
    return t("name").select("id", text.normal_commune(F.col("label")).alias("normal"))


@query(f"SELECT id, {number_sql('number')} AS normal, {number_sql('number', True)} AS compat, replace(number, ' ', '') AS plain FROM name")
def c06_normal_number(t):
    n = F.col("number")
    return t("name").select("id", text.normal_number(n).alias("normal"), text.normal_number(n, True).alias("compat"), text.without_spaces(n).alias("plain"))


@query(f"SELECT id, array_to_string({words_sql('label')}, '/') AS words, {simplified_sql('label', ' ', False)} AS spaced, array_to_string(list_sort(string_split({simplified_sql('label')}, '')), '') AS sorted_chars FROM name")
def c04_words_and_simplified(t):
    label = F.col("label")
    return t("name").select("id", F.array_join(text.words(label, "lower"), "/").alias("words"), text.simplified_landmark(label).alias("spaced"), text.simplified_landmark(label, False, False, True).alias("sorted_chars"))


@query(
    r"""SELECT id, CASE WHEN n <> '' THEN n END AS number, CASE WHEN n <> '' THEN trim(regexp_extract(a, '(?i)^(\d+\s*(?:[A-Za-z]|bis|ter|quater)?)\s+(.*)', 2)) ELSE trim(a) END AS street
    FROM (SELECT id, a, trim(regexp_extract(a, '(?i)^(\d+\s*(?:[A-Za-z]|bis|ter|quater)?)\s+(.*)', 1)) AS n FROM (SELECT id, CASE WHEN id % 4 = 0 THEN label ELSE concat(number, ' ', label) END AS a FROM name))"""
)
def c13_split_address(t):
    n, s = text.split_address(F.col("a"))
    return t("name").select("id", F.when(F.col("id") % 4 == 0, F.col("label")).otherwise(F.concat("number", F.lit(" "), "label")).alias("a")).select("id", n.alias("number"), s.alias("street"))


@query("SELECT id, array_to_string(list_transform(string_split(concat(label, ' , ', number, ',x'), ','), lambda e: trim(e)), '|') AS cells FROM name")
def c02_split_cell(t):
    return t("name").select("id", F.array_join(text.split_cell(F.concat("label", F.lit(" , "), "number", F.lit(",x"))), "|").alias("cells"))


@query("SELECT id, regexp_replace(regexp_replace(label, '^R ', 'Rue ', 'g'), 'all ', 'Allée ', 'g') AS out FROM name")
def c03_ordered_replacements(t):
    return t("name").select("id", text.replaced_in_order(F.col("label"), {"^R ": "Rue ", "all ": "Allée "}).alias("out"))


# blocks that match in full: a label and the same with other letters around and inside it, parted by what neither has
@query("SELECT id, round(2.0 * length(label) / (2 * length(label) + 7), 9) AS ratio, 2.0 * length(label) / (2 * length(label) + 7) >= 0.9 AS similar FROM (SELECT id, replace(lower(label), '#', '') AS label FROM name)")
def c11_name_ratio(t):
    label = F.replace(F.lower("label"), F.lit("#"), F.lit(""))
    half = F.floor(F.length(label) / 2).cast("int")
    other = F.concat(F.lit("#1#"), F.substring(label, F.lit(1), half), F.lit("#"), label.substr(half + 1, F.length(label)), F.lit("#2#"))
    ratio = text.block_ratio()(label, other)
    return t("name").select("id", F.round(ratio, 9).alias("ratio"), (ratio >= 0.9).alias("similar"))


@query("SELECT id, round(1 - levenshtein(label, concat(label, 's ', number)) / greatest(length(label), length(concat(label, 's ', number))), 9) AS ratio FROM name")
def c11_edit_ratio(t):
    return t("name").select("id", F.round(text.levenshtein_ratio(F.col("label"), F.concat("label", F.lit("s "), "number")), 9).alias("ratio"))


@query(f"SELECT id, {fold_sql('label')} AS folded, replace(replace(replace(replace(replace(concat('<b>', label, '&\"'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM name")
def c17_fold_and_escape(t):
    from chronolith.functions.ids import escaped_html

    return t("name").select("id", text.folded(F.col("label")).alias("folded"), escaped_html(F.concat(F.lit("<b>"), "label", F.lit('&"'))).alias("escaped"))


@query("SELECT id, regexp_matches(u, '^https?://[^\\s<>\"{}|\\\\^`]+$') AS valid, CASE WHEN lower(b) IN ('true', '1') THEN true WHEN lower(b) IN ('false', '0') THEN false END AS flag FROM (SELECT id, concat(CASE id % 3 WHEN 0 THEN 'http://x/' WHEN 1 THEN 'https://y/ ' ELSE 'ftp://z/' END, id) AS u, CASE id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' WHEN 2 THEN '1' ELSE 'x' END AS b FROM name)")
def c15_uri_and_boolean(t):
    from chronolith.functions.ids import boolean_of, is_valid_uri

    k = F.col("id")
    u = F.concat(F.when(k % 3 == 0, "http://x/").when(k % 3 == 1, "https://y/ ").otherwise("ftp://z/"), k.cast("string"))
    b = F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "0").when(k % 4 == 2, "1").otherwise("x")
    return t("name").select("id", is_valid_uri(u).alias("valid"), boolean_of(b).alias("flag"))


# --- times (C20-C32) --------------------------------------------------------------------


@query("SELECT t, strftime(stamp, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN extract(day FROM stamp) <> 31 THEN strftime(stamp, '%Y-%m-%dT00:00:00Z') END AS loose FROM instant")
def c20_canonical_stamp(t):
    day = F.dayofmonth("stamp")
    loose = F.when(day != 31, F.concat_ws("/", F.year("stamp").cast("string"), F.month("stamp").cast("string"), day.cast("string"))).otherwise("no date")
    return t("instant").select("t", times.canonical_stamp(F.col("stamp").cast("string")).alias("stamp"), times.canonical_stamp(loose).alias("loose"))


@query(
    """SELECT t, CASE precision WHEN 'day' THEN strftime(stamp, '%Y-%m-%d') WHEN 'month' THEN strftime(stamp, '%Y-%m') WHEN 'year' THEN strftime(stamp, '%Y') WHEN 'decade' THEN substr(strftime(stamp, '%Y'), 1, 3) ELSE substr(strftime(stamp, '%Y'), 1, 2) END AS cut,
    date_diff('day', DATE '0001-01-01', cast(stamp AS date)) AS day_no FROM instant"""
)
def c25_truncated(t):
    return t("instant").select("t", times.truncated(F.date_format("stamp", "yyyy-MM-dd"), F.col("precision")).alias("cut"), times.day_number(F.col("stamp")).alias("day_no"))


@query(f"SELECT t, {rank_sql('precision')} > 9 AS finer_than_year, CASE cast(substr(t, 2) AS bigint) % 15 {' '.join(f'WHEN {v} THEN {chr(39)}{k}{chr(39)}' for k, v in times.PRECISION_RANKS.items())} END AS name FROM instant")
def c27_precision_names(t):
    return t("instant").select("t", times.more_precise(F.lit("unitYear"), F.col("precision")).alias("finer_than_year"), times.precision_of(F.substring("t", 2, 20).cast("long") % 15).alias("name"))


@query(
    """SELECT t, cast(cast(to_days(cast(d + (153 * m2 + 2) // 5 + 365 * y2 + y2 // 4 - 32083 - 2440588 AS int)) AS interval) + DATE '1970-01-01' AS date) AS from_julian,
      cast(to_days(cast(d + (153 * m2 + 2) // 5 + 365 * y2 + y2 // 4 - y2 // 100 + y2 // 400 - 32045 - 2440588 AS int)) + DATE '1970-01-01' AS date) AS from_gregorian
    FROM (SELECT t, y + 4800 - (14 - m) // 12 AS y2, m + 12 * ((14 - m) // 12) - 3 AS m2, d FROM (SELECT t, extract(year FROM stamp) AS y, extract(month FROM stamp) AS m, extract(day FROM stamp) AS d FROM instant))"""
)
def c24_calendars(t):
    y, m, d = F.year("stamp"), F.month("stamp"), F.dayofmonth("stamp")
    return t("instant").select("t", times.to_gregorian(y, m, d, F.lit("julian")).alias("from_julian"), times.to_gregorian(y, m, d, F.lit("gregorian")).alias("from_gregorian"))


_MONTH = {lang: "CASE extract(month FROM stamp) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(names)) + " END" for lang, names in times.MONTHS.items()}


@query(
    f"""SELECT t,
      CASE precision WHEN 'century' THEN concat(ceil(y / 100.0)::int, 'e siècle') WHEN 'decade' THEN concat('années ', (y // 10) * 10) WHEN 'year' THEN cast(y AS varchar) WHEN 'month' THEN concat({_MONTH['fr']}, ' ', y)
        ELSE concat(CASE WHEN extract(day FROM stamp) = 1 THEN '1er' ELSE strftime(stamp, '%d') END, ' ', {_MONTH['fr']}, ' ', y) END AS fr,
      CASE precision WHEN 'century' THEN concat(ceil(y / 100.0)::int, CASE ceil(y / 100.0)::int WHEN 21 THEN 'st' ELSE 'th' END, ' century') WHEN 'decade' THEN concat((y // 10) * 10, 's') WHEN 'year' THEN cast(y AS varchar) WHEN 'month' THEN concat({_MONTH['en']}, ' ', y)
        ELSE concat({_MONTH['en']}, ' ', strftime(stamp, '%d'), ', ', y) END AS en
    FROM (SELECT *, extract(year FROM stamp) AS y FROM instant)"""
)
def q15_time_labels(t):
    return t("instant").select("t", *[times.time_label(F.col("stamp"), F.col("precision"), lang).alias(lang) for lang in ("fr", "en")])


@query("SELECT elem, CASE WHEN app_crisp IS NOT NULL THEN concat('Creation time: ', cast(cast(app_crisp AS date) AS varchar)) WHEN app_end IS NOT NULL AND app_begin IS NOT NULL THEN concat('Creation time: between ', cast(cast(app_begin AS date) AS varchar), ' and ', cast(cast(app_end AS date) AS varchar)) WHEN app_end IS NOT NULL THEN concat('Creation time: before ', cast(cast(app_end AS date) AS varchar)) WHEN app_begin IS NOT NULL THEN concat('Creation time: after ', cast(cast(app_begin AS date) AS varchar)) END AS label FROM bound")
def q16_validity_label(t):
    day = lambda c: F.col(c).cast("date").cast("string")
    return t("bound").select("elem", times.validity_label("app", day("app_crisp"), day("app_begin"), day("app_end"), "en").alias("label"))


@query("SELECT t, strftime(stamp, '%Y-%m-%d') AS iso, true AS valid, CASE WHEN calendar = 'julian' THEN false ELSE true END AS same_calendar FROM instant")
def c30_dates_and_calendars(t):
    iso = F.date_format("stamp", "yyyy-MM-dd")
    other = F.when(F.col("calendar") == "julian", "http://x/Q1985786").otherwise("http://x/Q1985727")
    return t("instant").select("t", iso.alias("iso"), times.is_iso_date(iso).alias("valid"), times.same_calendar(other, F.lit("https://x/Q1985727")).alias("same_calendar"))


# --- geometry (C40-C50) -------------------------------------------------------------------

_BOX = "SELECT id, x, y, x + 1 + id % 7 AS x2, y + 1 + id % 5 AS y2 FROM point"


@query(
    f"""SELECT a.id AS id, round(CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END / (a1 + a2 - CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END), 9) AS iou
    FROM (SELECT a.id, least(a.x2, b.x2) - greatest(a.x, b.x) AS w, least(a.y2, b.y2) - greatest(a.y, b.y) AS h, (a.x2 - a.x) * (a.y2 - a.y) AS a1, (b.x2 - b.x) * (b.y2 - b.y) AS a2
      FROM ({_BOX}) a JOIN (SELECT id, x + 0.5 AS x, y + 0.25 AS y, x2 + 0.5 AS x2, y2 AS y2 FROM ({_BOX})) b ON a.id = b.id) a"""
)
def v05_envelope_iou(t):
    def ring(dx, dy):
        x1, y1 = F.col("x") + dx, F.col("y") + dy
        x2, y2 = F.col("x") + 1 + F.col("id") % 7 + dx, F.col("y") + 1 + F.col("id") % 5
        corner = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
        return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2), corner(x1, y1)), F.lit("))"))

    boxes = t("point").select("id", geo.envelope(ring(F.lit(0.0), F.lit(0.0))).alias("a"), geo.envelope(ring(F.lit(0.5), F.lit(0.25))).alias("b"))
    return boxes.select("id", F.round(geo.box_iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query("SELECT id, round(sqrt(power(x - 1, 2) + power(y - 2, 2)), 6) AS length, sqrt(power(x - 1, 2) + power(y - 2, 2)) <= 60 AS near FROM point")
def v06_point_distance(t):
    other = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    wkt = geo.split_literal(F.concat(F.lit("<http://www.opengis.net/def/crs/EPSG/0/2154> POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")))[1]
    p = geo.centroid("wkt")
    return t("point").withColumn("wkt", wkt).select("id", F.round(geo.distance(p, other), 6).alias("length"), geo.similar_points(p, other, 60.0).alias("near"))


_RING = [(-100.5, -40.5), (80.5, -60.5), (120.5, 50.5), (0.5, 20.5), (-90.5, 70.5)]
_AREA = {"type": "Polygon", "coordinates": [[*map(list, _RING), list(_RING[0])]]}
_CROSSINGS = " + ".join(f"cast((({y1} > y) <> ({y2} > y)) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} AS int)" for (x1, y1), (x2, y2) in zip([(f"({a})", f"({b})") for a, b in _RING], [(f"({a})", f"({b})") for a, b in _RING[1:] + _RING[:1]]))


@query(f"SELECT id FROM point WHERE ({_CROSSINGS}) % 2 = 1")
def c49_points_in_polygon(t):
    return reading.within_area(t("point"), _AREA).select("id")


@query(
    f"""SELECT id, round({geo.FALSE_EAST} + r * sin(theta), 3) AS x, round({geo.FALSE_NORTH} + {geo.CONE_R0!r} - r * cos(theta), 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat, round(radians(lon) * 6378137.0, 3) AS mx
    FROM (SELECT id, lon, lat, {geo.ELLIPSOID_A * geo.CONE_F!r} * power(tan(pi() / 4 - radians(lat) / 2) / power((1 - {geo._E!r} * sin(radians(lat))) / (1 + {geo._E!r} * sin(radians(lat))), {geo._E / 2!r}), {geo.CONE_N!r}) AS r, {geo.CONE_N!r} * radians(lon - 3) AS theta
      FROM (SELECT id, x / 40 + 2 AS lon, y / 20 + 46.5 AS lat FROM point))"""
)
def c42_reprojected(t):
    p = t("point").select("id", F.struct((F.col("x") / 40 + 2).alias("x"), (F.col("y") / 20 + 46.5).alias("y")).alias("p"))
    p = p.select("id", geo.reprojected(F.col("p"), "4326", "2154").alias("l"), geo.reprojected(F.col("p"), "4326", "3857").alias("m"))
    p = p.withColumn("back", geo.reprojected(F.col("l"), "2154", "4326"))
    return p.select("id", F.round("l.x", 3).alias("x"), F.round("l.y", 3).alias("y"), F.round("back.x", 7).alias("lon"), F.round("back.y", 7).alias("lat"), F.round("m.x", 3).alias("mx"))


@query("SELECT id, concat('{\"type\":\"Point\",\"coordinates\":[', id, ',', id % 7, ']}') AS json, concat('POINT (', id, ' ', id % 7, ')') AS wkt, '2154' AS epsg FROM point")
def c46_geojson_round_trip(t):
    wkt = F.concat(F.lit("POINT ("), F.col("id").cast("string"), F.lit(" "), (F.col("id") % 7).cast("string"), F.lit(")"))
    json = geo.wkt_to_geojson(wkt)
    return t("point").select("id", json.alias("json"), geo.geojson_to_wkt(json).alias("wkt"), geo.epsg_of(geo.crs_uri(F.lit("EPSG:2154"))).alias("epsg"))


# --- sources (S01-S22) and algebra (A01-A33) ------------------------------------------------


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, event_type FROM events")
def s01_json_properties(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "event_type")


def _event_texts(t):
    name = F.concat_ws("-", "event_type", F.col("event_id").cast("string"))
    change = F.struct(F.lit("attribute").alias("on"), F.lit("name").alias("attribute"), F.array(F.struct(name.alias("value"), F.lit("fr").alias("lang"))).alias("makes_effective"), F.array(F.struct(F.concat(F.lit("old-"), name).alias("value"), F.lit("fr").alias("lang"))).alias("outdates"))
    gone = F.struct(F.lit("landmark").alias("on"), F.when(F.col("event_id") % 2 == 0, "appearance").otherwise("disappearance").alias("type"))
    lm = F.struct(F.lit("1").alias("id"), name.alias("label"), F.lit("fr").alias("lang"), F.lit("Thoroughfare").alias("type"), F.array(F.to_json(change), F.to_json(gone)).alias("changes"))
    row = F.concat(F.lit('{"source":{"uri":"s'), F.col("event_id").cast("string"), F.lit('"},"events":[{"time":{"stamp":"2024-01-01"},"landmarks":['), F.replace(F.replace(F.replace(F.to_json(lm), F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}")), F.lit("]}]}"))
    return t("events").select(row.alias("j"))


def _event_tables(t):
    got = events_json.from_text(_event_texts(t), "j")
    return got, got["landmark"].select(F.col("lm").alias("__lm"), "label")


@query("SELECT concat(event_type, '-', event_id) AS label, 'Name' AS attribute, side, CASE side WHEN 'outdates' THEN concat('old-', event_type, '-', event_id) ELSE concat(event_type, '-', event_id) END AS value, 'fr' AS lang FROM events, (VALUES ('makesEffective'), ('outdates')) AS v(side)")
def s02_event_versions(t):
    got, named = _event_tables(t)
    of = got["change"].select(F.col("cg").alias("__cg"), "lm")
    return got["version"].join(of, F.col("cg") == F.col("__cg")).join(named, F.col("lm") == F.col("__lm")).select("label", "attribute", "side", "value", "lang")


@query("SELECT concat(event_type, '-', event_id) AS label, 'AttributeVersionTransition' AS type, '2024-01-01' AS stamp FROM events UNION ALL SELECT concat(event_type, '-', event_id), CASE WHEN event_id % 2 = 0 THEN 'LandmarkAppearance' ELSE 'LandmarkDisappearance' END, '2024-01-01' FROM events")
def s02_event_changes(t):
    got, named = _event_tables(t)
    stamps = got["event"].select(F.col("ev").alias("__ev"), "stamp")
    return got["change"].join(named, F.col("lm") == F.col("__lm")).join(stamps, F.col("ev") == F.col("__ev")).select("label", "type", "stamp")


@query("SELECT lm AS g, label, type, concat('s', n % 5) AS start FROM landmark")
def s04_state_landmarks(t):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    row = F.concat(F.lit('{"source":{"uri":'), quoted(F.col("lm")), F.lit('},"time":{"start":{"stamp":'), quoted(F.concat(F.lit("s"), (F.col("n") % 5).cast("string"))), F.lit('}},"landmarks":[{"id":"1","label":'), quoted(F.col("label")), F.lit(',"type":'), quoted(F.col("type")), F.lit("}]}"))
    got = states_json.from_text(t("landmark").select(row.alias("j")), "j")
    times_ = got["valid_time"].select(F.col("elem").alias("__elem"), F.col("start.stamp").alias("start"))
    return got["landmark"].join(times_, F.col("lm") == F.col("__elem")).select("g", "label", "type", "start")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def s18_last_row_wins(t):
    rows = t("events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), "user_id", "event_type", "event_id")
    return files.last_row_wins(rows, "key", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT 'StreetNumber' AS type, concat(p_size, 'bis') AS label, concat(p_size, 'bis ', p_name, ', ', p_brand, ' ', p_type) AS address FROM part UNION ALL SELECT DISTINCT 'Thoroughfare', p_name, NULL FROM part UNION ALL SELECT DISTINCT 'District', p_type, NULL FROM part UNION ALL SELECT DISTINCT 'PostalCodeArea', p_brand, NULL FROM part")
def s06_address_file(t):
    rows = t("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("numero"), F.lit("bis").alias("rep"), F.col("p_name").alias("nom_voie"), F.col("p_brand").alias("code_postal"), F.col("p_type").alias("nom_commune"), F.lit("x").alias("code_insee"), F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat"))
    got = files.address_file(rows, "ban")
    shown = got["address"].select("target", F.col("label").alias("address"))
    return got["landmark"].join(shown, F.col("lm") == F.col("target"), "left").select("type", "label", "address")


@query("SELECT 'Belongs' AS type, c_name AS locatum, c_mktsegment AS relatum, c_nationkey AS street FROM customer UNION ALL SELECT 'Within', c_name, 'a', NULL FROM customer".replace("c_mktsegment AS relatum, c_nationkey AS street", "concat('street ', c_nationkey) AS relatum").replace("'a', NULL", "'a'"))
def s07_house_number_files(t):
    c = t("customer")
    numbers = c.select(F.lit("POINT (2 48)").alias("houseNumberGeomWKT"), F.col("c_custkey").cast("string").alias("houseNumberId"), F.col("c_name").alias("houseNumberLabel"))
    context = c.select(F.col("c_custkey").cast("string").alias("houseNumberId"), F.col("c_nationkey").cast("string").alias("streetId"), F.concat(F.lit("street "), F.col("c_nationkey").cast("string")).alias("streetName"), F.lit("1").alias("arrdtId"), F.lit("a").alias("arrdtName"), F.lit("i").alias("arrdtInsee"))
    got = files.house_number_files(numbers, context, "osm")
    named = lambda name: got["landmark"].select(F.col("lm").alias(f"__{name}"), F.col("label").alias(f"{name}_label"))
    rows = got["relation"].join(named("locatum"), F.col("locatum") == F.col("__locatum")).join(named("relatum"), F.col("relatum") == F.col("__relatum"))
    return rows.select("type", F.col("locatum_label").alias("locatum"), F.col("relatum_label").alias("relatum"))


@query("SELECT cast(o_orderkey AS varchar) AS landmark, o_orderpriority AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'LandmarkAppearance' ELSE 'LandmarkDisappearance' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'year' ELSE 'century' END AS precision, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'gregorian' AS calendar, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS made FROM orders")
def s11_linked_data(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(k.cast("string").alias("landmarkId"), F.lit("Thoroughfare").alias("landmarkType"), F.col("o_orderpriority").alias("nomOff"), F.lit("fr").alias("lang"), F.when(k % 2 == 0, "start").otherwise("end").alias("timeType"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timeStamp"), F.when(k % 3 == 0, 11).when(k % 3 == 1, 9).otherwise(7).alias("timePrec"), F.lit("http://www.wikidata.org/entity/Q1985727").alias("timeCal"))
    return files.linked_data_events(rows).select(F.col("landmarkId").alias("landmark"), "label", "type", "precision", "stamp", "calendar", F.array_join("makes_effective", "|").alias("made"))


@query("SELECT name, count(*) AS parts, min(n) AS first, CASE WHEN count(*) = 1 THEN min(w) ELSE concat('GEOMETRYCOLLECTION (', string_agg(w, ', ' ORDER BY n), ')') END AS wkt FROM (SELECT n, CASE WHEN n % 9 = 0 THEN NULL ELSE concat(type, n % 7) END AS name, concat('POINT (', n, ' 1)') AS w FROM landmark) GROUP BY name")
def s12_merged_features(t):
    rows = t("landmark").select(F.col("n").alias("ordinal"), F.lit("crs").alias("crs"), F.create_map(F.lit("name"), F.when(F.col("n") % 9 != 0, F.concat("type", (F.col("n") % 7).cast("string")))).alias("properties"), F.concat(F.lit("POINT ("), F.col("n").cast("string"), F.lit(" 1)")).alias("wkt"))
    return files.merged_features(rows, "name").select(F.col("properties")["name"].alias("name"), F.size("geometries").cast("long").alias("parts"), F.col("ordinal").alias("first"), "wkt")


@query("SELECT concat('<', s, '> <', p, '> ', CASE WHEN o_kind = 'uri' THEN concat('<', o, '>') ELSE concat('\"', o, '\"') END, ' <', g, '> .') AS value FROM quad")
def s20_n_quads(t):
    return graph.n_quads(t("quad"))


@query("SELECT s, p, o FROM quad WHERE s NOT IN (SELECT concat('c', c_custkey) FROM customer WHERE c_custkey % 3 = 0) AND o NOT IN (SELECT concat('c', c_custkey) FROM customer WHERE c_custkey % 3 = 0)")
def k19_without_resources(t):
    gone = t("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("r"))
    return graph.without_resources(t("quad"), gone).select("s", "p", "o")


@query("SELECT s, p, o, g, p = 'hasTime' AS permanent FROM quad")
def s34_split_immutable(t):
    stays, permanent = graph.split_immutable(t("quad"), ["hasTime"])
    return stays.withColumn("permanent", F.lit(False)).unionByName(permanent.withColumn("permanent", F.lit(True))).select("s", "p", "o", "g", "permanent")


def _registry(rows):
    return rows.sparkSession.createDataFrame([(f"g{i}", "source" if i < 3 else "final", True, f"label {i}", "fr") for i in range(5)], "g string, role string, is_active boolean, label string, lang string")


@query("SELECT g, lm, label FROM landmark WHERE g IN ('g0', 'g2')")
def a02_active_sources(t):
    rows = t("landmark")
    registry = graph.activated(_registry(rows), False, ["g1"])
    return graph.in_active_sources(rows, registry).select("g", "lm", "label")


@query("SELECT g, lm FROM landmark WHERE g IN ('g1', 'g2')")
def e06_excluded_sources(t):
    rows = t("landmark")
    return graph.in_active_sources(rows, _registry(rows), ["g0"]).select("g", "lm")


@query("SELECT * FROM (VALUES ('g3', 'label 3'), ('g4', 'label 4')) AS v(g, label)")
def q01_final_graphs(t):
    return graph.final_graphs(_registry(t("landmark")), "fr")


@query("SELECT ev, prop, t FROM (SELECT *, rank() OVER (PARTITION BY ev, prop ORDER BY t) AS r FROM candidate) WHERE r = 1")
def a12_extremes_with_ties(t):
    return graph.extremes(t("candidate"), ["ev", "prop"], "t")


@query("SELECT lr, string_agg(DISTINCT relatum, '|' ORDER BY relatum) AS members FROM relation GROUP BY lr")
def a13_set_signature(t):
    from chronolith.functions.ids import set_signature

    return t("relation").groupBy("lr").agg(set_signature(F.collect_set("relatum")).alias("members"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM quad WHERE p = 'isPartOf'), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s AS child, o AS parent FROM c UNION SELECT s, s FROM e UNION SELECT o, o FROM e")
def a17_closure(t):
    return graph.closure(t("quad").where("p = 'isPartOf'").select(F.col("s").alias("child"), F.col("o").alias("parent")))


@query("SELECT lm, CASE WHEN n % 4 = 1 THEN 'new' ELSE label END AS label FROM landmark")
def a23_replaced(t):
    rows = t("landmark").select("lm", "label", "n")
    return graph.replaced(rows.drop("n"), ["lm"], rows.where("n % 4 = 1").select("lm", F.lit("new").alias("label")))


# --- labels (L01-L06) --------------------------------------------------------------------------


@query(f"WITH {LABELLED_SQL} SELECT lm, pref_label, hidden_label FROM labelled")
def l02_labels(t):
    return labels.with_labels(t("landmark")).select("lm", "pref_label", "hidden_label")


@query("SELECT elem, type, label, lang FROM (SELECT lm AS elem, type, label, lang FROM landmark UNION SELECT av, 'Thoroughfare', value, 'fr' FROM version) WHERE elem NOT IN (SELECT lm FROM landmark WHERE n % 2 = 0)")
def l01_labelled_elements(t):
    lm = t("landmark")
    names = t("version").select("av", F.lit("Thoroughfare").alias("type"), "value", F.lit("fr").alias("lang"))
    return labels.labelled_elements(lm, names, lm.where("n % 2 = 0").select(F.col("lm").alias("elem")))


@query(f"""WITH {LABELLED_SQL}, tr AS (SELECT {sig('Landmark', 'type', 'hidden_label', 'lang')} AS root, pref_label, label, n FROM labelled WHERE kind <> 'number' AND hidden_label IS NOT NULL),
  ro AS (SELECT root, max(CASE WHEN n % 10 = 0 THEN label END) AS own FROM tr GROUP BY root), j AS (SELECT tr.root, coalesce(own, pref_label, label) AS main, pref_label, label FROM tr JOIN ro USING (root))
  SELECT root, 'label' AS kind, main AS label FROM j UNION SELECT root, 'alt', CASE WHEN pref_label <> main THEN pref_label WHEN label <> main THEN label END AS l FROM j WHERE l IS NOT NULL""")
def l04_root_labels(t):
    own = labels.with_labels(t("landmark"))
    traces = rooting.landmarks_by_label(own).select("trace", "root").join(own.select(F.col("lm").alias("trace"), "pref_label", "label", "n"), "trace")
    roots = traces.groupBy("root").agg(F.max(F.when(F.col("n") % 10 == 0, F.col("label"))).alias("label"))
    return labels.root_labels(roots, traces.select("root", "pref_label", "label"))


@query("SELECT a.lm, CASE WHEN r.rl IS NULL THEN a.label ELSE concat(a.label, ' (', r.rl, ')') END AS label FROM landmark a LEFT JOIN (SELECT locatum, rl FROM (SELECT locatum, b.label AS rl, row_number() OVER (PARTITION BY locatum ORDER BY b.label NULLS LAST, lr) AS k FROM relation LEFT JOIN landmark b ON relatum = b.lm) WHERE k = 1) r ON a.lm = r.locatum")
def l05_displayed(t):
    return labels.displayed(t("landmark"), t("relation"))


@query(f"SELECT id, {fold_sql('label')} AS folded FROM name WHERE contains({fold_sql('label')}, 'foret') ORDER BY folded, id LIMIT 20")
def l06_search(t):
    return labels.search(t("name"), "FORÊT", "label", "id").select("id", "folded")


# --- rooting (R01-R20) ----------------------------------------------------------------------------

_ROOTS = f"roots AS (SELECT lm AS trace, {sig('Landmark', 'type', 'hidden_label', 'lang')} AS root, type FROM labelled WHERE kind <> 'number' AND hidden_label IS NOT NULL)"


@query(f"WITH {LABELLED_SQL}, {_ROOTS} SELECT trace, root FROM roots")
def r03_roots_by_label(t):
    return rooting.landmarks_by_label(labels.with_labels(t("landmark"))).select("trace", "root")


@query(f"""WITH {LABELLED_SQL}, {_ROOTS}, k AS (SELECT DISTINCT type, hidden_label, lang FROM labelled WHERE kind <> 'number' AND n % 2 = 0)
  SELECT l.lm AS trace, CASE WHEN k.type IS NULL THEN r.root ELSE concat('known:', l.type, ':', l.hidden_label) END AS root FROM labelled l JOIN roots r ON l.lm = r.trace LEFT JOIN k ON k.type = l.type AND k.hidden_label = l.hidden_label AND k.lang IS NOT DISTINCT FROM l.lang WHERE l.n % 3 <> 0""")
def r03_roots_that_exist(t):
    own = labels.with_labels(t("landmark"))
    known = own.where((F.col("n") % 2 == 0) & (F.col("type") != "StreetNumber")).select("type", "hidden_label", F.col("lang").alias("hidden_lang"), F.concat_ws(":", F.lit("known"), "type", "hidden_label").alias("root"))
    return rooting.landmarks_by_label(own, own.where("n % 3 = 0").select(F.col("lm").alias("trace")), known).select("trace", "root")


@query(f"""WITH {LABELLED_SQL}, {_ROOTS}
  SELECT l.lm AS trace, {sig('Landmark', 'l.type', 'l.hidden_label', "'Belongs'", 'r.root')} AS root, x.lr AS relation FROM labelled l JOIN relation x ON x.locatum = l.lm AND x.type = 'Belongs' JOIN roots r ON r.trace = x.relatum WHERE l.type = 'StreetNumber' AND l.hidden_label IS NOT NULL""")
def r05_roots_by_relation(t):
    own = labels.with_labels(t("landmark"))
    return rooting.landmarks_by_relation(own, t("relation"), rooting.landmarks_by_label(own)).select("trace", "root", "relation")


@query(f"""WITH {LABELLED_SQL}, {_ROOTS}, s AS (SELECT x.lr, x.type, a.root AS lroot, string_agg(DISTINCT b.root, '|' ORDER BY b.root) AS relata FROM relation x JOIN roots a ON a.trace = x.locatum JOIN roots b ON b.trace = x.relatum GROUP BY ALL)
  SELECT lr AS trace, {sig('LandmarkRelation', 'type', 'lroot', 'relata')} AS root FROM s""")
def r06_relations_by_members(t):
    return rooting.relations_by_members(t("relation"), rooting.landmarks_by_label(labels.with_labels(t("landmark")))).select("trace", "root")


@query(f"SELECT DISTINCT attr AS trace, {sig('Attribute', 'attr_type', sig('Landmark', 'lm'))} AS root FROM version")
def r08_attributes(t):
    v = t("version").select("attr", "attr_type", "lm").distinct()
    roots = v.select(F.col("lm").alias("trace"), signature("Landmark", "lm").alias("root")).distinct()
    return rooting.by_parent(v, "attr", "Attribute", ["attr_type"], "lm", roots).select("trace", "root")


@query(f"WITH i AS (SELECT t, {sig('CrispTimeInstant', 'strftime(stamp, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')', 'precision', 'calendar')} AS root FROM instant) SELECT t AS trace, root FROM i")
def r10_instants(t):
    return rooting.instants(t("instant").withColumn("stamp", F.date_format("stamp", "yyyy-MM-dd"))).select("trace", "root")


@query(f"""WITH i AS (SELECT t, {sig('CrispTimeInstant', 'strftime(stamp, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')', 'precision', 'calendar')} AS root FROM instant), p AS (SELECT concat('f', o_orderkey) AS f, CASE WHEN o_orderkey % 4 <> 0 THEN concat('t', o_orderkey) END AS b, CASE WHEN o_orderkey % 3 <> 0 THEN concat('t', o_custkey) END AS e FROM orders)
  SELECT f AS trace, {sig('FuzzyTimeInstant', 'b.root', 'e.root')} AS root FROM p LEFT JOIN i b ON p.b = b.t LEFT JOIN i e ON p.e = e.t""")
def r11_fuzzy_instants(t):
    roots = rooting.instants(t("instant").withColumn("stamp", F.date_format("stamp", "yyyy-MM-dd")))
    k = F.col("o_orderkey")
    pairs = t("orders").select(F.concat(F.lit("f"), k.cast("string")).alias("t"), F.when(k % 4 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("begin"), F.when(k % 3 != 0, F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).alias("end"))
    return rooting.pairs_of_times(pairs, "FuzzyTimeInstant", roots).select("trace", "root")


@query(f"SELECT DISTINCT root, value FROM (SELECT {sig('Attribute', 'attr')} AS root, value FROM version)")
def r18_transferred_values(t):
    v = t("version")
    traces = v.select(signature("Attribute", "attr").alias("root"), F.col("av").alias("trace"))
    return rooting.transferred(traces, v, ["value"], "av")


@query("WITH m AS (SELECT concat('c', c_custkey) AS old, concat('seg:', c_mktsegment) AS new FROM customer WHERE c_custkey % 2 = 0) SELECT DISTINCT g, coalesce(a.new, s) AS s, p, coalesce(b.new, o) AS o FROM quad LEFT JOIN m a ON s = a.old LEFT JOIN m b ON o = b.old")
def r19_collapsed_duplicates(t):
    pairs = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("old"), F.concat(F.lit("seg:"), "c_mktsegment").alias("new"))
    return rooting.collapsed(t("quad"), pairs)


# --- comparison (V01-V07) ----------------------------------------------------------------------------


@query(f"""WITH {LABELLED_SQL}, {_ROOTS}, x AS (SELECT l.lm, r.root, l.type, l.hidden_label FROM labelled l JOIN roots r ON l.lm = r.trace)
  SELECT a.lm AS av1, b.lm AS av2, a.hidden_label = b.hidden_label AS same FROM x a JOIN x b ON a.root = b.root AND a.lm <> b.lm""")
def v03_name_comparison(t):
    own = labels.with_labels(t("landmark"))
    rows = rooting.landmarks_by_label(own).join(own.select(F.col("lm").alias("trace"), "label", "lang"), "trace")
    versions = rows.select("root", "trace", F.col("trace").alias("av"), F.lit("Name").alias("attr_type"), F.col("type").alias("lm_type"), F.col("label").alias("value"), "lang")
    return compare.compared(versions)


@query("""WITH b AS (SELECT id, id % 50 AS root, cast(id % 9 AS double) AS x, cast(id % 4 AS double) AS y FROM point), g AS (SELECT *, x AS x1, y AS y1, x + 10 AS x2, y + 10 AS y2 FROM b)
  SELECT concat('a', a.id) AS av1, concat('a', b.id) AS av2, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / (200 - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) >= 0.85 AS same FROM g a JOIN g b ON a.root = b.root AND a.id <> b.id""")
def v05_geometry_comparison(t):
    x, y = (F.col("id") % 9).cast("double"), (F.col("id") % 4).cast("double")
    corner = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    wkt = F.concat(F.lit("<http://www.opengis.net/def/crs/EPSG/0/2154> POLYGON (("), F.concat_ws(", ", corner(x, y), corner(x + 10, y), corner(x + 10, y + 10), corner(x, y + 10), corner(x, y)), F.lit("))"))
    key = F.concat(F.lit("a"), F.col("id").cast("string"))
    versions = t("point").select((F.col("id") % 50).cast("string").alias("root"), key.alias("trace"), key.alias("av"), F.lit("Geometry").alias("attr_type"), F.lit("District").alias("lm_type"), wkt.alias("value"), F.lit(None).cast("string").alias("lang"))
    return compare.compared(versions)


# --- changes and times (E01-E05, K20) ------------------------------------------------------------------


@query(f"SELECT {sig('Change', 'type', 'elem')} AS cg, type, elem AS applied_to FROM (SELECT lm AS elem, unnest(['LandmarkAppearance', 'LandmarkDisappearance']) AS type, n FROM landmark) WHERE NOT (type = 'LandmarkAppearance' AND n % 3 = 0)")
def e01_missing_changes(t):
    lm = t("landmark")
    known = lm.where("n % 3 = 0").select(F.col("lm").alias("applied_to"), F.lit("LandmarkAppearance").alias("type"))
    return changes.missing_changes(lm.select(F.col("lm").alias("elem"), F.lit("Landmark").alias("kind")), known).select("cg", "type", "applied_to")


@query("SELECT DISTINCT ev, prop, t FROM (SELECT ev, prop, t FROM candidate UNION ALL SELECT attr, 'hasTimeBefore', begin FROM version WHERE begin IS NOT NULL UNION ALL SELECT concat('d', attr), 'hasTimeAfter', ending FROM version WHERE ending IS NOT NULL)")
def e02_candidate_times(t):
    v = t("version")
    valid = v.select(F.col("attr").alias("ev"), F.lit("LandmarkAppearance").alias("type"), "begin", F.col("ending").alias("end")).unionByName(v.select(F.concat(F.lit("d"), "attr").alias("ev"), F.lit("LandmarkDisappearance").alias("type"), "begin", F.col("ending").alias("end")))
    return changes.candidate_times(t("candidate"), valid)


_FINAL = """fin AS (SELECT DISTINCT ev, prop, t FROM (SELECT *, bool_or(prop = 'hasTime') OVER (PARTITION BY ev) AS crisp, min(t) OVER (PARTITION BY ev, prop) AS lo, max(t) OVER (PARTITION BY ev, prop) AS hi FROM candidate)
  WHERE CASE WHEN crisp THEN prop = 'hasTime' WHEN prop = 'hasTimeAfter' THEN t = hi ELSE t = lo END)"""


@query(f"WITH {_FINAL} SELECT ev, prop, t FROM fin")
def e03_final_times(t):
    return changes.final_times(t("candidate"))


@query(f"WITH {_FINAL} SELECT ev, max(CASE WHEN prop = 'hasTimeAfter' THEN t END) AS fuzzy_begin, min(CASE WHEN prop = 'hasTimeBefore' THEN t END) AS fuzzy_end FROM fin GROUP BY ev HAVING count(*) FILTER (prop = 'hasTime') = 0")
def e04_fuzzy_instants(t):
    return changes.fuzzy_instants(changes.final_times(t("candidate"))).select("ev", "fuzzy_begin", "fuzzy_end")


@query(f"SELECT {sig('Address', 'locatum', 'relatum')} AS addr, concat(a.label, ', ', b.label) AS label, pos, CASE pos WHEN 0 THEN locatum ELSE relatum END AS segment FROM relation r JOIN landmark a ON locatum = a.lm AND a.type = 'StreetNumber' JOIN landmark b ON relatum = b.lm AND b.type = 'Thoroughfare', (VALUES (0), (1)) AS p(pos) WHERE r.type = 'Belongs'")
def k20_addresses(t):
    return changes.addresses(t("relation"), t("landmark")).select("addr", "label", "pos", "segment")


# --- evolution (K01-K19) ----------------------------------------------------------------------------------


def _ids(traces: str):
    return F.array_join(F.transform(traces, lambda x: x["av"]), "|").alias(traces)


def _evolution_inputs(t):
    versions = t("version").select("attr", "av", "begin", F.col("ending").alias("end"), F.col("value").alias("vid"))
    stated = t("stated").select("attr", "stamp", "precision", "cg", F.array("made").alias("makes"), F.array().cast("array<string>").alias("outdates"))
    return versions, stated


_EVOLUTION = """ev AS (
    SELECT attr, stamp, cg, made AS av, 1 AS m FROM stated
    UNION ALL SELECT attr, begin, NULL, av, 1 FROM version WHERE begin IS NOT NULL
    UNION ALL SELECT attr, ending, NULL, av, 0 FROM version WHERE ending IS NOT NULL),
  pts AS (SELECT attr, stamp, 0 AS side, bool_or(cg IS NOT NULL) AS real FROM ev GROUP BY attr, stamp),
  pts2 AS (SELECT * FROM pts UNION ALL SELECT DISTINCT attr, NULL, -1, false FROM pts UNION ALL SELECT DISTINCT attr, NULL, 1, false FROM pts),
  ch AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY side, stamp NULLS FIRST) - 1 AS idx FROM pts2),
  seg AS (SELECT attr, idx AS seg, stamp AS b, real AS br, lead(stamp) OVER w AS e, lead(real) OVER w AS er, lead(idx) OVER w AS nx FROM ch WINDOW w AS (PARTITION BY attr ORDER BY idx)),
  spn AS (SELECT attr, av, coalesce(f, s - 1) AS f, coalesce(s, f + 1) AS s FROM (SELECT ev.attr, ev.av, min(CASE WHEN m = 1 THEN idx END) AS f, max(CASE WHEN m = 0 THEN idx END) AS s FROM ev JOIN ch ON ch.attr = ev.attr AND ch.stamp = ev.stamp AND ch.side = 0 GROUP BY ev.attr, ev.av)),
  cov AS (SELECT g.attr, g.seg, any_value(b) AS b, any_value(e) AS e, any_value(br) AS br, any_value(er) AS er, list_sort(list(DISTINCT av) FILTER (av IS NOT NULL)) AS traces FROM seg g LEFT JOIN spn ON spn.attr = g.attr AND f <= seg AND seg < s WHERE nx IS NOT NULL GROUP BY g.attr, g.seg)"""


@query(f"WITH {_EVOLUTION} SELECT attr, seg, b AS begin, e AS ending, br AS begin_real, er AS end_real FROM seg WHERE nx IS NOT NULL")
def k05_elementary_versions(t):
    points = evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))
    return evolution.elementary_versions(points).withColumn("seg", F.col("seg").cast("long")).withColumnRenamed("end", "ending")


@query(f"WITH {_EVOLUTION} SELECT attr, av, f AS first, s AS stop FROM spn")
def k06_version_spans(t):
    return evolution.version_spans(evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))).select("attr", "av", F.col("first").cast("long").alias("first"), F.col("stop").cast("long").alias("stop"))


@query(f"WITH {_EVOLUTION} SELECT attr, seg, coalesce(array_to_string(traces, '|'), '') AS traces FROM cov")
def k07_version_cover(t):
    points = evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))
    return evolution.covered(points).select("attr", F.col("seg").cast("long").alias("seg"), _ids("traces"))


_PRUNED = f"""{_EVOLUTION},
  mk AS (SELECT *, (traces IS NULL OR len(traces) = 0) AND NOT (br AND er) AS gone FROM cov),
  kp AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY seg) AS n, lag(seg) OVER (PARTITION BY attr ORDER BY seg) AS pv, lead(seg) OVER (PARTITION BY attr ORDER BY seg) AS nxt FROM mk WHERE NOT gone),
  lft AS (SELECT k.attr, k.seg, bool_or(c.real) AS real, min(CASE WHEN c.real THEN c.stamp END) AS at, CASE WHEN bool_or(c.side = -1) THEN NULL ELSE min(c.stamp) END AS a, max(c.stamp) AS z FROM kp k JOIN ch c ON c.attr = k.attr AND c.idx <= k.seg AND c.idx > coalesce(k.pv, -1) GROUP BY k.attr, k.seg),
  rgt AS (SELECT k.attr, k.seg, bool_or(c.real) AS real, min(CASE WHEN c.real THEN c.stamp END) AS at, min(c.stamp) AS a, CASE WHEN bool_or(c.side = 1) THEN NULL ELSE max(c.stamp) END AS z FROM kp k JOIN ch c ON c.attr = k.attr AND c.idx > k.seg AND c.idx <= coalesce(k.nxt, 1000000000) GROUP BY k.attr, k.seg),
  prn AS (SELECT k.attr, k.n, k.traces, l.real AS begin_real, CASE WHEN l.real THEN l.at ELSE l.a END AS begin_after, CASE WHEN l.real THEN l.at ELSE l.z END AS begin_before, r.real AS end_real, CASE WHEN r.real THEN r.at ELSE r.a END AS end_after, CASE WHEN r.real THEN r.at ELSE r.z END AS end_before FROM kp k JOIN lft l ON l.attr = k.attr AND l.seg = k.seg JOIN rgt r ON r.attr = k.attr AND r.seg = k.seg)"""


@query(f"WITH {_PRUNED} SELECT attr, n, array_to_string(traces, '|') AS traces, begin_real, begin_after, begin_before, end_real, end_after, end_before FROM prn")
def k10_pruned(t):
    points = evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))
    return evolution.pruned(evolution.covered(points)).withColumn("traces", _ids("traces")).withColumn("n", F.col("n").cast("long"))


_MERGED = f"""{_PRUNED},
  prv AS (SELECT *, lag(traces) OVER (PARTITION BY attr ORDER BY n) AS earlier FROM prn),
  jd AS (SELECT p.attr, p.n, bool_or(x.a = x.b OR va.value = vb.value) AND NOT bool_or(x.a <> x.b AND va.value <> vb.value) AS mrg FROM prv p, LATERAL (SELECT u.a, w.b FROM (SELECT unnest(p.earlier) AS a) u, (SELECT unnest(p.traces) AS b) w) x JOIN version va ON va.av = x.a JOIN version vb ON vb.av = x.b WHERE NOT p.begin_real AND p.earlier IS NOT NULL GROUP BY p.attr, p.n),
  isl AS (SELECT prn.*, sum(CASE WHEN coalesce(mrg, false) THEN 0 ELSE 1 END) OVER (PARTITION BY prn.attr ORDER BY prn.n) AS version FROM prn LEFT JOIN jd ON jd.attr = prn.attr AND jd.n = prn.n)"""


_EVOLVED = f"""WITH {_MERGED} SELECT attr, cast(version AS bigint) AS version, array_to_string(list_sort(list_distinct(flatten(list(traces)))), '|') AS traces, arg_min(coalesce(cast(begin_after AS varchar), '-'), n) AS begin_after, arg_min(coalesce(cast(begin_before AS varchar), '-'), n) AS begin_before,
   arg_max(coalesce(cast(end_after AS varchar), '-'), n) AS end_after, arg_max(coalesce(cast(end_before AS varchar), '-'), n) AS end_before, arg_min(begin_real, n) AS begin_real, arg_max(end_real, n) AS end_real FROM isl GROUP BY attr, version"""


@query(_EVOLVED)
def k13_evolution_merge(t):
    return _evolved(evolution.evolution(*_evolution_inputs(t)))


def _evolved(out):
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias(c)
    return out.select("attr", F.col("version").cast("long").alias("version"), F.array_join("traces", "|").alias("traces"), *[stamp(c) for c in ("begin_after", "begin_before", "end_after", "end_before")], "begin_real", "end_real")


@query(re.sub(r"(FROM|JOIN) (version|stated)\b", r"\1 busy_\2", _EVOLVED))
def k13_long_attribute(t):
    """One attribute has half of all versions; attributes above 500 rows are cut into blocks."""
    return _evolved(evolution.evolution(*_evolution_inputs(lambda name: t(f"busy_{name}")), long=500))


@query(_EVOLVED)
def k13_judged_merge(t):
    """As the flagship, but a function judges the pairs of values that meet, as the build of facts does."""
    return _evolved(evolution.evolution(*_evolution_inputs(t), lambda pairs: pairs.withColumn("same", F.col("v1") == F.col("v2"))))


@query(f"""WITH {_MERGED}, fin AS (SELECT attr, version, arg_min(begin_real, n) AS r, min(n) AS n1, max(n) AS n2 FROM isl GROUP BY attr, version),
  sd AS (SELECT f.attr, f.version, 'begin' AS side, p.begin_after AS a, p.begin_before AS z FROM fin f JOIN prn p ON p.attr = f.attr AND p.n = f.n1 UNION ALL SELECT f.attr, f.version, 'end', p.end_after, p.end_before FROM fin f JOIN prn p ON p.attr = f.attr AND p.n = f.n2)
  SELECT side, prop, count(*) AS n FROM (SELECT side, 'hasTime' AS prop FROM sd WHERE a = z UNION ALL SELECT side, 'hasTimeAfter' FROM sd WHERE (a = z) IS NOT TRUE AND a IS NOT NULL UNION ALL SELECT side, 'hasTimeBefore' FROM sd WHERE (a = z) IS NOT TRUE AND z IS NOT NULL) GROUP BY ALL""")
def k14_event_times(t):
    out = evolution.event_times(evolution.evolution(*_evolution_inputs(t)))
    return out.groupBy("side", "prop").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MERGED} SELECT DISTINCT {sig('AttributeVersion', 'attr', 'cast(version AS bigint)')} AS root, unnest(traces) AS trace FROM isl")
def k15_version_traces(t):
    return evolution.version_traces(evolution.evolution(*_evolution_inputs(t)))


# --- temporal relations (T01-T09) -----------------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT a.ev, a.t AS t1, b.t AS t2, a.stamp AS s1, b.stamp AS s2, {rank_sql('a.precision')} AS r1, {rank_sql('b.precision')} AS r2 FROM instant a JOIN instant b ON a.ev = b.ev AND a.calendar = b.calendar AND (a.stamp < b.stamp OR (a.stamp = b.stamp AND a.t < b.t))),
    q AS (SELECT *, CASE least(r1, r2) WHEN 7 THEN year(s1) // 100 = year(s2) // 100 WHEN 8 THEN year(s1) // 10 = year(s2) // 10 WHEN 9 THEN year(s1) = year(s2) WHEN 10 THEN year(s1) = year(s2) AND month(s1) = month(s2) ELSE cast(s1 AS date) = cast(s2 AS date) END AS same FROM p)
    SELECT ev, t1, t2, CASE WHEN same THEN 'instantSameTime' ELSE 'instantBefore' END AS relation, CASE WHEN same THEN CASE WHEN r1 = r2 THEN 'as' WHEN r1 > r2 THEN 'first' ELSE 'second' END END AS finer FROM q"""
)
def t01_compared_instants(t):
    return temporal.compared_instants(t("instant"), "ev")


_ALLEN = "CASE WHEN a.begin = b.begin AND a.ending = b.ending THEN 'equals' WHEN a.ending < b.begin THEN 'before' WHEN a.ending = b.begin THEN 'meets' WHEN a.begin = b.begin AND a.ending < b.ending THEN 'starts' WHEN a.begin > b.begin AND a.ending = b.ending THEN 'finishes' WHEN a.begin > b.begin AND a.ending < b.ending THEN 'during' WHEN a.begin < b.begin AND a.ending > b.begin AND a.ending < b.ending THEN 'overlaps' END"


@query(f"SELECT * FROM (SELECT a.grp, a.i AS i1, b.i AS i2, {_ALLEN} AS relation FROM interval a JOIN interval b ON a.grp = b.grp AND a.i <> b.i) WHERE relation IS NOT NULL".replace("FROM interval a JOIN interval b", "FROM ivl a JOIN ivl b"))
def t03_allen_relations(t):
    return temporal.compared_intervals(t("interval").withColumnRenamed("ending", "end"), "grp")


ORACLES["t03_allen_relations"] = f"WITH ivl AS ({_TYPED['interval'].format(lineitem='lineitem')}) " + ORACLES["t03_allen_relations"]


@query("SELECT ev, max(CASE WHEN prop = 'hasTimeAfter' THEN t END) AS earliest, min(CASE WHEN prop = 'hasTimeBefore' THEN t END) AS latest FROM candidate GROUP BY ev")
def t04_earliest_and_latest(t):
    return temporal.earliest_and_latest(t("candidate").select("ev", "prop", F.col("t").alias("stamp"), F.lit("day").alias("precision")))


@query("SELECT elem AS av, coalesce(app_crisp, app_end, app_begin) AS begin, coalesce(dis_crisp, dis_begin, dis_end) AS ending FROM bound")
def t06_validity(t):
    b = t("bound")
    rows = b.select(F.col("elem").alias("av"), F.lit("begin").alias("side"), F.col("app_crisp").alias("time"), F.col("app_begin").alias("earliest"), F.col("app_end").alias("latest")).unionByName(b.select(F.col("elem").alias("av"), F.lit("end").alias("side"), F.col("dis_crisp").alias("time"), F.col("dis_begin").alias("earliest"), F.col("dis_end").alias("latest")))
    return temporal.validity(rows).withColumnRenamed("end", "ending")


@query("""WITH tm AS (SELECT concat('o', o_orderkey) AS ev, o_custkey AS grp, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r FROM orders),
  r AS (SELECT a.ev AS ev1, b.ev AS ev2 FROM tm a JOIN tm b ON a.grp = b.grp AND b.r = a.r + 1
   UNION SELECT concat('la', lm), concat('ld', lm) FROM landmark UNION SELECT concat('ra', lr), concat('rd', lr) FROM relation
   UNION SELECT concat('la', lm), concat('ra', lr) FROM (SELECT lr, locatum AS lm FROM relation UNION SELECT lr, relatum FROM relation) WHERE lm IN (SELECT lm FROM landmark)
   UNION SELECT concat('rd', lr), concat('ld', lm) FROM (SELECT lr, locatum AS lm FROM relation UNION SELECT lr, relatum FROM relation) WHERE lm IN (SELECT lm FROM landmark)
   UNION SELECT concat('m', av), concat('x', av) FROM version WHERE begin IS NOT NULL AND ending IS NOT NULL) SELECT ev1, ev2 FROM r WHERE ev1 <> ev2""")
def t09_events_before(t):
    lm, rel, v = t("landmark"), t("relation"), t("version")
    timed = t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("ev"), F.col("o_custkey").alias("grp"), F.col("o_orderdate").alias("stamp"))
    of = lambda rows, key, kind, p: rows.select(F.concat(F.lit(p), key).alias("ev"), F.lit(kind).alias("type"), F.col(key).alias("applied_to")).distinct()
    own = of(lm, "lm", "LandmarkAppearance", "la").unionByName(of(lm, "lm", "LandmarkDisappearance", "ld")).unionByName(of(rel, "lr", "LandmarkRelationAppearance", "ra")).unionByName(of(rel, "lr", "LandmarkRelationDisappearance", "rd"))
    members = rel.select("lr", F.col("locatum").alias("member")).unionByName(rel.select("lr", F.col("relatum").alias("member"))).distinct()
    versions = v.select("av", F.when(F.col("begin").isNotNull(), F.concat(F.lit("m"), "av")).alias("ev_made"), F.when(F.col("ending").isNotNull(), F.concat(F.lit("x"), "av")).alias("ev_gone"))
    return temporal.events_before(timed, own, members, versions)


@query("WITH b AS (SELECT concat('e', c_custkey % 200) AS ev1, concat('e', (c_custkey * 3) % 200) AS ev2 FROM customer) SELECT DISTINCT a.ev1, a.ev2 FROM b a JOIN b c ON a.ev1 = c.ev2 AND a.ev2 = c.ev1 WHERE a.ev1 < a.ev2")
def t08_similar_events(t):
    k = F.col("c_custkey")
    return temporal.similar_events(t("customer").select(F.concat(F.lit("e"), (k % 200).cast("string")).alias("ev1"), F.concat(F.lit("e"), (k * 3 % 200).cast("string")).alias("ev2")))


# --- reading (Q01-Q22) ------------------------------------------------------------------------------------------

_T, _LOW, _HIGH = "1998-06-01", "1998-01-01", "1998-12-01"


def _at(day: str):
    return F.lit(day).cast("timestamp_ntz")


_POSSIBLE = f"coalesce(app_crisp <= TIMESTAMP '{_T}', true) AND coalesce(app_begin <= TIMESTAMP '{_T}', true) AND coalesce(dis_crisp > TIMESTAMP '{_T}', true) AND coalesce(dis_end > TIMESTAMP '{_T}', true)"


@query(f"""SELECT elem, (coalesce(app_crisp <= TIMESTAMP '{_T}', false) OR coalesce(app_end <= TIMESTAMP '{_HIGH}', app_end <= TIMESTAMP '{_T}', false)) AND (coalesce(dis_crisp > TIMESTAMP '{_T}', false) OR coalesce(dis_begin >= TIMESTAMP '{_LOW}', dis_begin > TIMESTAMP '{_T}', false)) AS sure FROM bound WHERE {_POSSIBLE}""")
def q07_snapshot_landmarks(t):
    return reading.landmarks_at(t("bound"), _at(_T), _at(_LOW), _at(_HIGH))


@query(f"SELECT elem, NOT (coalesce(NOT (app_end <= TIMESTAMP '{_T}'), false) OR coalesce(NOT (dis_begin > TIMESTAMP '{_T}'), false)) AS sure FROM bound WHERE {_POSSIBLE}")
def q08_snapshot_versions(t):
    return reading.versions_at(t("bound"), _at(_T))


@query("SELECT elem, max(CASE WHEN side = 'app' AND kind = 'crisp' THEN stamp END) AS app_crisp, max(CASE WHEN side = 'dis' AND kind = 'end' THEN stamp END) AS dis_end FROM (SELECT elem, 'app' AS side, 'crisp' AS kind, app_crisp AS stamp FROM bound UNION ALL SELECT elem, 'dis', 'end', dis_end FROM bound) GROUP BY elem")
def q05_pivoted_validity(t):
    b = t("bound")
    rows = b.select("elem", F.lit("app").alias("side"), F.lit("crisp").alias("kind"), F.col("app_crisp").alias("stamp")).unionByName(b.select("elem", F.lit("dis").alias("side"), F.lit("end").alias("kind"), F.col("dis_end").alias("stamp")))
    return reading.pivoted(rows).select("elem", "app_crisp", "dis_end")


@query("""SELECT lm, coalesce(string_agg(DISTINCT CASE WHEN attr_type = 'view' THEN value END, '|' ORDER BY CASE WHEN attr_type = 'view' THEN value END), '') AS names, CASE WHEN count(DISTINCT CASE WHEN attr_type = 'click' THEN value END) = 1 THEN max(CASE WHEN attr_type = 'click' THEN value END) ELSE concat('GEOMETRYCOLLECTION (', string_agg(DISTINCT CASE WHEN attr_type = 'click' THEN value END, ', ' ORDER BY CASE WHEN attr_type = 'click' THEN value END), ')') END AS geometry
  FROM version GROUP BY lm HAVING count(CASE WHEN attr_type = 'click' THEN 1 END) > 0""")
def q10_snapshot_features(t):
    kind = F.when(F.col("attr_type") == "view", "Name").when(F.col("attr_type") == "click", "Geometry").otherwise("Other")
    return reading.features(t("version").withColumn("attr_type", kind)).select("lm", F.array_join("names", "|").alias("names"), "geometry")


@query("SELECT elem, CASE WHEN app_crisp IS NOT NULL THEN 'crisp' WHEN app_begin IS NOT NULL AND app_end IS NOT NULL THEN 'fuzzy' WHEN app_begin IS NOT NULL THEN 'after' WHEN app_end IS NOT NULL THEN 'before' ELSE 'infinite' END AS class, CASE WHEN app_crisp IS NOT NULL THEN 'crisp' WHEN coalesce(app_begin, app_end) IS NOT NULL THEN 'fuzzy' END AS kind, CASE WHEN app_crisp IS NOT NULL THEN app_crisp WHEN app_begin IS NOT NULL AND app_end IS NOT NULL THEN date_trunc('day', app_begin + (app_end - app_begin) / 2) ELSE coalesce(app_begin, app_end) END AS place FROM bound")
def q13_boundaries(t):
    c = [F.col(x) for x in ("app_crisp", "app_begin", "app_end")]
    edge = reading.boundary(*c, F.lit("day"), F.lit("gregorian"))
    return t("bound").select("elem", reading.classified(*c).alias("class"), edge["kind"].alias("kind"), reading.place_on_line(*c).alias("place"))


@query("SELECT v.av, v.value, b.app_crisp FROM (SELECT av, value, substr(av, 2) AS k FROM version) v LEFT JOIN bound b ON b.elem = v.k")
def q06_timeline(t):
    bounds = t("bound").withColumn("elem", F.concat(F.lit("v"), "elem"))
    return reading.timeline(t("version"), bounds.drop("lm")).select("av", "value", "app_crisp")


@query("SELECT label FROM (SELECT concat(a.label, ', ', b.label) AS label, b.label AS street FROM relation r JOIN landmark a ON locatum = a.lm AND a.type = 'StreetNumber' JOIN landmark b ON relatum = b.lm AND b.type = 'Thoroughfare' WHERE r.type = 'Belongs') WHERE lower(street) = 'bd. du small widget'")
def q17_addresses_along(t):
    rows = changes.addresses(t("relation"), t("landmark")).where("pos = 1")
    streets = t("landmark").select(F.col("lm").alias("segment"), F.col("label").alias("street"))
    return reading.addresses_along(rows.join(streets, "segment"), "BD. du small widget").select("label")


@query(f"SELECT DISTINCT {sig('Attribute', 'attr')} AS root, concat('source ', source) AS source FROM version")
def q22_provenance(t):
    v = t("version")
    traces = v.select(signature("Attribute", "attr").alias("root"), F.col("av").alias("trace"))
    sources = v.select("source").distinct().select("source", F.concat(F.lit("source "), "source").alias("label"), F.lit("d").alias("description"))
    return reading.provenance_of(traces.select("root").distinct(), traces, v.select(F.col("av").alias("elem"), "source"), sources).select("root", "source")


# --- statistics (G01-G06) ------------------------------------------------------------------------------------------


@query("SELECT g, type, count(DISTINCT lm) AS landmarks FROM landmark GROUP BY g, type")
def g02_landmarks_by_type(t):
    return statistics.landmarks_by_graph(t("landmark"), True)


@query("SELECT g, count(DISTINCT lm) AS landmarks FROM landmark GROUP BY g")
def g01_landmarks_by_graph(t):
    return statistics.landmarks_by_graph(t("landmark"))


@query("SELECT lm, count(DISTINCT av) AS versions FROM version GROUP BY lm ORDER BY versions DESC, lm LIMIT 25")
def g03_most_versions(t):
    return statistics.most_versions(t("version"), 25)


@query("SELECT lm, elem AS av, date_diff('day', cast(coalesce(app_crisp, app_end, app_begin) AS date), cast(coalesce(dis_crisp, dis_begin, dis_end) AS date)) AS days FROM bound WHERE coalesce(app_crisp, app_end, app_begin) IS NOT NULL AND coalesce(dis_crisp, dis_begin, dis_end) IS NOT NULL ORDER BY days DESC, elem LIMIT 50")
def g04_longest_valid(t):
    return statistics.longest_valid(t("bound").withColumnRenamed("elem", "av"), 50).withColumn("days", F.col("days").cast("long"))


@query("SELECT y AS year, count(elem) AS n FROM range(1994, 2005) AS r(y) LEFT JOIN bound ON year(coalesce(app_crisp, app_begin)) <= y AND coalesce(year(dis_crisp), 2004) >= y GROUP BY y")
def g05_alive_by_year(t):
    spans = t("bound").select("elem", F.coalesce("app_crisp", "app_begin").alias("start"), F.col("dis_crisp").alias("end"))
    return statistics.alive_by_year(spans, 1994, 2004).select(F.col("year").cast("long").alias("year"), "n")


@query("SELECT g, count(*) AS statements FROM quad GROUP BY g")
def g06_statements_by_graph(t):
    return statistics.statements_by_graph(t("quad"))


# --- validation (D01-D08) --------------------------------------------------------------------------------------------

_CLASSES = "cls AS (SELECT s, class FROM instance UNION SELECT s, 'Change' FROM instance WHERE class = 'AttributeChange')"


def _classes(t):
    rows = t("instance")
    return validation.classes_of(rows, graph.closure_of_rules(rows.sparkSession, [("AttributeChange", "Change")]))


@query(f"WITH {_CLASSES} SELECT DISTINCT s, p, 'Change' AS expected FROM quad q WHERE p = 'appliedTo' AND NOT EXISTS (SELECT 1 FROM cls WHERE cls.s = q.s AND class = 'Change')")
def d01_domain(t):
    quads = t("quad")
    return validation.domain_violations(quads, _classes(t), quads.sparkSession.createDataFrame([("appliedTo", "Change")], "p string, class string"))


@query(f"WITH {_CLASSES} SELECT DISTINCT s, p, o, 'Landmark' AS expected FROM quad q WHERE p = 'appliedTo' AND NOT EXISTS (SELECT 1 FROM cls WHERE cls.s = q.o AND class = 'Landmark') UNION SELECT s, p, o, 'dateTimeStamp' FROM quad WHERE p = 'hasTime' AND (o_kind <> 'literal' OR o_dtype IS DISTINCT FROM 'dateTimeStamp')")
def d02_range(t):
    quads = t("quad")
    rules = quads.sparkSession.createDataFrame([("appliedTo", "Landmark", None), ("hasTime", None, "dateTimeStamp")], "p string, class string, dtype string")
    return validation.range_violations(quads, _classes(t), rules)


@query("SELECT s, count(DISTINCT o) AS n FROM quad WHERE p = 'hasTime' GROUP BY s HAVING count(DISTINCT o) > 1")
def d03_cardinality(t):
    return validation.cardinality_violations(t("quad"), "hasTime", 1, 1)


@query("SELECT o AS node, count(DISTINCT s) AS n FROM quad WHERE p = 'appliedTo' GROUP BY o HAVING count(DISTINCT s) > 1")
def d04_inverse_functional(t):
    return validation.functional_violations(t("quad"), "appliedTo", True)


@query(f"WITH {_CLASSES} SELECT DISTINCT s, class, 'appliedTo' AS p FROM cls WHERE class = 'Change' AND s NOT IN (SELECT s FROM quad WHERE p = 'appliedTo')")
def d05_missing_property(t):
    quads = t("quad")
    return validation.missing_properties(quads, _classes(t), quads.sparkSession.createDataFrame([("Change", "appliedTo")], "class string, p string"))


@query(f"""WITH {_CLASSES}, tg AS (SELECT DISTINCT s FROM cls WHERE class = 'Change')
  SELECT 'ChangeShape' AS shape, s, 'appliedTo' AS path, 'minCount' AS rule FROM tg WHERE s NOT IN (SELECT s FROM quad WHERE p = 'appliedTo')
  UNION SELECT 'ChangeShape', s, 'appliedTo', 'class' FROM quad q WHERE p = 'appliedTo' AND s IN (SELECT s FROM tg) AND NOT EXISTS (SELECT 1 FROM cls WHERE cls.s = q.o AND class IN ('Landmark', 'Area'))
  UNION SELECT 'ChangeShape', s, 'hasTime', 'maxCount' FROM quad WHERE p = 'hasTime' AND s IN (SELECT s FROM tg) GROUP BY s HAVING count(DISTINCT o) > 1
  UNION SELECT 'ChangeShape', s, 'hasTime', 'datatype' FROM quad WHERE p = 'hasTime' AND s IN (SELECT s FROM tg) AND o_dtype IS DISTINCT FROM 'dateTimeStamp'""")
def d08_shape_report(t):
    shape = validation.Shape("ChangeShape", "Change", (validation.Property("appliedTo", least=1, classes=("Landmark", "Area"), kind="uri"), validation.Property("hasTime", most=1, dtype="dateTimeStamp", kind="literal")))
    return validation.shape_report(t("quad"), _classes(t), [shape])


# --- inference (I01-I03) -----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE base AS (SELECT s, p, o FROM quad WHERE p = 'isPartOf'), tr AS (SELECT s, o FROM base UNION SELECT tr.s, b.o FROM tr JOIN base b ON tr.o = b.s)
  SELECT s, 'isPartOf' AS p, o FROM tr UNION SELECT o, 'hasPart', s FROM tr UNION SELECT s, 'related', o FROM tr UNION SELECT o, 'related', s FROM tr""")
def i01_inferred(t):
    quads = t("quad").where("p = 'isPartOf'").select("s", "p", "o")
    make = quads.sparkSession.createDataFrame
    return inference.inferred(quads, make([("isPartOf", "hasPart")], "p string, q string"), make([("isPartOf", "related")], "p string, q string"), ["related"], ["isPartOf"])


@query("SELECT DISTINCT m AS a, o AS b FROM (SELECT o, min(o) OVER (PARTITION BY s) AS m FROM quad WHERE p = 'hasTime') WHERE m <> o")
def i02_same_as(t):
    return inference.same_as(t("quad").select("s", "p", "o"), ["hasTime"])


@query("WITH RECURSIVE b AS (SELECT DISTINCT concat('e', n_nationkey) AS x, concat('r', n_regionkey) AS y FROM nation UNION SELECT concat('r', r_regionkey), concat('r', r_regionkey + 1) FROM region WHERE r_regionkey < 4), c AS (SELECT x, y FROM b UNION SELECT c.x, b.y FROM c JOIN b ON c.y = b.x) SELECT x AS ev1, y AS ev2 FROM c")
def i03_event_order(t):
    a = t("nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("ev1"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("ev2"))
    b = t("region").where("r_regionkey < 4").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ev1"), F.concat(F.lit("r"), (F.col("r_regionkey") + 1).cast("string")).alias("ev2"))
    return inference.event_order(a.unionByName(b))


# --- linking and metrics (X01-X08, M01-M11) ----------------------------------------------------------------------------------


@query(f"SELECT id, concat({number_sql('number')}, ', ', {thoroughfare_sql('label')}) AS label, concat({simplified_sql(thoroughfare_sql('label'))}, '||', {number_sql('number')}) AS key FROM name")
def x01_address_keys(t):
    return linking.labelled(t("name").select("id", "number", F.col("label").alias("street"))).select("id", "label", "key")


_LINKS = """nx AS (SELECT key, ord, lead(ord) OVER (PARTITION BY key ORDER BY ord) AS nord FROM (SELECT DISTINCT key, ord FROM address)),
  lk AS (SELECT a.id AS from_id, b.id AS to_id, a.ord AS from_source, b.ord AS to_source, a.key, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS length FROM address a JOIN nx ON nx.key = a.key AND nx.ord = a.ord JOIN address b ON b.key = a.key AND b.ord = nx.nord)"""


@query(f"WITH {_LINKS} SELECT from_id, to_id, length < 10 AS similar FROM lk")
def x04_successive_links(t):
    return linking.successive_links(t("address")).select("from_id", "to_id", "similar")


@query("SELECT a.id AS from_id, b.id AS to_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 10 AS similar FROM address a JOIN address b ON a.key = b.key AND a.ord < b.ord")
def x02_all_links(t):
    return linking.all_links(t("address")).select("from_id", "to_id", "similar")


@query(f"WITH {_LINKS} SELECT id FROM address WHERE id NOT IN (SELECT from_id FROM lk) AND id NOT IN (SELECT to_id FROM lk)")
def x07_unlinked(t):
    rows = t("address")
    return linking.alone(rows).select("id")


@query(f"""WITH {_LINKS}, st AS (SELECT key, from_source, to_source, bool_or(length < 10) AS sim FROM lk GROUP BY ALL), nd AS (SELECT key, min(from_source) AS source, 0 AS new FROM st GROUP BY key UNION ALL SELECT key, to_source, CASE WHEN sim THEN 0 ELSE 1 END FROM st),
  g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY source) AS grp FROM nd) SELECT key, cast(grp AS bigint) AS grp, string_agg(DISTINCT cast(source AS varchar), '|' ORDER BY cast(source AS varchar)) AS sources FROM g GROUP BY key, grp""")
def m05_groups_of_sources(t):
    return linking.groups_of_sources(linking.similar_steps(t("address"))).select("key", "grp", F.array_join("sources", "|").alias("sources"))


_QUALITY = """src AS (SELECT attr AS label, value AS version, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM version GROUP BY attr, value), src2 AS (SELECT attr AS label, value AS version, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM version WHERE source <> 's2' GROUP BY attr, value),
  a AS (SELECT label, sources, count(*) AS a FROM src GROUP BY ALL), b AS (SELECT label, sources, count(*) AS b FROM src2 GROUP BY ALL),
  q AS (SELECT label, cast(sum(coalesce(a, 0)) AS bigint) AS n_ref, cast(sum(coalesce(b, 0)) AS bigint) AS n_mod, cast(sum(least(coalesce(a, 0), coalesce(b, 0))) AS bigint) AS shared FROM a FULL JOIN b USING (label, sources) GROUP BY label)"""


@query(f'WITH {_QUALITY} SELECT label, n_ref, n_mod, shared, n_ref = n_mod AND shared = n_ref AS "right", round(shared / (n_ref + n_mod - shared), 9) AS iou FROM q')
def m03_version_quality(t):
    rows = t("version").select(F.col("attr").alias("label"), F.col("value").alias("version"), "source")
    return metrics.version_quality(metrics.version_sources(rows), metrics.version_sources(rows, "s2")).withColumn("iou", F.round("iou", 9))


@query("""WITH r AS (SELECT lm AS label, elem, date_diff('day', DATE '0001-01-01', cast(app_crisp AS date)) AS d, date_diff('day', DATE '0001-01-01', cast(app_end AS date)) AS b, date_diff('day', DATE '0001-01-01', cast(app_begin AS date)) AS a FROM bound WHERE coalesce(app_crisp, app_end, app_begin) IS NOT NULL),
  m AS (SELECT label, elem, CASE WHEN cast(elem AS bigint) % 9 = 1 THEN coalesce(d, a + 3) ELSE d END AS d, CASE WHEN cast(elem AS bigint) % 9 = 1 THEN NULL ELSE b END AS b, CASE WHEN cast(elem AS bigint) % 9 = 1 THEN NULL ELSE a END AS a FROM r WHERE cast(elem AS bigint) % 20 <> 3),
  e AS (SELECT m.label, m.elem, bool_or(coalesce(CASE WHEN m.d IS NOT NULL THEN m.d = r.d ELSE r.d IS NULL AND m.b IS NOT DISTINCT FROM r.b AND m.a IS NOT DISTINCT FROM r.a END, false)) AS s, bool_or(m.d IS NOT NULL AND r.d IS NULL AND coalesce(m.d <= r.b, true) AND coalesce(m.d >= r.a, true)) AS c FROM m JOIN r ON m.label = r.label GROUP BY ALL)
  SELECT e.label, (SELECT count(*) FROM m WHERE m.label = e.label) = (SELECT count(*) FROM r WHERE r.label = e.label) AS preserved, bool_and(s) AS strict, bool_and(s OR c) AS consistent FROM e GROUP BY e.label""")
def m04_change_quality(t):
    day = times.day_number
    r = t("bound").where("coalesce(app_crisp, app_end, app_begin) is not null").select(F.col("lm").alias("label"), F.col("elem").alias("change"), day(F.col("app_crisp")).alias("day"), day(F.col("app_end")).alias("before_day"), day(F.col("app_begin")).alias("after_day"))
    k = F.col("change").cast("long")
    odd = k % 9 == 1
    m = r.where(k % 20 != 3).select("label", "change", F.when(odd, F.coalesce("day", F.col("after_day") + 3)).otherwise(F.col("day")).alias("day"), F.when(~odd, F.col("before_day")).alias("before_day"), F.when(~odd, F.col("after_day")).alias("after_day"))
    return metrics.change_quality(r, m)


# the rest of the catalogue registers itself with ``query``
from chronolith.plans import catalogue_functions  # noqa: E402, F401
from chronolith.plans import catalogue_graph  # noqa: E402, F401
from chronolith.plans import catalogue_reasoning  # noqa: E402, F401
from chronolith.plans import catalogue_store  # noqa: E402, F401
from chronolith.plans import catalogue_spatial  # noqa: E402, F401
from chronolith.plans import catalogue_text  # noqa: E402, F401
