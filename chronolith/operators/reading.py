"""Read-side queries: snapshots at a date, timelines, validity, competency questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import geo

#: Columns of the pivoted validity table: crisp, fuzzy begin and fuzzy end of the appearance and the disappearance.
BOUNDS = ["app_crisp", "app_begin", "app_end", "dis_crisp", "dis_begin", "dis_end"]


def pivoted(times: DataFrame) -> DataFrame:
    """A row for each element (elem, side app|dis, kind crisp|begin|end, stamp): six optional patterns become one scan."""
    pick = lambda side, kind: F.max(F.when((F.col("side") == side) & (F.col("kind") == kind), F.col("stamp"))).alias(f"{side}_{kind}")
    return times.groupBy("elem").agg(*[pick(*b.split("_")) for b in BOUNDS])


def possible(t: Column) -> Column:
    """No known bound excludes t."""
    c = {b: F.col(b) for b in BOUNDS}
    begun = F.coalesce(c["app_crisp"] <= t, F.lit(True)) & F.coalesce(c["app_begin"] <= t, F.lit(True))
    lasts = F.coalesce(c["dis_crisp"] > t, F.lit(True)) & F.coalesce(c["dis_end"] > t, F.lit(True))
    return begun & lasts


def landmarks_at(bounds: DataFrame, t: Column, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Landmarks that may exist at t (elem), and whether they do for sure.

    Sure needs a crisp or bounded appearance before t and a disappearance after it; with a tolerance, a fuzzy end up
    to ``high`` and a fuzzy begin from ``low`` on suffice, and count first."""
    begun = F.coalesce(F.col("app_crisp") <= t, F.lit(False)) | F.coalesce(*([F.col("app_end") <= high] if high is not None else []), F.col("app_end") <= t, F.lit(False))
    lasts = F.coalesce(F.col("dis_crisp") > t, F.lit(False)) | F.coalesce(*([F.col("dis_begin") >= low] if low is not None else []), F.col("dis_begin") > t, F.lit(False))
    return bounds.where(possible(t)).select("elem", (begun & lasts).alias("sure"))


def versions_at(bounds: DataFrame, t: Column) -> DataFrame:
    """Attribute versions that may hold at t, and whether they do: sure unless a known fuzzy bound contradicts."""
    doubt = F.coalesce(~(F.col("app_end") <= t), F.lit(False)) | F.coalesce(~(F.col("dis_begin") > t), F.lit(False))
    return bounds.where(possible(t)).select("elem", (~doubt).alias("sure"))


def features(versions: DataFrame) -> DataFrame:
    """Snapshot features (lm, names, geometries, geometry) of landmarks with a geometry, from versions that hold (lm, attr_type, value)."""
    values = lambda kind: F.array_sort(F.collect_set(F.when(F.col("attr_type") == kind, F.col("value"))))
    out = versions.groupBy("lm").agg(values("Name").alias("names"), values("Geometry").alias("geometries")).where(F.size("geometries") > 0)
    several = F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join("geometries", ", "), F.lit(")"))
    return out.withColumn("geometry", F.when(F.size("geometries") == 1, F.col("geometries")[0]).otherwise(several))


def within_area(points: DataFrame, area: dict, x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose point lies in a GeoJSON area (validated), outside its holes: a semi join on the area's cells."""
    from chronolith.operators import spatial

    polygons = points.sparkSession.createDataFrame([(k, geo.polygon_wkt(rings)) for k, rings in enumerate(geo.area_polygons(area))], "poly int, wkt string")
    return spatial.points_within(points, polygons, x, y)


def boundary(crisp: Column, begin: Column, end: Column, precision: Column, calendar: Column) -> Column:
    """struct(kind, value, begin, end, precision, calendar): crisp, fuzzy, or null."""
    kind = F.when(crisp.isNotNull(), "crisp").when(begin.isNotNull() | end.isNotNull(), "fuzzy")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), crisp.alias("value"), F.when(crisp.isNull(), begin).alias("begin"), F.when(crisp.isNull(), end).alias("end"), precision.alias("precision"), calendar.alias("calendar")))


def place_on_line(crisp: Column, begin: Column, end: Column) -> Column:
    """Where a boundary stands on a timeline: crisp, the middle of both bounds (a day), or the one that is known."""
    from chronolith.functions.times import midpoint

    return F.when(crisp.isNotNull(), crisp).when(begin.isNotNull() & end.isNotNull(), F.date_trunc("day", midpoint(begin, end)).cast("timestamp_ntz")).otherwise(F.coalesce(begin, end))


def classified(crisp: Column, begin: Column, end: Column) -> Column:
    """crisp, fuzzy (both bounds), after, before, or infinite."""
    return F.when(crisp.isNotNull(), "crisp").when(begin.isNotNull() & end.isNotNull(), "fuzzy").when(begin.isNotNull(), "after").when(end.isNotNull(), "before").otherwise("infinite")


def timeline(versions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every version with its bounds, by begin (unknown begins first), then id: versions (av, lm, attr_type, value)."""
    b = bounds.withColumnRenamed("elem", "__elem")
    out = versions.join(b, F.col("av") == F.col("__elem"), "left").drop("__elem")
    return out.orderBy(F.coalesce("app_crisp", "app_begin", "app_end").asc_nulls_first(), "av")


def addresses_along(addresses: DataFrame, street: str, lang: str | None = None) -> DataFrame:
    """Addresses (label, lang, street) along a street, case aside."""
    own = addresses.where(F.lower("street") == street.lower())
    return own if lang is None else own.where(F.col("lang") == lang)


def provenance_of(facts: DataFrame, traces: DataFrame, provenances: DataFrame, sources: DataFrame) -> DataFrame:
    """(root, source, description) of facts through their traces."""
    p = provenances.select(F.col("elem").alias("__e"), F.col("source").alias("__s"))
    s = sources.select(F.col("source").alias("__id"), F.col("label").alias("source"), "description")
    return facts.join(traces.select(F.col("root").alias("__r"), "trace"), F.col("root") == F.col("__r")).join(p, F.col("trace") == F.col("__e")).join(s, F.col("__s") == F.col("__id")).select("root", "source", "description").distinct()


def coordinates_of(addresses: DataFrame, geometries: DataFrame, label: str) -> DataFrame:
    """(addr, geometry) of the targets of addresses (addr, target, label) with a label, case aside; geometries (lm, geometry)."""
    own = addresses.where(F.lower("label") == label.lower()).select("addr", "target").distinct()
    return own.join(geometries.select("lm", "geometry"), F.col("target") == F.col("lm")).select("addr", "geometry").distinct()


def existing_at(bounds: DataFrame, t: Column) -> DataFrame:
    """Entities (elem) with an appearance at t or before and no disappearance up to t; unknown ends count as lasting."""
    begun = F.coalesce("app_crisp", "app_end", "app_begin") <= t
    return bounds.where(begun & F.coalesce(F.coalesce("dis_crisp", "dis_begin", "dis_end") > t, F.lit(True))).select("elem")


def history(versions: DataFrame, bounds: DataFrame, attr_type: str) -> DataFrame:
    """(lm, n, av, value, begin, end): the versions of one attribute type of every landmark, numbered in time."""
    b = bounds.select(F.col("elem").alias("__elem"), F.coalesce("app_crisp", "app_begin", "app_end").alias("begin"), F.coalesce("dis_crisp", "dis_begin", "dis_end").alias("end"))
    own = versions.where(F.col("attr_type") == attr_type).select("lm", "av", "value").join(b, F.col("av") == F.col("__elem"), "left")
    order = Window.partitionBy("lm").orderBy(F.col("begin").asc_nulls_first(), "av")
    return own.select("lm", F.row_number().over(order).alias("n"), "av", "value", "begin", "end")


def history_of_changes(versions: DataFrame, bounds: DataFrame, attr_type: str) -> DataFrame:
    """(lm, stamp, outdates, makes): what a landmark's changes of one attribute type end and begin, by time."""
    own = history(versions, bounds, attr_type)
    ends = F.explode(F.array(F.struct(F.col("begin").alias("stamp"), F.lit(None).cast("string").alias("outdates"), F.col("av").alias("makes")), F.struct(F.col("end").alias("stamp"), F.col("av").alias("outdates"), F.lit(None).cast("string").alias("makes")))).alias("x")
    rows = own.select("lm", ends).select("lm", "x.*").where("stamp is not null")
    return rows.groupBy("lm", "stamp").agg(F.array_sort(F.collect_set("outdates")).alias("outdates"), F.array_sort(F.collect_set("makes")).alias("makes"))


def values_of(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(av, value) of a list of versions (av)."""
    return versions.join(wanted.select("av").distinct(), "av", "left_semi").select("av", "value")
