"""Tabular and geographic files, and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import geo, text, times
from chronolith.functions.ids import signature

# fixed values: columns of the national address file and of house-number files
BAN = "id string, id_fantoir string, numero string, rep string, nom_voie string, code_postal string, code_insee string, nom_commune string, lon double, lat double"
HOUSE_NUMBERS = "houseNumberGeomWKT string, houseNumberId string, houseNumberLabel string"
HOUSE_NUMBER_CONTEXT = "houseNumberId string, streetId string, streetName string, arrdtId string, arrdtName string, arrdtInsee string"
# fixed values: columns of the linked-data export
LINKED_DATA = "landmarkId string, landmarkType string, nomOff string, lang string, timeType string, timeStamp string, timePrec int, timeCal string, statement string"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV file by header names, in any order of columns; a byte-order mark is dropped."""
    fields = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def last_row_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row for each key, the last by ordinal; rows without a key stay."""
    columns = rows.columns
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))
    keyed = rows.where(F.col(key).isNotNull()).withColumn("__n", n).where("__n = 1").select(*columns)
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def address_file(rows: DataFrame, source: str) -> dict[str, DataFrame]:
    """Street numbers, thoroughfares, districts and postal areas of the national address file, each once by label."""
    own = rows.select(F.concat(F.col("numero"), F.coalesce("rep", F.lit(""))).alias("number"), "nom_voie", "nom_commune", "code_postal", "code_insee", F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")).alias("geometry"), "id")
    sn, th, di, pc = signature("StreetNumber", F.lit(source), "id"), signature("Thoroughfare", F.lit(source), "nom_voie"), signature("District", F.lit(source), "nom_commune"), signature("PostalCodeArea", F.lit(source), "code_postal")
    kind = lambda lm, type_, label, lang, geometry=None: own.select(lm.alias("lm"), F.lit(type_).alias("type"), F.col(label).alias("label"), F.lit(lang).cast("string").alias("lang"), (F.col(geometry) if geometry else F.lit(None).cast("string")).alias("geometry")).dropDuplicates(["lm"])
    landmark = kind(sn, "StreetNumber", "number", None, "geometry").unionByName(kind(th, "Thoroughfare", "nom_voie", "fr")).unionByName(kind(di, "District", "nom_commune", "fr")).unionByName(kind(pc, "PostalCodeArea", "code_postal", None))
    pair = lambda type_, a, b: own.select(F.lit(type_).alias("type"), a.alias("locatum"), b.alias("relatum"))
    relation = pair("Belongs", sn, th).unionByName(pair("Within", sn, di)).unionByName(pair("Within", sn, pc)).distinct().withColumn("lr", signature("LandmarkRelation", "type", "locatum", "relatum"))
    address = own.select(sn.alias("target"), F.concat("number", F.lit(" "), "nom_voie", F.lit(", "), "code_postal", F.lit(" "), "nom_commune").alias("label"))
    return {"landmark": landmark, "relation": relation, "address": address}


def house_number_files(numbers: DataFrame, context: DataFrame, source: str) -> dict[str, DataFrame]:
    """Street numbers with their streets and districts, of two files that share an id; ids, not labels, tell things apart."""
    own = numbers.join(context, "houseNumberId")
    parts = [("StreetNumber", "houseNumberId", "houseNumberLabel", None, "houseNumberGeomWKT"), ("Thoroughfare", "streetId", "streetName", "fr", None), ("District", "arrdtId", "arrdtName", "fr", None)]
    landmark = None
    for type_, key, label, lang, geometry in parts:
        part = own.select(signature(type_, F.lit(source), key).alias("lm"), F.lit(type_).alias("type"), F.col(label).alias("label"), F.lit(lang).cast("string").alias("lang"), (F.col(geometry) if geometry else F.lit(None).cast("string")).alias("geometry")).dropDuplicates(["lm"])
        landmark = part if landmark is None else landmark.unionByName(part)
    sn = signature("StreetNumber", F.lit(source), "houseNumberId")
    relation = own.select(F.lit("Belongs").alias("type"), sn.alias("locatum"), signature("Thoroughfare", F.lit(source), "streetId").alias("relatum")).unionByName(own.select(F.lit("Within").alias("type"), sn.alias("locatum"), signature("District", F.lit(source), "arrdtId").alias("relatum"))).distinct()
    return {"landmark": landmark, "relation": relation}


def street_nomenclature(rows: DataFrame, source: str, name: str, start: str | None, end: str | None, areas: list[str]) -> dict[str, DataFrame]:
    """Streets of a city's list: areas from multi-valued cells, and an event for each date that is given."""
    lm = signature("Thoroughfare", F.lit(source), name)
    landmark = rows.select(lm.alias("lm"), F.lit("Thoroughfare").alias("type"), F.col(name).alias("label"), F.lit("fr").alias("lang")).dropDuplicates(["lm"])
    within = None
    for area in areas:
        part = rows.select(lm.alias("locatum"), F.explode(text.split_cell(F.col(f"`{area}`"))).alias("area")).select(F.lit("Within").alias("type"), "locatum", signature("District", F.lit(source), "area").alias("relatum"), "area")
        within = part if within is None else within.unionByName(part)
    event = None
    for column, change in ((start, "LandmarkAppearance"), (end, "LandmarkDisappearance")):
        if column:
            stamp = times.canonical_stamp(F.col(f"`{column}`"))
            part = rows.select(lm.alias("applied_to"), F.lit(change).alias("type"), stamp.alias("stamp")).where("stamp is not null")
            event = part if event is None else event.unionByName(part)
    return {"landmark": landmark, "relation": within, "event": event}


def linked_data_events(rows: DataFrame) -> DataFrame:
    """One event for each row of the linked-data export: a start is an appearance, an end a disappearance."""
    known = times.precision_of(F.col("timePrec"))
    start = F.col("timeType") == "start"
    return rows.select("landmarkId", "landmarkType", F.col("nomOff").alias("label"), "lang", times.canonical_stamp(F.col("timeStamp")).alias("stamp"), known.alias("precision"), times.calendar_of(F.col("timeCal")).alias("calendar"), F.when(start, "LandmarkAppearance").otherwise("LandmarkDisappearance").alias("type"), F.when(start, F.array("nomOff")).otherwise(F.array().cast("array<string>")).alias("makes_effective"), F.when(start, F.array().cast("array<string>")).otherwise(F.array("nomOff")).alias("outdates"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, properties as text map, wkt) of a feature collection's features."""
    schema = "features array<struct<properties: map<string, string>, geometry: string>>, crs struct<properties: struct<name: string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.coalesce(geo.crs_uri(F.col("crs.properties.name")), F.lit(geo.CRS_PREFIX + "EPSG/0/4326")).alias("crs"), F.posexplode("features").alias("ordinal", "f")).select("ordinal", "crs", "f.properties", geo.geojson_to_wkt(F.col("f.geometry")).alias("wkt"))


def merged_features(features: DataFrame, key: str, null_is_one_group: bool = True) -> DataFrame:
    """Features of one identity: all their geometries in order, and the first one's properties; without a key, one group or each apart."""
    identity = F.col("properties")[key]
    group = identity if null_is_one_group else F.coalesce(F.nullif(identity, F.lit("")), F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    out = features.withColumn("__group", group).groupBy("__group", "crs").agg(F.min("ordinal").alias("ordinal"), F.min_by("properties", "ordinal").alias("properties"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "wkt"))), lambda x: x["wkt"]).alias("geometries"))
    one = F.when(F.size("geometries") == 1, F.col("geometries")[0]).otherwise(F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join("geometries", ", "), F.lit(")")))
    return out.withColumn("wkt", one).drop("__group")


def dissolved_features(features: DataFrame, key: str, null_is_one_group: bool = True) -> DataFrame:
    """``merged_features`` with geometries dissolved: polygons that overlap or touch become one without inner borders."""
    from chronolith.operators import spatial

    merged = merged_features(features, key, null_is_one_group)
    one = spatial.unions(merged.select(F.col("ordinal").alias("g"), F.explode("geometries").alias("wkt"))).select(F.col("g").alias("__g"), F.col("wkt").alias("__wkt"))
    return merged.join(one, F.col("ordinal") == F.col("__g"), "left").withColumn("wkt", F.col("__wkt")).drop("__g", "__wkt")


def street_number_features(features: DataFrame, number: str | None, street: str | None, address: str | None = None) -> DataFrame:
    """(number, street, wkt) from two label columns, or from one address that is split."""
    if address:
        n, s = text.split_address(F.col("properties")[address])
    else:
        n, s = F.col("properties")[number], F.col("properties")[street]
    return features.select(n.alias("number"), s.alias("street"), "wkt")


def write_graph(quads: DataFrame, path: str, mode: str = "append") -> None:
    """Statements, a folder for each graph."""
    quads.write.mode(mode).partitionBy("g").parquet(path)


def replace_graphs(quads: DataFrame, path: str) -> None:
    """Graphs in ``quads`` in place of those written before; others stay."""
    quads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(path)


def read_graphs(spark: SparkSession, path: str, graphs: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if graphs is None else rows.where(F.col("g").isin(graphs))


def write_lines(lines: DataFrame, path: str) -> None:
    """A text sink of one column."""
    lines.write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_json_lines(rows: DataFrame) -> DataFrame:
    """A JSON text for each row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def safe_name(value: str) -> str:
    """A table or folder name of a graph's name."""
    return re.sub(r"\W+", "_", value).strip("_").lower()


def described(**columns: Column) -> Column:
    """A description: a JSON object without its null fields."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "true"})


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns of one file format under the names that the readers know."""
    return rows.withColumnsRenamed(names)


# fixed values: columns of a city's lists of streets, by list and file format, and the names that ``street_nomenclature`` takes
STREET_COLUMNS = {
    ("current", "csv"): {"Identifiant": "id", "Dénomination complète minuscule": "name", "Date de l'arrété": "start", "Arrondissement": "borough", "Quartier": "district", "geo_shape": "geometry"},
    ("current", "json"): {"id": "id", "typo_min": "name", "date_arret": "start", "arrdt": "borough", "quartier": "district", "geometry": "geometry"},
    ("obsolete", "csv"): {"Identifiant": "id", "Dénomination complète minuscule": "name", "Date de l'arrêté": "start", "Date de caducité": "end", "Arrondissement": "borough", "Quartier": "district"},
    ("obsolete", "json"): {"id": "id", "typo_min": "name", "date_arret": "start", "date_voie_ancienne": "end", "arrdt": "borough", "quartier": "district"},
}


def street_list(rows: DataFrame, source: str, which: str, file_format: str) -> dict[str, DataFrame]:
    """Streets of a city's list of current or obsolete streets, in either file format."""
    names = STREET_COLUMNS[which, file_format]
    absent = [c for c in names if c not in rows.columns and names[c] != "geometry"]
    if absent:
        raise ValueError(f"no column {absent[0]!r} in a {file_format} list of {which} streets")
    own = renamed(rows.select(*[F.col(f"`{c}`") for c in names if c in rows.columns]), names)
    return street_nomenclature(own, source, "name", "start", "end" if which == "obsolete" else None, ["borough", "district"])


def of_families(parts: dict[str, DataFrame], sides: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Landed extracts of several families of entities as one table, a row for each side of their time: (family, side, ...)."""
    out = None
    for family, rows in parts.items():
        own = rows.select(F.lit(family).alias("family"), F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"), "*")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def landmarks_of(sources: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Landmarks (g, lm, type, label, lang) of the tables that each source's reader gave, g being the source."""
    out = None
    for name, tables in sources.items():
        own = tables["landmark"].select(F.lit(name).alias("g"), "lm", "type", "label", "lang")
        out = own if out is None else out.unionByName(own)
    return out


def address_table(parts: list[DataFrame], source: str = "2154", target: str = "2154") -> DataFrame:
    """Street numbers (source, number, street, wkt) of several files as points (source, number, street, x, y) in one reference system."""
    out = None
    for rows in parts:
        out = rows if out is None else out.unionByName(rows)
    placed = out.withColumn("__at", geo.centroid("wkt"))
    return placed.withColumn("__at", geo.reprojected(F.col("__at"), source, target)).select("source", "number", "street", F.col("__at.x").alias("x"), F.col("__at.y").alias("y"))
