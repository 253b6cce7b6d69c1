"""State descriptions: JSON with landmarks, relations and addresses that hold in a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.ids import signature
from chronolith.sources.events_json import PROVENANCE, SOURCE, TIME, members

SPAN = f"struct<start: {TIME}, `end`: {TIME}>"
LANDMARK = f"struct<id: string, label: string, lang: string, type: string, attributes: map<string, struct<value: string, lang: string, datatype: string>>, provenance: {PROVENANCE}, time: {SPAN}>"
RELATION = "struct<id: string, type: string, locatum: string, relatum: string>"
ADDRESS = "struct<id: string, label: string, lang: string, target: string, segments: array<string>>"
SCHEMA = f"landmarks array<{LANDMARK}>, relations array<{RELATION}>, addresses array<{ADDRESS}>, time {SPAN}, source {SOURCE}"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def from_text(rows: DataFrame, column: str) -> dict[str, DataFrame]:
    return tables(rows.select(F.from_json(column, SCHEMA).alias("d")).select("d.*"))


def tables(descriptions: DataFrame) -> dict[str, DataFrame]:
    own = descriptions.withColumn("g", F.col("source.uri"))
    landmarks = own.select("g", F.col("time").alias("file_time"), F.explode("landmarks").alias("l")).withColumn("lm", signature("Landmark", "g", "l.id"))
    landmark = landmarks.select("g", "lm", F.coalesce("l.type", F.lit("Undefined")).alias("type"), "l.label", "l.lang", F.col("l.provenance.uri").alias("provenance"))
    # a landmark's own time counts, else the file's
    time = lambda side: F.coalesce(F.col(f"l.time.{side}"), F.col(f"file_time.{side}"))
    valid_time = landmarks.select("g", F.col("lm").alias("elem"), time("start").alias("start"), time("end").alias("end"))
    version = landmarks.select("g", "lm", F.explode("l.attributes").alias("name", "v"), time("start").alias("start"), time("end").alias("end"))
    kind = F.array_join(F.transform(F.split("name", "_"), F.initcap), "")
    version = version.select("g", "lm", signature("Attribute", "lm", kind).alias("attr"), kind.alias("attr_type"), signature("AttributeVersion", "lm", kind).alias("av"), "v.value", "v.lang", "v.datatype", "start", "end")
    relation = own.select("g", F.explode("relations").alias("r")).select("g", signature("LandmarkRelation", "g", "r.id").alias("lr"), "r.type", F.col("r.locatum").alias("l"), F.explode(members(F.col("r.relatum"))).alias("m"))
    relation = relation.select("g", "lr", "type", signature("Landmark", "g", "l").alias("locatum"), signature("Landmark", "g", "m").alias("relatum"))
    steps = own.select("g", F.explode("addresses").alias("a")).select("g", "a", F.posexplode("a.segments").alias("pos", "segment"))
    address = steps.select("g", signature("Address", "g", "a.id").alias("addr"), "a.label", "a.lang", signature("Landmark", "g", "a.target").alias("target"), "pos", signature("Landmark", "g", "segment").alias("segment"))
    # ids that relations or addresses name and no landmark has
    named = relation.select("g", F.col("locatum").alias("lm")).unionByName(relation.select("g", F.col("relatum").alias("lm"))).unionByName(address.select("g", F.col("target").alias("lm"))).unionByName(address.select("g", F.col("segment").alias("lm"))).distinct()
    undefined = named.join(landmark.select("lm"), "lm", "left_anti").select("g", "lm", F.lit("Undefined").alias("type"))
    return {"landmark": landmark, "valid_time": valid_time, "version": version, "relation": relation, "address": address, "undefined": undefined}
