"""Event descriptions: JSON with a source and events on landmarks and their relations.

``read`` gives typed tables; ids come from the file's source and the place of an element in it, so a second read
gives the same ones.  Malformed events go to ``rejected`` with a reason, and to no other table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.ids import signature

TIME = "struct<stamp: string, calendar: string, precision: string>"
VALUES = "array<struct<value: string, lang: string, datatype: string>>"
CHANGE = f"struct<`on`: string, type: string, attribute: string, makes_effective: {VALUES}, outdates: {VALUES}>"
PROVENANCE = "struct<uri: string>"
LANDMARK = f"struct<id: string, label: string, lang: string, type: string, changes: array<{CHANGE}>>"
RELATION = f"struct<id: string, type: string, locatum: string, relatum: string, changes: array<{CHANGE}>, change: array<{CHANGE}>>"
EVENT = f"struct<time: {TIME}, label: string, lang: string, landmarks: array<{LANDMARK}>, relations: array<{RELATION}>, provenance: {PROVENANCE}>"
SOURCE = "struct<uri: string, label: string, lang: string, comment: string, publisher: struct<uri: string, label: string>>"
SCHEMA = f"source {SOURCE}, events array<{EVENT}>"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables(spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def from_text(rows: DataFrame, column: str) -> dict[str, DataFrame]:
    """The same from a column of JSON texts, one description each."""
    return tables(rows.select(F.from_json(column, SCHEMA).alias("d")).select("d.*"))


def members(relatum: F.Column) -> F.Column:
    """A relatum may be one id or a list of them, which a string field reads as text."""
    listed = F.from_json(relatum, "array<string>")
    return F.when(relatum.startswith("["), listed).otherwise(F.array(relatum))


def tables(descriptions: DataFrame) -> dict[str, DataFrame]:
    events = descriptions.select("source", F.posexplode("events").alias("n", "e")).withColumn("ev", signature("Event", "source.uri", "n"))
    wrong = F.when(F.col("e").isNull(), "not an event").when(F.col("e.landmarks").isNull() & F.col("e.relations").isNull(), "neither landmarks nor relations are lists")
    rejected = events.where(wrong.isNotNull()).select("ev", wrong.alias("reason"))
    events = events.where(wrong.isNull())
    event = events.select("ev", "e.label", "e.lang", F.col("e.time.stamp").alias("stamp"), F.col("e.time.calendar").alias("calendar"), F.col("e.time.precision").alias("precision"), F.col("e.provenance.uri").alias("provenance"), F.col("source.uri").alias("source"))
    landmarks = events.select("ev", F.col("source.uri").alias("g"), F.explode("e.landmarks").alias("l")).withColumn("lm", signature("Landmark", "ev", "l.id"))
    landmark = landmarks.select("g", "lm", "l.type", "l.label", "l.lang")
    changes = landmarks.select("ev", "lm", F.posexplode("l.changes").alias("k", "c"))
    cg = signature("Change", "ev", "lm", "k")
    kind = F.initcap("c.type")
    change = changes.select(
        cg.alias("cg"),
        F.when(F.col("c.on") == "landmark", F.concat(F.lit("Landmark"), kind)).otherwise("AttributeVersionTransition").alias("type"),
        F.when(F.col("c.on") == "landmark", F.col("lm")).otherwise(signature("Attribute", "lm", F.initcap("c.attribute"))).alias("applied_to"),
        "ev",
        "lm",
        F.initcap("c.attribute").alias("attribute"),
    )
    sides = F.array(F.struct(F.lit("makesEffective").alias("side"), F.col("c.makes_effective").alias("v")), F.struct(F.lit("outdates").alias("side"), F.col("c.outdates").alias("v")))
    version = changes.where("c.on = 'attribute'").select(cg.alias("cg"), "lm", F.initcap("c.attribute").alias("attribute"), F.explode(sides).alias("s")).select("cg", "lm", "attribute", "s.side", F.explode("s.v").alias("v"))
    version = version.select(signature("AttributeVersion", "lm", "attribute", "v.value", "v.lang").alias("av"), "cg", "side", signature("Attribute", "lm", "attribute").alias("attr"), "attribute", "v.value", "v.lang", "v.datatype")
    relations = events.select("ev", F.explode("e.relations").alias("r")).withColumn("lr", signature("LandmarkRelation", "ev", "r.id"))
    relation = relations.select("lr", "r.type", signature("Landmark", "ev", "r.locatum").alias("locatum"), F.explode(members(F.col("r.relatum"))).alias("m"), "ev").select("lr", "type", "locatum", signature("Landmark", "ev", "m").alias("relatum"))
    relation_change = relations.select("ev", "lr", F.posexplode(F.coalesce("r.changes", "r.change")).alias("k", "c")).select(signature("Change", "ev", "lr", "k").alias("cg"), F.concat(F.lit("LandmarkRelation"), F.initcap("c.type")).alias("type"), F.col("lr").alias("applied_to"), "ev")
    source = descriptions.select("source.uri", "source.label", "source.lang", "source.comment", F.col("source.publisher.uri").alias("publisher"), F.col("source.publisher.label").alias("publisher_label"))
    return {"event": event, "landmark": landmark, "change": change, "version": version, "relation": relation, "relation_change": relation_change, "source": source, "rejected": rejected}
