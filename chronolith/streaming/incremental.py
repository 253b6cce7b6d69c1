"""Incremental ingestion: versions that arrive in a stream re-derive the evolution of the attributes they touch.

An extension: each micro-batch appends new versions to the version table, and writes the evolution of touched
attributes only, as a new generation, in folders by a hash of the attribute; ``latest`` reads each attribute's newest one.  A batch that runs again after a
failure writes the same rows to the same folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolith.operators import evolution

#: Folders that attributes are dealt to.
BUCKETS = 64
VERSIONS = "attr string, av string, value string, `begin` timestamp_ntz, `end` timestamp_ntz, arrived timestamp"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("attr"), F.lit(BUCKETS)).cast("int")


def start(spark: SparkSession, source: str, target: str, delay: str = "1 hour", once: bool = True) -> StreamingQuery:
    """A query from a folder of JSON lines to ``target``; repeated deliveries within ``delay`` are dropped."""
    arriving = spark.readStream.schema(VERSIONS).json(source).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["av"])

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.drop("arrived").withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/versions/batch={number}")
        buckets = [r.bucket for r in batch.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS at most: history is read of these alone
        everything = session.read.option("basePath", f"{target}/versions").parquet(f"{target}/versions").where((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        touched = batch.select("attr").distinct()
        own = everything.join(touched, "attr", "left_semi").select("attr", "av", F.col("value").alias("vid"), "begin", "end")
        none = session.createDataFrame([], "attr string, stamp timestamp_ntz, precision int, cg string, makes array<string>, outdates array<string>")
        evolution.evolution(own, none).withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/evolution/batch={number}")

    query = arriving.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/progress")
    return (query.trigger(availableNow=True) if once else query).start()


def latest(spark: SparkSession, target: str, attributes: list[str] | None = None) -> DataFrame:
    """The newest evolution of each attribute, or of some, whose buckets alone are then read."""
    rows = spark.read.option("basePath", f"{target}/evolution").parquet(f"{target}/evolution")
    if attributes is not None:
        wanted = spark.createDataFrame([(a,) for a in attributes], "attr string").select(_bucket().alias("bucket")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r.bucket for r in wanted]) & F.col("attr").isin(attributes))
    newest = F.max("batch").over(Window.partitionBy("attr"))
    return rows.withColumn("__newest", newest).where("batch = __newest").drop("__newest", "batch", "bucket")


def windowed_counts(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events (ts timestamp, event_type) by window and type, late ones up to ``delay``: for a stream or a table."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
