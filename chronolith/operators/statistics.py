"""Statistics over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def landmarks_by_graph(landmarks: DataFrame, by_type: bool = False) -> DataFrame:
    return landmarks.groupBy("g", *["type"] * by_type).agg(F.count_distinct("lm").alias("landmarks"))


def most_versions(versions: DataFrame, most: int) -> DataFrame:
    """Landmarks with the most different versions of one attribute type: a top-k report."""
    return versions.groupBy("lm").agg(F.count_distinct("av").alias("versions")).orderBy(F.desc("versions"), "lm").limit(most)


def longest_valid(bounds: DataFrame, most: int) -> DataFrame:
    """Versions (av, lm, six bounds) that hold longest, in days: a top-k report."""
    start = F.coalesce("app_crisp", "app_end", "app_begin")
    end = F.coalesce("dis_crisp", "dis_begin", "dis_end")
    return bounds.select("lm", "av", F.datediff(end, start).alias("days")).where("days is not null").orderBy(F.desc("days"), "av").limit(most)


def alive_by_year(spans: DataFrame, first: int, last: int) -> DataFrame:
    """(year, n): elements (elem, start, end) that exist in each year, by a running sum of begins less ends, so long spans cost two rows each."""
    from pyspark.sql import Window

    clipped = spans.where("start is not null").select(F.greatest(F.year("start"), F.lit(first)).alias("a"), F.least(F.coalesce(F.year("end"), F.lit(last)), F.lit(last)).alias("b")).where("a <= b")
    steps = clipped.select(F.explode(F.array(F.struct(F.col("a").alias("year"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("year"), F.lit(-1).alias("step")))).alias("x")).groupBy("x.year").agg(F.sum("x.step").alias("step"))
    years = spans.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    run = Window.orderBy("y")  # a row for each year
    return years.join(steps, F.col("y") == F.col("year"), "left").select(F.col("y").alias("year"), F.sum(F.coalesce("step", F.lit(0))).over(run).alias("n"))


def statements_by_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("statements"))
