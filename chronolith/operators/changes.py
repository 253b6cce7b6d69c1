"""Changes, events and their times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.ids import signature


def missing_changes(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """Appearance and disappearance, each with an event, of elements (elem, kind) that lack them: (cg, ev, type, applied_to)."""
    wanted = elements.select(F.col("elem").alias("applied_to"), F.explode(F.array(F.concat("kind", F.lit("Appearance")), F.concat("kind", F.lit("Disappearance")))).alias("type"))
    new = wanted.join(changes.select("applied_to", "type").distinct(), ["applied_to", "type"], "left_anti")
    return new.select(signature("Change", "type", "applied_to").alias("cg"), signature("Event", "type", "applied_to").alias("ev"), "type", "applied_to")


def candidate_times(own: DataFrame, valid: DataFrame) -> DataFrame:
    """(ev, prop, t) from events' own times (ev, prop, t) and valid times of traces (ev, type, begin, end): a beginning bounds an appearance from above, an end a disappearance from below."""
    begins = valid.where(F.col("type").endswith("Appearance") & F.col("begin").isNotNull()).select("ev", F.lit("hasTimeBefore").alias("prop"), F.col("begin").alias("t"))
    ends = valid.where(F.col("type").endswith("Disappearance") & F.col("end").isNotNull()).select("ev", F.lit("hasTimeAfter").alias("prop"), F.col("end").alias("t"))
    return own.select("ev", "prop", "t").unionByName(begins).unionByName(ends).distinct()


def final_times(candidates: DataFrame) -> DataFrame:
    """Crisp times win; else the least upper and the largest lower bounds, all that tie."""
    one = Window.partitionBy("ev")
    rows = candidates.withColumn("crisp", F.max((F.col("prop") == "hasTime").cast("int")).over(one))
    order = F.when(F.col("prop") == "hasTimeAfter", -F.unix_micros(F.col("t").cast("timestamp"))).otherwise(F.unix_micros(F.col("t").cast("timestamp")))
    ranked = rows.withColumn("n", F.rank().over(Window.partitionBy("ev", "prop").orderBy(order)))
    keep = F.when(F.col("crisp") == 1, F.col("prop") == "hasTime").otherwise(F.col("n") == 1)
    return ranked.where(keep).select("ev", "prop", "t").distinct()


def fuzzy_instants(times: DataFrame) -> DataFrame:
    """(ev, t, fuzzy_begin, fuzzy_end) of events with bounds only: an instant for each pair of bounds."""
    bounds = times.groupBy("ev").agg(
        F.max(F.when(F.col("prop") == "hasTimeAfter", F.col("t"))).alias("fuzzy_begin"),
        F.min(F.when(F.col("prop") == "hasTimeBefore", F.col("t"))).alias("fuzzy_end"),
        F.max(F.when(F.col("prop") == "hasTime", F.col("t"))).alias("crisp"),
    )
    bounds = bounds.where("crisp is null and (fuzzy_begin is not null or fuzzy_end is not null)")
    return bounds.select("ev", signature("FuzzyTimeInstant", "fuzzy_begin", "fuzzy_end").alias("t"), "fuzzy_begin", "fuzzy_end")


def addresses(relations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(addr, target, label, lang, pos, segment) of street numbers that belong to thoroughfares."""
    number = landmarks.where("type = 'StreetNumber'").select(F.col("lm").alias("__n"), F.col("label").alias("n_label"))
    street = landmarks.where("type = 'Thoroughfare'").select(F.col("lm").alias("__s"), F.col("label").alias("s_label"), "lang")
    own = relations.where("type = 'Belongs'").join(number, F.col("locatum") == F.col("__n")).join(street, F.col("relatum") == F.col("__s"))
    steps = F.posexplode(F.array("locatum", "relatum")).alias("pos", "segment")
    return own.select(signature("Address", "locatum", "relatum").alias("addr"), F.col("locatum").alias("target"), F.concat("n_label", F.lit(", "), "s_label").alias("label"), "lang", steps)
