"""The fact graph, built from sources in steps whose results are tables; a build may resume at any step.

Input tables: landmark (g, lm, type, label, lang); relation (g, lr, type, locatum, relatum); version (g, lm, attr,
attr_type, av, value, lang, begin, end); change (g, attr, stamp, precision, cg, makes, outdates); event_time (ev,
prop, t, applied_to, type); registry (g, role, is_active, label, lang).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import times
from chronolith.functions.ids import signature
from chronolith.operators import changes, compare, evolution, graph, labels, rooting
from chronolith.sources.config import Comparison

INPUTS = ("landmark", "relation", "version", "change", "event_time", "registry")


class Build:
    """Steps in order; each reads tables, the input's or earlier steps', and writes its own."""

    STEPS = ("labels", "landmark_roots", "relation_roots", "attribute_roots", "root_labels", "time_roots", "change_roots", "event_roots", "values", "event_times", "fuzzy_times", "facts", "fact_times", "addresses")

    def __init__(self, spark: SparkSession, path: str, inputs: dict[str, DataFrame], excluded: list[str] | None = None, settings: Comparison | None = None, compat: bool = False) -> None:
        if set(INPUTS) - set(inputs):
            raise ValueError(f"inputs lack {sorted(set(INPUTS) - set(inputs))}")
        self.spark, self.path, self.excluded, self.settings, self.compat = spark, path.rstrip("/"), excluded or [], settings or Comparison(), compat
        # only active sources that aren't excluded take part
        self.inputs = {k: graph.in_active_sources(v, inputs["registry"], self.excluded) if "g" in v.columns and k != "registry" else v for k, v in inputs.items()}

    def table(self, name: str) -> DataFrame:
        return self.inputs[name] if name in self.inputs else self.spark.read.parquet(f"{self.path}/{name}")

    def run(self, start_step: str | int = 0) -> None:
        start = self.STEPS.index(start_step) if isinstance(start_step, str) else start_step
        for step in self.STEPS[start:]:
            getattr(self, step)().write.mode("overwrite").parquet(f"{self.path}/{step}")

    def labels(self) -> DataFrame:
        return labels.with_labels(self.table("landmark"), self.compat)

    def landmark_roots(self) -> DataFrame:
        own = self.table("labels")
        by_label = rooting.landmarks_by_label(own).select("trace", "root")
        by_relation = rooting.landmarks_by_relation(own, self.table("relation"), by_label).groupBy("trace").agg(F.min("root").alias("root"))
        return by_label.unionByName(by_relation.join(by_label.select("trace"), "trace", "left_anti"))

    def relation_roots(self) -> DataFrame:
        return rooting.relations_by_members(self.table("relation"), self.table("landmark_roots"))

    def attribute_roots(self) -> DataFrame:
        attributes = self.table("version").select("attr", "attr_type", "lm").distinct()
        return rooting.by_parent(attributes, "attr", "Attribute", ["attr_type"], "lm", self.table("landmark_roots"))

    def root_labels(self) -> DataFrame:
        """Labels of roots: (root, kind, label)."""
        own = self.table("labels").select(F.col("lm").alias("trace"), "label", "pref_label")
        traces = self.table("landmark_roots").join(own, "trace").select("root", "pref_label", "label")
        return labels.root_labels(traces.select("root").distinct().withColumn("label", F.lit(None).cast("string")), traces)

    def time_roots(self) -> DataFrame:
        """Roots of the instants that event times and changes use."""
        stamps = self.table("event_time").select(F.col("t").alias("stamp"), F.lit("day").alias("precision")).unionByName(self.table("change").select("stamp", F.coalesce(times.precision_of(F.col("precision")), F.lit("day")).alias("precision")))
        own = stamps.where("stamp is not null").distinct().withColumn("calendar", F.lit("gregorian")).withColumn("t", signature("TimeInstant", "stamp", "precision", "calendar"))
        return rooting.instants(own)

    def change_roots(self) -> DataFrame:
        """Roots of stated appearances and disappearances, by type and root of what they apply to."""
        roots = self.table("landmark_roots").select("trace", "root").unionByName(self.table("relation_roots").select("trace", "root"))
        changes_ = self.table("event_time").select(signature("Change", "ev", "type", "applied_to").alias("cg"), "ev", "type", "applied_to").distinct()
        return rooting.by_parent(changes_, "cg", "Change", ["type"], "applied_to", roots).join(changes_.select(F.col("cg").alias("trace"), "ev"), "trace")

    def event_roots(self) -> DataFrame:
        """One root event for each root change."""
        return rooting.by_parent(self.table("change_roots").select("ev", "trace"), "ev", "Event", [], "trace", self.table("change_roots"))

    def values(self) -> DataFrame:
        """Versions with the value that each is compared by."""
        v = self.table("version").select("lm", "attr", "attr_type", "av", "value", "lang")
        types = self.table("landmark").select(F.col("lm").alias("__lm"), F.col("type").alias("lm_type")).distinct()
        roots = self.table("attribute_roots").select(F.col("trace").alias("__attr"), "root")
        own = v.join(types, F.col("lm") == F.col("__lm")).join(roots, F.col("attr") == F.col("__attr"))
        return compare.valued(own.select("root", F.col("lm").alias("trace"), "av", "attr_type", "lm_type", "value", "lang"), self.settings.geom_max_distance)

    def comparisons(self) -> DataFrame:
        """All pairs of versions of a root's traces, for readers who want them; facts compare neighbours only."""
        return compare.compared(self.table("values").drop("vid", *compare.VALUE), self.settings.geom_similarity_coef, self.settings.geom_max_distance)

    def event_times(self) -> DataFrame:
        """Crisp times or bounds of the events of roots: those that exist and those that every root lacks."""
        known = self.table("change_roots").select(F.col("trace").alias("__cg"), "type", F.col("parent_root").alias("applied_to"), "ev")
        events = self.table("event_roots").select(F.col("trace").alias("__ev"), F.col("root").alias("event_root")).distinct()
        known = known.join(events, F.col("ev") == F.col("__ev"))
        given = self.table("event_time").select(F.col("ev").alias("__e"), F.col("type").alias("__type"), "prop", "t").join(known, (F.col("__e") == F.col("ev")) & (F.col("__type") == F.col("type"))).select(F.col("event_root").alias("ev"), "prop", "t")
        landmark_roots, relation_roots = self.table("landmark_roots").select("trace", "root"), self.table("relation_roots").select("root")
        elements = landmark_roots.select(F.col("root").alias("elem"), F.lit("Landmark").alias("kind")).unionByName(relation_roots.select(F.col("root").alias("elem"), F.lit("LandmarkRelation").alias("kind"))).distinct()
        missing = changes.missing_changes(elements, known.select("applied_to", "type"))
        valid = self.table("version").join(landmark_roots, F.col("lm") == F.col("trace")).select("root", "begin", "end")
        every = missing.select("ev", "type", "applied_to").unionByName(known.select(F.col("event_root").alias("ev"), "type", "applied_to").distinct())
        bounds = every.join(valid, F.col("applied_to") == F.col("root")).select("ev", "type", "begin", "end")
        return changes.final_times(changes.candidate_times(given, bounds))

    def fuzzy_times(self) -> DataFrame:
        """An instant for each pair of bounds."""
        return changes.fuzzy_instants(self.table("event_times"))

    def facts(self) -> DataFrame:
        """Coherent versions of root attributes; versions are compared where they are neighbours in time."""
        roots = self.table("attribute_roots").select("trace", "root")
        values = self.table("values")
        own = self.table("version").join(values.select(F.col("av").alias("__av"), "vid"), F.col("av") == F.col("__av"))
        versions = own.join(roots, F.col("attr") == F.col("trace")).select(F.col("root").alias("attr"), "av", "begin", "end", "vid")
        stated = self.table("change").join(roots, F.col("attr") == F.col("trace")).select(F.col("root").alias("attr"), "stamp", "precision", "cg", "makes", "outdates")
        return evolution.evolution(versions, stated, compare.judged(values, self.settings.geom_similarity_coef, self.settings.geom_max_distance))

    def fact_times(self) -> DataFrame:
        """Times of the changes between facts."""
        return evolution.event_times(self.table("facts"))

    def addresses(self) -> DataFrame:
        return changes.addresses(self.table("relation"), self.table("landmark"))
