"""The read surface: functions that give DataFrames, over tables of a final graph.

Tables: registry (g, role, is_active, label, lang); code (kind, code, label, lang); landmark (g, lm, type, label,
lang); relation (lr, type, locatum, relatum); version (av, lm, attr_type, value, x, y); landmark_bounds and
version_bounds (elem and the six bounds of ``operators.reading``).
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions import times
from chronolith.operators import graph, labels, reading
from chronolith.sources.config import Reading


class Service:
    def __init__(self, tables: dict[str, DataFrame], settings: Reading | None = None) -> None:
        self.tables, self.settings = tables, settings or Reading()

    def graphs(self) -> DataFrame:
        return graph.final_graphs(self.tables["registry"], self.settings.default_lang)

    def types(self, kind: str) -> DataFrame:
        """Codes of a kind (landmark types, attribute types) with labels in the language of the settings."""
        return self.tables["code"].where((F.col("kind") == kind) & (F.col("lang") == self.settings.default_lang)).select("code", "label")

    def landmarks(self, g: str, landmark_type: str | None = None) -> DataFrame:
        """Landmarks of a graph, with a relatum's label, in the language of the settings or none."""
        own = self.tables["landmark"].where((F.col("g") == g) & (F.col("lang").isNull() | (F.col("lang") == self.settings.default_lang)))
        shown = labels.displayed(own, self.tables["relation"])
        return shown if landmark_type is None else shown.join(own.where(F.col("type") == landmark_type).select("lm"), "lm", "left_semi")

    def search(self, g: str, query: str) -> DataFrame:
        return labels.search(self.landmarks(g), query, "label", "lm", self.settings.search_limit)

    def valid_time(self, lm: str) -> DataFrame:
        return self.tables["landmark_bounds"].where(F.col("elem") == lm).limit(1)

    def evolution(self, lm: str) -> DataFrame:
        """A landmark's versions with their boundaries, by begin."""
        rows = reading.timeline(self.tables["version"].where(F.col("lm") == lm), self.tables["version_bounds"])
        edge = lambda side: reading.boundary(*[F.col(f"{side}_{k}") for k in ("crisp", "begin", "end")], F.lit("day"), F.lit(self.settings.calendar))
        place = lambda side: reading.place_on_line(*[F.col(f"{side}_{k}") for k in ("crisp", "begin", "end")])
        return rows.select("av", "attr_type", "value", edge("app").alias("start"), edge("dis").alias("end"), place("app").alias("start_place"), place("dis").alias("end_place"))

    def snapshot(self, day: str, area: dict | None = None) -> DataFrame:
        """Features at a day: landmarks that may exist, whether surely, and the versions that hold; within an area if one is given."""
        t = datetime.date.fromisoformat(day)
        at = lambda y: F.lit(f"{y:04d}-{t.month:02d}-{min(t.day, 28):02d}" if y != t.year else day).cast("timestamp_ntz")
        low, high = t.year - self.settings.time_delay_years, t.year + self.settings.time_delay_years
        landmarks = reading.landmarks_at(self.tables["landmark_bounds"], at(t.year), at(low), at(high)).select(F.col("elem").alias("__lm"), F.col("sure").alias("exists_for_sure"))
        versions = self.tables["version"].join(reading.versions_at(self.tables["version_bounds"], at(t.year)).select(F.col("elem").alias("__av")), F.col("av") == F.col("__av"), "left_semi")
        if area is not None:
            inside = reading.within_area(versions.where("attr_type = 'Geometry'"), area).select("lm").distinct()
            versions = versions.join(inside, "lm", "left_semi")
        return reading.features(versions).join(landmarks, F.col("lm") == F.col("__lm")).drop("__lm")

    def time_labels(self, lm: str) -> DataFrame:
        """Sentences on a landmark's appearance and disappearance."""
        label = lambda c: times.time_label(F.col(c), F.lit("day"), self.settings.default_lang)
        return self.valid_time(lm).select(*[times.validity_label(s, label(f"{s}_crisp"), label(f"{s}_begin"), label(f"{s}_end"), self.settings.default_lang).alias(s) for s in ("app", "dis")])
