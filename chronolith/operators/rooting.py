"""Reconciliation: traces of sources meet roots by signature; where no root has it, one is made.

Root ids are digests of signatures, so runs agree and no insert-on-miss loop is needed: a signature join with the
roots that exist, and the digest elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.ids import set_signature, signature

ROOTED_BY_LABEL = ("Municipality", "District", "PostalCodeArea", "Thoroughfare")
ROOTED_BY_RELATION = ("HouseNumber", "DistrictNumber", "StreetNumber")


def rooted(traces: DataFrame, trace: str, kind: str, key: list[str], roots: DataFrame | None = None, root: str = "root", ignore_null: bool = True) -> DataFrame:
    """``traces`` with a ``root`` column.

    key: columns that identify; roots: known ones (key columns and ``root``), of which the least id wins."""
    own = traces
    for c in key if ignore_null else []:
        own = own.where(F.col(c).isNotNull())
    made = signature(kind, *key)
    if roots is None:
        return own.withColumn("root", made)
    known = roots.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.min(root).alias("__root"))
    condition = None
    for c in key:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        condition = same if condition is None else condition & same
    return own.join(known, condition, "left").withColumn("root", F.coalesce("__root", made)).drop("__root", *[f"__{c}" for c in key])


def landmarks_by_label(landmarks: DataFrame, traced: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(trace, root, type, hidden_label, hidden_lang) of landmarks that are told by type and hidden label; ``traced`` (trace) are done already."""
    own = landmarks.where(F.col("type").isin(*ROOTED_BY_LABEL)).select(F.col("lm").alias("trace"), "type", "hidden_label", F.col("lang").alias("hidden_lang"))
    if traced is not None:
        own = own.join(traced.select("trace"), "trace", "left_anti")
    own = own.where("hidden_label is not null")
    if roots is None:
        return own.withColumn("root", signature("Landmark", "type", "hidden_label", "hidden_lang"))
    known = roots.groupBy(F.col("type").alias("__t"), F.col("hidden_label").alias("__h"), F.col("hidden_lang").alias("__l")).agg(F.min("root").alias("__root"))
    out = own.join(known, (F.col("type") == F.col("__t")) & (F.col("hidden_label") == F.col("__h")) & F.col("hidden_lang").eqNullSafe(F.col("__l")), "left")
    return out.select("trace", "type", "hidden_label", "hidden_lang", F.coalesce("__root", signature("Landmark", "type", "hidden_label", "hidden_lang")).alias("root"))


def landmarks_by_relation(landmarks: DataFrame, relations: DataFrame, container_roots: DataFrame) -> DataFrame:
    """Contained landmarks by (type, hidden label, relation's type, root of the relatum): trace, root, relation, relation_root."""
    own = landmarks.where(F.col("type").isin(*ROOTED_BY_RELATION) & F.col("hidden_label").isNotNull()).select("lm", F.col("type").alias("lm_type"), "hidden_label")
    links = relations.where(F.col("type") == "Belongs").select("lr", F.col("type").alias("lr_type"), "locatum", "relatum")
    containers = container_roots.select(F.col("trace").alias("__trace"), F.col("root").alias("relatum_root"))
    joined = own.join(links, F.col("lm") == F.col("locatum")).join(containers, F.col("relatum") == F.col("__trace"))
    root = signature("Landmark", "lm_type", "hidden_label", "lr_type", "relatum_root")
    return joined.select(F.col("lm").alias("trace"), root.alias("root"), F.col("lr").alias("relation"), signature("LandmarkRelation", "lr_type", root, "relatum_root").alias("relation_root"))


def relations_by_members(relations: DataFrame, landmark_roots: DataFrame) -> DataFrame:
    """(trace, root, type, locatum_root, relata) of relations (lr, type, locatum, relatum, a row each) by type, root of the locatum and set of roots of relata."""
    a = landmark_roots.select(F.col("trace").alias("__a"), F.col("root").alias("locatum_root"))
    b = landmark_roots.select(F.col("trace").alias("__b"), F.col("root").alias("relatum_root"))
    joined = relations.join(a, F.col("locatum") == F.col("__a")).join(b, F.col("relatum") == F.col("__b"))
    sets = joined.groupBy(F.col("lr").alias("trace"), "type", "locatum_root").agg(set_signature(F.collect_set("relatum_root")).alias("relata"))
    return sets.withColumn("root", signature("LandmarkRelation", "type", "locatum_root", "relata"))


def by_parent(rows: DataFrame, trace: str, kind: str, own: list[str], parent: str, parent_roots: DataFrame) -> DataFrame:
    """(trace, root, parent_root) by own columns and the root of a parent: attributes of landmarks, changes of what they apply to, events of changes."""
    p = parent_roots.select(F.col("trace").alias("__p"), F.col("root").alias("parent_root"))
    joined = rows.join(p, F.col(parent) == F.col("__p"))
    return joined.select(F.col(trace).alias("trace"), *own, "parent_root", signature(kind, *own, "parent_root").alias("root")).distinct()


def instants(times: DataFrame) -> DataFrame:
    """(trace, root, ...) of crisp instants by stamp, precision and calendar."""
    return times.select(F.col("t").alias("trace"), "stamp", "precision", "calendar", signature("CrispTimeInstant", "stamp", "precision", "calendar").alias("root"))


def pairs_of_times(pairs: DataFrame, kind: str, roots: DataFrame) -> DataFrame:
    """(trace, root, begin_root, end_root) of fuzzy instants or intervals (t, begin, end) by the roots of their ends, either of which may lack."""
    b = roots.select(F.col("trace").alias("__b"), F.col("root").alias("begin_root"))
    e = roots.select(F.col("trace").alias("__e"), F.col("root").alias("end_root"))
    joined = pairs.join(b, F.col("begin") == F.col("__b"), "left").join(e, F.col("end") == F.col("__e"), "left")
    return joined.select(F.col("t").alias("trace"), "begin_root", "end_root", signature(kind, "begin_root", "end_root").alias("root"))


def transferred(traces: DataFrame, values: DataFrame, columns: list[str], key: str = "elem") -> DataFrame:
    """Values of traces (key, columns) as values of their roots: a set."""
    return traces.select("root", "trace").join(values.select(F.col(key).alias("__k"), *columns), F.col("trace") == F.col("__k")).select("root", *columns).distinct()


def collapsed(quads: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Statements with old ids (old, new) rewritten, as subject and object."""
    a = duplicates.select(F.col("old").alias("__s"), F.col("new").alias("__new_s"))
    b = duplicates.select(F.col("old").alias("__o"), F.col("new").alias("__new_o"))
    out = quads.join(a, F.col("s") == F.col("__s"), "left").join(b, F.col("o") == F.col("__o"), "left")
    return out.select("g", F.coalesce("__new_s", "s").alias("s"), "p", F.coalesce("__new_o", "o").alias("o")).distinct()


def hashed(*columns: Column | str) -> Column:
    return signature("Resource", *columns)
