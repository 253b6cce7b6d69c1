"""Quality of reconstructed versions and changes against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version_sources(rows: DataFrame, ignored: str | None = None) -> DataFrame:
    """(label, version, sources): the set of sources of each version, as one text, but for an ignored source."""
    own = rows if ignored is None else rows.where(F.col("source") != ignored)
    return own.groupBy("label", "version").agg(F.concat_ws("|", F.array_sort(F.collect_set("source"))).alias("sources"))


def version_quality(reference: DataFrame, modified: DataFrame) -> DataFrame:
    """(label, n_ref, n_mod, shared, right, iou) of version sets by label, on all labels of either side.

    Right: as many versions on both sides, and each source set has its counterpart."""
    a = reference.groupBy("label", "sources").agg(F.count(F.lit(1)).alias("a")).alias("a")
    b = modified.groupBy("label", "sources").agg(F.count(F.lit(1)).alias("b")).alias("b")
    both = a.join(b, ["label", "sources"], "full")
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = both.groupBy("label").agg(n("a").alias("n_ref"), n("b").alias("n_mod"), F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("shared"))
    total = F.col("n_ref") + F.col("n_mod") - F.col("shared")
    return out.select("label", "n_ref", "n_mod", "shared", ((F.col("n_ref") == F.col("n_mod")) & (F.col("shared") == F.col("n_ref"))).alias("right"), (F.col("shared") / total).alias("iou"))


def overall(quality: DataFrame) -> DataFrame:
    return quality.agg(F.count_if("right").alias("n_right"), F.count_if(~F.col("right")).alias("n_wrong"), F.count(F.lit(1)).alias("n_labels"), F.sum("shared").alias("shared"), (F.sum("shared") / F.sum(F.col("n_ref") + F.col("n_mod") - F.col("shared"))).alias("iou"))


def change_quality(reference: DataFrame, modified: DataFrame) -> DataFrame:
    """(label, preserved, strict, consistent) of changes (label, change, day, before_day, after_day).

    Preserved: as many changes. Strict: every modified change has a reference change of the same time or bounds.
    Consistent: every one has a reference change whose time or bounds allow it.  A label that the reference lacks
    fails all three."""
    both = modified.groupBy("label").agg(F.count(F.lit(1)).alias("n_mod")).join(reference.groupBy(F.col("label").alias("__l")).agg(F.count(F.lit(1)).alias("n_ref")), F.col("label") == F.col("__l"), "left")
    r = reference.select(F.col("label").alias("__label"), F.col("day").alias("r_day"), F.col("before_day").alias("r_before"), F.col("after_day").alias("r_after"))
    pairs = modified.join(r, F.col("label") == F.col("__label"), "left")
    strict = F.when(F.col("day").isNotNull(), F.col("day") == F.col("r_day")).otherwise(F.col("r_day").isNull() & F.col("before_day").eqNullSafe(F.col("r_before")) & F.col("after_day").eqNullSafe(F.col("r_after")))
    inside = F.coalesce(F.col("day") <= F.col("r_before"), F.lit(True)) & F.coalesce(F.col("day") >= F.col("r_after"), F.lit(True)) & (F.col("r_before").isNotNull() | F.col("r_after").isNotNull())
    found = F.col("__label").isNotNull()
    consistent = F.coalesce(strict, F.lit(False)) | (F.col("day").isNotNull() & F.col("r_day").isNull() & inside)
    each = pairs.groupBy("label", "change").agg(F.bool_or(found & F.coalesce(strict, F.lit(False))).alias("s"), F.bool_or(found & F.coalesce(consistent, F.lit(False))).alias("c")).groupBy("label").agg(F.bool_and("s").alias("strict"), F.bool_and("c").alias("consistent")).withColumnRenamed("label", "__each")
    return both.join(each, F.col("label") == F.col("__each")).select("label", F.coalesce(F.col("n_mod") == F.col("n_ref"), F.lit(False)).alias("preserved"), "strict", "consistent")


def sampled(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A share of rows by a hash of their key: the same rows on every run and partitioning."""
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def near_point(x, y, radius: float, key, seed: int = 0):
    """A point at random, by key, within a radius."""
    u = lambda salt: F.pmod(F.xxhash64(key, F.lit(seed + salt)), F.lit(1_000_000)) / 1_000_000
    angle, far = u(1) * 6.283185307179586, F.sqrt(u(2)) * radius
    return x + far * F.cos(angle), y + far * F.sin(angle)


def random_day(start, end, key, seed: int = 0):
    """A day at random, by key, from start to end."""
    span = F.datediff(end, start) + 1
    return F.date_add(start, F.pmod(F.xxhash64(key, F.lit(seed)), span).cast("int"))


def change_times(changes: DataFrame, times: DataFrame) -> DataFrame:
    """(label, change, day, before_day, after_day): times of changes in days, from changes (label, change, ev) and times (ev, prop, t)."""
    from chronolith.functions.times import day_number

    pick = lambda prop, of, name: of(F.when(F.col("prop") == prop, day_number(F.col("t")))).alias(name)
    days = times.groupBy(F.col("ev").alias("__ev")).agg(pick("hasTime", F.min, "day"), pick("hasTimeBefore", F.min, "before_day"), pick("hasTimeAfter", F.max, "after_day"))
    return changes.join(days, F.col("ev") == F.col("__ev"), "left").select("label", "change", "day", "before_day", "after_day")


def labelled_sources(versions: DataFrame, traces: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, version, source) of final versions (lm, av) through their traces (root, trace, source) and the labels of landmarks (lm, label)."""
    t = traces.select(F.col("root").alias("__root"), "source")
    lm = labels.select(F.col("lm").alias("__lm"), "label")
    return versions.join(t, F.col("av") == F.col("__root")).join(lm, F.col("lm") == F.col("__lm")).select("label", F.col("av").alias("version"), "source").distinct()


def of_labels_in(rows: DataFrame, source: str) -> DataFrame:
    """Rows (label, version, source) of labels that a source has."""
    wanted = rows.where(F.col("source") == source).select(F.col("label").alias("__label")).distinct()
    return rows.join(wanted, F.col("label") == F.col("__label"), "left_semi")


def changed_versions(reference: DataFrame, modified: DataFrame) -> DataFrame:
    """(label, unmodified): whether a label's sets of sources are alike on both sides."""
    return version_quality(reference, modified).select("label", F.col("right").alias("unmodified"))


def fragment_states(landmarks: DataFrame, share: float = 0.6, seed: int = 0) -> DataFrame:
    """(lm, state): a share of landmarks (lm, label, type, start, end) as state descriptions in JSON."""
    own = sampled(landmarks, "lm", share, seed)
    time = F.struct(F.struct(F.col("start").alias("stamp"), F.lit("day").alias("precision"), F.lit("gregorian").alias("calendar")).alias("start"), F.struct(F.col("end").alias("stamp"), F.lit("day").alias("precision"), F.lit("gregorian").alias("calendar")).alias("end"))
    return own.select("lm", F.to_json(F.struct(F.array(F.struct(F.lit("1").alias("id"), "label", "type")).alias("landmarks"), time.alias("time"), F.struct(F.concat(F.lit("fragment:"), "lm").alias("uri")).alias("source"))).alias("state"))


def fragment_events(changes: DataFrame, share: float = 0.6, seed: int = 0) -> DataFrame:
    """(change, event): a share of changes (change, label, type, stamp) as event descriptions in JSON."""
    own = sampled(changes, "change", share, seed)
    lm = F.struct(F.lit("1").alias("id"), "label", F.lit("StreetNumber").alias("type"), F.array(F.struct(F.lit("landmark").alias("on"), "type")).alias("changes"))
    event = F.struct(F.struct(F.col("stamp").alias("stamp"), F.lit("day").alias("precision"), F.lit("gregorian").alias("calendar")).alias("time"), F.array(lm).alias("landmarks"))
    return own.select("change", F.to_json(F.struct(F.array(event).alias("events"), F.struct(F.concat(F.lit("fragment:"), "change").alias("uri")).alias("source"))).alias("event"))


def evaluated(reference: DataFrame, modified: DataFrame, fragment: str | None = None) -> DataFrame:
    """The table of an evaluation of versions (label, version, source): labels of the fragment's source only, that source ignored."""
    ref, mod = (reference, modified) if fragment is None else (of_labels_in(reference, fragment), of_labels_in(modified, fragment))
    return overall(version_quality(version_sources(ref, fragment), version_sources(mod, fragment)))
