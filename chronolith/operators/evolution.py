"""Elementary versions and their merging into a coherent evolution.

All rows of an attribute are brought together once, and every later step is a window or a group within that
partitioning: attributes spread over tasks, nothing is joined back, and chains are ordered by time, so a transitive
merge is a running sum.

Tables: versions (attr, av, begin, end, and optionally vid, the id of the value that is compared) with valid times,
either end null; changes (attr, cg, stamp, precision, makes, outdates) that sources state.  Stamps are any ordered
type.  Within steps a version is struct(av, vid).

An attribute with more than ``LONG`` rows doesn't stay in one task: its rows are cut into blocks by time, windows run
within blocks, and what a block needs of those before and after it (sums, last and first rows) comes from a row for
each block.  Such rows carry a column ``__block`` through all steps, which are otherwise the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.rounds import settled

VERSIONS = "array<struct<av: string, vid: string>>"
#: Rows of an attribute above which it is cut, and about how many a block has.
LONG, BLOCK_ROWS = 200_000, 50_000


def _along(rows: DataFrame, order: Column, lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with values of the row before or after of the same attribute, and running sums up to each row.

    Plain windows by attribute, or, where rows have blocks, windows by block and a window over a row for each block."""
    lags, leads, sums = lags or {}, leads or {}, sums or {}
    if "__block" not in rows.columns:
        whole = Window.partitionBy("attr").orderBy(order)
        return rows.select("*", *[F.lag(c).over(whole).alias(n) for n, c in lags.items()], *[F.lead(c).over(whole).alias(n) for n, c in leads.items()], *[F.sum(c).over(whole).alias(n) for n, c in sums.items()])
    within = Window.partitionBy("attr", "__block").orderBy(order)
    packed = lambda of: F.struct(F.lit(0).alias("__0"), *[c.alias(n) for n, c in of.items()])
    at = rows.select("*", F.row_number().over(within).alias("__at"), packed(lags).alias("__lags"), packed(leads).alias("__leads"), *[c.alias(f"__s_{n}") for n, c in sums.items()])
    at = settled(at, "long-rows")  # read twice, as each step before it would be
    ends = at.groupBy(F.col("attr").alias("__attr"), F.col("__block").alias("__b")).agg(F.max_by("__lags", "__at").alias("__last"), F.min_by("__leads", "__at").alias("__first"), *[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums])
    blocks = Window.partitionBy("__attr").orderBy("__b")
    ends = ends.select("__attr", "__b", F.lag("__last").over(blocks).alias("__last"), F.lead("__first").over(blocks).alias("__first"), *[F.coalesce(F.sum(f"__t_{n}").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__t_{n}") for n in sums])
    own = at.withColumn("__before", F.lag("__lags").over(within)).withColumn("__after", F.lead("__leads").over(within))
    for n in sums:
        own = own.withColumn(f"__s_{n}", F.sum(f"__s_{n}").over(within))
    met = own.join(ends, (F.col("attr") == F.col("__attr")) & (F.col("__block") == F.col("__b")))
    before, after = F.coalesce("__before", "__last"), F.coalesce("__after", "__first")
    return met.select(*rows.columns, *[before[n].alias(n) for n in lags], *[after[n].alias(n) for n in leads], *[(F.col(f"__s_{n}") + F.col(f"__t_{n}")).alias(n) for n in sums])


def _held(rows: DataFrame) -> list[str]:
    """The block column, where rows have one."""
    return ["__block"] if "__block" in rows.columns else []


def blocked(events: DataFrame, n: int) -> DataFrame:
    """``events`` with blocks: ranges of (attr, stamp) of about equal size."""
    stamps = events.select("attr", "stamp").distinct()
    ranges = settled(stamps.repartitionByRange(n, "attr", F.col("stamp").asc_nulls_last()).withColumn("__block", F.spark_partition_id()), "blocks")
    ranges = ranges.select(F.col("attr").alias("__attr"), F.col("stamp").alias("__stamp"), "__block")
    return events.join(ranges, (F.col("attr") == F.col("__attr")) & F.col("stamp").eqNullSafe(F.col("__stamp"))).drop("__attr", "__stamp")


def sorted_set(structs: Column) -> Column:
    """An array of structs sorted, each once.  ``array_distinct`` compares all pairs where elements are structs; sorted, equal ones are neighbours."""
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    return F.transform(F.array(F.array_sort(structs)), once)[0]  # the inner array is bound once, not sorted again for each element


def _none() -> Column:
    return F.array().cast(VERSIONS)


def stated_and_virtual(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """(attr, stamp, rank, cg, makes, outdates): changes as stated (with cg), and two virtual ones (without) for each valid time.

    A version without a valid time that has a vid keeps one row without a stamp, as a stated change names it without."""
    known = lambda c: F.transform(c, lambda x: F.struct(x.alias("av"), F.lit(None).cast("string").alias("vid")))
    real = changes.select("attr", "stamp", F.coalesce("precision", F.lit(-1)).alias("rank"), "cg", known("makes").alias("makes"), known("outdates").alias("outdates"))
    vid = F.col("vid") if "vid" in versions.columns else F.lit(None).cast("string")
    own = F.array(F.struct(F.col("av").cast("string").alias("av"), vid.cast("string").alias("vid")))
    ends = F.explode(F.array(F.struct(F.col("begin").alias("stamp"), own.alias("makes"), _none().alias("outdates")), F.struct(F.col("end").alias("stamp"), _none().alias("makes"), own.alias("outdates")))).alias("x")
    untimed = F.col("begin").isNull() & F.col("end").isNull() & vid.isNotNull()
    virtual = versions.select("attr", ends, F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("cg"), untimed.alias("untimed"))
    virtual = virtual.where("x.stamp is not null or (untimed and size(x.makes) > 0)").select("attr", "x.stamp", "rank", "cg", "x.makes", "x.outdates")
    return real.where("stamp is not null").unionByName(virtual)


def elementary_changes(events: DataFrame) -> DataFrame:
    """One row for each attribute and stamp, with the unions of what is made and outdated, plus one at either infinity.

    (attr, idx, side, stamp, rank, real, makes, outdates); side is -1, 0, 1; idx counts from 0 at minus infinity.  Rows
    without a stamp are no changes: they keep side 2 and no idx, for the vids that they carry.  This is where the rows of an attribute meet: the steps that follow need no other exchange."""
    flat = lambda c: sorted_set(F.flatten(F.collect_list(c)))
    held = _held(events)
    if not held:
        events = events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "attr")  # a fixed number: the work after it is far more than its bytes tell
    at = events.groupBy("attr", "stamp", *held).agg(F.max("rank").alias("rank"), F.array_sort(F.collect_set("cg")).alias("real"), flat("makes").alias("makes"), flat("outdates").alias("outdates"))
    at = _along(at, F.col("stamp").asc_nulls_last(), leads={"__next": F.col("stamp")}, sums={"__n": F.lit(1)}).withColumn("__last", F.col("__next").isNull())
    stamp_type, none = events.schema["stamp"].dataType, F.array().cast("array<string>")
    row = lambda idx, side, stamp, rank, real, makes, outdates: F.array(F.struct(idx.cast("int").alias("idx"), F.lit(side).alias("side"), stamp.alias("stamp"), rank.alias("rank"), real.alias("real"), makes.alias("makes"), outdates.alias("outdates")))
    end = lambda idx, side: row(idx, side, F.lit(None).cast(stamp_type), F.lit(-1), none, _none(), _none())
    own = row(F.col("__n"), 0, F.col("stamp"), F.col("rank"), F.col("real"), F.col("makes"), F.col("outdates"))
    with_ends = F.when(F.col("__n") == 1, F.concat(end(F.lit(0), -1), own)).otherwise(own)
    with_ends = F.when(F.col("__last"), F.concat(with_ends, end(F.col("__n") + 1, 1))).otherwise(with_ends)
    with_ends = F.when(F.col("stamp").isNull(), row(F.lit(None), 2, F.col("stamp"), F.col("rank"), F.col("real"), F.col("makes"), F.col("outdates"))).otherwise(with_ends)
    return at.select("attr", *held, F.inline(with_ends))


def elementary_versions(changes: DataFrame) -> DataFrame:
    """Segments between consecutive changes: (attr, seg, begin, end, begin_real, end_real); infinite ends are null."""
    out = _along(changes.where("idx is not null"), F.col("idx"), leads={"end": F.col("stamp"), "end_real": F.size("real") > 0, "next": F.col("idx")})
    return out.where("next is not null").select("attr", F.col("idx").alias("seg"), F.col("stamp").alias("begin"), "end", (F.size("real") > 0).alias("begin_real"), "end_real", *_held(out))


def _mentions(changes: DataFrame, *columns: Column | str) -> DataFrame:
    """A row for each version that a change makes (m = 1) or outdates (m = 0), or one without any: (attr, idx, place, av, vid, m)."""
    side = lambda c, m: F.transform(c, lambda x: F.struct(x["av"].alias("av"), x["vid"].alias("vid"), F.lit(m).alias("m")))
    return changes.select("attr", "idx", *columns, F.posexplode_outer(F.concat(side("makes", 1), side("outdates", 0))).alias("place", "x")).select("attr", "idx", *[c if isinstance(c, str) else c for c in columns], "place", "x.av", "x.vid", "x.m")


def version_spans(changes: DataFrame) -> DataFrame:
    """(attr, av, first, stop): segments of each version; a version that is only outdated covers one before, one that is only made covers one after."""
    at = _mentions(changes.where("idx is not null")).where("av is not null").groupBy("attr", "av").agg(F.min(F.when(F.col("m") == 1, F.col("idx"))).alias("first"), F.max(F.when(F.col("m") == 0, F.col("idx"))).alias("stop"))
    return at.select("attr", "av", F.coalesce("first", F.col("stop") - 1).alias("first"), F.coalesce("stop", F.col("first") + 1).alias("stop"))


def covered(changes: DataFrame) -> DataFrame:
    """Segments (as of ``elementary_versions``) with the versions that cover them (traces).

    A version's row at its first change writes a row into each of its segments, and a change's first row writes its own
    segment, so that the range join of spans and segments is one group by segment."""
    held = _held(changes)
    rows = _along(changes, F.col("idx").asc_nulls_last(), leads={"end": F.col("stamp"), "end_real": F.size("real") > 0, "__next": F.col("idx")})
    rows = rows.select("attr", "idx", "makes", "outdates", F.col("stamp").alias("begin"), "end", (F.size("real") > 0).alias("begin_real"), "end_real", F.col("__next").isNotNull().alias("within"), *held)
    each = _mentions(rows, "begin", "end", "begin_real", "end_real", "within", *held)
    one = Window.partitionBy("attr", "av")
    made, gone = F.min(F.when(F.col("m") == 1, F.col("idx"))).over(one), F.max(F.when(F.col("m") == 0, F.col("idx"))).over(one)
    each = each.select("*", made.alias("__made"), gone.alias("__gone"), F.max("vid").over(one).alias("__vid"), F.row_number().over(one.orderBy(F.col("idx").asc_nulls_last(), "place")).alias("__k"))
    first, stop = F.coalesce("__made", F.col("__gone") - 1), F.coalesce("__gone", F.col("__made") + 1)
    facts = ["begin", "end", "begin_real", "end_real", *held]
    bare = lambda c: F.lit(None).cast(each.schema[c].dataType).alias(c)
    part = lambda seg, trace, info: F.struct(seg.cast("int").alias("seg"), trace.alias("trace"), *[(F.col(c).alias(c) if info else bare(c)) for c in facts], F.lit(info).alias("own"))
    own = F.when((F.coalesce("place", F.lit(0)) == 0) & F.col("within"), F.array(part(F.col("idx"), F.lit(None).cast("struct<av: string, vid: string>"), True)))
    spread = F.when(F.col("av").isNotNull() & (F.col("__k") == 1) & (stop > first), F.transform(F.sequence(first, stop - 1), lambda s: part(s, F.struct(F.col("av").alias("av"), F.col("__vid").alias("vid")), False)))
    parts = each.select("attr", F.inline(F.concat(F.coalesce(own, F.array()), F.coalesce(spread, F.array()))))
    out = parts.groupBy("attr", "seg").agg(*[F.max(c).alias(c) for c in facts], F.max("own").alias("own"), F.array_sort(F.collect_set("trace")).alias("traces"))
    return out.where("own").drop("own")


def pruned(segments: DataFrame) -> DataFrame:
    """Segments that stay, numbered anew, each with the change that begins it and the one that ends it.

    An empty segment next to a change that no source states goes.  If a source states the change on one side, that
    change takes over; if on neither, one fuzzy change from the segment's begin to its end replaces both.
    (attr, n, traces, begin_real, begin_after, begin_before, end_real, end_after, end_before): crisp if after = before."""
    gone, begin_real, end_real = F.col("gone"), F.col("begin_real"), F.col("end_real")
    held = _held(segments)
    # a run of removed segments stands between two kept ones: it gets the number of the kept one before it, 0 before the first
    rows = _along(segments.withColumn("gone", (F.size("traces") == 0) & ~(begin_real & end_real)), F.col("seg"), sums={"n": (~gone).cast("int")})
    # the change after kept segment n is made of its end and both sides of the removed segments that follow
    begin = F.when(gone, F.col("begin"))
    change = rows.groupBy("attr", "n").agg(
        F.first(F.when(~gone, F.col("traces")), ignorenulls=True).alias("traces"),
        F.max(end_real | (gone & begin_real)).alias("real"),
        F.min(F.least(F.when(begin_real, begin), F.when(end_real, F.col("end")))).alias("at"),
        F.min(F.least(begin, F.col("end"))).alias("after"),
        F.max(F.greatest(begin, F.col("end"))).alias("before"),
        F.max(F.col("end").isNull() | (gone & F.col("begin").isNull())).alias("open"),
        *[F.min(c).alias(c) for c in held],
    )
    change = _along(change, F.col("n"), leads={"__next": F.col("n")})
    last = F.col("__next").isNull()
    # before the first kept segment only what is open to minus infinity counts; after the last, to plus infinity
    change = change.select(
        "attr",
        "n",
        "traces",
        F.col("real").alias("end_real"),
        F.when(F.col("real"), F.col("at")).when((F.col("n") == 0) & F.col("open"), F.lit(None)).otherwise(F.col("after")).alias("end_after"),
        F.when(F.col("real"), F.col("at")).when(last & F.col("open"), F.lit(None)).otherwise(F.col("before")).alias("end_before"),
        *held,
    )
    change = _along(change, F.col("n"), lags={f"begin_{c}": F.col(f"end_{c}") for c in ("real", "after", "before")})
    return change.select("attr", "n", "traces", F.coalesce("begin_real", F.lit(False)).alias("begin_real"), "begin_after", "begin_before", "end_real", "end_after", "end_before", *held).where("n > 0")


def continued(segments: DataFrame, comparisons: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``merge``: whether a segment continues the one before: the change between is virtual, some pair of their traces is the same (or one trace), and none is different.

    Without comparisons, versions are the same if their vid is, and different if not.  With them, (av1, av2, same) or,
    of values, (v1, v2, same), both ways; a function gets the pairs (v1, v2) of different values that meet, so that no
    other pair is ever compared."""
    rows = _along(segments, F.col("n"), lags={"__earlier": F.col("traces")})
    may = F.col("__earlier").isNotNull() & ~F.col("begin_real") & (F.size("__earlier") > 0) & (F.size("traces") > 0)
    ids = lambda c, name: F.filter(F.transform(c, lambda x: x[name]), lambda v: v.isNotNull())
    shared = F.arrays_overlap(ids("__earlier", "av"), ids("traces", "av")) | F.arrays_overlap(ids("__earlier", "vid"), ids("traces", "vid"))
    if comparisons is None:
        a, b = ids("__earlier", "vid"), ids("traces", "vid")
        differ = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_union(a, b)) > 1)
        return rows.withColumn("merge", F.coalesce(may & shared & ~differ, F.lit(False))).drop("__earlier")
    name = "av" if not callable(comparisons) and "av1" in comparisons.columns else "vid"
    pairs = rows.where(may).select("attr", "n", F.explode(F.array_distinct(ids("__earlier", name))).alias("__a"), "traces").select("attr", "n", "__a", F.explode(F.array_distinct(ids("traces", name))).alias("__b")).where("__a <> __b")
    if callable(comparisons):
        comparisons = comparisons(pairs.select(F.col("__a").alias("v1"), F.col("__b").alias("v2")).distinct())
    given = comparisons.select(F.col("av1" if name == "av" else "v1").alias("__c"), F.col("av2" if name == "av" else "v2").alias("__d"), F.col("same").alias("__same"))
    judged = pairs.join(given, (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d"))).groupBy(F.col("attr").alias("__attr"), F.col("n").alias("__n")).agg(F.bool_or("__same").alias("__some"), F.bool_or(~F.col("__same")).alias("__differ"))
    out = rows.join(judged, (F.col("attr") == F.col("__attr")) & (F.col("n") == F.col("__n")), "left")
    merge = may & (shared | F.coalesce("__some", F.lit(False))) & ~F.coalesce("__differ", F.lit(False))
    return out.withColumn("merge", F.coalesce(merge, F.lit(False))).select(*segments.columns, "merge")


def merged(segments: DataFrame) -> DataFrame:
    """Maximal chains as versions: (attr, version, traces, begin_real, begin_after, begin_before, end_real, end_after, end_before)."""
    rows = _along(segments, F.col("n"), sums={"version": F.when(F.col("merge"), 0).otherwise(1)})
    first = lambda c: F.min_by(c, "n").alias(c)
    last = lambda c: F.max_by(c, "n").alias(c)
    traces = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("traces")), lambda x: x["av"])))
    return rows.groupBy("attr", "version").agg(traces.alias("traces"), first("begin_real"), first("begin_after"), first("begin_before"), last("end_real"), last("end_after"), last("end_before"))


def merge_sets(segments: DataFrame) -> DataFrame:
    """(attr, version, members): the segments of each maximal chain as one text, which names the version that they become."""
    rows = _along(segments, F.col("n"), sums={"version": F.when(F.col("merge"), 0).otherwise(1)})
    return rows.groupBy("attr", "version").agg(F.array_join(F.array_sort(F.collect_list("n")), "|").alias("members"))


def evolution(versions: DataFrame, changes: DataFrame, comparisons: DataFrame | Callable[[DataFrame], DataFrame] | None = None, long: int | None = None) -> DataFrame:
    """The coherent evolution of every attribute; see ``continued`` for how versions are compared.

    Attributes of more than ``long`` rows (``LONG`` by default) are counted first and go in blocks, all others in one
    exchange by attribute."""
    events, long = stated_and_virtual(versions, changes), LONG if long is None else long
    own = lambda rows: merged(continued(pruned(covered(elementary_changes(rows))), comparisons))
    # a version has two virtual changes at most: counting what comes in leaves arrays unread
    sizes = versions.select("attr", F.lit(2).alias("n")).unionByName(changes.select("attr", F.lit(1).alias("n"))).groupBy(F.col("attr").alias("__attr")).agg(F.sum("n").alias("n")).where(F.col("n") > long)
    total = sizes.agg(F.sum("n")).first()[0]
    if total is None:
        return own(events)
    sizes = settled(sizes, "long-attributes")
    names = sizes.select("__attr")
    cut = blocked(events.join(names, F.col("attr") == F.col("__attr"), "left_semi"), max(2, -(-total // min(long, BLOCK_ROWS))))
    return own(events.join(names, F.col("attr") == F.col("__attr"), "left_anti")).unionByName(own(cut))


def version_traces(final: DataFrame) -> DataFrame:
    """(root, trace) of final versions."""
    from chronolith.functions.ids import signature

    return final.select(signature("AttributeVersion", "attr", "version").alias("root"), F.explode("traces").alias("trace"))


def event_times(final: DataFrame) -> DataFrame:
    """(attr, version, side, prop, stamp): crisp changes have a time, fuzzy ones a time after and a time before."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_after").alias("after"), F.col(f"{s}_before").alias("before")) for s in ("begin", "end")])).alias("x")
    rows = final.select("attr", "version", sides).select("attr", "version", "x.*")
    crisp = F.col("after") == F.col("before")
    props = F.explode(F.when(crisp, F.array(F.struct(F.lit("hasTime").alias("prop"), F.col("after").alias("stamp")))).otherwise(F.array(F.struct(F.lit("hasTimeAfter").alias("prop"), F.col("after").alias("stamp")), F.struct(F.lit("hasTimeBefore").alias("prop"), F.col("before").alias("stamp"))))).alias("p")
    return rows.select("attr", "version", "side", props).select("attr", "version", "side", "p.*").where("stamp is not null")
