"""The order of events: the rules that say which event comes before which, and what times follow from it.

Statements (s, p, o) come in, with the vocabulary of events: ``type``, ``isChangeType``, ``dependsOn``, ``appliedTo``,
``locatum``, ``relatum``, ``makesEffective``, ``outdates``, ``hasTime``, ``instantBefore``, ``eventBefore``, ``eventAfter``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.components import components
from chronolith.operators.reachability import Order, _distinct_edges, covered
from chronolith.operators.rounds import settled

#: Nodes of one chain that one task of a running extreme takes.
BLOCK = 1 << 16


# fixed values: the vocabulary of events
VOCABULARY = ["isChangeType", "dependsOn", "appliedTo", "locatum", "relatum", "makesEffective", "outdates", "hasTime", "instantBefore", "eventBefore", "eventAfter"]


def _read_once(quads: DataFrame) -> DataFrame:
    """The statements that the rules read, written once: a dozen joins begin with them."""
    return settled(quads.where(F.col("p").isin(VOCABULARY)).select("s", "p", "o"), "event-statements")


def _of(quads: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return quads.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def _pairs(a: DataFrame, b: DataFrame, on: Column, rule: Column) -> DataFrame:
    return a.join(b, on).where("c1 <> c2").select("ev1", "ev2", rule.alias("rule"))


def changes_of(quads: DataFrame) -> DataFrame:
    """(cg, kind, target, ev): changes with their type, what they apply to and the event they depend on."""
    kinds, targets, events = _of(quads, "isChangeType", "cg", "kind"), _of(quads, "appliedTo", "__t", "target"), _of(quads, "dependsOn", "__e", "ev")
    return kinds.join(targets, F.col("cg") == F.col("__t")).join(events, F.col("cg") == F.col("__e")).select("cg", "kind", "target", "ev")


def stated_order(quads: DataFrame) -> DataFrame:
    """(ev1, ev2, rule) that the rules on changes, relations, versions and times give, and those that statements hold.

    Rules on times read ``instantBefore`` as it is stated; ``order_of`` also follows it over instants without events."""
    return _stated_order(_read_once(quads))


def _stated_order(quads: DataFrame) -> DataFrame:
    times = [_of(quads, "hasTime", f"ev{k}", f"t{k}") for k in (1, 2)]
    steps = _of(quads, "instantBefore", "__t1", "__t2")
    timed = times[0].join(steps, F.col("t1") == F.col("__t1")).join(times[1], F.col("__t2") == F.col("t2")).select("ev1", "ev2", F.lit("1").alias("rule"))
    return _untimed_order(quads).unionByName(timed.where("ev1 <> ev2")).distinct()


def _untimed_order(quads: DataFrame) -> DataFrame:
    """What all rules but the one on times give; rows may repeat."""
    changes = settled(changes_of(quads), "changes")
    of, starts = F.regexp_extract("kind", "^(.*)(?:Appearance|Disappearance)$", 1), F.col("kind").endswith("Appearance")
    own = changes.where(F.col("kind").isin([f"{x}{y}" for x in ("Landmark", "LandmarkRelation") for y in ("Appearance", "Disappearance")])).withColumn("of", of).withColumn("starts", starts)
    side = lambda k: own.select(*[F.col(c).alias(f"{n}{k}") for c, n in (("cg", "c"), ("target", "t"), ("ev", "ev"), ("of", "of"), ("starts", "starts"))])
    # what a change begins another one ends: rules 2 and 3
    parts = [_pairs(side(1).where("starts1"), side(2).where("not starts2"), (F.col("t1") == F.col("t2")) & (F.col("of1") == F.col("of2")), F.when(F.col("of1") == "Landmark", "2").otherwise("3"))]
    # members of a relation begin before it and end after it: the rules 4
    members = quads.where(F.col("p").isin("locatum", "relatum")).select(F.col("s").alias("lr"), F.col("p").alias("role"), F.col("o").alias("lm"))
    met = members.join(side(1).where("of1 = 'Landmark'"), F.col("lm") == F.col("t1")).join(side(2).where("of2 = 'LandmarkRelation'"), (F.col("lr") == F.col("t2")) & (F.col("starts1") == F.col("starts2"))).where("c1 <> c2")
    first = F.col("starts1")
    rule = F.concat(F.when(first, "4_a_").otherwise("4_b_"), F.when(F.col("role") == "locatum", "a").otherwise("b"))
    parts.append(met.select(F.when(first, F.col("ev1")).otherwise(F.col("ev2")).alias("ev1"), F.when(first, F.col("ev2")).otherwise(F.col("ev1")).alias("ev2"), rule.alias("rule")))
    events = _of(quads, "dependsOn", "cg", "ev")
    made, gone = (_of(quads, p, f"c{k}", f"av{k}").join(events.select(F.col("cg").alias("__c"), F.col("ev").alias(f"ev{k}")), F.col(f"c{k}") == F.col("__c")).drop("__c") for p, k in (("makesEffective", 1), ("outdates", 2)))
    parts.append(_pairs(made, gone, F.col("av1") == F.col("av2"), F.lit("5")))
    parts.append(_of(quads, "eventBefore", "ev1", "ev2").unionByName(_of(quads, "eventAfter", "ev2", "ev1")).select("ev1", "ev2", F.lit("stated").alias("rule")))
    return reduce(DataFrame.unionByName, parts).where("ev1 <> ev2")


def order_edges(quads: DataFrame) -> DataFrame:
    """(src, dst, rank) of an order graph whose nodes are events and marks on instants; edges of a lesser rank make better chains.

    An event comes before the mark behind its instant and after the one in front of it, so events of one instant stay
    unordered; where an instant has one event only, the event is both marks.  An instant without events has one mark,
    or none, if at most one instant is next before it and at most one after: the order runs on over it."""
    quads = _read_once(quads)
    own = _untimed_order(quads)
    edge = lambda rows, a, b, rank: rows.select(a.alias("src"), b.alias("dst"), F.lit(rank).alias("rank"))
    marks, steps = _steps_of_instants(quads)
    several = settled(marks.where("least <> greatest"), "instants-several")
    held = _of(quads, "hasTime", "ev", "__t").join(several.select("t"), F.col("__t") == F.col("t"))
    mark = lambda sign: F.concat(F.lit(sign), F.col("t"))
    parts = [
        own.select(F.col("ev1").alias("src"), F.col("ev2").alias("dst"), F.when(F.col("rule").isin("5", "stated"), 0).otherwise(1).alias("rank")),
        steps.select("src", "dst", F.lit(2).alias("rank")),
        edge(held, F.col("ev"), mark(AFTER), 3), edge(held, mark(FRONT), F.col("ev"), 3), edge(several, mark(FRONT), mark(AFTER), 3),
    ]
    return reduce(DataFrame.unionByName, parts)


def _steps_of_instants(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instants (t, least, greatest: of their events, next, pass), and steps (src, dst) between their marks."""
    stated = _of(quads, "instantBefore", "t1", "t2").where("t1 <> t2").distinct()
    none = F.lit(None).cast("string")
    rows = _of(quads, "hasTime", "ev", "t").select("t", "ev", none.alias("next"), none.alias("last"))
    rows = rows.unionByName(stated.select(F.col("t1").alias("t"), none.alias("ev"), F.col("t2").alias("next"), none.alias("last"))).unionByName(stated.select(F.col("t2").alias("t"), none.alias("ev"), none.alias("next"), F.col("t1").alias("last")))
    at = rows.where("t is not null").groupBy("t").agg(F.min("ev").alias("least"), F.max("ev").alias("greatest"), F.max("next").alias("next"), F.min("next").alias("__next"), F.max("last").alias("last"), F.min("last").alias("__last"))
    passed = F.col("least").isNull() & (F.col("next").isNull() | (F.col("next") == F.col("__next"))) & (F.col("last").isNull() | (F.col("last") == F.col("__last")))
    marks = settled(at.select("t", "least", "greatest", "next", passed.alias("pass")), "instants")
    # what is passed leads on to the first instant that is not; one that leads nowhere, or round and round, is in no way
    rows = marks.where("pass and next is not null").select("t", F.col("next").alias("to"))
    stop = marks.where("not pass").select(F.col("t").alias("__t"))
    rows = settled(rows.join(stop, F.col("to") == F.col("__t"), "left").select("t", "to", F.col("__t").isNull().alias("open")), "instants-passed")
    done, left, last = [], rows.where("open").count(), None
    while left and left != last:
        done.append(rows.where("not open"))
        to = reduce(DataFrame.unionByName, [*done, rows.where("open")]).select(F.col("t").alias("__t"), F.col("to").alias("__to"), F.col("open").alias("__open"))
        rows = settled(rows.where("open").join(to, F.col("to") == F.col("__t")).select("t", F.col("__to").alias("to"), F.col("__open").alias("open")), "instants-passed")
        left, last = rows.where("open").count(), left
    over = reduce(DataFrame.unionByName, [*done, rows.where("not open")]).select(F.col("t").alias("__p"), F.col("to").alias("__over"))
    single = F.col("least") == F.col("greatest")
    name = lambda sign: F.when(single, F.col("least")).when(F.col("least").isNull(), F.concat(F.lit(FRONT), F.col("t"))).otherwise(F.concat(F.lit(sign), F.col("t")))
    stops = marks.where("not pass")
    ends = settled(over.join(stops.select("t", name(FRONT).alias("__d")), F.col("__over") == F.col("t")).select("__p", "__d").unionByName(stops.select(F.col("t").alias("__p"), name(FRONT).alias("__d"))), "instants-ends")
    begun = stops.join(stated, F.col("t") == F.col("t1")).select(name(AFTER).alias("src"), "t2")
    return marks, begun.join(ends, F.col("t2") == F.col("__p")).select("src", F.col("__d").alias("dst"))


FRONT, AFTER = "\x01", "\x02"


def is_event(column: str) -> Column:
    return ~F.substring(column, 1, 1).isin(FRONT, AFTER)


def order_of(quads: DataFrame) -> Order:
    """The order of all events, to be asked by ``before`` and ``same_events``."""
    return Order(order_edges(quads))


def before(order: Order, events: DataFrame | None = None) -> DataFrame:
    """(ev1, ev2) of all that comes after each event, or after some (column n)."""
    return order.reached(events).where(is_event("src") & is_event("dst")).select(F.col("src").alias("ev1"), F.col("dst").alias("ev2"))


def same_events(order: Order) -> DataFrame:
    """(ev, rep) of events that come before and after each other: one event, named by the least."""
    own = order.cycles().where(is_event("n"))
    first = own.groupBy(F.col("rep").alias("__rep")).agg(F.min("n").alias("least"))
    return own.join(first, F.col("rep") == F.col("__rep")).select(F.col("n").alias("ev"), F.col("least").alias("rep"))


def _running(rows: DataFrame, lows: list[str], highs: list[str], cut: bool, strict: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the largest of each of ``lows`` up to each place of its chain, and the least of ``highs`` from it on,
    the place itself left out for those in ``strict``.

    If some chain is long (``cut``), chains are cut into blocks: extremes of blocks run over blocks, those of places within one."""
    keys = ["chain", "__block"] if cut else ["chain"]
    rows = rows.withColumn("__block", F.floor(F.col("pos") / BLOCK)) if cut else rows
    along = lambda order, c: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if c in strict else Window.currentRow)
    inner = [F.max(c).over(along(F.col("pos"), c)).alias(f"__r_{c}") for c in lows] + [F.min(c).over(along(F.col("pos").desc(), c)).alias(f"__r_{c}") for c in highs]
    kept = [c for c in rows.columns if c not in lows + highs]
    if not cut:
        return rows.select(*kept, *inner).withColumnsRenamed({f"__r_{c}": c for c in lows + highs})
    blocks = rows.groupBy(F.col("chain").alias("__c"), F.col("__block").alias("__b")).agg(*[F.max(c).alias(c) for c in lows], *[F.min(c).alias(c) for c in highs])
    over = lambda order: Window.partitionBy("__c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__c", "__b", *[F.max(c).over(over(F.col("__b"))).alias(f"__o_{c}") for c in lows], *[F.min(c).over(over(F.col("__b").desc())).alias(f"__o_{c}") for c in highs])
    met = rows.select(*kept, *inner).join(blocks, (F.col("chain") == F.col("__c")) & (F.col("__block") == F.col("__b")))
    return met.select(*[c for c in kept if c != "__block"], *[F.greatest(f"__r_{c}", f"__o_{c}").alias(c) for c in lows], *[F.least(f"__r_{c}", f"__o_{c}").alias(c) for c in highs])


def bounds(edges: DataFrame, times: DataFrame, most: int = 1000) -> DataFrame:
    """(n, earliest, latest): the latest time of all that comes before a node and the earliest of all after it.

    edges (src, dst) may hold cycles, whose nodes come before themselves; times (n, stamp), several a node at will.
    Nodes lie on chains, along which extremes run at once.  From chain to chain an edge sends a bound only when what
    came to its chain in the last round makes it tighter, so that a round reads only chains to which something came,
    and nodes themselves are read once, at the end.  Bounds are times of the table, so rounds end, after as many as a
    way changes chains."""
    nodes, others = covered(settled(_distinct_edges(edges), "bound-edges"))
    at = lambda k: nodes.select(F.col("n").alias(f"__{k}"), F.col("chain").alias(f"__{k}c"), F.col("pos").alias(f"__{k}p"))
    crossing = others.join(at("s"), F.col("src") == F.col("__s")).join(at("d"), F.col("dst") == F.col("__d")).where("__sc <> __dc or __sp >= __dp")
    crossing = settled(crossing.select(F.col("__sc").alias("chain"), F.col("__sp").alias("pos"), F.col("__dc").alias("to_chain"), F.col("__dp").alias("to_pos")), "bound-crossing")
    own = times.where("stamp is not null").groupBy(F.col("n").alias("__n")).agg(F.max("stamp").alias("low"), F.min("stamp").alias("high"))
    own = settled(nodes.join(own, F.col("n") == F.col("__n")).select("chain", "pos", "low", "high"), "bound-times")
    cut = bool((nodes.agg(F.max("pos")).first()[0] or 0) >= BLOCK)
    stamp = times.schema["stamp"].dataType
    none = F.lit(None).cast(stamp)
    # both ways of an edge: ``down`` sends what is low from its source on, ``up`` what is high to its source
    ways = crossing.select("chain", "pos", "to_chain", "to_pos", F.lit(True).alias("down")).unionByName(crossing.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"), F.lit(False).alias("down")))
    known, news, came = None, own, []
    for _ in range(most):
        value = lambda rows, fresh: rows.select("chain", "pos", *[(F.col(c) if fresh == f else none).alias(f"{c}_{k}") for c in ("low", "high") for k, f in (("old", False), ("new", True))], none.cast("string").alias("to_chain"), F.lit(None).cast("long").alias("to_pos"), F.lit(None).cast("boolean").alias("down"))
        senders = ways.select("chain", "pos", *[none.alias(c) for c in ("low_old", "low_new", "high_old", "high_new")], "to_chain", "to_pos", "down")
        rows = senders if known is None else value(known, False).unionByName(senders)
        touched = news.select(F.col("chain").alias("__touched")).distinct()
        rows = rows.join(touched, F.col("chain") == F.col("__touched"), "left_semi").unionByName(value(news, True))
        rows = _running(rows, ["low_old", "low_new"], ["high_old", "high_new"], cut).where("to_chain is not null")
        low = F.when(F.col("down") & (F.col("low_old").isNull() | (F.col("low_new") > F.col("low_old"))), F.col("low_new"))
        high = F.when(~F.col("down") & (F.col("high_old").isNull() | (F.col("high_new") < F.col("high_old"))), F.col("high_new"))
        sent = rows.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), low.alias("low"), high.alias("high")).where("low is not null or high is not null")
        known = news if known is None else known.unionByName(news)
        news = settled(sent.groupBy("chain", "pos").agg(F.max("low").alias("low"), F.min("high").alias("high")), "bounds-sent")
        if news.isEmpty():
            break
        came.append(news)
    else:
        raise RuntimeError(f"bounds still change after {most} rounds")
    place = lambda rows, n, **values: rows.select("chain", "pos", n.alias("n"), *[values.get(c, none).alias(c) for c in ("last", "low", "first", "high")])
    nobody = F.lit(None).cast("string")
    rows = place(nodes, F.col("n")).unionByName(place(own, nobody, last=F.col("low"), first=F.col("high")))
    for part in came:
        rows = rows.unionByName(place(part, nobody, low=F.col("low"), high=F.col("high")))
    out = _running(rows, ["last", "low"], ["first", "high"], cut, ("last", "first")).where("n is not null")
    return out.select("n", F.greatest("last", "low").alias("earliest"), F.least("first", "high").alias("latest")).where("earliest is not null or latest is not null")


def event_bounds(quads: DataFrame, stamps: DataFrame) -> DataFrame:
    """(ev, earliest, latest) that the times of earlier and later events say of each event; stamps (t, stamp) of instants."""
    times = _of(quads, "hasTime", "n", "t").join(stamps.select(F.col("t").alias("__t"), "stamp"), F.col("t") == F.col("__t")).select("n", "stamp")
    return bounds(order_edges(quads), times).where(is_event("n")).withColumnRenamed("n", "ev")


def contradictions(quads: DataFrame, stamps: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(ev, stamp, earliest, latest) of events whose own time lies outside what the order leaves them, or that have nothing left."""
    found = found if found is not None else event_bounds(quads, stamps)
    times = _of(quads, "hasTime", "__ev", "t").join(stamps.select(F.col("t").alias("__t"), "stamp"), F.col("t") == F.col("__t")).select("__ev", "stamp")
    rows = found.join(times, F.col("ev") == F.col("__ev"), "left").select("ev", "stamp", "earliest", "latest")
    return rows.where("stamp < earliest or stamp > latest or earliest > latest")


def identified(depends: DataFrame) -> DataFrame:
    """(ev, rep) of all events of changes (cg, ev) that depend on several: one event, whole chains of changes merged."""
    least = settled(depends.groupBy(F.col("cg").alias("__cg")).agg(F.min("ev").alias("a")), "events-least")
    return components(depends.join(least, F.col("cg") == F.col("__cg")).select("a", F.col("ev").alias("b"))).withColumnRenamed("n", "ev")
