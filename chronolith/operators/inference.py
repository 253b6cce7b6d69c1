"""Inference over statements (s, p, o): properties of properties, and what follows for events.

Rules are few rows and broadcast by name, as in ``validation``: a shuffle by their few predicates or classes has few tasks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.components import components, rewritten
from chronolith.operators.reachability import Order
from chronolith.operators.rounds import extended, fixpoint, settled

TRIPLE = ["s", "p", "o"]


def inverse(quads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Statements of inverse properties (p, q), both ways."""
    both = pairs.select(F.col("p").alias("__p"), F.col("q").alias("__q")).unionByName(pairs.select(F.col("q").alias("__p"), F.col("p").alias("__q")))
    return quads.join(F.broadcast(both), F.col("p") == F.col("__p")).select(F.col("o").alias("s"), F.col("__q").alias("p"), F.col("s").alias("o"))


def sub_properties(quads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Statements of super-properties (p, q)."""
    r = pairs.select(F.col("p").alias("__p"), F.col("q").alias("__q"))
    return quads.join(F.broadcast(r), F.col("p") == F.col("__p")).select("s", F.col("__q").alias("p"), "o")


def symmetric(quads: DataFrame, properties: list[str]) -> DataFrame:
    return quads.where(F.col("p").isin(properties)).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def transitive_step(known: DataFrame, new: DataFrame, properties: list[str]) -> DataFrame:
    """Statements of transitive properties that a new one and a known one give together, in either order."""

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.where(F.col("p").isin(properties)).select(F.col("s").alias("__s"), F.col("p").alias("__p"), F.col("o").alias("__o"))
        return a.where(F.col("p").isin(properties)).join(other, (F.col("o") == F.col("__s")) & (F.col("p") == F.col("__p"))).select("s", "p", F.col("__o").alias("o"))

    return joined(new, known).unionByName(joined(known, new))


def chain(a: DataFrame, b: DataFrame, first: str, second: str, result: str) -> DataFrame:
    """Statements of a property chain: a ``first`` of ``a``, then a ``second`` of ``b``."""
    other = b.where(F.col("p") == second).select(F.col("s").alias("__s"), F.col("o").alias("__o"))
    return a.where(F.col("p") == first).join(other, F.col("o") == F.col("__s")).select("s", F.lit(result).alias("p"), F.col("__o").alias("o"))


def typed_by(quads: DataFrame, rules: DataFrame, of: str = "s") -> DataFrame:
    """Types of subjects (domain) or objects (range) of rules' (p, class)."""
    r = rules.select(F.col("p").alias("__p"), F.col("class").alias("__c"))
    return quads.join(F.broadcast(r), F.col("p") == F.col("__p")).select(F.col(of).alias("s"), F.lit("type").alias("p"), F.col("__c").alias("o")).distinct()


def same_as(quads: DataFrame, functional: list[str], inverse_functional: list[str] = ()) -> DataFrame:
    """Pairs (a, b) that functional and inverse functional properties make one: each node with the least of its group, which stands for all pairs."""
    f = quads.where(F.col("p").isin(list(functional))).select(F.concat_ws("|", "p", "s").alias("k"), F.col("o").alias("b"))
    i = quads.where(F.col("p").isin(list(inverse_functional))).select(F.concat_ws("|", "p", "o").alias("k"), F.col("s").alias("b"))
    rows = f.unionByName(i).distinct()
    least = rows.groupBy("k").agg(F.min("b").alias("a"), F.max("b").alias("__z")).where("a <> __z").select("a", F.col("k").alias("__k"))
    return rows.join(least, F.col("k") == F.col("__k")).where("a <> b").select("a", "b").distinct()


def has_key(quads: DataFrame, keys: list[str], once: bool = False) -> DataFrame:
    """Pairs (a, b) that share a value of every key property, each node with the least of its group; ``once``: no statement comes twice."""
    rows = None
    for k in keys:
        own = quads.where(F.col("p") == k).select("s", F.col("o").alias(f"__{k}"))
        own = own if once else own.distinct()
        rows = own if rows is None else rows.join(own, "s")
    values = [f"__{k}" for k in keys]
    least = rows.groupBy(*values).agg(F.min("s").alias("a"), F.max("s").alias("__z")).where("a <> __z")
    on = [F.col(v) == F.col(f"_{v}") for v in values]
    least = least.select("a", *[F.col(v).alias(f"_{v}") for v in values])
    return rows.join(least, on).where("a <> s").select("a", F.col("s").alias("b")).distinct()


def equivalents(pairs: DataFrame) -> DataFrame:
    """Both directions of equivalent classes or properties (p, q), as sub-rules."""
    return pairs.select("p", "q").unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()


def of_unions(types: DataFrame, unions: DataFrame) -> DataFrame:
    """Types (s, class) of unions (class, member): any member is enough."""
    u = unions.select(F.col("member").alias("__m"), F.col("class").alias("__c"))
    return types.join(F.broadcast(u), F.col("class") == F.col("__m")).select("s", F.col("__c").alias("class"))


def of_intersections(types: DataFrame, intersections: DataFrame) -> DataFrame:
    """Types (s, class) of intersections (class, member): all members are needed."""
    needed = intersections.groupBy("class").agg(F.count_distinct("member").alias("__n")).withColumnRenamed("class", "__k")
    i = intersections.select(F.col("member").alias("__m"), F.col("class").alias("__c"))
    have = types.join(F.broadcast(i), F.col("class") == F.col("__m")).groupBy("s", "__c").agg(F.count_distinct("__m").alias("__have"))
    return have.join(F.broadcast(needed), (F.col("__c") == F.col("__k")) & (F.col("__have") == F.col("__n"))).select("s", F.col("__c").alias("class"))


def class_members(types: DataFrame, unions: DataFrame, intersections: DataFrame) -> DataFrame:
    """Types (s, class) that class constructors add: of unions (class, member), any member is enough, of intersections all are needed."""
    return of_unions(types, unions).unionByName(of_intersections(types, intersections)).distinct()


def _step(inverses: DataFrame | None = None, supers: DataFrame | None = None, symmetrics: list[str] = (), transitives: list[str] = (), chains: list[tuple[str, str, str]] = (), domains: DataFrame | None = None, ranges: DataFrame | None = None, unions: DataFrame | None = None, intersections: DataFrame | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """One round of rules, of those that there are.  Rules of one premise see new statements only; those of two need one new."""

    def step(known: DataFrame, new: DataFrame) -> DataFrame:
        parts = []
        if inverses is not None:
            parts.append(inverse(new, inverses))
        if supers is not None:
            parts.append(sub_properties(new, supers))
        if symmetrics:
            parts.append(symmetric(new, symmetrics))
        if transitives:
            parts.append(transitive_step(known, new, transitives))
        for c in chains:
            parts += [chain(new, known, *c), chain(known, new, *c)]
        if domains is not None:
            parts.append(typed_by(new, domains))
        if ranges is not None:
            parts.append(typed_by(new, ranges, "o"))
        types = new.where("p = 'type'").select("s", F.col("o").alias("class"))
        if unions is not None:
            parts.append(_typed(of_unions(types, unions)))
        if intersections is not None:  # of a node with a new type all types count
            own = known.where("p = 'type'").join(types.select(F.col("s").alias("__s")), F.col("s") == F.col("__s"), "left_semi")
            parts.append(_typed(of_intersections(own.select("s", F.col("o").alias("class")), intersections)))
        return reduce(DataFrame.unionByName, parts) if parts else new.limit(0)

    return step


def _typed(members: DataFrame) -> DataFrame:
    return members.select("s", F.lit("type").alias("p"), F.col("class").alias("o"))


def inferred(quads: DataFrame, inverses: DataFrame | None, supers: DataFrame | None, symmetrics: list[str], transitives: list[str], chains: list[tuple[str, str, str]] = (), domains: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """All statements that follow, with those that came in."""
    return fixpoint(quads.select(TRIPLE), _step(inverses, supers, symmetrics, transitives, chains, domains, ranges), by="p")


def event_order(before: DataFrame) -> DataFrame:
    """Transitive order of events (ev1, ev2), read from labels of chains: as many rows as the answer has, none on the way."""
    return Order(before.select(F.col("ev1").alias("src"), F.col("ev2").alias("dst"))).reached().select(F.col("src").alias("ev1"), F.col("dst").alias("ev2"))


def similar_change_events(depends: DataFrame) -> DataFrame:
    """Events (a, b) that one change (cg, ev) depends on."""
    return same_as(depends.select(F.col("cg").alias("s"), F.lit("dependsOn").alias("p"), F.col("ev").alias("o")), ["dependsOn"])


def identities(quads: DataFrame, functional: list[str], inverse_functional: list[str] = (), keys: list[list[str]] = ()) -> DataFrame:
    """(n, rep): classes of nodes that functional and inverse functional properties, sets of key properties and
    ``sameAs`` statements make one, each with its least node; whole chains of pairs are one class."""
    pairs = same_as(quads, list(functional), list(inverse_functional)).unionByName(quads.where("p = 'sameAs'").select(F.col("s").alias("a"), F.col("o").alias("b")))
    for key in keys:
        pairs = pairs.unionByName(has_key(quads, list(key)))
    return components(pairs)


def _stars(pairs: DataFrame) -> DataFrame:
    """(n, rep) of the nodes that pairs (a, b) give another representative, settled; empty without such pairs.

    Pairs that functional properties or a key make are stars already (each node with one lesser node, which has none
    itself); only where stars meet are they joined into classes."""
    edges = settled(pairs.where("a <> b").select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("rep")).distinct(), "pairs")
    ends = edges.select("n", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("rep").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
        return edges
    return settled(components(edges.select(F.col("n").alias("a"), F.col("rep").alias("b"))).where("n <> rep"), "identities")


def _renamed(rows: DataFrame, found: DataFrame, literals: list[str]) -> DataFrame:
    """Statements with representatives in place of members; values stay."""
    value = F.coalesce(F.col("p").isin(list(literals)), F.lit(False))
    return rewritten(rows.where(~value), found, ["s", "o"]).unionByName(rewritten(rows.where(value), found, ["s"]))


def _followed(members: DataFrame | None, found: DataFrame) -> DataFrame:
    """``members`` after one more merge: who was named after a node that has now another name follows it."""
    if members is None:
        return found
    moved = members.join(found.select(F.col("n").alias("__n"), F.col("rep").alias("__rep")), F.col("rep") == F.col("__n"), "left").select("n", F.coalesce("__rep", "rep").alias("rep"))
    return settled(moved.unionByName(found.join(members.select(F.col("n").alias("__m")), F.col("n") == F.col("__m"), "left_anti")), "members")


def _near(quads: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """Statements of a key by which nodes (n) that a merge touched, as subjects or as values, can meet others."""

    def meets(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
        return rows.join(nodes.toDF("__n"), F.col(column) == F.col("__n"), "left_semi")

    own = quads.where(F.col("p").isin(key))
    subjects = settled(meets(own, "o", touched).select("s").unionByName(touched.toDF("s")).distinct(), "near")
    values = settled(meets(own.where(F.col("p") == key[0]), "s", subjects).select("o").distinct(), "near")
    every = settled(meets(own.where(F.col("p") == key[0]), "o", values).select("s").distinct(), "near")
    return meets(own, "s", every)


def _merged(quads: DataFrame, functional: list[str], inverse_functional: list[str], keys: list[list[str]], literals: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """(statements over representatives, members (n, rep) or None where nothing merges), of settled statements.

    Only statements that identities can come from are rewritten in each turn, the others once.  Keys are tried where
    nothing else merges, first over all, then around the nodes that were merged since."""
    stated = list({*functional, *inverse_functional, *[k for key in keys for k in key], "sameAs"})
    own, rest = quads.where(F.col("p").isin(stated)), quads.where(~F.col("p").isin(stated) | F.col("p").isNull())
    members, touched, tried = None, None, False
    for _ in range(most):
        nodes = own.where(~F.col("p").isin(list(literals)) | F.col("p").isin([*inverse_functional, *[k for key in keys for k in key]]))
        pairs = same_as(nodes, [p for p in functional if p not in literals], inverse_functional)
        found = _stars(pairs.unionByName(nodes.where("p = 'sameAs'").select(F.col("s").alias("a"), F.col("o").alias("b"))))
        none = found.isEmpty()
        if none and keys and (touched is not None or not tried):
            near = [_near(nodes, touched, key) if tried else nodes for key in keys]
            found = _stars(reduce(DataFrame.unionByName, [has_key(rows, key, once=True) for rows, key in zip(near, keys)]))
            none, touched, tried = found.isEmpty(), None, True
        if none:
            return (quads, None) if members is None else (settled(own.unionByName(_renamed(rest, members, literals)), "reasoned"), members)
        members = _followed(members, found)
        own = settled(_renamed(own, found, literals), "reasoned")
        reps = found.select(F.col("rep").alias("n")).distinct()
        touched = reps if touched is None else touched.unionByName(reps).distinct()
    raise RuntimeError(f"no end after {most} turns")


def reasoned(
    quads: DataFrame,
    functional: list[str] = (),
    inverse_functional: list[str] = (),
    keys: list[list[str]] = (),
    unions: DataFrame | None = None,
    intersections: DataFrame | None = None,
    literals: list[str] = (),
    most: int = 32,
    **rules: object,
) -> tuple[DataFrame, DataFrame]:
    """(statements over representatives, members (n, rep)): all rules to one fixpoint.

    ``rules`` are arguments of ``inferred``.  In turn, until nothing changes: nodes that identities make one are
    replaced by the least of their class, in subjects and objects, so that a merged node has the premises of all its
    members; statements get all that the rules and the class constructors add.  A turn follows only where something was
    added that identities can come from.  Classes only grow, so turns end.  Properties of ``literals`` have values, which
    no identity merges or replaces.  ``components.expanded`` reads by any member's name."""
    functional, inverse_functional, keys = list(functional), list(inverse_functional), [list(key) for key in keys]
    stated = [*functional, *inverse_functional, *[k for key in keys for k in key], "sameAs"]
    classes = [r.select("class") for r in (unions, intersections, rules.get("domains"), rules.get("ranges")) if r is not None]
    current, members, again = settled(quads.select(TRIPLE).distinct(), "reasoned"), None, True
    for _ in range(most):
        current, found = _merged(current, functional, inverse_functional, keys, literals, most)
        if found is None and not again:
            break
        members = members if found is None else _followed(members, found)
        alike = unions
        if members is not None and classes:  # a class that a rule names may be a merged node: its members are the representative's too
            named = reduce(DataFrame.unionByName, classes).distinct().withColumnRenamed("class", "__k")
            also = settled(members.join(F.broadcast(named), F.col("n") == F.col("__k")).select(F.col("rep").alias("class"), F.col("n").alias("member")), "classes")
            if not also.isEmpty():
                alike = also if unions is None else unions.select("class", "member").unionByName(also)
        current, added = extended(current, _step(unions=alike, intersections=intersections, **rules), by="p")
        # what made nodes one is told by members; rules may add it again, from other statements
        again = found is not None and not current.where("p = 'sameAs'").isEmpty()
        if again:
            current = settled(current.where("not p <=> 'sameAs'"), "reasoned")
        elif added.where(F.col("p").isin(stated)).isEmpty():
            break
    else:
        raise RuntimeError(f"no end after {most} turns")
    return current, members if members is not None else current.sparkSession.createDataFrame([], "n string, rep string")


def under(quads: DataFrame, rules: dict[str, object] | None) -> DataFrame:
    """Statements with all that a set of rules (arguments of ``inferred``) adds, or, without rules, as they are."""
    return quads.select(TRIPLE) if rules is None else inferred(quads, **rules)
