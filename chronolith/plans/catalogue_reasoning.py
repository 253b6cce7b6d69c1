"""Queries of event order, reachability and identity, each with its SQL; registered with those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import event_order, inference
from chronolith.operators.components import components, expanded
from chronolith.operators.reachability import Order
from chronolith.plans.catalogue import query


def _s(c):
    return F.col(c).cast("string")


# --- event order (I03, rules 0 to 6) ----------------------------------------------------------------------------

_CHANGES = "cg AS (SELECT k.s AS c, k.o AS kind, a.o AS target, d.o AS ev FROM claim k JOIN claim a ON a.s = k.s AND a.p = 'appliedTo' JOIN claim d ON d.s = k.s AND d.p = 'dependsOn' WHERE k.p = 'isChangeType'), ht AS (SELECT s AS ev, o AS t FROM claim WHERE p = 'hasTime')"
_RULES = f"""{_CHANGES}, rl AS (
  SELECT a.ev AS ev1, b.ev AS ev2, '2' AS rule FROM cg a JOIN cg b ON a.target = b.target AND a.kind = 'LandmarkAppearance' AND b.kind = 'LandmarkDisappearance'
  UNION SELECT a.ev, b.ev, '3' FROM cg a JOIN cg b ON a.target = b.target AND a.kind = 'LandmarkRelationAppearance' AND b.kind = 'LandmarkRelationDisappearance'
  UNION SELECT a.ev, b.ev, CASE m.p WHEN 'locatum' THEN '4_a_a' ELSE '4_a_b' END FROM claim m JOIN cg a ON a.target = m.o AND a.kind = 'LandmarkAppearance' JOIN cg b ON b.target = m.s AND b.kind = 'LandmarkRelationAppearance' WHERE m.p IN ('locatum', 'relatum')
  UNION SELECT a.ev, b.ev, CASE m.p WHEN 'locatum' THEN '4_b_a' ELSE '4_b_b' END FROM claim m JOIN cg a ON a.target = m.s AND a.kind = 'LandmarkRelationDisappearance' JOIN cg b ON b.target = m.o AND b.kind = 'LandmarkDisappearance' WHERE m.p IN ('locatum', 'relatum')
  UNION SELECT d.o, f.o, '5' FROM claim a JOIN claim b ON a.o = b.o AND b.p = 'outdates' JOIN claim d ON d.s = a.s AND d.p = 'dependsOn' JOIN claim f ON f.s = b.s AND f.p = 'dependsOn' WHERE a.p = 'makesEffective'
  UNION SELECT a.ev, b.ev, '1' FROM claim i JOIN ht a ON a.t = i.s JOIN ht b ON b.t = i.o WHERE i.p = 'instantBefore')"""
_AFTER = f"""{_RULES}, st AS (SELECT ev, t, split_part(t, '|', 1) AS c, CAST(split_part(t, '|', 2) AS DATE) AS d FROM ht),
  e AS (SELECT ev1, ev2 FROM rl WHERE ev1 <> ev2 UNION SELECT a.ev, b.ev FROM st a JOIN st b ON a.c = b.c AND a.d < b.d),
  r AS (SELECT ev1, ev2 FROM e UNION SELECT r.ev1, e.ev2 FROM r JOIN e ON r.ev2 = e.ev1)"""

_BOUNDS = "b AS (SELECT ev, max(lo) AS earliest, min(hi) AS latest FROM (SELECT ev2 AS ev, d AS lo, CAST(NULL AS DATE) AS hi FROM r JOIN st ON st.ev = ev1 UNION ALL SELECT ev1, NULL, d FROM r JOIN st ON st.ev = ev2) GROUP BY ev)"


def _stamps(claims):
    return claims.where("p = 'hasTime'").select(F.col("o").alias("t"), F.try_to_date(F.substring_index("o", "|", -1)).alias("stamp")).distinct()


@query(f"WITH {_RULES} SELECT ev1, ev2, rule FROM rl WHERE ev1 <> ev2")
def i03_rules(t):
    return event_order.stated_order(t("claim"))


@query(f"WITH RECURSIVE {_AFTER}, {_BOUNDS} SELECT ev, earliest, latest FROM b")
def i03_event_bounds(t):
    claims = t("claim")
    return event_order.event_bounds(claims, _stamps(claims))


@query(f"WITH RECURSIVE {_AFTER}, {_BOUNDS} SELECT b.ev, st.d AS stamp, earliest, latest FROM b LEFT JOIN st ON st.ev = b.ev WHERE st.d < earliest OR st.d > latest OR earliest > latest")
def i03_contradictions(t):
    claims = t("claim")
    return event_order.contradictions(claims, _stamps(claims))


@query(f"WITH RECURSIVE {_AFTER} SELECT ev1, ev2 FROM r")
def i03_events_before(t):
    return event_order.before(event_order.order_of(t("claim")))


@query(f"WITH RECURSIVE {_AFTER}, m AS (SELECT a.ev1 AS ev, a.ev2 AS other FROM r a JOIN r b ON a.ev1 = b.ev2 AND a.ev2 = b.ev1 WHERE a.ev1 <> a.ev2) SELECT ev, least(ev, min(other)) AS rep FROM m GROUP BY ev")
def i03_same_events(t):
    return event_order.same_events(event_order.order_of(t("claim")))


@query(f"WITH RECURSIVE {_AFTER}, q AS (SELECT DISTINCT concat('la', (o_orderkey * 7) % 150) AS first, concat('e', o_orderkey) AS second FROM orders) SELECT first, second FROM q JOIN r ON ev1 = first AND ev2 = second")
def i03_asked_pairs(t):
    k = F.col("o_orderkey")
    pairs = t("orders").select(F.concat(F.lit("la"), (k * 7 % 150).cast("string")).alias("first"), F.concat(F.lit("e"), k.cast("string")).alias("second")).distinct()
    return event_order.order_of(t("claim")).holds(pairs, "first", "second")


@query("WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM quad WHERE p IN ('isPartOf', 'appliedTo')), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s AS child, o AS parent FROM c")
def a18_labelled_paths(t):
    edges = t("quad").where(F.col("p").isin("isPartOf", "appliedTo")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return Order(edges).reached().select(F.col("src").alias("child"), F.col("dst").alias("parent"))


# --- identity (I01, I02) ------------------------------------------------------------------------------------------

# customers in a row that share a change with the next one: classes are runs, pairs only touch
@query("WITH r AS (SELECT concat('e', c_custkey) AS ev, c_custkey // 13 AS g, count(*) OVER (PARTITION BY c_custkey // 13) AS n FROM customer) SELECT ev, min(ev) OVER (PARTITION BY g) AS rep FROM r WHERE n > 1")
def i02_chained_events(t):
    k = F.col("c_custkey")
    depends = t("customer").select(F.concat(F.lit("g"), k.cast("string")).alias("cg"), F.concat(F.lit("e"), k.cast("string")).alias("ev")).unionByName(t("customer").where("c_custkey % 13 > 0").select(F.concat(F.lit("g"), (k - 1).cast("string")).alias("cg"), F.concat(F.lit("e"), k.cast("string")).alias("ev")))
    own = event_order.identified(depends)
    size = own.groupBy(F.col("rep").alias("__rep")).count()
    return own.join(size.where("count > 1"), F.col("rep") == F.col("__rep")).select("ev", "rep")


_LINKED = "lk AS (SELECT DISTINCT concat('c', o_custkey) AS a, concat('x', CAST(o_orderdate AS DATE)) AS b FROM orders WHERE o_orderkey % 9 = 0)"


@query(f"WITH RECURSIVE {_LINKED}, ways AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), r AS (SELECT a AS n, a AS m FROM ways UNION SELECT r.n, ways.b FROM r JOIN ways ON r.m = ways.a) SELECT n, min(m) AS rep FROM r GROUP BY n")
def i02_classes(t):
    pairs = t("orders").where("o_orderkey % 9 = 0").select(F.concat(F.lit("c"), _s("o_custkey")).alias("a"), F.concat(F.lit("x"), F.to_date("o_orderdate").cast("string")).alias("b"))
    return components(pairs)


# orders are the subjects: the functional property makes customers with a common account one; the key (account, day) makes their
# orders one; the sub-property, its range and a union of classes add statements to merged nodes
_FACTS = """f AS (SELECT concat('o', o_orderkey) AS s, 'placedBy' AS p, concat('c', o_custkey) AS o FROM orders WHERE o_orderkey % 3 = 0
  UNION SELECT concat('o', o_orderkey), 'day', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0
  UNION SELECT concat('k', c_custkey // 4), 'accountOf', concat('c', c_custkey) FROM customer WHERE c_custkey % 20 < 8),
  cr AS (SELECT o AS n, min(o) OVER (PARTITION BY s) AS rep FROM f WHERE p = 'accountOf'),
  g AS (SELECT s, p, coalesce(rep, o) AS o FROM f LEFT JOIN cr ON o = n),
  w AS (SELECT a.s AS n, min(a.s) OVER (PARTITION BY a.o, b.o) AS rep FROM g a JOIN g b ON a.s = b.s AND b.p = 'day' WHERE a.p = 'placedBy'),
  h AS (SELECT DISTINCT coalesce(w.rep, s) AS s, p, o FROM g LEFT JOIN w ON s = n)"""


def _facts(t):
    orders, customers = t("orders").where("o_orderkey % 3 = 0"), t("customer").where("c_custkey % 20 < 8")
    o = F.concat(F.lit("o"), _s("o_orderkey")).alias("s")
    rows = orders.select(o, F.lit("placedBy").alias("p"), F.concat(F.lit("c"), _s("o_custkey")).alias("o")).unionByName(orders.select(o, F.lit("day").alias("p"), F.to_date("o_orderdate").cast("string").alias("o")))
    rows = rows.unionByName(customers.select(F.concat(F.lit("k"), F.floor(F.col("c_custkey") / 4).cast("string")).alias("s"), F.lit("accountOf").alias("p"), F.concat(F.lit("c"), _s("c_custkey")).alias("o")))
    make = rows.sparkSession.createDataFrame
    return inference.reasoned(
        rows, functional=["accountOf"], keys=[["placedBy", "day"]], literals=["day"], supers=make([("placedBy", "concerns")], "p string, q string"),
        ranges=make([("concerns", "Buyer")], "p string, class string"), unions=make([("Agent", "Buyer")], "class string, member string"), transitives=[], symmetrics=[],
    )


@query(f"WITH {_FACTS} SELECT s, p, o FROM h UNION SELECT s, 'concerns', o FROM h WHERE p = 'placedBy' UNION SELECT o, 'type', 'Buyer' FROM h WHERE p = 'placedBy' UNION SELECT o, 'type', 'Agent' FROM h WHERE p = 'placedBy'")
def i01_reasoned(t):
    return _facts(t)[0]


@query(f"WITH {_FACTS} SELECT DISTINCT n, rep FROM (SELECT * FROM cr UNION SELECT * FROM w) WHERE n <> rep")
def i01_identities(t):
    return _facts(t)[1]


@query(f"WITH {_FACTS}, e AS (SELECT s, p, o FROM h WHERE p = 'placedBy') SELECT s, p, coalesce(n, o) AS o FROM e LEFT JOIN (SELECT DISTINCT n, rep FROM cr) m ON m.rep = e.o")
def i01_expanded(t):
    rows, members = _facts(t)
    every = members.unionByName(members.select(F.col("rep").alias("n"), "rep")).distinct()
    return expanded(rows.where("p = 'placedBy'"), every, "o")
