"""Queries of the graph's operators that ``catalogue`` doesn't hold, each with its SQL; registered with those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import geo, text, times
from chronolith.functions.ids import signature
from chronolith.operators import changes, compare, evolution, graph, inference, labels, linking, metrics, reading, rooting, temporal, validation
from chronolith.plans.catalogue import ORACLES, _ALLEN, _CLASSES, _EVOLUTION, _LINKS, _PRUNED, _ROOTS, KIND_SQL, LABELLED_SQL, _classes, _evolution_inputs, _ids, number_sql, query, sig, simplified_sql, thoroughfare_sql
from chronolith.plans.tables import SQL as TYPED
from chronolith.service import Service
from chronolith.sources import config, states_json


def _s(c):
    return F.col(c).cast("string")


# --- labels and rooting (L03, R01-R20) -------------------------------------------------------------------


@query(f"WITH {LABELLED_SQL} SELECT lm AS s, 'labels' AS g, 'prefLabel' AS p, pref_label AS o FROM labelled WHERE pref_label IS NOT NULL UNION ALL SELECT lm, 'labels', 'hiddenLabel', hidden_label FROM labelled WHERE hidden_label IS NOT NULL")
def l03_label_graph(t):
    own = labels.with_labels(t("landmark")).withColumn("g", F.lit("labels"))
    return graph.statements(own, "lm", {"pref_label": ("prefLabel", "literal"), "hidden_label": ("hiddenLabel", "literal")}).select("s", "g", "p", "o")


_CONTAINED = f"""by_label AS (SELECT trace, root FROM roots), contained AS (SELECT l.lm AS trace, min({sig('Landmark', 'l.type', 'l.hidden_label', "'Belongs'", 'r.root')}) AS root FROM labelled l JOIN relation x ON x.locatum = l.lm AND x.type = 'Belongs' JOIN roots r ON r.trace = x.relatum WHERE l.type = 'StreetNumber' AND l.hidden_label IS NOT NULL GROUP BY l.lm),
  every AS (SELECT * FROM by_label UNION ALL SELECT * FROM contained)"""


def _landmark_roots(t):
    own = labels.with_labels(t("landmark"))
    by_label = rooting.landmarks_by_label(own).select("trace", "root")
    contained = rooting.landmarks_by_relation(own, t("relation"), by_label).groupBy("trace").agg(F.min("root").alias("root"))
    return by_label.unionByName(contained.join(by_label.select("trace"), "trace", "left_anti"))


@query(f"WITH {LABELLED_SQL}, {_ROOTS}, {_CONTAINED} SELECT trace, root FROM every")
def r01_roots_in_order(t):
    return _landmark_roots(t)


@query(f"WITH {LABELLED_SQL} SELECT lm AS trace, type, hidden_label FROM labelled WHERE type <> 'StreetNumber' AND g IN ('g0', 'g2') AND n % 3 <> 0 AND hidden_label IS NOT NULL")
def r02_candidates_by_label(t):
    lm = t("landmark")
    registry = lm.sparkSession.createDataFrame([(g, "source", g in ("g0", "g2"), g, "fr") for g in ("g0", "g1", "g2", "g3")], "g string, role string, is_active boolean, label string, lang string")
    own = labels.with_labels(graph.in_active_sources(lm, registry))
    return rooting.landmarks_by_label(own, lm.where("n % 3 = 0").select(F.col("lm").alias("trace"))).select("trace", "type", "hidden_label")


@query(f"WITH {LABELLED_SQL}, {_ROOTS} SELECT l.lm AS trace, x.lr AS relation, {sig('LandmarkRelation', chr(39) + 'Belongs' + chr(39), sig('Landmark', 'l.type', 'l.hidden_label', chr(39) + 'Belongs' + chr(39), 'r.root'), 'r.root')} AS relation_root FROM labelled l JOIN relation x ON x.locatum = l.lm AND x.type = 'Belongs' JOIN roots r ON r.trace = x.relatum WHERE l.type = 'StreetNumber' AND l.hidden_label IS NOT NULL")
def r04_contained_candidates(t):
    own = labels.with_labels(t("landmark"))
    return rooting.landmarks_by_relation(own, t("relation"), rooting.landmarks_by_label(own)).select("trace", "relation", "relation_root")


@query(f"WITH {LABELLED_SQL}, {_ROOTS} SELECT DISTINCT x.lr AS trace, x.type, a.root AS locatum_root FROM relation x JOIN roots a ON a.trace = x.locatum JOIN roots b ON b.trace = x.relatum")
def r07_relation_candidates(t):
    return rooting.relations_by_members(t("relation"), rooting.landmarks_by_label(labels.with_labels(t("landmark")))).select("trace", "type", "locatum_root")


@query(f"SELECT DISTINCT attr AS trace, attr_type, {sig('Landmark', 'lm')} AS parent_root FROM version WHERE source <> 's2'")
def r09_attribute_candidates(t):
    v = t("version").where("source <> 's2'").select("attr", "attr_type", "lm").distinct()
    roots = v.select(F.col("lm").alias("trace"), signature("Landmark", "lm").alias("root")).distinct()
    return rooting.by_parent(v, "attr", "Attribute", ["attr_type"], "lm", roots).select("trace", "attr_type", "parent_root")


_CRISP = f"i AS (SELECT t, {sig('CrispTimeInstant', 'strftime(stamp, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')', 'precision', 'calendar')} AS root FROM instant)"


def _crisp(t):
    return rooting.instants(t("instant").withColumn("stamp", F.date_format("stamp", "yyyy-MM-dd")))


@query(f"WITH {_CRISP}, p AS (SELECT concat('n', o_orderkey) AS n, concat('t', o_orderkey) AS b, CASE WHEN o_orderkey % 2 = 0 THEN concat('t', o_custkey) END AS e FROM orders) SELECT n AS trace, {sig('TimeInterval', 'b.root', 'e.root')} AS root FROM p LEFT JOIN i b ON p.b = b.t LEFT JOIN i e ON p.e = e.t")
def r12_intervals(t):
    k = F.col("o_orderkey")
    pairs = t("orders").select(F.concat(F.lit("n"), _s("o_orderkey")).alias("t"), F.concat(F.lit("t"), _s("o_orderkey")).alias("begin"), F.when(k % 2 == 0, F.concat(F.lit("t"), _s("o_custkey"))).alias("end"))
    return rooting.pairs_of_times(pairs, "TimeInterval", _crisp(t)).select("trace", "root")


@query("SELECT t, strftime(stamp, '%Y-%m-%d') AS stamp FROM instant WHERE calendar = 'gregorian' AND t NOT IN (SELECT t FROM instant AS d WHERE d.precision = 'day')")
def r13_time_candidates(t):
    i = t("instant")
    left = i.where("calendar = 'gregorian'").join(i.where("precision = 'day'").select("t"), "t", "left_anti")
    return rooting.instants(left.withColumn("stamp", F.date_format("stamp", "yyyy-MM-dd"))).select(F.col("trace").alias("t"), "stamp")


_CHANGES = f"""cg AS (SELECT concat('c', lm, type) AS c, lm, 'LandmarkAppearance' AS kind FROM landmark UNION ALL SELECT concat('d', lm), lm, 'LandmarkDisappearance' FROM landmark WHERE n % 2 = 0)"""
_CHANGE_ROOTS = f"{LABELLED_SQL}, {_ROOTS}, {_CHANGES}, cr AS (SELECT c AS trace, kind, root AS parent, {sig('Change', 'kind', 'root')} AS root FROM cg JOIN roots ON roots.trace = cg.lm)"


def _change_roots(t):
    lm = t("landmark")
    rows = lm.select(F.concat(F.lit("c"), "lm", "type").alias("cg"), "lm", F.lit("LandmarkAppearance").alias("kind")).unionByName(lm.where("n % 2 = 0").select(F.concat(F.lit("d"), "lm").alias("cg"), "lm", F.lit("LandmarkDisappearance").alias("kind")))
    return rooting.by_parent(rows, "cg", "Change", ["kind"], "lm", rooting.landmarks_by_label(labels.with_labels(lm)))


@query(f"WITH {_CHANGE_ROOTS} SELECT trace, kind, root FROM cr")
def r14_changes(t):
    return _change_roots(t).select("trace", "kind", "root")


@query(f"WITH {_CHANGE_ROOTS} SELECT concat('e', cr.trace) AS trace, {sig('Event', 'cr.root')} AS root FROM cr")
def r15_events(t):
    own = _change_roots(t)
    return rooting.by_parent(own.select(F.concat(F.lit("e"), "trace").alias("ev"), "trace"), "ev", "Event", [], "trace", own).select("trace", "root")


@query(f"WITH {_CHANGE_ROOTS} SELECT DISTINCT root, parent AS applied_to FROM cr WHERE kind = 'LandmarkDisappearance'")
def r16_change_candidates(t):
    return _change_roots(t).where("kind = 'LandmarkDisappearance'").select("root", F.col("parent_root").alias("applied_to")).distinct()


@query(f"""WITH {LABELLED_SQL}, g AS (SELECT type, hidden_label, lang, min(CASE WHEN n % 2 = 0 THEN concat('old:', lm) END) AS known FROM labelled WHERE kind <> 'number' AND hidden_label IS NOT NULL GROUP BY ALL)
  SELECT l.lm AS trace, coalesce(g.known, {sig('Landmark', 'l.type', 'l.hidden_label', 'l.lang')}) AS root FROM labelled l JOIN g ON g.type = l.type AND g.hidden_label = l.hidden_label AND g.lang IS NOT DISTINCT FROM l.lang""")
def r17_optional_root_or_new(t):
    own = labels.with_labels(t("landmark")).where((F.col("type") != "StreetNumber") & F.col("hidden_label").isNotNull())
    known = own.where("n % 2 = 0").select("type", "hidden_label", "lang", F.concat(F.lit("old:"), "lm").alias("root"))
    return rooting.rooted(own, "lm", "Landmark", ["type", "hidden_label", "lang"], known, ignore_null=False).select(F.col("lm").alias("trace"), "root")


@query("""WITH m AS (SELECT concat('c', c_custkey) AS old, concat('nation:', c_nationkey) AS new FROM customer WHERE c_custkey % 3 = 0), q AS (SELECT DISTINCT coalesce(a.new, s) AS s, p, coalesce(b.new, o) AS o FROM quad LEFT JOIN m a ON s = a.old LEFT JOIN m b ON o = b.old)
  SELECT q.o AS landmark, count(DISTINCT q.s) AS changes FROM q WHERE q.p = 'appliedTo' GROUP BY q.o""")
def r20_prototype_chain(t):
    pairs = t("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), _s("c_custkey")).alias("old"), F.concat(F.lit("nation:"), _s("c_nationkey")).alias("new"))
    return rooting.collapsed(t("quad"), pairs).where("p = 'appliedTo'").groupBy(F.col("o").alias("landmark")).agg(F.count_distinct("s").alias("changes"))


# --- comparison (V01-V07) -----------------------------------------------------------------------------------


def _name_versions(t):
    own = labels.with_labels(t("landmark"))
    rows = rooting.landmarks_by_label(own).join(own.select(F.col("lm").alias("trace"), "label", "lang"), "trace")
    return rows.select("root", "trace", F.col("trace").alias("av"), F.lit("Name").alias("attr_type"), F.col("type").alias("lm_type"), F.col("label").alias("value"), "lang")


@query("SELECT a.av AS av1, b.av AS av2 FROM version a JOIN version AS b ON a.lm = b.lm AND a.attr_type = b.attr_type AND a.av <> b.av WHERE a.attr_type IN ('signup', 'purchase')")
def v01_candidate_pairs(t):
    own = t("version").where("attr_type in ('signup', 'purchase')").select(F.concat_ws("/", "lm", "attr_type").alias("root"), F.col("av").alias("trace"), "av", F.lit("InseeCode").alias("attr_type"), F.lit("District").alias("lm_type"), "value", F.lit(None).cast("string").alias("lang"))
    return compare.compared(own).select("av1", "av2")


@query(f"WITH {LABELLED_SQL} SELECT lm AS av, hidden_label AS as_name FROM labelled WHERE kind <> 'number'")
def v02_processed_values(t):
    own = t("landmark").where("type <> 'StreetNumber'").select(F.col("lm").alias("av"), F.lit("Name").alias("attr_type"), F.col("type").alias("lm_type"), F.col("label").alias("value"), "lang")
    return compare.processed(own).select("av", "as_name")


@query(f"SELECT lm, {KIND_SQL} AS kind, type = 'StreetNumber' AS by_distance FROM landmark")
def v04_kinds(t):
    kind = text.kind_of_name(F.col("type"))
    return t("landmark").select("lm", kind.alias("kind"), (kind == "number").alias("by_distance"))


@query(f"""WITH {_PRUNED}, prv AS (SELECT *, lag(traces) OVER (PARTITION BY attr ORDER BY n) AS earlier FROM prn), x AS (SELECT unnest(earlier) AS a, traces FROM prv WHERE NOT begin_real AND earlier IS NOT NULL), y AS (SELECT a, unnest(traces) AS b FROM x)
  SELECT DISTINCT va.value AS v1, vb.value AS v2, false AS same FROM y JOIN version va ON va.av = a JOIN version vb ON vb.av = b WHERE va.value <> vb.value""")
def v07_judged_neighbours(t):
    """The pairs of values that meet in time, and only they, are judged."""
    own = t("version").select(F.lit("r").alias("root"), F.col("av").alias("trace"), "av", F.lit("InseeCode").alias("attr_type"), F.lit("District").alias("lm_type"), "value", F.lit(None).cast("string").alias("lang"))
    values = compare.valued(own)
    versions, stated = _evolution_inputs(t)
    versions = versions.drop("vid").join(values.select(F.col("av").alias("__av"), "vid"), F.col("av") == F.col("__av")).drop("__av")
    met = []

    def judge(pairs):
        met.append(compare.judged(values)(pairs))
        return met[0]

    evolution.continued(evolution.pruned(evolution.covered(evolution.elementary_changes(evolution.stated_and_virtual(versions, stated)))), judge)
    name = lambda k: values.groupBy(F.col("vid").alias(f"__v{k}")).agg(F.any_value("as_code").alias(f"c{k}"))
    rows = met[0].join(name(1), F.col("v1") == F.col("__v1")).join(name(2), F.col("v2") == F.col("__v2"))
    return rows.select(F.col("c1").alias("v1"), F.col("c2").alias("v2"), "same")


# --- changes and evolution (E05, E07, K01-K18) ---------------------------------------------------------------------


@query(f"WITH ev AS (SELECT {sig('Event', chr(39) + 'LandmarkAppearance' + chr(39), 'lm')} AS ev, min(begin) AS t, 'hasTimeBefore' AS prop FROM version WHERE begin IS NOT NULL GROUP BY lm UNION ALL SELECT {sig('Event', chr(39) + 'LandmarkDisappearance' + chr(39), 'lm')}, max(ending), 'hasTimeAfter' FROM version WHERE ending IS NOT NULL GROUP BY lm) SELECT ev, prop, t FROM ev")
def e05_times_of_missing_events(t):
    v = t("version")
    none = v.sparkSession.createDataFrame([], "applied_to string, type string")
    missing = changes.missing_changes(v.select(F.col("lm").alias("elem"), F.lit("Landmark").alias("kind")).distinct(), none)
    bounds = missing.join(v.select("lm", "begin", F.col("ending").alias("end")), F.col("applied_to") == F.col("lm")).select("ev", "type", "begin", "end")
    given = v.sparkSession.createDataFrame([], "ev string, prop string, t timestamp_ntz")
    return changes.final_times(changes.candidate_times(given, bounds))


@query(f"SELECT lm, {sig('FuzzyTimeInstant', 'a', 'z')} AS t FROM (SELECT lm, max(begin) AS a, min(ending) AS z FROM version GROUP BY lm) WHERE a IS NOT NULL OR z IS NOT NULL".replace("'a'", "'a'"))
def e07_one_fuzzy_instant(t):
    v = t("version")
    own = v.where("begin is not null").select(F.col("lm").alias("ev"), F.lit("hasTimeAfter").alias("prop"), F.col("begin").alias("t")).unionByName(v.where("ending is not null").select(F.col("lm").alias("ev"), F.lit("hasTimeBefore").alias("prop"), F.col("ending").alias("t")))
    return changes.fuzzy_instants(changes.final_times(own)).select(F.col("ev").alias("lm"), "t")


@query("SELECT attr, stamp, cg, makes, outdates FROM (SELECT attr, stamp, cg, made AS makes, NULL AS outdates FROM stated UNION ALL SELECT attr, begin, NULL, av, NULL FROM version WHERE begin IS NOT NULL UNION ALL SELECT attr, ending, NULL, NULL, av FROM version WHERE ending IS NOT NULL)")
def k02_stated_and_virtual(t):
    first = lambda c: F.try_element_at(c, F.lit(1))["av"].alias(c)
    return evolution.stated_and_virtual(*_evolution_inputs(t)).where("stamp is not null").select("attr", "stamp", "cg", first("makes"), first("outdates"))


@query("SELECT attr, count(DISTINCT av) AS versions, count(DISTINCT cg) AS changes FROM (SELECT attr, av, NULL AS cg FROM version UNION ALL SELECT attr, NULL, cg FROM stated) GROUP BY attr")
def k01_loaded_attributes(t):
    versions, stated = _evolution_inputs(t)
    a = versions.groupBy("attr").agg(F.count_distinct("av").alias("versions"))
    b = stated.groupBy(F.col("attr").alias("__attr")).agg(F.count_distinct("cg").alias("n"))
    return a.join(b, F.col("attr") == F.col("__attr"), "left").select("attr", "versions", F.coalesce("n", F.lit(0)).alias("changes"))


@query("""WITH e AS (SELECT attr, stamp, cg, made AS mk, NULL AS od, precision AS r FROM stated UNION ALL SELECT attr, begin, NULL, av, NULL, -1 FROM version WHERE begin IS NOT NULL UNION ALL SELECT attr, ending, NULL, NULL, av, -1 FROM version WHERE ending IS NOT NULL)
  SELECT attr, stamp, max(r) AS rank, coalesce(string_agg(DISTINCT cg, '|' ORDER BY cg), '') AS real, coalesce(string_agg(DISTINCT mk, '|' ORDER BY mk), '') AS makes, coalesce(string_agg(DISTINCT od, '|' ORDER BY od), '') AS outdates FROM e GROUP BY attr, stamp""")
def k03_collapsed_changes(t):
    rows = evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t))).where("side = 0")
    avs = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["av"]))), "|").alias(c)
    return rows.select("attr", "stamp", "rank", F.array_join("real", "|").alias("real"), avs("makes"), avs("outdates"))


@query(f"WITH {_EVOLUTION} SELECT attr, cast(idx AS int) AS idx, cast(side AS int) AS side FROM ch WHERE side <> 0")
def k04_infinite_boundaries(t):
    return evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t))).where("side in (-1, 1)").select("attr", "idx", "side")


@query(f"WITH {_PRUNED} SELECT attr, count(*) AS segments, count(*) FILTER (gone) AS removed FROM mk GROUP BY attr")
def k08_segments_by_attribute(t):
    points = evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))
    rows = evolution.covered(points)
    gone = (F.size("traces") == 0) & ~(F.col("begin_real") & F.col("end_real"))
    return rows.groupBy("attr").agg(F.count(F.lit(1)).alias("segments"), F.count_if(gone).alias("removed"))


@query(f"WITH {_PRUNED} SELECT attr, seg FROM mk WHERE gone")
def k09_empty_segments(t):
    rows = evolution.covered(evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t))))
    return rows.where((F.size("traces") == 0) & ~(F.col("begin_real") & F.col("end_real"))).select("attr", F.col("seg").cast("long").alias("seg"))


@query(f"WITH {_PRUNED} SELECT attr, count(*) AS kept FROM kp GROUP BY attr")
def k11_kept_segments(t):
    rows = evolution.pruned(evolution.covered(evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))))
    return rows.groupBy("attr").agg(F.count(F.lit(1)).alias("kept"))


_JUDGED = f"""{_PRUNED},
  prv AS (SELECT *, lag(traces) OVER (PARTITION BY attr ORDER BY n) AS earlier FROM prn),
  jd AS (SELECT p.attr, p.n, bool_or(x.a = x.b OR va.value = vb.value) AND NOT bool_or(x.a <> x.b AND va.value <> vb.value) AS mrg FROM prv p, LATERAL (SELECT u.a, w.b FROM (SELECT unnest(p.earlier) AS a) u, (SELECT unnest(p.traces) AS b) w) x JOIN version va ON va.av = x.a JOIN version vb ON vb.av = x.b WHERE NOT p.begin_real AND p.earlier IS NOT NULL GROUP BY p.attr, p.n)"""


def _segments(t):
    return evolution.pruned(evolution.covered(evolution.elementary_changes(evolution.stated_and_virtual(*_evolution_inputs(t)))))


@query(f"WITH {_JUDGED} SELECT prn.attr, prn.n, coalesce(mrg, false) AS merge FROM prn LEFT JOIN jd ON jd.attr = prn.attr AND jd.n = prn.n")
def k12_merge_predicate(t):
    return evolution.continued(_segments(t)).select("attr", F.col("n").cast("long").alias("n"), "merge")


@query(f"WITH {_JUDGED} SELECT prn.attr, prn.n, coalesce(mrg, false) AS merge FROM prn LEFT JOIN jd ON jd.attr = prn.attr AND jd.n = prn.n")
def k12_merge_by_judgement(t):
    same = lambda pairs: pairs.select("v1", "v2", (F.col("v1") == F.col("v2")).alias("same"))
    return evolution.continued(_segments(t), same).select("attr", F.col("n").cast("long").alias("n"), "merge")


@query("SELECT a.attr, a.av AS av1, b.av AS av2 FROM (SELECT *, dense_rank() OVER (PARTITION BY attr ORDER BY begin) AS r FROM version WHERE begin IS NOT NULL) a JOIN (SELECT *, dense_rank() OVER (PARTITION BY attr ORDER BY begin) AS r FROM version WHERE begin IS NOT NULL) b ON a.attr = b.attr AND b.r = a.r + 1")
def k16_next_changes(t):
    return graph.following(t("version"), "attr", "begin", "av")


@query(f"WITH {_JUDGED}, isl AS (SELECT prn.*, sum(CASE WHEN coalesce(mrg, false) THEN 0 ELSE 1 END) OVER (PARTITION BY prn.attr ORDER BY prn.n) AS version FROM prn LEFT JOIN jd ON jd.attr = prn.attr AND jd.n = prn.n) SELECT attr, string_agg(cast(n AS varchar), '|' ORDER BY n) AS members FROM isl GROUP BY attr, version")
def k17_merge_sets(t):
    return evolution.merge_sets(evolution.continued(_segments(t))).select("attr", "members")


@query(f"WITH {_PRUNED} SELECT attr, n, begin_after AS a, end_before AS z FROM prn WHERE len(traces) > 0")
def k18_versions_with_traces(t):
    return _segments(t).where(F.size("traces") > 0).select("attr", F.col("n").cast("long").alias("n"), F.col("begin_after").alias("a"), F.col("end_before").alias("z"))


# --- temporal relations (T02-T07) --------------------------------------------------------------------------------


_PAIRS = """p AS (SELECT a.grp, a.t AS t1, b.t AS t2 FROM x a JOIN x AS b ON a.grp = b.grp AND a.calendar = b.calendar AND (a.stamp < b.stamp OR (a.stamp = b.stamp AND a.t < b.t)))"""


@query(f"WITH x AS (SELECT ev AS grp, t, stamp, calendar FROM instant), {_PAIRS} SELECT * FROM p")
def t02_instants_of_events(t):
    i = t("instant")
    return temporal.compared_instants(temporal.instants_of_events(i.select("ev", "t"), i.drop("ev")), "grp").select("grp", "t1", "t2")


@query(f"WITH x AS (SELECT concat('r', cast(ev AS bigint) // 3) AS grp, t, stamp, calendar FROM instant), {_PAIRS} SELECT * FROM p")
def t02_instants_of_traces(t):
    i = t("instant")
    traces = i.select(F.col("ev").alias("trace")).distinct().select("trace", F.concat(F.lit("r"), F.floor(F.col("trace").cast("long") / 3).cast("string")).alias("root"))
    return temporal.compared_instants(temporal.instants_of_traces(traces, i.select("ev", "t"), i.drop("ev")), "grp").select("grp", "t1", "t2")


@query(f"WITH x AS (SELECT concat('a', cast(ev AS bigint) % 40) AS grp, t, stamp, calendar FROM instant), {_PAIRS} SELECT * FROM p")
def t02_instants_of_attributes(t):
    i = t("instant")
    own = i.select("ev").distinct().select("ev", F.concat(F.lit("a"), (F.col("ev").cast("long") % 40).cast("string")).alias("attr"))
    return temporal.compared_instants(temporal.instants_of_attributes(own, i.select("ev", "t"), i.drop("ev")), "grp").select("grp", "t1", "t2")


@query("SELECT ev, t AS t1, lead(t) OVER w AS t2 FROM instant WINDOW w AS (PARTITION BY ev, calendar ORDER BY stamp, t) QUALIFY lead(t) OVER w IS NOT NULL")
def t01_steps_of_instants(t):
    return temporal.steps_of_instants(t("instant"), "ev").select("ev", "t1", "t2")


@query(f"""WITH nb AS (SELECT grp, i AS p, begin AS b1, ending AS e1, lead(i) OVER w AS q, lead(begin) OVER w AS b2, lead(ending) OVER w AS e2 FROM interval AS z WINDOW w AS (PARTITION BY grp ORDER BY begin, ending, i)),
  pr AS (SELECT grp, p AS i1, q AS i2, b1 AS ab, e1 AS ae, b2 AS bb, e2 AS be, 0 AS way FROM nb WHERE q IS NOT NULL UNION ALL SELECT grp, q, p, b2, e2, b1, e1, 1 FROM nb WHERE q IS NOT NULL),
  rl AS (SELECT grp, i1, i2, way, least(i1, i2) AS k1, greatest(i1, i2) AS k2, {_ALLEN.replace('a.begin', 'ab').replace('a.ending', 'ae').replace('b.begin', 'bb').replace('b.ending', 'be')} AS relation FROM pr)
  SELECT grp, i1, i2, relation FROM (SELECT *, row_number() OVER (PARTITION BY grp, k1, k2 ORDER BY way) AS n FROM rl WHERE relation IS NOT NULL) WHERE n = 1""".replace("FROM interval AS z", "FROM ivl"))
def t03_steps_of_intervals(t):
    return temporal.steps_of_intervals(t("interval").withColumnRenamed("ending", "end"), "grp")


ORACLES["t03_steps_of_intervals"] = f"WITH ivl AS ({TYPED['interval'].format(lineitem='lineitem')}), " + ORACLES["t03_steps_of_intervals"].removeprefix("WITH ")


@query("SELECT ev, count(*) AS n FROM candidate GROUP BY ev")
def t05_without_bounds(t):
    c = t("candidate")
    bounds = temporal.earliest_and_latest(c.select("ev", "prop", F.col("t").alias("stamp"), F.lit("day").alias("precision")))
    with_bounds = c.groupBy("ev").agg(F.count(F.lit(1)).alias("n")).join(bounds, "ev")
    return temporal.without_bounds(with_bounds)


_CHAIN = """et AS (SELECT cast(o_custkey AS varchar) AS ev, CASE WHEN o_orderkey % 40 = 0 THEN 'hasTime' WHEN o_orderkey % 2 = 0 THEN 'hasTimeBefore' ELSE 'hasTimeAfter' END AS prop, concat('t', o_orderkey) AS t, o_orderdate AS stamp FROM orders),
  bd AS (SELECT ev, min(CASE WHEN prop = 'hasTime' THEN stamp END) AS c, max(CASE WHEN prop = 'hasTimeAfter' THEN stamp END) AS e, min(CASE WHEN prop = 'hasTimeBefore' THEN stamp END) AS l FROM et GROUP BY ev),
  sd AS (SELECT concat('v', c_custkey) AS av, concat('g', c_custkey % 50) AS grp, cast(c_custkey AS varchar) AS b, cast(c_custkey + 1 AS varchar) AS z FROM customer),
  iv AS (SELECT grp, av AS i, coalesce(x.c, x.l, x.e) AS begin, coalesce(y.c, y.e, y.l) AS ending FROM sd LEFT JOIN bd x ON x.ev = sd.b LEFT JOIN bd y ON y.ev = sd.z)"""


def _chain(t):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    et = t("orders").select(_s("o_custkey").alias("ev"), F.when(o % 40 == 0, "hasTime").when(o % 2 == 0, "hasTimeBefore").otherwise("hasTimeAfter").alias("prop"), F.concat(F.lit("t"), o.cast("string")).alias("t"))
    side = lambda name, by: t("customer").select(F.concat(F.lit("v"), k.cast("string")).alias("av"), F.concat(F.lit("g"), (k % 50).cast("string")).alias("grp"), F.lit(name).alias("side"), (k + by).cast("string").alias("ev"))
    return temporal.time_relations(et, t("instant").drop("ev"), side("begin", 0).unionByName(side("end", 1)))


@query(f"WITH {_CHAIN} SELECT grp, i, begin, ending FROM iv")
def t07_intervals_of_chain(t):
    return _chain(t)["intervals"].withColumnRenamed("end", "ending")


@query(f"WITH {_CHAIN} SELECT a.grp, a.i AS i1, b.i AS i2 FROM iv a JOIN iv AS b ON a.grp = b.grp AND a.i <> b.i AND a.ending < b.begin")
def t07_relations_of_chain(t):
    return _chain(t)["relations"].where("relation = 'before'").select("grp", "i1", "i2")


# --- reading (Q02-Q21, W01, W02) ---------------------------------------------------------------------------------------


def _service(t, **settings):
    lm = t("landmark")
    make = lm.sparkSession.createDataFrame
    code = make([("landmark", "Thoroughfare", "Voie", "fr"), ("landmark", "Thoroughfare", "Street", "en"), ("landmark", "District", "Quartier", "fr"), ("attribute", "Name", "Nom", "fr")], "kind string, code string, label string, lang string")
    bounds = t("bound")
    return Service({"code": code, "landmark": lm, "relation": t("relation"), "registry": make([("g0", "final", True, "Faits", "fr")], "g string, role string, is_active boolean, label string, lang string"), "landmark_bounds": bounds.drop("lm"), "version_bounds": bounds.drop("lm").withColumn("elem", F.concat(F.lit("v"), "elem")), "version": t("version").withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))}, config.Reading(**settings))


@query("SELECT DISTINCT type, l AS label FROM landmark JOIN (VALUES ('Thoroughfare', 'Voie'), ('District', 'Quartier')) AS v(k, l) ON type = k")
def q02_type_labels(t):
    own = _service(t).types("landmark").select("code", F.col("label").alias("l"))
    return t("landmark").join(own, F.col("type") == F.col("code")).select("type", F.col("l").alias("label")).distinct()


_SHOWN = "SELECT a.lm, a.type, CASE WHEN r.rl IS NULL THEN a.label ELSE concat(a.label, ' (', r.rl, ')') END AS label FROM (SELECT * FROM landmark WHERE g = 'g1' AND (lang IS NULL OR lang = 'fr')) a LEFT JOIN (SELECT locatum, rl FROM (SELECT locatum, b.label AS rl, row_number() OVER (PARTITION BY locatum ORDER BY b.label NULLS LAST, lr) AS k FROM relation LEFT JOIN (SELECT * FROM landmark WHERE g = 'g1' AND (lang IS NULL OR lang = 'fr')) b ON relatum = b.lm) WHERE k = 1) r ON a.lm = r.locatum"


@query(f"SELECT lm, label FROM ({_SHOWN})")
def q03_landmarks_of_graph(t):
    return _service(t).landmarks("g1")


@query(f"SELECT lm, label FROM ({_SHOWN}) WHERE type = 'StreetNumber'")
def q04_landmarks_by_type(t):
    return _service(t).landmarks("g1", "StreetNumber")


@query("SELECT av, value FROM version WHERE cast(substr(av, 2) AS bigint) % 7 = 0")
def q09_values_of_versions(t):
    v = t("version")
    return reading.values_of(v, v.where("cast(substr(av, 2) as bigint) % 7 = 0").select("av"))


@query("SELECT 'v' || b.elem AS av, v.value, CASE WHEN app_crisp IS NOT NULL THEN 'crisp' WHEN coalesce(app_begin, app_end) IS NOT NULL THEN 'fuzzy' END AS start, CASE WHEN dis_crisp IS NOT NULL THEN 'crisp' WHEN coalesce(dis_begin, dis_end) IS NOT NULL THEN 'fuzzy' END AS finish FROM version v LEFT JOIN bound b ON v.av = 'v' || b.elem")
def q11_evolution_features(t):
    bounds = t("bound").drop("lm").withColumn("elem", F.concat(F.lit("v"), "elem"))
    rows = reading.timeline(t("version"), bounds)
    side = lambda s: reading.boundary(*[F.col(f"{s}_{k}") for k in ("crisp", "begin", "end")], F.lit("day"), F.lit("gregorian"))["kind"]
    return rows.select("av", "value", side("app").alias("start"), side("dis").alias("finish"))


@query("SELECT elem, CASE WHEN dis_crisp IS NOT NULL THEN 'crisp' ELSE 'fuzzy' END AS kind, dis_crisp AS value, CASE WHEN dis_crisp IS NULL THEN dis_begin END AS begin, CASE WHEN dis_crisp IS NULL THEN dis_end END AS ending FROM bound WHERE coalesce(dis_crisp, dis_begin, dis_end) IS NOT NULL")
def q12_boundary_structs(t):
    edge = reading.boundary(F.col("dis_crisp"), F.col("dis_begin"), F.col("dis_end"), F.lit("day"), F.lit("gregorian"))
    return t("bound").withColumn("e", edge).where("e is not null").select("elem", "e.kind", "e.value", "e.begin", F.col("e.end").alias("ending"))


@query("SELECT elem, CASE WHEN dis_crisp IS NOT NULL THEN 'crisp' WHEN dis_begin IS NOT NULL AND dis_end IS NOT NULL THEN 'fuzzy' WHEN dis_begin IS NOT NULL THEN 'after' WHEN dis_end IS NOT NULL THEN 'before' ELSE 'infinite' END AS class FROM bound")
def q14_version_dates(t):
    return t("bound").select("elem", reading.classified(F.col("dis_crisp"), F.col("dis_begin"), F.col("dis_end")).alias("class"))


@query(f"SELECT {sig('Address', 'locatum', 'relatum')} AS addr, concat('POINT (', p.x, ' ', p.y, ')') AS geometry FROM relation r JOIN landmark a ON locatum = a.lm AND a.type = 'StreetNumber' JOIN landmark b ON relatum = b.lm AND b.type = 'Thoroughfare' JOIN point p ON concat('lm', p.id) = a.lm WHERE r.type = 'Belongs' AND lower(concat(a.label, ', ', b.label)) = (SELECT min(lower(concat(a.label, ', ', b.label))) FROM relation r JOIN landmark a ON locatum = a.lm AND a.type = 'StreetNumber' JOIN landmark b ON relatum = b.lm AND b.type = 'Thoroughfare' WHERE r.type = 'Belongs')")
def q18_coordinates_of_address(t):
    rows = changes.addresses(t("relation"), t("landmark"))
    places = t("point").select(F.concat(F.lit("lm"), _s("id")).alias("lm"), F.concat(F.lit("POINT ("), _s("x"), F.lit(" "), _s("y"), F.lit(")")).alias("geometry"))
    first = rows.agg(F.min(F.lower("label"))).first()[0] or ""
    return reading.coordinates_of(rows, places, first.upper())


@query(f"SELECT DISTINCT concat(a.label, ', ', b.label) AS label FROM relation r JOIN landmark a ON locatum = a.lm AND a.type = 'StreetNumber' JOIN landmark b ON relatum = b.lm AND b.type = 'Thoroughfare' JOIN point p ON concat('lm', p.id) = a.lm WHERE r.type = 'Belongs' AND p.x >= -150 AND p.x < 150 AND p.y >= -60 AND p.y < 60")
def q19_addresses_within(t):
    area = {"type": "Polygon", "coordinates": [[[-150, -60], [150, -60], [150, 60], [-150, 60], [-150, -60]]]}
    inside = reading.within_area(t("point"), area).select(F.concat(F.lit("lm"), _s("id")).alias("__lm"))
    return changes.addresses(t("relation"), t("landmark")).join(inside, F.col("target") == F.col("__lm")).select("label").distinct()


@query("SELECT elem FROM bound WHERE coalesce(app_crisp, app_end, app_begin) <= TIMESTAMP '1998-06-01' AND coalesce(coalesce(dis_crisp, dis_begin, dis_end) > TIMESTAMP '1998-06-01', true)")
def q20_existing_at(t):
    return reading.existing_at(t("bound"), F.lit("1998-06-01").cast("timestamp_ntz"))


_HISTORY = "h AS (SELECT v.lm, v.av, v.value, coalesce(app_crisp, app_begin, app_end) AS a, coalesce(dis_crisp, dis_begin, dis_end) AS z FROM version v LEFT JOIN bound b ON v.av = 'v' || b.elem WHERE v.attr_type = 'view')"


@query(f"WITH {_HISTORY} SELECT lm, row_number() OVER (PARTITION BY lm ORDER BY a NULLS FIRST, av) AS n, av, value, a AS begin, z AS ending FROM h")
def q21_history_of_versions(t):
    return reading.history(t("version"), t("bound").withColumn("elem", F.concat(F.lit("v"), "elem")), "view").withColumnRenamed("end", "ending").withColumn("n", F.col("n").cast("long"))


@query(f"WITH {_HISTORY} SELECT lm, stamp, coalesce(string_agg(DISTINCT o, '|' ORDER BY o), '') AS outdates, coalesce(string_agg(DISTINCT m, '|' ORDER BY m), '') AS makes FROM (SELECT lm, a AS stamp, NULL AS o, av AS m FROM h UNION ALL SELECT lm, z, av, NULL FROM h) WHERE stamp IS NOT NULL GROUP BY lm, stamp")
def q21_history_of_changes(t):
    rows = reading.history_of_changes(t("version"), t("bound").withColumn("elem", F.concat(F.lit("v"), "elem")), "view")
    return rows.select("lm", "stamp", F.array_join("outdates", "|").alias("outdates"), F.array_join("makes", "|").alias("makes"))


@query("SELECT elem AS lm, app_crisp, dis_end FROM bound WHERE elem = (SELECT max(elem) FROM bound)")
def w01_valid_time(t):
    last = t("bound").agg(F.max("elem")).first()[0]
    return _service(t).valid_time(last).select(F.col("elem").alias("lm"), "app_crisp", "dis_end")


@query("SELECT g, 'Faits' AS label, 'en' AS lang FROM (SELECT DISTINCT g FROM landmark WHERE g = 'g0')")
def w02_settings_change_labels(t):
    own = config.reading({"default_lang": "en", "search_limit": 5, "time_delay_years": 3, "calendar": "gregorian"})
    rows = _service(t).graphs()
    return t("landmark").select("g").distinct().join(rows, "g").select("g", "label", F.lit(own.default_lang).alias("lang"))


# --- validation and inference (D06, D07, I01, I02) ----------------------------------------------------------------------------


@query(f"WITH {_CLASSES}, m AS (SELECT * FROM (VALUES {', '.join(str(x) for x in validation.MANDATORY)}) AS v(class, p)) SELECT DISTINCT cls.s, cls.class, m.p, 'mandatory' AS rule FROM cls JOIN m ON m.class = cls.class WHERE NOT EXISTS (SELECT 1 FROM quad q WHERE q.s = cls.s AND q.p = m.p)")
def d06_mandatory_properties(t):
    return validation.elements_report(t("quad"), _classes(t))


@query(f"""WITH {_CLASSES} SELECT DISTINCT s, p, NULL AS o, 'Change' AS expected, 'domain' AS rule FROM quad q WHERE p = 'appliedTo' AND NOT EXISTS (SELECT 1 FROM cls WHERE cls.s = q.s AND class = 'Change')
  UNION ALL SELECT DISTINCT s, p, NULL, 'CrispTimeInstant', 'domain' FROM quad q WHERE p = 'timeStamp'
  UNION ALL SELECT DISTINCT s, 'timeStamp', o, 'dateTimeStamp', 'range' FROM quad WHERE p = 'hasTime' AND o_dtype IS DISTINCT FROM 'dateTimeStamp'
  UNION ALL SELECT DISTINCT s, 'timeStamp', NULL, 'CrispTimeInstant', 'domain' FROM quad WHERE p = 'hasTime'""")
def d07_domains_and_ranges(t):
    quads = t("quad").withColumn("p", F.when(F.col("p") == "hasTime", "timeStamp").otherwise(F.col("p")))
    return validation.properties_report(quads, _classes(t))


@query("""SELECT s, 'type' AS p, 'Change' AS o FROM quad WHERE p = 'appliedTo' UNION SELECT o, 'type', 'Landmark' FROM quad WHERE p = 'appliedTo' UNION SELECT s, p, o FROM quad WHERE p = 'appliedTo'""")
def i01_types_of_domains(t):
    quads = t("quad").where("p = 'appliedTo'")
    make = quads.sparkSession.createDataFrame
    none = make([], "p string, q string")
    return inference.inferred(quads, none, none, [], [], domains=make([("appliedTo", "Change")], "p string, class string"), ranges=make([("appliedTo", "Landmark")], "p string, class string"))


@query("SELECT DISTINCT m AS a, s AS b FROM (SELECT a.s, min(a.s) OVER (PARTITION BY a.o, b.o) AS m FROM (SELECT DISTINCT s, o FROM quad WHERE p = 'appliedTo') a JOIN (SELECT DISTINCT s, o FROM quad WHERE p = 'hasTime' AND o_dtype = 'string') b ON a.s = b.s) WHERE m <> s")
def i01_keys(t):
    q = t("quad")
    return inference.has_key(q.where("p = 'appliedTo' or o_dtype = 'string'"), ["appliedTo", "hasTime"])


@query("SELECT DISTINCT s, c AS class FROM (SELECT s, 'Thing' AS c FROM instance WHERE class IN ('Area', 'Landmark') UNION ALL SELECT s, 'Both' FROM (SELECT s, class FROM instance UNION SELECT o, 'Used' FROM quad WHERE p = 'appliedTo') WHERE class IN ('Landmark', 'Used') GROUP BY s HAVING count(DISTINCT class) = 2)")
def i01_class_constructors(t):
    types = t("instance").unionByName(t("quad").where("p = 'appliedTo'").select(F.col("o").alias("s"), F.lit("Used").alias("class"))).distinct()
    make = types.sparkSession.createDataFrame
    return inference.class_members(types, make([("Thing", "Area"), ("Thing", "Landmark")], "class string, member string"), make([("Both", "Landmark"), ("Both", "Used")], "class string, member string"))


@query("SELECT s, p, o FROM quad WHERE p = 'appliedTo' UNION SELECT s, 'concerns', o FROM quad WHERE p = 'appliedTo'")
def i01_equivalent_properties(t):
    quads = t("quad").where("p = 'appliedTo'")
    make = quads.sparkSession.createDataFrame
    pairs = inference.equivalents(make([("appliedTo", "concerns")], "p string, q string"))
    return inference.inferred(quads, make([], "p string, q string"), pairs, [], [])


@query("SELECT DISTINCT m AS a, ev AS b FROM (SELECT concat('e', o_orderkey) AS ev, min(concat('e', o_orderkey)) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE m <> ev")
def i02_events_of_one_change(t):
    return inference.similar_change_events(t("orders").select(_s("o_custkey").alias("cg"), F.concat(F.lit("e"), _s("o_orderkey")).alias("ev")))


# --- linking and metrics (X03-X08, M01-M11) ------------------------------------------------------------------------------------


@query(f"WITH {_LINKS} SELECT from_id, to_id, round(length, 6) AS length, length < 25 AS similar FROM lk")
def x03_similar_by_distance(t):
    return linking.successive_links(t("address"), 25.0).select("from_id", "to_id", F.round("length", 6).alias("length"), "similar")


_MANUAL = "mn AS (SELECT id AS from_id, concat('hand', id) AS to_id FROM address WHERE ord = 0)"


def _flagged(t):
    a = t("address")
    manual = a.where("ord = 0").select(F.col("id").alias("from_id"), F.concat(F.lit("hand"), "id").alias("to_id"), F.lit(True).alias("to_keep"), F.lit("2024-02-02").cast("date").alias("creation_date"))
    return linking.flagged(linking.successive_links(a, without=manual, ends=True), "auto", "2024-01-01"), manual


@query(f"WITH {_LINKS}, {_MANUAL} SELECT from_id, to_id, false AS validated, length < 10 AS to_keep, 'auto' AS method, DATE '2024-01-01' AS creation_date FROM lk UNION ALL SELECT from_id, to_id, true, true, 'manual', DATE '2024-02-02' FROM mn")
def x05_flagged_and_manual_links(t):
    return linking.with_manual(*_flagged(t), apart=True)


@query(f"WITH {_LINKS} SELECT from_id, to_id FROM lk WHERE from_source = 0 AND to_source = 2")
def x05_links_of_pair(t):
    return linking.of_pair(linking.flagged(linking.successive_links(t("address")), "auto", "2024-01-01"), 0, 2).select("from_id", "to_id")


@query(f"WITH {_LINKS} SELECT from_id, to_id, a.key AS from_label, b.key AS to_label, concat('LINESTRING (', a.x, ' ', a.y, ', ', b.x, ' ', b.y, ')') AS line FROM lk JOIN address a ON a.id = from_id JOIN address AS b ON b.id = to_id WHERE length < 10".replace("length < 10", "lk.length < 10"))
def x06_exported_links(t):
    return linking.exported(linking.flagged(linking.successive_links(t("address"), ends=True), "auto", "2024-01-01"))


_STREETS = "ad AS (SELECT concat(p_partkey, '.', s) AS id, s AS ord, p_partkey % 30 AS num, p_name AS street, cast(p_size AS double) AS x, cast(s * 4 AS double) AS y FROM part, (VALUES (0), (1), (2)) AS v(s) WHERE p_partkey % (s + 2) = 0)"
_KEYED = f"ky AS (SELECT *, concat({simplified_sql(thoroughfare_sql('street'))}, '||', num) AS key FROM ad)"


def _streets(t):
    k = F.col("p_partkey")
    rows = t("part").select("p_partkey", "p_name", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s")).where("p_partkey % (s + 2) = 0")
    return rows.select(F.concat_ws(".", k.cast("string"), _s("s")).alias("id"), F.col("s").alias("ord"), (k % 30).cast("string").alias("number"), F.col("p_name").alias("street"), F.col("p_size").cast("double").alias("x"), (F.col("s") * 4).cast("double").alias("y"))


@query(f"""WITH {_STREETS}, {_KEYED}, nx AS (SELECT key, ord, lead(ord) OVER (PARTITION BY key ORDER BY ord) AS nord FROM (SELECT DISTINCT key, ord FROM ky))
  SELECT a.id AS from_id, b.id AS to_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 10 AS similar FROM ky a JOIN nx ON nx.key = a.key AND nx.ord = a.ord JOIN ky b ON b.key = a.key AND b.ord = nx.nord""")
def x08_linked_from_addresses(t):
    return linking.linked(_streets(t))["link"].select("from_id", "to_id", "similar")


@query(f"WITH {_STREETS}, {_KEYED} SELECT id FROM ky WHERE key IN (SELECT key FROM ky GROUP BY key HAVING count(DISTINCT ord) = 1)")
def x08_unlinked_addresses(t):
    return linking.linked(_streets(t))["unlinked"].select("id")


_DAYS = "(SELECT ev, min(CASE WHEN prop = 'hasTime' THEN t END) AS c, min(CASE WHEN prop = 'hasTimeBefore' THEN t END) AS b, max(CASE WHEN prop = 'hasTimeAfter' THEN t END) AS a FROM candidate GROUP BY ev)"


@query(f"SELECT c_name AS label, concat('c', c_custkey) AS change, date_diff('day', DATE '0001-01-01', cast(c AS date)) AS day, date_diff('day', DATE '0001-01-01', cast(b AS date)) AS before_day, date_diff('day', DATE '0001-01-01', cast(a AS date)) AS after_day FROM customer LEFT JOIN {_DAYS} ON ev = cast(c_custkey AS varchar)")
def m01_change_times_in_days(t):
    rows = t("customer").select(F.col("c_name").alias("label"), F.concat(F.lit("c"), _s("c_custkey")).alias("change"), _s("c_custkey").alias("ev"))
    return metrics.change_times(rows, t("candidate"))


@query("SELECT DISTINCT concat('label ', lm) AS label, attr AS version, source FROM version")
def m01_labelled_sources(t):
    v = t("version")
    return metrics.labelled_sources(v.select("lm", F.col("attr").alias("av")).distinct(), v.select(F.col("attr").alias("root"), "source").distinct(), v.select("lm", F.concat(F.lit("label "), "lm").alias("label")).distinct())


def _version_rows(t):
    return t("version").select(F.col("attr").alias("label"), F.col("value").alias("version"), "source")


@query("SELECT attr AS label, value AS version, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM version WHERE attr IN (SELECT attr FROM version AS w WHERE w.source = 's1') GROUP BY attr, value")
def m02_sources_of_versions(t):
    return metrics.version_sources(metrics.of_labels_in(_version_rows(t), "s1"))


@query(f"""WITH {_LINKS}, st AS (SELECT key, from_source, to_source, bool_or(length < 10) AS sim FROM lk GROUP BY ALL), nd AS (SELECT key, min(from_source) AS source, 0 AS new FROM st GROUP BY key UNION ALL SELECT key, to_source, CASE WHEN sim THEN 0 ELSE 1 END FROM st),
  g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY source) AS grp FROM nd), al AS (SELECT DISTINCT key, ord FROM address WHERE id NOT IN (SELECT from_id FROM lk) AND id NOT IN (SELECT to_id FROM lk))
  SELECT key, cast(grp AS bigint) AS grp, string_agg(DISTINCT cast(source AS varchar), '|' ORDER BY cast(source AS varchar)) AS sources FROM g WHERE key NOT IN (SELECT key FROM al) GROUP BY key, grp UNION ALL SELECT key, row_number() OVER (PARTITION BY key ORDER BY ord) - 1, cast(ord AS varchar) FROM al""")
def m06_single_groups(t):
    rows = t("address")
    return linking.with_single_groups(linking.groups_of_sources(linking.similar_steps(rows)), linking.alone(rows)).select("key", "grp", F.array_join("sources", "|").alias("sources"))


@query("SELECT id, true AS near, true AS again FROM point")
def m07_points_near(t):
    x, y = metrics.near_point(F.col("x"), F.col("y"), 10.0, F.col("id"))
    own = t("point").withColumn("nx", x).withColumn("ny", y)
    again = metrics.near_point(F.col("x"), F.col("y"), 10.0, F.col("id"))
    return own.select("id", (F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")) <= 10.000001).alias("near"), ((F.col("nx") == again[0]) & (F.col("ny") == again[1])).alias("again"))


@query("SELECT elem, true AS within FROM bound WHERE app_crisp IS NOT NULL AND dis_crisp IS NOT NULL AND dis_crisp > app_crisp")
def m08_random_days(t):
    b = t("bound").where("app_crisp is not null and dis_crisp is not null and dis_crisp > app_crisp")
    a, z = F.col("app_crisp").cast("date"), F.col("dis_crisp").cast("date")
    return b.select("elem", metrics.random_day(a, z, F.col("elem")).between(a, z).alias("within"))


@query("SELECT label, start, count(*) AS n FROM (SELECT label, concat('s', n % 5) AS start FROM landmark) GROUP BY ALL")
def m09_fragment_states(t):
    rows = t("landmark").select("lm", "label", "type", F.concat(F.lit("s"), (F.col("n") % 5).cast("string")).alias("start"), F.lit("2000-01-01").alias("end"))
    # a share of 1 keeps every landmark, so that what is read back can be compared
    got = states_json.from_text(metrics.fragment_states(rows, 1.0), "state")
    times_ = got["valid_time"].select(F.col("elem").alias("__e"), F.col("start.stamp").alias("start"))
    return got["landmark"].join(times_, F.col("lm") == F.col("__e")).groupBy("label", "start").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS label, count(*) AS n, count(*) > 0 AS some FROM events WHERE event_id % 2 = 0 GROUP BY event_type".replace("count(*) AS n, ", "count(*) AS n, "))
def m09_fragment_events(t):
    from chronolith.sources import events_json

    rows = t("events").where("event_id % 2 = 0").select(_s("event_id").alias("change"), F.col("event_type").alias("label"), F.lit("appearance").alias("type"), F.lit("2000-01-01").alias("stamp"))
    got = events_json.from_text(metrics.fragment_events(rows, 1.0), "event")
    return got["landmark"].join(got["change"].where("type = 'LandmarkAppearance'").select(F.col("lm").alias("__lm")), F.col("lm") == F.col("__lm")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("some", F.col("n") > 0)


_EVALUATED = """src AS (SELECT attr AS label, value AS version, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM {0} GROUP BY attr, value), mod AS (SELECT attr AS label, value AS version, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM {1} GROUP BY attr, value),
  a AS (SELECT label, sources, count(*) AS a FROM src GROUP BY ALL), b AS (SELECT label, sources, count(*) AS b FROM mod GROUP BY ALL),
  q AS (SELECT label, sum(coalesce(a, 0)) AS r, sum(coalesce(b, 0)) AS m, sum(least(coalesce(a, 0), coalesce(b, 0))) AS s FROM a FULL JOIN b USING (label, sources) GROUP BY label)"""
_TOTALS = "SELECT count(*) FILTER (r = m AND s = r) AS n_right, count(*) FILTER (NOT (r = m AND s = r)) AS n_wrong, count(*) AS n_labels, cast(sum(s) AS bigint) AS shared, round(sum(s) / sum(r + m - s), 9) AS iou FROM q"


@query(f"WITH fr AS (SELECT DISTINCT attr AS a FROM version WHERE source = 's2'), {_EVALUATED.format('(SELECT * FROM version WHERE attr IN (SELECT a FROM fr) AND source <> ' + chr(39) + 's2' + chr(39) + ')', '(SELECT * FROM version WHERE attr IN (SELECT a FROM fr) AND source <> ' + chr(39) + 's2' + chr(39) + ')')} {_TOTALS}")
def m10_fragment_evaluation(t):
    rows = _version_rows(t)
    return metrics.evaluated(rows, rows, "s2").withColumn("iou", F.round("iou", 9))


@query(f"WITH {_EVALUATED.format('version', '(SELECT * FROM version WHERE source <> ' + chr(39) + 's1' + chr(39) + ')')} {_TOTALS}")
def m11_version_evaluation(t):
    rows = _version_rows(t)
    return metrics.evaluated(rows, rows.where("source <> 's1'")).withColumn("iou", F.round("iou", 9))
