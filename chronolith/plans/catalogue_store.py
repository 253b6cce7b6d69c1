"""Queries of the graph store, the label index and all shapes, each with its SQL; registered with those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import labels, validation
from chronolith.operators.graph_store import GraphStore
from chronolith.operators.rounds import scratch
from chronolith.plans.catalogue import fold_sql, query

# --- snapshots (S26, S29, S30) ----------------------------------------------------------------------------------------


def _store(t):
    quads = t("quad")
    store = GraphStore(quads.sparkSession, scratch(quads.sparkSession, "store"))
    first = store.replace(quads)
    second = store.replace(quads.where("g = 'g1' and p = 'hasTime'").withColumn("o", F.lit("new")))
    store.append(quads.where("g = 'g2' and p = 'appliedTo'"))
    store.drop(["g0"])
    return store, first, second


@query("SELECT 'first' AS state, s, p, o, g FROM quad UNION ALL SELECT 'second', s, p, CASE WHEN g = 'g1' THEN 'new' ELSE o END, g FROM quad WHERE g <> 'g1' OR p = 'hasTime' UNION ALL SELECT 'last', s, p, CASE WHEN g = 'g1' THEN 'new' ELSE o END, g FROM quad WHERE (g = 'g1' AND p = 'hasTime') OR g = 'g2' UNION ALL SELECT 'last', s, p, o, g FROM quad WHERE g = 'g2' AND p = 'appliedTo'")
def s26_snapshots(t):
    store, first, second = _store(t)
    parts = [store.read(snapshot=n).select(F.lit(name).alias("state"), "s", "p", "o", "g") for name, n in (("first", first), ("second", second), ("last", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT s, p, o, g FROM quad WHERE g = 'g2' UNION ALL SELECT s, p, o, g FROM quad WHERE g = 'g2' AND p = 'appliedTo'")
def s30_one_graph_after_vacuum(t):
    store, _, _ = _store(t)
    store.vacuum()
    return store.read(["g2", "g9"]).select("s", "p", "o", "g")


# --- search by the index (L06) ----------------------------------------------------------------------------------------


@query(f"SELECT id, {fold_sql('label')} AS folded FROM name WHERE contains({fold_sql('label')}, 'foret') ORDER BY folded, id LIMIT 20")
def l06_indexed_search(t):
    rows = t("name")
    index = labels.LabelIndex.build(rows, "label", "id", scratch(rows.sparkSession, "label-index"))
    return index.search("FORÊT").select(F.col("key").alias("id"), "folded")


# --- all shapes (D08) ---------------------------------------------------------------------------------------------------

_RULES = ", ".join(
    f"('{x.name}', '{x.target}', '{p.path}', {'NULL' if p.least is None else p.least}, {'NULL' if p.most is None else p.most}, {'NULL' if p.dtype is None else repr(p.dtype)}, '{p.kind}', {list(p.classes) or 'CAST([] AS VARCHAR[])'})"
    for x in validation.SHAPES
    for p in x.properties
)


@query(f"""WITH r(shape, target, path, least, most, dtype, kind, allowed) AS (VALUES {_RULES}), f AS (SELECT DISTINCT shape, s, path, least, most, dtype, kind, allowed FROM thing JOIN r ON class = target),
  v AS (SELECT f.*, o, CASE WHEN o IN ('LandmarkAppearance', 'LandmarkDisappearance') THEN 'literal' ELSE 'uri' END AS o_kind FROM f LEFT JOIN claim c ON c.s = f.s AND c.p = f.path)
  SELECT shape, s, path, 'minCount' AS rule FROM v GROUP BY shape, s, path, least HAVING count(DISTINCT o) < least UNION SELECT shape, s, path, 'maxCount' FROM v GROUP BY shape, s, path, most HAVING count(DISTINCT o) > most
  UNION SELECT shape, s, path, 'nodeKind' FROM v WHERE o IS NOT NULL AND o_kind <> kind UNION SELECT shape, s, path, 'datatype' FROM v WHERE o IS NOT NULL AND dtype IS NOT NULL
  UNION SELECT shape, s, path, 'class' FROM v WHERE o IS NOT NULL AND len(allowed) > 0 AND NOT EXISTS (SELECT 1 FROM thing x WHERE x.s = v.o AND list_contains(v.allowed, x.class))""")
def d08_all_shapes(t):
    literal = F.col("o").isin("LandmarkAppearance", "LandmarkDisappearance")
    quads = t("claim").select("s", "p", "o", F.when(literal, "literal").otherwise("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"))
    return validation.shape_report(quads, t("thing"), validation.SHAPES)
