"""Typed tables of the engine, derived from the driver's tables by plain projections that both SQL dialects share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = "region nation customer supplier part orders lineitem events documents labels embeddings conversations".split()

SQL = {
    # names in need of normal forms
    "name": """
        SELECT p_partkey AS id,
          concat(CASE p_partkey % 8 WHEN 0 THEN 'R ' WHEN 1 THEN 'rue de l''' WHEN 2 THEN 'Bd. du ' WHEN 3 THEN 'av ' WHEN 4 THEN 'pl. des ' WHEN 5 THEN 'St-' WHEN 6 THEN 'all ' ELSE 'imp. d’' END,
            p_name, CASE p_partkey % 5 WHEN 0 THEN ' le Grand' WHEN 1 THEN ' 10' WHEN 2 THEN '-en-Laye' WHEN 3 THEN ' Forêt' ELSE '' END) AS label,
          concat(cast(p_partkey % 99 AS string), CASE p_partkey % 6 WHEN 0 THEN ' bis' WHEN 1 THEN 'TER' WHEN 2 THEN ' quater' WHEN 3 THEN '/2' WHEN 4 THEN ';4' ELSE '' END) AS number
        FROM {part}""",
    "landmark": """
        SELECT concat('g', cast(c_custkey % 4 AS string)) AS g, concat('lm', cast(c_custkey AS string)) AS lm,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 'StreetNumber' WHEN 'BUILDING' THEN 'Thoroughfare' WHEN 'AUTOMOBILE' THEN 'District' WHEN 'FURNITURE' THEN 'Municipality' ELSE 'PostalCodeArea' END AS type,
          CASE c_mktsegment WHEN 'MACHINERY' THEN concat(cast(c_custkey % 50 AS string), CASE c_custkey % 3 WHEN 0 THEN ' bis' WHEN 1 THEN '' ELSE '/2' END)
            ELSE concat(CASE c_custkey % 4 WHEN 0 THEN 'R ' WHEN 1 THEN 'rue de l''' WHEN 2 THEN 'bd. du ' ELSE 'st ' END, p_name) END AS label,
          CASE WHEN c_mktsegment = 'MACHINERY' THEN cast(NULL AS string) ELSE 'fr' END AS lang,
          c_custkey AS n
        FROM {customer} JOIN {part} ON p_partkey = c_custkey % 60""",
    "relation": """
        SELECT concat('lr', cast(c_custkey AS string)) AS lr, CASE c_custkey % 3 WHEN 0 THEN 'Along' WHEN 1 THEN 'Within' ELSE 'Belongs' END AS type,
          concat('lm', cast(c_custkey AS string)) AS locatum, concat('lm', cast((c_custkey * 7 + 3) % 150 AS string)) AS relatum FROM {customer}
        UNION ALL
        SELECT concat('lr', cast(c_custkey AS string)), CASE c_custkey % 3 WHEN 0 THEN 'Along' WHEN 1 THEN 'Within' ELSE 'Belongs' END,
          concat('lm', cast(c_custkey AS string)), concat('lm', cast((c_custkey * 11 + 5) % 150 AS string)) FROM {customer} WHERE c_custkey % 5 = 0""",
    "version": """
        SELECT concat(cast(user_id AS string), '-', event_type) AS attr, concat('u', cast(user_id AS string)) AS lm, event_type AS attr_type,
          concat('v', cast(event_id AS string)) AS av, cast(cast(floor(value) AS bigint) % 3 AS string) AS value, concat('s', cast(event_id % 3 AS string)) AS source,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('day', ts) END AS begin,
          CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('day', ts) + INTERVAL '1' DAY WHEN event_id % 3 = 1 THEN date_trunc('day', ts) + INTERVAL '3' DAY ELSE date_trunc('day', ts) + INTERVAL '6' DAY END AS ending
        FROM {events}""",
    "stated": """
        SELECT concat(cast(user_id AS string), '-', event_type) AS attr, date_trunc('day', ts) AS stamp, cast(11 AS int) AS precision, concat('c', cast(event_id AS string)) AS cg, concat('v', cast(event_id AS string)) AS made
        FROM {events} WHERE event_type IN ('purchase', 'signup') AND event_id % 4 = 0""",
    "bound": """
        SELECT cast(o_orderkey AS string) AS elem, cast(o_custkey AS string) AS lm,
          CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS app_crisp,
          CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate - INTERVAL '100' DAY END AS app_begin,
          CASE WHEN o_orderkey % 6 = 1 THEN o_orderdate + INTERVAL '100' DAY END AS app_end,
          CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL '400' DAY END AS dis_crisp,
          CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate + INTERVAL '300' DAY END AS dis_begin,
          CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 5 = 2 THEN o_orderdate + INTERVAL '500' DAY END AS dis_end
        FROM {orders}""",
    "instant": """
        SELECT concat('t', cast(o_orderkey AS string)) AS t, cast(o_custkey AS string) AS ev, o_orderdate AS stamp,
          CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'decade' ELSE 'century' END AS precision,
          CASE WHEN o_orderkey % 10 = 0 THEN 'julian' ELSE 'gregorian' END AS calendar
        FROM {orders}""",
    "candidate": """
        SELECT cast(o_custkey AS string) AS ev, CASE WHEN o_orderkey % 40 = 0 THEN 'hasTime' WHEN o_orderkey % 2 = 0 THEN 'hasTimeBefore' ELSE 'hasTimeAfter' END AS prop, o_orderdate AS t FROM {orders}""",
    "interval": """
        SELECT cast(l_orderkey AS string) AS grp, concat(cast(l_orderkey AS string), '.', cast(l_linenumber AS string)) AS i, min(l_shipdate) AS begin, min(l_shipdate) + max(CASE WHEN l_quantity < 10 THEN INTERVAL '0' DAY WHEN l_quantity < 30 THEN INTERVAL '20' DAY ELSE INTERVAL '60' DAY END) AS ending
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "quad": """
        SELECT concat('o', cast(o_orderkey AS string)) AS s, 'appliedTo' AS p, concat('c', cast(o_custkey AS string)) AS o, 'uri' AS o_kind, cast(NULL AS string) AS o_dtype, concat('g', cast(o_orderkey % 3 AS string)) AS g FROM {orders} WHERE o_orderkey % 17 <> 0
        UNION ALL SELECT concat('o', cast(o_orderkey AS string)), 'hasTime', cast(cast(o_orderdate AS date) AS string), 'literal', CASE WHEN o_orderkey % 7 = 0 THEN 'string' ELSE 'dateTimeStamp' END, concat('g', cast(o_orderkey % 3 AS string)) FROM {orders}
        UNION ALL SELECT concat('o', cast(o_orderkey AS string)), 'hasTime', o_orderpriority, 'literal', 'string', concat('g', cast(o_orderkey % 3 AS string)) FROM {orders} WHERE o_orderkey % 50 = 0
        UNION ALL SELECT concat('c', cast(c_custkey AS string)), 'isPartOf', concat('n', cast(c_nationkey AS string)), 'uri', NULL, 'g0' FROM {customer}
        UNION ALL SELECT concat('n', cast(n_nationkey AS string)), 'isPartOf', concat('r', cast(n_regionkey AS string)), 'uri', NULL, 'g0' FROM {nation}""",
    "instance": """
        SELECT concat('o', cast(o_orderkey AS string)) AS s, CASE WHEN o_orderstatus = 'F' THEN 'AttributeChange' WHEN o_orderstatus = 'O' THEN 'Change' ELSE 'Event' END AS class FROM {orders}
        UNION ALL SELECT concat('c', cast(c_custkey AS string)), CASE WHEN c_custkey % 10 = 0 THEN 'Area' ELSE 'Landmark' END FROM {customer}
        UNION ALL SELECT concat('n', cast(n_nationkey AS string)), 'Area' FROM {nation}""",
    "address": """
        SELECT concat(cast(c_custkey AS string), '.', cast(s_suppkey % 3 AS string)) AS id, s_suppkey % 3 AS ord, concat('k', cast(c_custkey % 400 AS string)) AS key, cast(c_custkey % 97 AS double) AS x, cast((c_custkey * 3) % 41 AS double) AS y
        FROM {customer} JOIN {supplier} ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7 GROUP BY c_custkey, s_suppkey % 3""",
    "point": """
        SELECT c_custkey AS id, cast(c_custkey % 360 AS double) - 180 + cast(c_nationkey AS double) / 100 AS x, cast((c_custkey * 13) % 170 AS double) - 85 AS y FROM {customer}""",
    # half of all versions are of one attribute
    "busy_version": """
        SELECT CASE WHEN event_id % 2 = 0 THEN 'hub' ELSE concat(cast(user_id AS string), '-', event_type) END AS attr, concat('v', cast(event_id AS string)) AS av, cast(cast(floor(value) AS bigint) % 2 AS string) AS value,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS begin,
          CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) + INTERVAL '1' HOUR WHEN event_id % 3 = 1 THEN date_trunc('hour', ts) + INTERVAL '2' HOUR ELSE date_trunc('hour', ts) + INTERVAL '5' HOUR END AS ending
        FROM {events}""",
    "busy_stated": """
        SELECT CASE WHEN event_id % 2 = 0 THEN 'hub' ELSE concat(cast(user_id AS string), '-', event_type) END AS attr, date_trunc('hour', ts) AS stamp, cast(11 AS int) AS precision, concat('c', cast(event_id AS string)) AS cg, concat('v', cast(event_id AS string)) AS made
        FROM {events} WHERE event_id % 20 = 0""",
    # classes of what ``claim`` speaks of; some are missing
    "thing": """
        SELECT concat('lm', cast(c_custkey AS string)) AS s, 'Landmark' AS class FROM {customer} WHERE c_custkey % 7 <> 0
        UNION ALL SELECT concat('lr', cast(c_custkey AS string)), 'LandmarkRelation' FROM {customer}
        UNION ALL SELECT concat('ca', cast(c_custkey AS string)), 'LandmarkChange' FROM {customer} UNION ALL SELECT concat('cd', cast(c_custkey AS string)), 'Change' FROM {customer} UNION ALL SELECT concat('cra', cast(c_custkey AS string)), 'LandmarkRelationChange' FROM {customer}
        UNION ALL SELECT concat('crd', cast(c_custkey AS string)), 'LandmarkChange' FROM {customer} WHERE c_custkey % 9 = 0
        UNION ALL SELECT concat('la', cast(c_custkey AS string)), 'Event' FROM {customer} WHERE c_custkey % 5 <> 0 UNION ALL SELECT concat('ld', cast(c_custkey AS string)), 'Event' FROM {customer} UNION ALL SELECT concat('ra', cast(c_custkey AS string)), 'Event' FROM {customer}
        UNION ALL SELECT concat('e', cast(o_orderkey AS string)), 'Event' FROM {orders} WHERE o_orderkey % 6 <> 1
        UNION ALL SELECT concat('ma', cast(o_orderkey AS string)), 'AttributeChange' FROM {orders} UNION ALL SELECT concat('ava', cast(o_orderkey AS string)), 'AttributeVersion' FROM {orders} WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT DISTINCT concat('t', cast(o_custkey AS string), '|', cast(cast(o_orderdate AS date) AS string)), 'CrispTimeInstant' FROM {orders} WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 'LandmarkAppearance', 'ChangeType' FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'LandmarkRelationAppearance', 'ChangeType' FROM {region} WHERE r_regionkey = 0""",
    # statements on events: landmarks of customers, relations between them, versions that orders make and outdate, times of some orders
    "claim": """
        WITH ow AS (SELECT o_orderkey AS k, o_custkey AS c, cast(cast(o_orderdate AS date) AS string) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer})),
          cc AS (SELECT cast(c_custkey AS string) AS c, cast((c_custkey * 7 + 3) % 150 AS string) AS o FROM {customer}),
          dd AS (SELECT c, d, lead(d) OVER (PARTITION BY c ORDER BY d) AS nd FROM (SELECT DISTINCT c, d FROM ow) AS u),
          ed AS (SELECT 'w' AS v, concat('la', cast(c AS string)) AS made, concat('e', cast(k AS string)) AS gone, cast(c AS string) AS i FROM ow WHERE r = 1
            UNION ALL SELECT 'z', concat('e', cast(k AS string)), concat('ld', cast(c AS string)), cast(c AS string) FROM ow WHERE r = n
            UNION ALL SELECT 'a', concat('e', cast(k AS string)), concat('e', cast(nx AS string)), cast(k AS string) FROM ow WHERE nx IS NOT NULL
            UNION ALL SELECT 'y', concat('e', cast(l.k AS string)), concat('e', cast(f.k AS string)), cast(l.c AS string) FROM ow AS l JOIN ow AS f ON l.c = f.c AND f.r = 1 WHERE l.r = l.n AND l.n > 1 AND l.c % 40 = 0),
          ch AS (SELECT concat('ca', c) AS cg, 'LandmarkAppearance' AS kind, concat('lm', c) AS target, concat('la', c) AS ev FROM cc UNION ALL SELECT concat('cd', c), 'LandmarkDisappearance', concat('lm', c), concat('ld', c) FROM cc
            UNION ALL SELECT concat('cra', c), 'LandmarkRelationAppearance', concat('lr', c), concat('ra', c) FROM cc UNION ALL SELECT concat('crd', c), 'LandmarkRelationDisappearance', concat('lr', c), concat('rd', c) FROM cc)
        SELECT cg AS s, 'isChangeType' AS p, kind AS o FROM ch UNION ALL SELECT cg, 'appliedTo', target FROM ch UNION ALL SELECT cg, 'dependsOn', ev FROM ch
        UNION ALL SELECT concat('lr', c), 'locatum', concat('lm', c) FROM cc UNION ALL SELECT concat('lr', c), 'relatum', concat('lm', o) FROM cc
        UNION ALL SELECT concat('m', v, i), 'makesEffective', concat('av', v, i) FROM ed UNION ALL SELECT concat('m', v, i), 'dependsOn', made FROM ed
        UNION ALL SELECT concat('x', v, i), 'outdates', concat('av', v, i) FROM ed UNION ALL SELECT concat('x', v, i), 'dependsOn', gone FROM ed
        UNION ALL SELECT concat('e', cast(k AS string)), 'hasTime', concat('t', cast(c AS string), '|', d) FROM ow WHERE k % 3 = 0
        UNION ALL SELECT concat('t', cast(c AS string), '|', d), 'instantBefore', concat('t', cast(c AS string), '|', nd) FROM dd WHERE nd IS NOT NULL""",
}

#: Rows of ``SQL`` by a way that grows with the tables: what suppliers tell is made distinct before customers meet them.
SPARK_SQL = {
    "address": """
        SELECT concat(cast(c_custkey AS string), '.', cast(ord AS string)) AS id, ord, concat('k', cast(c_custkey % 400 AS string)) AS key, cast(c_custkey % 97 AS double) AS x, cast((c_custkey * 3) % 41 AS double) AS y
        FROM {customer} JOIN (SELECT DISTINCT s_nationkey, s_suppkey % 7 AS part, s_suppkey % 3 AS ord FROM {supplier}) ON s_nationkey = c_nationkey AND part = c_custkey % 7 GROUP BY c_custkey, ord""",
}


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SPARK_SQL.get(name, SQL[name])
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if f"{{{t}}}" in sql}
    return spark.sql(sql, **frames)


def duckdb_with(sql: str) -> str:
    """A query with the typed tables that it names as leading expressions."""
    used = [n for n in SQL if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)]
    if not used:
        return sql
    parts = [f"{n} AS ({SQL[n].format(**{t: t for t in SOURCES})})" for n in used]
    own = sql.strip()
    if own[:5].upper() == "WITH ":
        recursive = own[5:].lstrip().upper().startswith("RECURSIVE")
        rest = own[5:].lstrip()
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}, {rest[9:].lstrip() if recursive else rest}"
    return f"WITH {', '.join(parts)} {own}"
