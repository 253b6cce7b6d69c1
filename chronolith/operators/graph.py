"""Graphs: the registry with its roles, statements, and the algebra over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.rounds import fixpoint

ROLES = ("source", "construction", "final", "meta", "ontology", "temporary")


def registered(registry: DataFrame, graph: str, role: str, label: str | None = None, lang: str | None = None) -> DataFrame:
    """The registry (g, role, is_active, label, lang) with a graph added or replaced."""
    if role not in ROLES:
        raise ValueError(f"no such role: {role}")
    row = registry.sparkSession.createDataFrame([(graph, role, role == "source", label, lang)], registry.schema)
    return registry.where(F.col("g") != graph).unionByName(row)


def activated(registry: DataFrame, active: bool, graphs: list[str] | None = None, role: str = "source") -> DataFrame:
    """Activity of all graphs of a role, or of some graphs."""
    chosen = (F.col("role") == role) if graphs is None else F.col("g").isin(graphs)
    return registry.withColumn("is_active", F.when(chosen, F.lit(active)).otherwise(F.col("is_active")))


def without_construction(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("role") != "construction")


def final_graphs(registry: DataFrame, lang: str) -> DataFrame:
    """Final graphs with their label in a language, or null."""
    return registry.where("role = 'final'").select("g", F.when(F.col("lang") == lang, F.col("label")).alias("label"))


def in_active_sources(rows: DataFrame, registry: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Rows of active source graphs, but for excluded ones."""
    active = registry.where("role = 'source' and is_active").where(~F.col("g").isin(excluded or [])).select("g")
    return rows.join(active, "g", "left_semi")


def union_of_graphs(rows: DataFrame, key: list[str]) -> DataFrame:
    """The default dataset: statements of all graphs, each once."""
    return rows.dropDuplicates(key)


def statements(rows: DataFrame, subject: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Quads (g, s, p, o, o_kind) of a typed table: column -> (predicate, kind); arrays give a statement each."""
    parts = []
    for column, (predicate, kind) in columns.items():
        values = F.explode(F.col(column)) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
        parts.append(rows.select("g", F.col(subject).alias("s"), F.lit(predicate).alias("p"), values.cast("string").alias("o"), F.lit(kind).alias("o_kind")).where("o is not null"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def n_quads(quads: DataFrame) -> DataFrame:
    """A line of text for each statement."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    o = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(quoted)
    return quads.select(F.concat_ws(" ", F.concat(F.lit("<"), F.col("s"), F.lit(">")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), o, F.concat(F.lit("<"), F.col("g"), F.lit(">")), F.lit(".")).alias("value"))


def without_resources(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Statements that name none of the resources (column r), as subject or object."""
    gone = resources.select(F.col("r").alias("__r")).distinct()
    return quads.join(gone, F.col("s") == F.col("__r"), "left_anti").join(gone, F.col("o") == F.col("__r"), "left_anti")


def split_immutable(quads: DataFrame, predicates: list[str]) -> tuple[DataFrame, DataFrame]:
    """(statements that stay, statements of the predicates, for the permanent graph)."""
    permanent = F.col("p").isin(predicates)
    return quads.where(~permanent), quads.where(permanent)


def replaced(base: DataFrame, key: list[str], new: DataFrame) -> DataFrame:
    """Delete and insert: rows of ``new`` in place of those with their key."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def extremes(rows: DataFrame, group: list[str], by: str, largest: bool = False) -> DataFrame:
    """Rows at the least or largest value of their group, all that tie."""
    from pyspark.sql import Window

    order = F.col(by).desc() if largest else F.col(by).asc()
    return rows.where(F.col(by).isNotNull()).withColumn("__rank", F.rank().over(Window.partitionBy(*group).orderBy(order))).where("__rank = 1").drop("__rank")


def closure_of_rules(spark: SparkSession, edges: list[tuple[str, str]], reflexive: bool = True) -> DataFrame:
    """Transitive closure (child, parent) of a hierarchy that is part of the program, as class hierarchies are: a few rules, closed on the driver."""
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    if reflexive:
        pairs |= {(n, n) for edge in edges for n in edge}
    return spark.createDataFrame(sorted(pairs), "child string, parent string")


def closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """Transitive closure of a hierarchy (child, parent): paths double in each round, so a cycle ends as well."""
    pairs = edges.select("child", "parent").distinct()

    def step(known: DataFrame, new: DataFrame) -> DataFrame:
        joined = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent"))
        return joined(new, known).unionByName(joined(known, new))

    pairs = fixpoint(pairs, step)
    if reflexive:
        nodes = edges.select(F.explode(F.array("child", "parent")).alias("n"))
        pairs = pairs.unionByName(nodes.select(F.col("n").alias("child"), F.col("n").alias("parent"))).distinct()
    return pairs


def copied(quads: DataFrame, target: DataFrame, graphs: list[str]) -> DataFrame:
    """Statements of some graphs added to another dataset, in place of what it had of them."""
    return target.where(~F.col("g").isin(graphs)).unionByName(quads.where(F.col("g").isin(graphs)))


def following(rows: DataFrame, group: str, by: str, key: str) -> DataFrame:
    """(group, key1, key2): each row with those of the next value of its group, all that tie: a join on dense ranks, not on inequalities."""
    from pyspark.sql import Window

    ranked = rows.where(F.col(by).isNotNull()).select(group, key, F.dense_rank().over(Window.partitionBy(group).orderBy(by)).alias("__r"))
    nxt = ranked.select(F.col(group).alias("__g"), (F.col("__r") - 1).alias("__q"), F.col(key).alias(f"{key}2"))
    return ranked.join(nxt, (F.col(group) == F.col("__g")) & (F.col("__r") == F.col("__q"))).select(group, F.col(key).alias(f"{key}1"), f"{key}2")


def updated(quads: DataFrame, *updates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Several updates in turn, each a function of statements."""
    return reduce(lambda rows, update: update(rows), updates, quads)


class Repository:
    """A dataset with a name: a database of the catalog that holds a table of statements for each graph's rows."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def exists(self) -> bool:
        return self.spark.catalog.databaseExists(self.name)

    def create(self) -> Repository:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.name}")
        return self

    def put(self, quads: DataFrame) -> None:
        quads.write.mode("append").partitionBy("g").saveAsTable(f"{self.name}.quad")

    def quads(self) -> DataFrame:
        return self.spark.table(f"{self.name}.quad")

    def clear(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.quad")

    def remove(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
