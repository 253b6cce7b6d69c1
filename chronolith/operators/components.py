"""Classes of nodes that pairs make one, and statements with one representative for each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.rounds import settled


def components(pairs: DataFrame, most: int = 64) -> DataFrame:
    """(n, rep): every node of ``pairs`` (a, b) with the least node of its class, itself included.

    Rounds of large stars and small stars: in a large star each node hands its greater neighbours to its least one, in
    a small star its lesser ones, until nothing changes.  Rows never exceed the pairs that came in, paths shrink to
    stars in a logarithmic number of rounds, and the least neighbour of each node is written before rows meet it, so
    that a node with very many neighbours can be split."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Edges (u, v), u > v, after one star."""
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = settled(near.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m")), "star-least").withColumn("__m", F.least("__m", "__u"))
        met = near.join(least, F.col("u") == F.col("__u"))
        moved = met.where("v > u") if large else met.where("v <> __m")
        out = moved.select(F.col("v").alias("u"), F.col("__m").alias("v"))
        if not large:
            out = out.unionByName(least.select(F.col("__u").alias("u"), F.col("__m").alias("v")))
        return out.where("u <> v").distinct()

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("n")).where("n is not null").distinct()
    edges = settled(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    for _ in range(most):
        after = settled(star(settled(star(edges, True), "star"), False), "star")
        gone = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if gone:
            break
    else:
        raise RuntimeError(f"no classes after {most} rounds")
    reps = edges.select(F.col("u").alias("__n"), F.col("v").alias("__rep"))
    return nodes.join(reps, F.col("n") == F.col("__n"), "left").select("n", F.coalesce("__rep", "n").alias("rep"))


def rewritten(rows: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the representative in place of each member in some columns; equal rows once.

    ``members`` (n, rep) need only hold nodes that have another representative."""
    own = members.where("n <> rep").select(F.col("n").alias("__n"), F.col("rep").alias("__rep"))
    for c in columns:
        rows = rows.join(own, F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__rep", c)).drop("__n", "__rep")
    return rows.distinct()


def expanded(rows: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """``rows`` over representatives with a row for each member in place of ``column``: what reading by any name needs."""
    own = members.select(F.col("rep").alias("__rep"), F.col("n").alias("__n"))
    return rows.join(own, F.col(column) == F.col("__rep"), "left").withColumn(column, F.coalesce("__n", column)).drop("__rep", "__n")
