"""Which node comes before which, from labels instead of all pairs.

Edges are covered by chains: paths that share no node, so that on one chain "before" is a comparison of positions.  A
label (chain, pos, to_chain, to_pos) says that from ``pos`` of a chain one gets to ``to_pos`` of another, hence from
anything up to ``pos`` to anything from ``to_pos`` on.  Labels that another one implies are dropped, so those of two
chains are a staircase, and each start has one step: ``after`` < start <= ``pos``.  Cycles need no special care: they
show as labels of a chain to an earlier place of itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.components import components
from chronolith.operators.rounds import settled

LABEL = ["chain", "pos", "to_chain", "to_pos"]


def _distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges once each; of a column ``rank``, if there is one, the least."""
    own = edges.where("src is not null and dst is not null")
    return own.groupBy("src", "dst").agg(F.min("rank").alias("rank")) if "rank" in edges.columns else own.select("src", "dst").distinct()


def matched(edges: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of edges in which each node has at most one next and one previous node, and of all others.

    Each node offers itself by the edge of the least ``rank``, where edges have one.  After the first round only edges
    whose ends are both free go on, so that all edges are exchanged once by either end."""
    rank = F.col("rank") if "rank" in edges.columns else F.lit(0)
    left, taken, others = edges.where("src <> dst").select("src", "dst", rank.alias("rank")), [], [edges.where("src = dst").select("src", "dst")]
    for k in range(rounds):
        order = ["rank", F.xxhash64("src", "dst"), "src", "dst"]
        offers = left.withColumn("__offer", F.row_number().over(Window.partitionBy("src").orderBy(*order)) == 1)
        at = offers.withColumn("taken", F.col("__offer") & (F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("__offer"), *order)) == 1))
        at = settled(at.withColumn("used", F.max("taken").over(Window.partitionBy("dst"))).drop("__offer"), "chain-steps")
        mine = at.where("taken").select("src", "dst")
        taken.append(mine)
        others.append(at.where("not taken and used").select("src", "dst"))
        rest = at.where("not used").join(mine.select(F.col("src").alias("__src")), F.col("src") == F.col("__src"), "left")
        rest = settled(rest.select("src", "dst", "rank", F.col("__src").isNull().alias("free")), "chain-left")
        last = k == rounds - 1
        others.append(rest.where(F.lit(last) | ~F.col("free")).select("src", "dst"))
        left = rest.where("free").drop("free")
        if last or left.isEmpty():
            break
    return reduce(DataFrame.unionByName, taken), reduce(DataFrame.unionByName, others)


def chains(edges: DataFrame) -> DataFrame:
    """(n, chain, pos): every node of ``edges`` (src, dst) on one chain, named after its first node."""
    return covered(settled(_distinct_edges(edges), "edges"))[0]


def covered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node on a chain, as ``chains`` has it, and the edges (src, dst) that are no steps of chains.

    ``edges`` are distinct, settled and without nulls."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    steps, others = matched(edges)
    done, ring = _positions(nodes, steps)
    if ring is not None:  # a ring is cut before its least node
        least = _least_of_ring(ring)
        onto = settled(steps.join(least.select(F.col("n").alias("__n"), F.col("least").alias("__least")), F.col("dst") == F.col("__n")).select("src", "dst", "__least"), "chain-cut")
        done = done.unionByName(_positions(least.select("n"), onto.where("dst <> __least").select("src", "dst"))[0])
        others = others.unionByName(onto.where("dst = __least").select("src", "dst"))
    return done, others


def _positions(nodes: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(n, chain, pos) of nodes on open chains; (n, to), the node before, of those on rings, if there are any.

    Jumps double; a round writes only rows that were still on their way, so none is written again once it has arrived."""
    before = steps.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    own = nodes.join(before, F.col("n") == F.col("__dst"), "left")
    # ``to`` is where the jumps have come to, ``open`` whether there is more before it
    rows = first = settled(own.select("n", F.coalesce("__src", "n").alias("to"), F.col("__src").isNotNull().cast("long").alias("pos"), F.col("__src").isNotNull().alias("open")), "chain-jumps")
    done, left, last = [], rows.where("open").count(), None
    # an open chain ends some of its rows in each round, so once none ends, what is left are rings
    while left and left != last:
        done.append(rows.where("not open"))
        known = reduce(DataFrame.unionByName, [*done, rows.where("open")])
        to = known.select(F.col("n").alias("__n"), F.col("to").alias("__to"), F.col("pos").alias("__pos"), F.col("open").alias("__open"))
        rows = settled(rows.where("open").join(to, F.col("to") == F.col("__n")).select("n", F.col("__to").alias("to"), (F.col("pos") + F.col("__pos")).alias("pos"), F.col("__open").alias("open")), "chain-jumps")
        left, last = rows.where("open").count(), left
    out = reduce(DataFrame.unionByName, [*done, rows.where("not open")]).select("n", F.col("to").alias("chain"), "pos")
    return out, first.join(rows.where("open").select(F.col("n").alias("__r")), F.col("n") == F.col("__r"), "left_semi").select("n", "to") if left else None


def _least_of_ring(ring: DataFrame) -> DataFrame:
    """(n, least): the least node of each node's ring, given the node before each.

    Jumps double until no node finds a lesser one: then each window's least is that of the window before it, all around."""
    rows = settled(ring.select("n", "to", F.least("n", "to").alias("least"), F.lit(True).alias("moved")), "chain-rings")
    while not rows.where("moved").isEmpty():
        to = rows.select(F.col("n").alias("__n"), F.col("to").alias("__to"), F.col("least").alias("__least"))
        rows = settled(rows.join(to, F.col("to") == F.col("__n")).select("n", F.col("__to").alias("to"), F.least("least", "__least").alias("least"), (F.col("__least") < F.col("least")).alias("moved")), "chain-rings")
    return rows.select("n", "least")


def pruned(labels: DataFrame) -> DataFrame:
    """Labels that no other implies, with ``after``: the last start before those that a label serves."""
    pair = Window.partitionBy("chain", "to_chain")
    better = F.min("to_pos").over(pair.orderBy(F.desc("pos"), "to_pos").rowsBetween(Window.unboundedPreceding, -1))
    kept = labels.withColumn("__better", better).where("__better is null or to_pos < __better").drop("__better")
    return kept.withColumn("after", F.coalesce(F.lag("pos").over(pair.orderBy("pos")), F.lit(-1)))


def labelled(edges: DataFrame, nodes: DataFrame, most: int = 32) -> DataFrame:
    """Labels (chain, pos, to_chain, to_pos, after) of all that chains and ``edges``, which may leave out their steps, connect.

    Each round puts labels end to end, so the length of ways doubles; only labels of which one is new are tried, and none
    that comes to a place of a chain from which no label leaves any more, as all those do that end in a common last node."""
    at = lambda k: nodes.select(F.col("n").alias(f"__{k}"), F.col("chain").alias(f"{k}_chain"), F.col("pos").alias(f"{k}_pos"))
    crossing = edges.join(at("src"), F.col("src") == F.col("__src")).join(at("dst"), F.col("dst") == F.col("__dst"))
    crossing = crossing.where("src_chain <> dst_chain or src_pos >= dst_pos").select(F.col("src_chain").alias("chain"), F.col("src_pos").alias("pos"), F.col("dst_chain").alias("to_chain"), F.col("dst_pos").alias("to_pos"))
    known = settled(pruned(crossing.distinct()).withColumn("fresh", F.lit(True)), "labels")
    for _ in range(most):
        then = known.select(F.col("chain").alias("__chain"), F.col("pos").alias("__pos"), F.col("after").alias("__after"), F.col("to_chain").alias("__to_chain"), F.col("to_pos").alias("__to_pos"), F.col("fresh").alias("__fresh"))
        on = (F.col("to_chain") == F.col("__chain")) & (F.col("to_pos") > F.col("__after")) & (F.col("to_pos") <= F.col("__pos"))
        ends = known.groupBy(F.col("chain").alias("__from")).agg(F.max("pos").alias("__most"))
        going = known.join(ends, (F.col("to_chain") == F.col("__from")) & (F.col("to_pos") <= F.col("__most")), "left_semi")
        found = going.join(then, on).where("fresh or __fresh").select("chain", "pos", F.col("__to_chain").alias("to_chain"), F.col("__to_pos").alias("to_pos"))
        found = found.where("chain <> to_chain or pos >= to_pos").distinct()
        old = known.select(*LABEL, F.lit(False).alias("fresh"))
        both = old.unionByName(found.withColumn("fresh", F.lit(True))).groupBy(*LABEL).agg(F.min("fresh").alias("fresh"))
        known = settled(pruned(both), "labels")
        if known.where("fresh").isEmpty():
            return known.drop("fresh")
    raise RuntimeError(f"labels still change after {most} rounds")


class Order:
    """The order that edges (src, dst) make, held as chains and labels."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges = settled(_distinct_edges(edges), "order-edges")
        self.nodes, others = covered(self.edges)
        self.labels = labelled(others, self.nodes)

    def _placed(self, rows: DataFrame, column: str, name: str, nodes: DataFrame | None = None) -> DataFrame:
        own = (self.nodes if nodes is None else nodes).select(F.col("n").alias("__n"), F.col("chain").alias(f"{name}_chain"), F.col("pos").alias(f"{name}_pos"))
        return rows.join(own, F.col(column) == F.col("__n")).drop("__n")

    def holds(self, pairs: DataFrame, first: str = "src", second: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
        """Rows of ``pairs`` whose first node comes before the second: a join on two chains, at most one label a row.

        ``nodes``: those of the order that ``pairs`` can hold, if not all."""
        rows = self._placed(self._placed(pairs, first, "__a", nodes), second, "__b", nodes)
        own = self.labels.select(F.col("chain").alias("__chain"), F.col("pos").alias("__pos"), F.col("after").alias("__after"), F.col("to_chain").alias("__to_chain"), F.col("to_pos").alias("__to_pos"))
        on = (F.col("__a_chain") == F.col("__chain")) & (F.col("__b_chain") == F.col("__to_chain")) & (F.col("__a_pos") > F.col("__after")) & (F.col("__a_pos") <= F.col("__pos"))
        along = (F.col("__a_chain") == F.col("__b_chain")) & (F.col("__a_pos") < F.col("__b_pos"))
        return rows.join(own, on, "left").where(along | F.coalesce(F.col("__to_pos") <= F.col("__b_pos"), F.lit(False))).select(*pairs.columns)

    def reached(self, starts: DataFrame | None = None) -> DataFrame:
        """(src, dst) of all that come after each node, or after some nodes (column n): as many rows as the answer has."""
        own = self.nodes if starts is None else self.nodes.join(starts.select(F.col("n").alias("__s")).distinct(), F.col("n") == F.col("__s"), "left_semi")
        lab = self.labels.select(F.col("chain").alias("__chain"), F.col("pos").alias("__pos"), "after", "to_chain", "to_pos")
        far = own.join(lab, (F.col("chain") == F.col("__chain")) & (F.col("pos") > F.col("after")) & (F.col("pos") <= F.col("__pos"))).select("n", "to_chain", "to_pos")
        near = own.select("n", F.col("chain").alias("to_chain"), (F.col("pos") + 1).alias("to_pos"))
        start = far.unionByName(near).groupBy("n", "to_chain").agg(F.min("to_pos").alias("to_pos"))
        end = self.nodes.select(F.col("n").alias("dst"), F.col("chain").alias("__chain"), F.col("pos").alias("__pos"))
        return start.join(end, (F.col("to_chain") == F.col("__chain")) & (F.col("__pos") >= F.col("to_pos"))).select(F.col("n").alias("src"), "dst")

    def cycles(self) -> DataFrame:
        """(n, rep) of nodes that come before themselves by way of others, with the least node of their cycle's class.

        A node comes before itself where a label leads from its place, or one behind it, back to its place or before."""
        loops = self.labels.where("chain = to_chain").select(F.col("chain").alias("__chain"), F.col("pos").alias("__pos"), "after", "to_pos")
        own = self.nodes.join(loops, (F.col("chain") == F.col("__chain")) & (F.col("pos") > F.col("after")) & (F.col("pos") <= F.col("__pos")) & (F.col("pos") >= F.col("to_pos"))).select("n", "chain", "pos")
        own = settled(own, "cycle-nodes")
        edges = self.edges.where("src <> dst").select("src", "dst")
        for c in ("src", "dst"):
            edges = edges.join(own.select(F.col("n").alias("__n")), F.col(c) == F.col("__n"), "left_semi")
        back = self.holds(edges, "dst", "src", own)
        return components(back.select(F.col("src").alias("a"), F.col("dst").alias("b")))
