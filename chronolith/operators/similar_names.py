"""Names that are alike by matching blocks, found without comparing all pairs and judged without Python.

The ratio of two texts is twice the letters in their matching blocks over their letters: the longest common run,
the earliest in the first text and then in the second, and so on to its left and right.  Blocks are an alignment, so a
ratio bounds from below how many runs of two letters the texts share; texts share one of their rarest runs then, which
is what candidates are joined by.  The bound holds for every pair: none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.rounds import settled


def matching_ratio(a: str, b: str) -> Column:
    """2 * letters in matching blocks / letters of both, of two columns; 1 for two empty texts.

    A fold over the stretches that are left to search, at most one for each letter of the shorter text and one more on
    either side.  Letters that are frequent in long texts count like any others."""
    none = "named_struct('i', 0, 'j', 0, 'k', 0)"
    stretch = lambda al, ah, bl, bh: f"named_struct('al', {al}, 'ah', {ah}, 'bl', {bl}, 'bh', {bh})"
    inner = "substr(b, r.bl + 1, r.bh - r.bl)"
    at = f"aggregate(sequence(r.al, r.ah - l), {none}, (g, i) -> CASE WHEN g.k > 0 THEN g WHEN instr({inner}, substr(a, i + 1, l)) > 0 THEN named_struct('i', i, 'j', r.bl + instr({inner}, substr(a, i + 1, l)) - 1, 'k', l) ELSE g END)"
    longest = f"CASE WHEN least(r.ah - r.al, r.bh - r.bl) <= 0 THEN {none} ELSE aggregate(sequence(least(r.ah - r.al, r.bh - r.bl), 1, -1), {none}, (f, l) -> CASE WHEN f.k > 0 THEN f ELSE {at} END) END"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    more = f"filter(array({stretch('r.al', 'f.i', 'r.bl', 'f.j')}, {stretch('f.i + f.k', 'r.ah', 'f.j + f.k', 'r.bh')}), x -> x.ah > x.al AND x.bh > x.bl)"
    step = let("s.todo[0]", "r", let(longest, "f", f"named_struct('m', s.m + f.k, 'todo', concat(slice(s.todo, 2, size(s.todo)), CASE WHEN f.k > 0 THEN {more} ELSE slice(s.todo, 1, 0) END))"))
    start = f"named_struct('m', 0, 'todo', array({stretch('0', 'length(a)', '0', 'length(b)')}))"
    fold = f"aggregate(sequence(0, 2 * least(length(a), length(b)) + 2), {start}, (s, n) -> CASE WHEN size(s.todo) = 0 THEN s ELSE {step} END).m"
    whole = f"CASE WHEN length(a) + length(b) = 0 THEN 1.0D WHEN a = b THEN 1.0D ELSE 2.0D * {fold} / (length(a) + length(b)) END"
    return F.expr(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN element_at(transform(array({a}), a -> {let(b, 'b', whole)}), 1) END")


def _tokens(name: Column) -> Column:
    """Runs of two letters with their number among equal ones; the ends of the name are letters too."""
    own = F.concat(F.lit("\x02"), name, F.lit("\x03"))
    runs = F.transform(F.sequence(F.lit(1), F.length(own) - 1), lambda i: F.substring(own, i, F.lit(2)))
    return F.transform(runs, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda h: h == g)).alias("n")))


def similar_names(names: DataFrame, least: float = 0.9) -> DataFrame:
    """(name, other, ratio) of different names (column name), name < other, whose ratio either way round is ``least`` or more.

    A name that repeats counts once; who has it is a join away."""
    own = settled(names.select("name").where("name is not null").distinct().withColumn("size", F.length("name")).withColumn("tokens", _tokens(F.col("name"))), "names")
    t, size = least, F.col("size")
    # a pair has M letters in blocks, M >= t * T / 2 of T in all, and shares 3 * M - T + 1 runs at least
    shared = lambda total: 3 * F.ceil(t * total / 2 - 1e-9) - total + 1
    shortest = size + F.ceil(size * (t / (2 - t)) - 1e-9)
    fewest = F.greatest(F.ceil((1.5 * t - 1) * shortest + 1 - 1e-9), F.lit(1))
    each = own.select("name", "size", F.explode("tokens").alias("token"))
    often = settled(each.groupBy(F.col("token").alias("__token")).agg(F.count(F.lit(1)).alias("often")), "name-runs")
    rare = Window.partitionBy("name").orderBy("often", "token")
    first = each.join(often, F.col("token") == F.col("__token")).withColumn("__r", F.row_number().over(rare)).where(F.col("__r") <= size + 1 - fewest + 1).select("token", "name", "size")
    other = first.select(F.col("token").alias("__token"), F.col("name").alias("other"), F.col("size").alias("other_size"))
    near = 2 * F.least("size", "other_size") >= t * (size + F.col("other_size")) - 1e-9
    pairs = first.join(other, (F.col("token") == F.col("__token")) & (F.col("name") < F.col("other")) & near).select("name", "other").distinct()
    of = lambda k: own.select(F.col("name").alias(f"__n{k}"), F.col("tokens").alias(f"__t{k}"), F.col("size").alias(f"__s{k}"))
    met = pairs.join(of(1), F.col("name") == F.col("__n1")).join(of(2), F.col("other") == F.col("__n2"))
    close = settled(met.where(F.size(F.array_intersect("__t1", "__t2")) >= shared(F.col("__s1") + F.col("__s2"))).select("name", "other"), "name-pairs")
    return close.select("name", "other", F.greatest(matching_ratio("name", "other"), matching_ratio("other", "name")).alias("ratio")).where(F.col("ratio") >= least - 1e-12)
