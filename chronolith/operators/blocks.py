"""Pairs of rows by way of blocks: what is asked of two rows is asked of their classes, and rows are put in place last.

A result of pairs has as many rows as its contract says; what goes through a shuffle is blocks of rows, not pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block: an array of this many is held at once by a task.
MOST = 1000
#: Rows of a block that meet another block at once.
SLICE = 25


def blocked(rows: DataFrame, by: list[str], name: str, order: list[str] | None = None, most: int = MOST) -> DataFrame:
    """``rows`` by their columns ``by``: the others as structs of an array ``name`` of ``most`` rows at the most, numbered by
    ``name_block``; with ``order``, blocks follow each other by it."""
    rest = [c for c in rows.columns if c not in by]
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*(order or [F.lit(0)])))
    own = rows.withColumn(f"{name}_block", F.floor((number - 1) / most))
    return own.groupBy(*by, f"{name}_block").agg(F.collect_list(F.struct(*rest)).alias(name))


def expanded(pairs: DataFrame, first: str, second: str, spread: list[str] | None = None) -> DataFrame:
    """``pairs`` with a row for each member of the array ``first`` and each of ``second``, which become structs; with
    ``spread``, pairs of blocks are dealt out anew by these columns, so that no task has all pairs of a large group.

    A task holds the rows that one row of a step becomes, so the first block is taken a slice at a time."""
    blocks = [f"{first}_block", f"{second}_block"]
    kept = [c for c in pairs.columns if c not in (first, second, *blocks)]
    if spread is not None:  # by number, as few bytes become many rows: adaptive execution would make a few tasks of them
        pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *spread, *blocks)
    fields = {c: pairs.schema[c].dataType.elementType.names for c in (first, second)}
    names = {c: [f"__{c}_{n}" for n in fields[c]] for c in fields}
    starts = F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1)), F.lit(SLICE))
    own = pairs.select(*kept, second, F.explode(F.transform(starts, lambda k: F.slice(first, k, F.lit(SLICE)))).alias(first))
    own = own.select(*kept, second, F.inline(first).alias(*names[first])).select(*kept, *names[first], F.inline(second).alias(*names[second]))
    return own.select(*kept, *[F.struct(*[F.col(x).alias(n) for x, n in zip(names[c], fields[c])]).alias(c) for c in (first, second)])
