"""Fixpoints: rounds of new rows in the shared folder, each joined with what is known."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; one of this machine only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="chronolith-rounds-"))
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Take a folder of the shared place away; nothing happens where the session has ended."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the cluster's own clean-up applies then
        pass


def settled(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fixpoint(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most: int = 64, by: str | None = None) -> DataFrame:
    """``start`` and all that ``step(known, new)`` adds, where ``new`` is what the last round added to ``known``."""
    return extended(settled(start.distinct(), "fixpoint"), step, most, by)[0]


def extended(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most: int = 64, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows, added rows) of a fixpoint over ``start``, whose rows are settled and differ from each other.

    A rule need only be tried where one premise is new.  Rounds are written apart in one folder, so each row is
    written once, lineage ends there, and a lost executor loses nothing.  With ``by``, a column of few values, what a
    round finds is compared only with known rows of the same values, and written as it is where there are none."""
    spark = start.sparkSession
    path = scratch(spark, "fixpoint")
    schema = start.schema
    read = lambda paths: spark.read.schema(schema).parquet(*paths)
    written, known, new = [], start, start
    for n in range(most):
        found, own = step(known, new).distinct(), f"{path}/round={n + 1}"
        old = known
        if by:
            found.write.parquet(f"{path}/found={n + 1}")
            found = read([f"{path}/found={n + 1}"])
            kinds = found.select(F.col(by).alias("__by")).distinct()
            old = known.join(F.broadcast(kinds), F.col(by).eqNullSafe(F.col("__by")), "left_semi")
        if by and old.isEmpty():
            own = f"{path}/found={n + 1}"
        else:
            old = old.select(*[F.col(c).alias(f"__known_{c}") for c in start.columns])
            found.join(old, [F.col(c).eqNullSafe(F.col(f"__known_{c}")) for c in start.columns], "left_anti").write.parquet(own)
        new = read([own])
        if new.isEmpty():
            return known, read([*written, own])
        written.append(own)
        known = start.unionByName(read(written))
    raise RuntimeError(f"no fixpoint after {most} rounds")
