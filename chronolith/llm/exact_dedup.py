"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest.  ``add`` reduces new rows to one row per digest, finds those
that the index lacks by a sort-merge anti-join on the buckets, and appends them; counts of digests that it holds
already go to a second folder.  ``members`` gives every row's standing, groups being counted over all batches.

An index outlives the driver: its files lie in the warehouse or where the caller says, and opening it again finds
them by the catalog or, where the catalog has forgotten the table, by the folder.  Queries over one table take a
fresh index in scratch space, as their result is that table's alone, and feed it in blocks of doc_ids, the largest
first: later blocks meet what earlier ones left.  ``add`` isn't atomic: a batch that is added twice is counted twice.

Defined results: a null text counts as empty; of equal texts in one batch the row with the largest doc_id stays,
while a text that an earlier batch brought keeps that batch's row; a null doc_id loses to any other; repeated
rows share one group and each is returned; an empty table gives no rows; other columns are carried by
``deduplicated`` and not read by ``members``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import partitions, scratch_path, settle, table

COLUMNS = "digest string, keep_id long, group_size long"
AGAIN = "digest string, group_size long"
#: Batches in which the query feeds its table.
BLOCKS = 2


def digest_of(text: str = "text") -> F.Column:
    return F.sha2(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), 256)


class DigestIndex:
    """A table (digest, keep_id, group_size), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None) -> None:
        """Open the index of a name, or make it in the folder ``path`` (one named after it in the warehouse)."""
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            root = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
            held = self._held(root)
            n = held or buckets or partitions(spark)
            spark.sql(f"CREATE TABLE {name} ({COLUMNS.replace('long', 'bigint')}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{root}/buckets-{n}'")
        facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        self.path, self.buckets = facts["Location"], int(facts["Num Buckets"])
        self.again_path = f"{self.path}-again"
        if not self._exists(self.again_path):
            spark.createDataFrame([], AGAIN).write.mode("append").parquet(self.again_path)
        if not self._exists(self.path):
            self._append(spark.createDataFrame([], COLUMNS))

    def _place(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        """Whether a folder has been written to the end once."""
        files, place = self._place(path)
        return files.exists(place) and len(files.listStatus(place)) > 0

    def _held(self, root: str) -> int | None:
        """The number of buckets of an index that a folder holds."""
        files, place = self._place(root)
        names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
        found = [int(m[1]) for x in names if (m := re.fullmatch(r"buckets-(\d+)", x))]
        return found[0] if found else None

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def rows(self) -> DataFrame:
        """digest, keep_id, group_size, as the batch that brought the digest left them."""
        return self.spark.table(self.name)

    def counted(self) -> DataFrame:
        """The rows with groups counted over all batches; read as files, without buckets, so that both sides of a hot key can be split."""
        first = self.spark.read.schema(COLUMNS).parquet(self.path)
        again = self.spark.read.schema(AGAIN).parquet(self.again_path)
        if again.isEmpty():
            return first
        more = again.groupBy(F.col("digest").alias("__digest")).agg(F.sum("group_size").alias("__more"))
        return settle(first.join(more, F.col("digest") == F.col("__digest"), "left").select("digest", "keep_id", (F.col("group_size") + F.coalesce("__more", F.lit(0))).alias("group_size")), "digest-counts")

    def add(self, docs: DataFrame) -> None:
        """Append the digests of ``docs`` that the index doesn't hold, and count those that it does."""
        batch = docs.select(digest_of().alias("digest"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # written first: the optimizer would else move the anti-join below the aggregate, where a hot text meets in one task
        batch = settle(batch, "digest-batch")
        if not self.rows().isEmpty():
            batch.join(self.rows().select("digest").hint("merge"), "digest", "left_semi").select("digest", "group_size").write.mode("append").parquet(self.again_path)
        # the table is read and appended to: Spark plans the scan's file list before it writes new files
        self._append(batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti"))

    def members(self, docs: DataFrame) -> DataFrame:
        """Per row: doc_id, keep_id, group_size, kept, text_sha256.

        Most texts are alone: their rows need nothing but the digest, yet which they are is known from the index
        only, so rows meet it in one sort-merge join on the digest, whose hot keys adaptive execution splits."""
        index = self.counted()
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"))
        return rows.join(index.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias("text_sha256"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An index of its own, whose files go when the driver ends."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, path=scratch_path(spark, name))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, single: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id their group keeps, all columns as they came.

    A keeper is unique by (digest, doc_id) unless whole keys repeat, so rows meet the index on both: no hot key.
    Rows that repeat a keeper's whole key are all returned, or, with ``single``, one row of each text that the index
    lacked: rows are numbered and a group keeps one number."""
    index = index or fresh_index(docs.sparkSession)
    taken = {c.lower() for c in docs.columns}
    own, row = (next(n for n in (f"__{name}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for name in ("own", "row"))
    if single:
        numbered = settle(docs.withColumn(own, digest_of()).withColumn(row, F.monotonically_increasing_id()), "digest-rows")
        one = numbered.groupBy(F.col(own).alias("digest")).agg(F.coalesce(F.max_by(row, F.col("doc_id").cast("long")), F.min(row)).alias("__one"))
        one = settle(one, "digest-keepers").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
        one = settle(one.select("__one"), "digest-keepers")  # before the index gets these digests
        index.add(numbered)
        return numbered.join(one.hint("merge"), F.col(row) == one["__one"], "left_semi").drop(own, row)
    index.add(docs)
    keep = docs.sparkSession.read.schema(COLUMNS).parquet(index.path).hint("merge")
    return docs.withColumn(own, digest_of()).join(keep, (F.col(own) == keep["digest"]) & F.col("doc_id").cast("long").eqNullSafe(keep["keep_id"]), "left_semi").drop(own)


def in_blocks(docs: DataFrame, blocks: int = BLOCKS) -> list[DataFrame]:
    """All rows in blocks of equal ranges of doc_ids, the largest first; null doc_ids are in the last."""
    own = F.col("doc_id").cast("long")
    low, high = docs.agg(F.min(own), F.max(own)).first()
    if low is None:
        return [docs]
    cuts = [high + 1 - (high + 1 - low) * i // blocks for i in range(1, blocks)]  # falling
    edges = [None, *cuts, None]
    parts = []
    for above, least in zip(edges, edges[1:]):
        inside = F.lit(True) if above is None else own < above
        inside = inside if least is None else inside & (own >= least)
        parts.append(docs.where(inside if least is not None else F.coalesce(inside, F.lit(True))))
    return parts


def op2_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fresh_index(spark)
    for block in in_blocks(docs):
        index.add(block)
    return index.members(docs)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
