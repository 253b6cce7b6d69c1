"""Labels: collection, normal and hidden forms, labels of roots, display, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import text


def labelled_elements(landmarks: DataFrame, name_versions: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(elem, type, label, lang) of landmarks and of their name versions; with ``hidden`` (elem), only those without a hidden label."""
    a = landmarks.select(F.col("lm").alias("elem"), "type", "label", "lang")
    b = name_versions.select(F.col("av").alias("elem"), "type", F.col("value").alias("label"), "lang")
    out = a.unionByName(b).where("label is not null").distinct()
    return out if hidden is None else out.join(hidden.select("elem").distinct(), "elem", "left_anti")


def with_labels(elements: DataFrame, compat: bool = False) -> DataFrame:
    """pref_label (normal) and hidden_label (simplified normal) by the element's type."""
    kind = text.kind_of_name(F.col("type"))
    out = elements.withColumn("pref_label", text.normal_name(F.col("label"), kind, F.col("lang"), compat))
    return out.withColumn("hidden_label", text.simplified_name(F.col("pref_label"), kind, F.col("lang")))


def root_labels(roots: DataFrame, traces: DataFrame) -> DataFrame:
    """Labels of roots: own label, else its traces' normal labels, else their labels; others of a trace become alternative labels.

    roots (root, label); traces (root, pref_label, label).  Set-valued: (root, kind, label)."""
    joined = traces.select(F.col("root").alias("__root"), "pref_label", F.col("label").alias("trace_label")).join(roots.select("root", F.col("label").alias("own")), F.col("root") == F.col("__root"))
    main = joined.select("root", F.lit("label").alias("kind"), F.coalesce("own", "pref_label", "trace_label").alias("label"))
    alternative = joined.select("root", F.lit("alt").alias("kind"), F.when(F.col("pref_label") != F.coalesce("own", "pref_label", "trace_label"), F.col("pref_label")).otherwise(F.when(F.col("trace_label") != F.coalesce("own", "pref_label", "trace_label"), F.col("trace_label"))).alias("label"))
    return main.unionByName(alternative).where("label is not null").distinct()


def displayed(landmarks: DataFrame, relations: DataFrame) -> DataFrame:
    """(lm, label): ``label (relatum's label)``, by each landmark's first relation."""
    first = Window.partitionBy("lm").orderBy(F.col("relatum_label").asc_nulls_last(), "lr")
    named = landmarks.select(F.col("lm").alias("__relatum"), F.col("label").alias("relatum_label"))
    links = relations.select(F.col("locatum").alias("lm"), "lr", "relatum").join(named, F.col("relatum") == F.col("__relatum"), "left")
    links = links.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("lm").alias("__lm"), "relatum_label")
    out = landmarks.select("lm", "label").join(links, F.col("lm") == F.col("__lm"), "left")
    return out.select("lm", F.when(F.col("relatum_label").isNotNull(), F.concat("label", F.lit(" ("), "relatum_label", F.lit(")"))).otherwise(F.col("label")).alias("label"))


def search(labels: DataFrame, query: str, column: str, key: str, most: int = 20) -> DataFrame:
    """The first rows, by folded label and key, whose label holds the query, case and accents aside."""
    own = text.folded(F.col(column))
    return labels.withColumn("folded", own).where(F.contains("folded", text.folded(F.lit(query)))).orderBy("folded", key).limit(most)


class LabelIndex:
    """Labels by their runs of three letters, on disk: what a search reads are the postings of its own runs.

    Postings (gram, key) lie in ``buckets`` folders by the run's hash; labels (key, folded) beside them."""

    def __init__(self, spark: SparkSession, path: str, key_type: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key_type, self.buckets = spark, path.rstrip("/"), key_type, buckets

    @classmethod
    def build(cls, rows: DataFrame, column: str, key: str, path: str, buckets: int = 64) -> LabelIndex:
        out = cls(rows.sparkSession, path, rows.schema[key].dataType.simpleString(), buckets)
        own = rows.select(F.col(key).alias("key"), text.folded(F.col(column)).alias("folded")).where("folded is not null")
        own.write.parquet(f"{out.path}/labels")
        gram = F.explode(out._grams(F.col("folded"))).alias("gram")
        own.select("key", gram).withColumn("bucket", out._bucket(F.col("gram"))).repartition(F.col("bucket"), F.col("gram")).write.partitionBy("bucket").parquet(f"{out.path}/postings")
        return out

    @staticmethod
    def _grams(folded: Column) -> Column:
        return F.when(F.length(folded) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(folded) - 2), lambda i: F.substring(folded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def candidates(self, query: str) -> DataFrame | None:
        """(key) of labels that have all runs of a query; None if it is too short to have one."""
        grams = self.spark.range(1).select(F.explode(self._grams(text.folded(F.lit(query)))).alias("gram")).select("gram", self._bucket(F.col("gram")).alias("bucket")).collect()
        if not grams:
            return None
        postings = self.spark.read.schema(f"gram string, key {self.key_type}, bucket int").parquet(f"{self.path}/postings")
        mine = postings.where(F.col("bucket").isin([g.bucket for g in grams]) & F.col("gram").isin([g.gram for g in grams]))
        return mine.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("key")

    def search(self, query: str, most: int = 20) -> DataFrame:
        """(key, folded): the rows of ``search``, by way of the postings."""
        labels, found = self.spark.read.schema(f"key {self.key_type}, folded string").parquet(f"{self.path}/labels"), self.candidates(query)
        if found is not None:
            labels = labels.join(found.select(F.col("key").alias("__key")), F.col("key") == F.col("__key"), "left_semi")
        return labels.where(F.contains("folded", text.folded(F.lit(query)))).orderBy("folded", "key").limit(most)
