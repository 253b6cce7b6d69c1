"""Importance resampling towards a target distribution, by hashed runs of words.

A task joins its texts block by block, numbers their words and sorts the block's suffixes by their first
``n`` words (prefix doubling on word ids: a suffix array to the depth that counts).  Neighbours in that order whose
common prefix has k words or more are one run of one k-gram, so each distinct k-gram of a block is hashed once and
its bucket is scattered back to all its occurrences.

One pass over documents and target gives counts by bucket, from which each bucket gets an integer gain; a second
pass sums gains by document.  Gumbel noise by doc_id turns weights into scores, the highest of which are a sample
without replacement.  Ranks are running counts over ranges of scores, so no task sees all documents.

The driver holds one number for each bucket and one for each range.

Defined results: null and empty texts have no features and weight 0; a null doc_id draws its noise as an empty id and
comes after others of its score; rows that repeat a doc_id are ranked one after another; without target texts or
documents gains are those of zero counts; an empty table of documents gives no rows; other columns are not read by
``scored`` and are carried by ``drawn``, where repeated doc_ids are told apart by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, partitions, settle, table

BUCKETS, SHARE, SEED, LEAST = 10_000, 10, 2024, 20
#: Rows of one range of scores.
RANGE_ROWS = 2_000_000
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if chr(c) in "0123456789" or c in _LETTERS or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BETWEEN = b"\xff"  # no byte of UTF-8


class _Numbers(dict):
    """word -> its id, in order of first use; the words by id."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids of the words of all texts, -1 after each text; the place after each text's words; the words by id."""
    joined = (b" " + _BETWEEN + b" ").join([(t or "").encode() for t in texts] + [b""])
    numbers = _Numbers()
    numbers[_BETWEEN] = -1
    words = joined.translate(_TABLE).split()  # bytes beyond ASCII stay, the mark among them
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return ids, np.flatnonzero(ids < 0), numbers.words


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` ids, and how many ids (at most ``depth``) each shares with the one before.

    A mark ends a suffix: what follows it isn't compared."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, reach = ids - ids.min(), 1
    order = np.argsort(rank, kind="stable")
    left = np.zeros(n, np.int64)  # ids up to the next mark
    marks = np.flatnonzero(ids < 0)
    left[:] = np.append(marks, n)[np.searchsorted(marks, np.arange(n))] - np.arange(n)
    while reach < depth:
        step = min(reach, depth - reach)
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        second[left <= step] = 0
        order = np.lexsort((second, rank))
        change = np.ones(n, np.int64)
        change[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change) - 1
        reach += step
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    same = np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        same = same & (left[a] > k) & (left[b] > k)
        same[same] = ids[a[same] + k] == ids[b[same] + k]
        shared[1:] += same
    return order, shared


def bucket_places(texts: list[str | None], depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each k-gram's place (k up to ``depth``), and the numbers of words and of places of each text."""
    ids, ends, words = word_ids(texts)
    order, shared = suffix_order(ids, depth)
    text = np.searchsorted(ends, order)
    left = ends[np.minimum(text, len(ends) - 1)] - order if len(order) else order
    found, owner = [], []
    for k in range(1, depth + 1):
        whole = np.flatnonzero(left >= k)  # places whose text has k words from there
        if not len(whole):
            break
        # a run ends where fewer than k words are shared; suffixes too short for k can't lie inside a run
        first = shared[whole] < k
        first[0] = True
        heads = order[whole[first]]
        grams = [words[i] for i in ids[heads]] if k == 1 else [b" ".join([words[i] for i in ids[h : h + k]]) for h in heads]
        hashed = np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % buckets  # once for each run
        found.append(hashed[np.cumsum(first) - 1])
        owner.append(text[whole])
    n_words = np.diff(ends, prepend=-1) - 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words, np.zeros(len(texts), np.int64)
    bucket, owner = np.concatenate(found), np.concatenate(owner)
    return bucket, owner, n_words, np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame, depth: int = 1, buckets: int = BUCKETS, block: int = 8 << 20) -> np.ndarray:
    """How many features of all rows' texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in in_slices(batches, "text", block):
            total += np.bincount(bucket_places(batch.column("text").to_pylist(), depth, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "held"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held"))
    for r in rows.collect():  # a number for each bucket
        out[r.bucket] = r.held
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share over the source's), by bucket."""
    n = len(source)
    return np.floor(1000 * np.log(((target + 1) * float(source.sum() + n)) / ((source + 1) * float(target.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel number) that depends on the id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, gains: np.ndarray, depth: int = 1, block: int = 8 << 20, carried: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row, with the columns ``carried``."""
    carried, buckets = carried or [], len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", block):
            bucket, owner, n_words, places = bucket_places(batch.column("text").to_pylist(), depth, buckets)
            total = np.zeros(len(places), np.int64)
            np.add.at(total, owner, gains[bucket])
            weight = np.where(places > 0, total // np.maximum(places, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(places, pa.int64()), pa.array(weight, pa.int64()), *[batch.column(c) for c in carried]], names=["doc_id", "n_words", "n_features", "weight", *carried])

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, n_words long, n_features long, weight long", *[f"{c} {types[c]}" for c in carried]])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried).mapInArrow(run, schema)


def scored(docs: DataFrame, target: DataFrame, depth: int = 1, buckets: int = BUCKETS, seed: int = SEED, carried: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs``; ``target`` needs a column text."""
    gains = gains_of(bucket_counts(docs, depth, buckets), bucket_counts(target, depth, buckets))
    return weighted(docs, gains, depth, carried=carried).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Rows of ``scored`` with rank, from 1 by falling score among those with ``least`` words; null beyond ``share`` percent.

    Rows are ranged by what orders them and numbered in each range; ranges are counted and their starts added."""
    spark = rows.sparkSession
    rows = settle(rows.withColumn("__row", F.monotonically_increasing_id()), "resampling-scores")
    fit = F.col("n_words") >= least
    drawn = share * rows.where(fit).count() // 100
    order = [F.when(fit, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("__row")]
    ranges = max(partitions(spark), -(-rows.count() // RANGE_ROWS))
    along = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # the number of a row is its partition's, shifted, plus its place there
    own = settle(along.select("*", F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__place")), "resampling-ranges")
    sizes = sorted((r["__range"], r["count"]) for r in own.groupBy("__range").count().collect())  # a number for each range
    starts, at = [], 0
    for k, size in sizes:
        starts.append((k, at))
        at += size
    placed = own.join(spark.createDataFrame(starts, "__part long, __start long"), F.col("__range") == F.col("__part"))
    rank = F.col("__start") + F.col("__place") + 1
    return placed.withColumn("rank", F.when(rank <= drawn, rank)).drop("__row", "__at", "__range", "__place", "__part", "__start")


def drawn(docs: DataFrame, target: DataFrame, depth: int = 1, buckets: int = BUCKETS, share: int = SHARE, seed: int = SEED, least: int = LEAST) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they came, and ``rank`` (``resampling_rank`` where that name is taken)."""
    taken = {c.lower() for c in docs.columns}
    row, rank = next(n for n in (f"__own{'_' * k}" for k in range(len(taken) + 1)) if n not in taken), "resampling_rank" if "rank" in taken else "rank"
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "resampling-rows")
    own = ranked(scored(numbered, target, depth, buckets, seed, [row]), share, least).where("rank is not null")
    return numbered.join(own.select(F.col(row).alias("__drawn_row"), F.col("rank").alias("__drawn_rank")), F.col(row) == F.col("__drawn_row")).select(*docs.columns, F.col("__drawn_rank").alias(rank))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a word's bytes by the table of its remainders, once for each distinct word.
ORACLE = r"""
WITH RECURSIVE step(b, c, k) AS (
  SELECT b, b::UBIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), remainders AS (SELECT list(c ORDER BY b) AS r FROM step WHERE k = 8),
words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), vocabulary AS (SELECT DISTINCT w FROM words),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::INT, 2))::UBIGINT)),
      lambda a, x: xor(a >> 8, r[(xor(a & 255, x) + 1)::INT])), 4294967295::UBIGINT)::BIGINT % 10000 AS bucket
  FROM vocabulary, remainders
), counted AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), summed AS (
  SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scores AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN summed USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
