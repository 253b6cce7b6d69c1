"""Quality verdicts by learned decision lists.

Statistics of every whole text are gathered in one pass.  A decision list for low quality is learned from labelled
statistics by sequential covering: a rule grows by the threshold test of best information gain on two thirds of
what is left, is pruned from its end on the other third, and is kept if its precision on all that it covers of
both holds up; what it covers is set aside, and the next rule grows.  The list becomes an ordered Spark conditional expression over the
statistics, so the verdict runs inside the engine.

Learning reads at most ``SAMPLE`` labelled rows (the smallest hashes of doc_id); statistics and verdicts cover all.

Defined results: null and empty texts have no words, zero counts, and fail the base; repeated rows are judged
each; a null doc_id is carried; without labels of both kinds the list is empty and the base alone decides; an
empty table gives no rows; other columns are not read by ``judged`` and carried by ``kept_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, table

SAMPLE = 6000
WINDOW = 8
#: A rule must be right about this share of what it covers of all rows left, and cover this many low ones.
PRECISION, COVER, MOST_RULES, MOST_TESTS = 0.9, 5, 12, 4
_MULTIPLY = np.random.default_rng(11).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct", "n_same_next", "n_digits"]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    mix = np.zeros(n, np.uint64)
    for i in range(window):
        mix = (mix ^ (mix >> np.uint64(29))) * _MULTIPLY[i] + hashes[i : n + i]
    order = np.argsort(mix, kind="stable")
    same = mix[order][1:] == mix[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return (
        len(words),
        len(text) - (len(raw) - sum(map(len, words))),
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(hashes),
        len(lines),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        raw.count(b"!") + raw.count(b"?"),
        len(np.unique(hashes)),
        int((hashes[1:] == hashes[:-1]).sum()),
        len(raw) - len(raw.translate(None, b"0123456789")),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            rows = [statistics_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: Features of the rules: (name, numerator, denominator).
FEATURES = [
    ("symbols a word character", "n_symbols", "word_chars"),
    ("repeated lines", "n_dup_lines", "n_lines"),
    ("repeated words", "n_repeat_words", "n_words"),
    ("capitals a word character", "n_upper", "word_chars"),
    ("exclamations a word", "n_bangs", "n_words"),
    ("distinct words", "n_distinct", "n_words"),
    ("words like the one before", "n_same_next", "n_words"),
    ("digits a word character", "n_digits", "word_chars"),
    ("characters a word", "word_chars", "n_words"),
    ("words a line", "n_words", "n_lines"),
]


def feature_column(index: int) -> Column:
    _, over, under = FEATURES[index]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def feature_matrix(rows: np.ndarray) -> np.ndarray:
    at = {c: rows[:, i].astype(np.float64) for i, c in enumerate(COUNTS)}
    return np.stack([at[over] / np.maximum(at[under], 1) for _, over, under in FEATURES], axis=1)


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self) -> Column:
        c = feature_column(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_TESTS and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0:
            break
        base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for f in range(x.shape[1]):
            order = np.argsort(x[inside, f], kind="stable")
            value, label = x[inside, f][order], bad[inside][order]
            cut = np.flatnonzero(value[1:] > value[:-1])
            if not len(cut):
                continue
            p_low, all_low = np.cumsum(label)[cut], cut + 1
            for above in (True, False):
                p = p0 - p_low if above else p_low
                n = (len(value) - all_low if above else all_low) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where((p > 0) & (p + n >= COVER), p * (np.log2(p / (p + n)) - base), -1)
                i = int(np.argmax(g))
                if g[i] > gain:
                    gain, best = g[i], Test(f, above, float((value[cut[i]] + value[cut[i] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float]:
    """The start of a rule that is worth most on other rows, and its precision there (Laplace)."""
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        covered = bad[_covers(rule[:k], x)]
        p, n = int(covered.sum()), int((~covered).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth, precision = rule[:k], value, (p + 1) / (p + n + 2)
    return best, precision


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 5) -> list[Rule]:
    """An ordered list of rules for low quality."""
    rules: list[Rule] = []
    r = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and bad[left].sum() >= COVER and (~bad[left]).any():
        at = r.permutation(np.flatnonzero(left))
        grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        rule, _ = _pruned(rule, x[prune], bad[prune])
        covered = _covers(rule, x) & left
        p, n = int(bad[covered].sum()), int((~bad[covered]).sum())
        if (p + 1) / (p + n + 2) < PRECISION or p < COVER:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule calls the row bad: an ordered conditional expression."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        held = rule[0].column()
        for test in rule[1:]:
            held = held & test.column()
        out = F.when(held, False) if out is None else out.when(held, False)
    return out.otherwise(True)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the bounded sample of labelled rows; of repeated labels or rows of one doc_id, one counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("__label"), F.col("quality").cast("int").alias("__quality")).where("__quality is not null and __label is not null").groupBy("__label").agg(F.min("__quality").alias("__quality")).orderBy(F.xxhash64("__label"), "__label").limit(sample)
    some = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__label")).select(F.col("doc_id"), "text")
    counted = statistics(some).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c"))
    rows = counted.join(F.broadcast(own), F.col("doc_id") == F.col("__label")).select("doc_id", "c.*", "__quality").collect()  # as many rows as the sample has
    if not rows:
        return []
    values = np.array(sorted(tuple(x) for x in rows), np.int64)
    return learn(feature_matrix(values[:, 1:-1]), values[:, -1] == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    rows = statistics(docs).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fitted(docs, table(spark, sf_dir, "labels")))
