"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases in whole texts.

A text is read as words (A-Z in small letters, ASCII letters, digits and all beyond ASCII); the automaton runs over
the words joined by one blank, so one pass finds every place of every phrase, overlapping ones included.  A phrase
that lies inside a longer one's place is no finding of its own, except for the base phrases, all of whose places
count.  After the words of an identifier tag the text itself is read: a shunting-yard parser turns the expression
that follows on the same line into reverse Polish form (with > and > or), which is then evaluated: ``or`` is the
reader's choice (the freest part counts), ``and`` binds both (the least free counts), ``with`` loosens its licence.

``scanned`` returns the findings of each document with spans; ``permitted`` evaluates an expression against a set of
licences.  The score of a document is that of its least free finding: 1 permissive, 0 all rights reserved, 0.5 where
nothing is found or a licence is unknown.

Defined results: null and empty texts have no words and no findings, an empty list of labels is an empty string;
a tag with no expression after it is no finding; an expression that breaks off counts up to its last complete part;
repeated rows and null doc_ids are carried; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, table

# fixed values: the base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notice phrases and their labels, written as words.
NOTICES = {
    "apache license version 2 0": "apache-2", "licensed under the apache license": "apache-2", "the mit license": "mit", "mit license": "mit",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu gpl v3": "gpl-3.0", "gnu gpl v2": "gpl-2.0", "gplv3": "gpl-3.0", "gplv2": "gpl-2.0",
    "gnu lesser general public license": "lgpl", "gnu lesser general public license version 3": "lgpl-3.0", "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu affero general public license": "agpl-3.0",
    "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0", "mozilla public license v 2 0": "mpl-2.0", "eclipse public license": "epl", "isc license": "isc",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "redistribution and use in source and binary forms": "bsd", "boost software license": "bsl-1.0", "the unlicense": "unlicense", "zlib license": "zlib",
    "cc0": "cc0-1.0", "dedicated to the public domain": "public-domain", "in the public domain": "public-domain", "cc by 4 0": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
#: Words of identifier tags; an expression must follow on the same line.
TAGS = ["spdx license identifier", "license expression", "license identifier"]

#: How freely a licence lets its text be used, by the start of its label (the longest that fits).
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0, "0bsd": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.1, "busl": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN, LOOSER = 0.5, 0.2
#: Labels of identifiers that have another name among the base labels.
SAME = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-2.0": "cc-by-nc"}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?))")
#: A word in the text as it came, and what must stand between a tag and its expression.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_AFTER = re.compile(r"[ \t]*[:=][ \t]*[\"']?")
_BETWEEN = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(_BETWEEN[c] for c in _LOWER)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def automaton_of(phrases: dict[str, object]) -> ahocorasick.Automaton:
    """An automaton over blank-joined words; a hit's value is (phrase's length in code points, words, value)."""
    out = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, value))
    out.make_automaton()
    return out


def label_of(identifier: str) -> str:
    """The label of an identifier: small letters, an "or later" mark dropped."""
    own = re.sub(r"(?:\+|-only|-or-later)$", "", identifier.lower())
    return SAME.get(own, own)


def freedom(label: str) -> float:
    starts = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    return FREEDOM[max(starts, key=len)] if starts else UNKNOWN


def parse(text: str, start: int = 0) -> tuple[list[str], int]:
    """Shunting-yard: the longest expression at ``start`` in reverse Polish form and where it ends.

    The form is empty where no expression starts.  Parts that never close or lack an operand end the expression
    before them."""
    tokens: list[tuple[str, int]] = []
    at = start
    while m := _TOKEN.match(text, at):
        tokens.append((m[1] or m[2], m.end()))
        at = m.end()
    best: tuple[list[str], int] = ([], start)
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand is due
    for token, end in tokens:
        word = token.lower()
        if operand:
            if token == "(" and (not held or held[-1] != "with"):
                held.append("(")
                continue
            if token in ("(", ")") or word in PRECEDENCE:
                break
            out.append(token)
            operand = False
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif word in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            break
        if not operand and "(" not in held:
            best = (out + held[::-1], end)
    return best


def evaluate(form: list[str], licence: Callable[[str], object], either: Callable, both: Callable, eased: Callable) -> object:
    """The value of a reverse Polish form."""
    stack: list = []
    for k, token in enumerate(form):
        word = token.lower()
        if word in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(eased(a, b) if word == "with" else either(a, b) if word == "or" else both(a, b))
        else:  # the right side of ``with`` is an exception's name, no licence
            exception = k + 1 < len(form) and form[k + 1].lower() == "with"
            stack.append(token if exception else licence(token))
    return stack[0]


def score_of(form: list[str]) -> float:
    return evaluate(form, lambda x: freedom(label_of(x)), max, min, lambda a, _: min(1.0, a + LOOSER))


def permitted(expression: str, allowed: set[str], exceptions: set[str] | None = None) -> bool | None:
    """Whether licences of ``allowed`` (labels) satisfy an expression; None if it is no expression as a whole.

    A licence with an exception is permitted if it is itself, or if the exception is among ``exceptions``."""
    form, end = parse(expression)
    if not form or expression[end:].strip():
        return None
    eased = lambda a, b: a or b.lower() in (exceptions or set())
    return bool(evaluate(form, lambda x: label_of(x) in allowed, lambda a, b: a or b, lambda a, b: a and b, eased))


def labels_of(form: list[str]) -> list[str]:
    own = [label_of(t) for k, t in enumerate(form) if t.lower() not in PRECEDENCE and not (k + 1 < len(form) and form[k + 1].lower() == "with")]
    return sorted(set(own))


def canonical(form: list[str]) -> str:
    """The expression with brackets only where precedence needs them."""
    text, _ = evaluate(
        form, lambda x: (x, 4),
        lambda a, b: (f"{a[0]} OR {b[0]}", 1),
        lambda a, b: (" AND ".join(f"({x})" if p < 2 else x for x, p in (a, b)), 2),
        lambda a, b: (f"{a[0] if a[1] > 3 else '(' + a[0] + ')'} WITH {b}", 3),
    )
    return text


Finding = tuple[str, list[str], str | None, int, int, int, int, float]


class Scanner:
    """Findings of a text: (kind, labels, expression, first_word, words, start, stop, score), by place."""

    def __init__(self) -> None:
        phrases: dict[str, object] = {p: [("notice", label)] for p, label in NOTICES.items()}
        for p, label in BASE.items():
            phrases[p] = [*phrases.get(p, []), ("base", label)]
        for p in TAGS:
            phrases[p] = [("tag", None)]
        self.automaton = automaton_of(phrases)

    def findings(self, text: str | None) -> tuple[int, list[Finding]]:
        """The number of words, and the findings."""
        words = words_of(text or "")
        joined = (b" " + b" ".join(words) + b" ").decode()
        hits = [(end - size + 2, n, value) for end, (size, n, values) in self.automaton.iter(joined) for value in values]
        if not hits:
            return len(words), []
        starts = list(accumulate((len(w.decode()) + 1 for w in words), initial=1))  # where words begin in what was searched
        spans = [m.span() for m in _WORD.finditer(text)]
        own: list[Finding] = []
        longest: list[Finding] = []
        for at, n, (kind, label) in hits:
            first = bisect_right(starts, at) - 1
            if kind == "tag":
                after = _AFTER.match(text, spans[first + n - 1][1])
                form, stop = parse(text, after.end()) if after else ([], 0)
                if form:
                    longest.append((kind, labels_of(form), canonical(form), first, n, spans[first][0], stop, score_of(form)))
                continue
            finding = (kind, [label], None, first, n, spans[first][0], spans[first + n - 1][1], freedom(label))
            (own if kind == "base" else longest).append(finding)
        places = sorted({(f[3], f[3] + f[4]) for f in [*own, *longest]}, key=lambda p: (p[0], -p[1]))
        inside, reach = set(), (-1, -1)
        for p in places:  # by start, the longest first: a place is inside another if an earlier one reaches as far
            if p[1] <= reach[1]:
                inside.add(p)
            else:
                reach = p
        longest = [f for f in longest if (f[3], f[3] + f[4]) not in inside]
        return len(words), sorted({(k, tuple(x), e, *r): (k, x, e, *r) for k, x, e, *r in [*own, *longest]}.values(), key=lambda f: (f[3], f[4], f[0]))


FINDING = pa.struct([("kind", pa.string()), ("labels", pa.list_(pa.string())), ("expression", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and findings of every row; start and stop are code points of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, names = Scanner(), [f.name for f in FINDING]
        for batch in in_slices(batches, "text"):
            got = [scanner.findings(t.as_py()) for t in batch.column("text")]
            found = pa.array([[dict(zip(names, f)) for f in x] for _, x in got], pa.list_(FINDING))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), found], names=["doc_id", "n_words", "findings"])

    schema = "doc_id long, n_words long, findings array<struct<kind: string, labels: array<string>, expression: string, first_word: long, words: long, start: long, stop: long, score: double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def summarised(scans: DataFrame) -> DataFrame:
    """One row of counts and labels for each row of ``scanned``."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    joined = lambda found: F.array_join(F.sort_array(F.array_distinct(F.flatten(F.transform(found, lambda f: f["labels"])))), ",")
    return scans.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["first_word"])).alias("first_word"), F.array_max(F.transform(base, lambda f: f["first_word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("findings")).alias("labels"),
        F.coalesce(F.array_min(F.transform("findings", lambda f: f["score"])), F.lit(UNKNOWN)).alias("score"),
        F.transform(F.filter("findings", lambda f: f["kind"] == "tag"), lambda f: f["expression"]).alias("expressions"),
    )


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(scanned(table(spark, sf_dir, "documents")))
