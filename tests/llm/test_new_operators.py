"""Whitening, licence scans and importance resampling against brute force, with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from chronolith.llm import licences, queries, target_resampling, token_files, toxicity, whitening

SF = "/root/testdata/sf0.01"
NARROW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# 11
def brute_whitening(rows):
    """Exact rational covariance, then the eigendecomposition of its doubles."""
    kept = [(i, [math.floor(Fraction(1024) * Fraction(float(np.float32(c)))) + 100000 for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    total = [sum(x[k] for _, x in kept) for k in range(d)]
    v = np.array([[float(sum(Fraction(x[a] * n - total[a]) * (x[b] * n - total[b]) for _, x in kept) / (n**3)) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:8]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, total)) for _, x in kept]
    w = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, total)] for _, x in kept]) @ vectors[:, order] / np.sqrt(values[order])
    return kept, n, deviations, w, values[order] / np.trace(v)


def check_whitening(got, rows):
    kept, n, deviations, w, explained = brute_whitening(rows)
    k = w.shape[1]
    own = sorted(((i is not None, i or 0), dev, tuple(abs(x) for x in r)) for (i, _), dev, r in zip(kept, deviations, w))
    by_row = {}
    for r in got:
        assert r.n == n and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-6 and str(r.deviation) == r.deviation_digits
        by_row.setdefault((r.vec_id, r.deviation), [[] for _ in range(k)])[r.component - 1].append(r.whitened)
    assert len(got) == k * len(kept)
    want = {}
    for (i, _), dev, r in zip(kept, deviations, w):
        for c, x in enumerate(r):
            want.setdefault((i, dev), [[] for _ in range(k)])[c].append(x)
    assert by_row.keys() == want.keys() and len(own) == len(kept)
    for c in range(k):  # either sign, the same for all rows
        a = np.concatenate([sorted(by_row[key][c]) for key in want])
        same, other = np.concatenate([sorted(want[key][c]) for key in want]), np.concatenate([sorted(-x for x in want[key][c]) for key in want])
        assert np.allclose(a, same, rtol=0, atol=1e-7) or np.allclose(a, other, rtol=0, atol=1e-7)


def test_whitening(spark):
    r = np.random.default_rng(3)
    mix = r.normal(size=(12, 12)) * np.arange(1, 13)
    vectors = [[float(np.float32(x)) for x in v] for v in r.normal(size=(300, 12)) @ mix]
    rows = [*enumerate(vectors), (5, vectors[5]), (5, vectors[5]), (None, vectors[6]), (400, None), (401, []), (402, [*vectors[0][:-1], None]), (403, [float("nan"), *vectors[0][1:]]), (404, [float("inf"), *vectors[0][1:]]), (405, [-3e3, *vectors[0][1:]]), (None, vectors[9])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, vector string, n int").repartition(5)
    found = whitening.finite_vectors(table)
    fit = whitening.fitted(found)
    check_whitening(whitening.whitened(found, fit, whitening.identity_error(found, fit)).collect(), rows)


def test_whitening_products_are_exact():
    r = np.random.default_rng(4)
    for top in (5, 1 << 12, 1 << 40, 1 << 61):
        x = r.integers(-top, top, (50, 4))
        got = sum(m.astype(object) * (1 << whitening.LIMB * p) for p, m in enumerate(whitening.limb_products(x)))
        assert (got == x.astype(object).T @ x.astype(object)).all()
    assert whitening.integers(np.array([1e300, -1e300, 0.5])).tolist() == [1 << 62, -(1 << 62), 100512]
    y = r.integers(-(1 << 61), 1 << 61, (5, 3))
    assert whitening._deviations(y) == [sum(int(c) ** 2 for c in row) for row in y]


def test_whitening_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    own = lambda rows: whitening.finite_vectors(spark.createDataFrame(rows, schema))
    run = lambda v: whitening.whitened(v, f := whitening.fitted(v), whitening.identity_error(v, f) if f else None).collect()
    assert run(own([])) == [] and run(own([(1, None), (2, [])])) == []
    same = run(own([(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same, key=lambda r: (r.vec_id, r.component))] == [(i, c, 2, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = run(own([(i, [float(i), 2.0 * i]) for i in range(9)] + [(99, [1.0])]))  # rank 1, and a vector of another length
    assert {r.vec_id for r in line} == set(range(9)) and {r.whitened is None for r in line if r.component == 2} == {True}
    assert max(r.identity_error for r in line) < 1e-9
    huge = run(own([(i, [1e30 * (-1) ** i, float(i)]) for i in range(4)]))
    assert {r.deviation for r in huge} == {None} and all(int(r.deviation_digits) > 1 << 120 for r in huge)


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.QUERIES["op11_digit_slice_whitening"](spark, SF).collect(), rows)


# 12
def brute_licences(text):
    """Base columns by comparing every place with every phrase."""
    words = WORD.findall((text or "").translate(NARROW))
    places = []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    own = [k for k, _ in places]
    return len(words), len(places), min(own, default=None), max(own, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    """All labels of notices and tags, by places of phrases and a recursive reading of expressions."""
    words = WORD.findall((text or "").translate(NARROW))
    hits = []
    for table, kind in ((licences.BASE, "base"), (licences.NOTICES, "notice"), (dict.fromkeys(licences.TAGS), "tag")):
        for phrase, label in table.items():
            p = phrase.split()
            hits += [(k, k + len(p), kind, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    out = {h[3] for h in hits if h[2] == "base"}
    for a, b, kind, label in hits:
        if kind == "notice" and not any(x <= a and b <= y and (x, y) != (a, b) for x, y, *_ in hits):
            out.add(label)
    return out


def test_licences_by_brute_force(spark):
    texts = [
        None, "", " \n", "Released under the MIT License.", "under the mit license under the MIT license, CC-BY-NC cc by nc sa", "É under the mit licenseé under the mit license", "apache license, version 2 apache license version 2.0", "GNU Lesser General Public License, version 2.1",
        "x" * 5000 + " cc by nc " + "word " * 30000 + "Apache License Version 2", "日本 CC BY-NC 日本", "Mozilla Public License, v. 2.0. All rights reserved.", "mit license mit", "Licensed under the Apache License, Version 2.0 (the ...)",
    ]
    rows = [(i, t, "k", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "k", 1.0), (None, texts[4], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").repartition(3)
    got = licences.summarised(licences.scanned(docs)).collect()
    want = Counter((i, *brute_licences(t), ",".join(sorted(brute_labels(t)))) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got) == want
    assert all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id in (0, 1, 2)} == {0.5}
    assert licences.summarised(licences.scanned(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


@pytest.mark.parametrize(
    "line, expression, labels, score",
    [
        ("SPDX-License-Identifier: MIT", "MIT", "mit", 1.0),
        ("# SPDX-License-Identifier: GPL-2.0-only OR MIT AND BSD-3-Clause\nApache", "GPL-2.0-only OR MIT AND BSD-3-Clause", "bsd-3-clause,gpl-2.0,mit", 1.0),
        ("// spdx-license-identifier: (GPL-2.0+ or MIT) and Apache-2.0 */", "(GPL-2.0+ OR MIT) AND Apache-2.0", "apache-2,gpl-2.0,mit", 1.0),
        ("SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1 AND MIT", "GPL-3.0-or-later WITH GCC-exception-3.1 AND MIT", "gpl-3.0,mit", 0.6),
        ("SPDX-License-Identifier: MIT AND (LGPL-2.1 OR", "MIT", "mit", 1.0),
        ('license expression = "AGPL-3.0 AND Odd-1.0"', "AGPL-3.0 AND Odd-1.0", "agpl-3.0,odd-1.0", 0.3),
        ("SPDX-License-Identifier: )", None, "", 0.5),
        ("SPDX-License-Identifier:\nMIT", None, "", 0.5),
        ("the license identifier is here", None, "", 0.5),
    ],
)
def test_licence_expressions(spark, line, expression, labels, score):
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    (row,) = licences.summarised(licences.scanned(docs)).collect()
    assert row.expressions == ([expression] if expression else []) and row.labels == labels and math.isclose(row.score, score)


def test_licence_spans_and_permission(spark):
    text = "Éa. Released under the MIT License;\n// SPDX-License-Identifier: MIT OR (ISC AND Zlib) "
    (row,) = licences.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(f.kind, text[f.start : f.stop]) for f in row.findings] == [("base", "under the MIT License"), ("tag", "SPDX-License-Identifier: MIT OR (ISC AND Zlib)")]
    allowed = {"mit", "gpl-2.0"}
    said = ["MIT", "ISC", "ISC OR MIT", "ISC AND MIT", "(ISC AND MIT) OR GPL-2.0+", "ISC OR (ISC AND MIT OR ISC)", "ISC WITH own-exception", "ISC WITH other", "MIT OR", "", "((MIT))"]
    assert [licences.permitted(x, allowed, {"own-exception"}) for x in said] == [True, False, True, False, True, False, True, False, None, None, True]


def test_licence_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_licence_scan"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *brute_licences(t)) for i, t in rows)
    assert any(r.labels != r.base_labels for r in got)


# 13
def brute_resampling(docs, target, depth=1, buckets=10000, share=10, least=20):
    def features(text):
        words = WORD.findall((text or "").translate(NARROW))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, depth + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = fit[: share * len(fit) // 100]
    return Counter(r for r in rows), [(k + 1, r) for k, r in enumerate(drawn)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_resampling_by_brute_force(spark, depth):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdé"), 3)) for _ in range(60)] + ["A-b", "日本", "Q9"]
    texts = [" ".join(r.choice(words, r.integers(1, 90))) for _ in range(120)] + [None, "", "., \n", "one", "\xff \x00 x"] + ["same words here " * 9] * 5
    docs = list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (None, texts[3]), (None, texts[4]), (None, texts[4])]
    target = [" ".join(r.choice(words[:20], 30)) for _ in range(15)] + [None, ""]
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, n_words int").repartition(6)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = target_resampling.ranked(target_resampling.scored(table, goal, depth), share=40).collect()
    want, drawn = brute_resampling(docs, target, depth, share=40)
    assert Counter((x.doc_id, x.n_words, x.n_features, x.weight, x.score) for x in got) == want
    assert sorted((x["rank"], (x.doc_id, x.n_words, x.n_features, x.weight, x.score)) for x in got if x["rank"]) == drawn
    rows = target_resampling.drawn(table, goal, depth, share=40)
    assert rows.columns == ["doc_id", "text", "rank", "n_words", "resampling_rank"]
    assert sorted((x.resampling_rank, x.doc_id) for x in rows.collect()) == [(k, x[0]) for k, x in drawn]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert target_resampling.ranked(target_resampling.scored(none, none)).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = target_resampling.ranked(target_resampling.scored(one, none), least=1, share=100).collect()
    want, drawn = brute_resampling([(1, "a b")], [], least=1, share=100)
    assert Counter((x.doc_id, x.n_words, x.n_features, x.weight, x.score) for x in got) == want and [x["rank"] for x in got] == [1]


def test_suffixes_are_in_order():
    ids, ends, words = target_resampling.word_ids(["b a b a", "", None, "a b a", "b"])
    order, shared = target_resampling.suffix_order(ids, 4)
    own = [tuple(ids[p : min(p + 4, ends[np.searchsorted(ends, p)])]) for p in order]
    assert own == sorted(own) and words == [b"b", b"a"]
    for k in range(1, len(own)):
        assert shared[k] == next((i for i, (a, b) in enumerate(zip(own[k - 1], own[k])) if a != b), min(len(own[k - 1]), len(own[k])))


def test_resampling_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES["op13_importance_resampling"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLES["op13_importance_resampling"]).fetchall())


# 5 and 6, their bounds
def test_sample_skips_only_what_does_not_fit(spark, monkeypatch):
    """A text over the bound, wherever its hash comes, leaves the others in."""
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, share: seen.update(texts=texts, labels=labels, share=share))
    texts = [f"text {i} " * 3 for i in range(60)]
    texts[20] = texts[41] = "x" * 5000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    toxicity.fitted(docs, labels, sample_bytes=2000)
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and i not in (20, 41)]
    assert len(seen["texts"]) == len(kept) and sorted(seen["labels"]) == sorted(i % 2 for i in kept) and max(map(len, seen["texts"])) < 100
    toxicity.fitted(docs, labels, sample_bytes=100)
    assert set(seen["labels"]) == {0, 1} and all(sum(len(t) for t, y in zip(seen["texts"], seen["labels"]) if y == k) <= 100 for k in (0, 1))


def test_ranges_part_one_doc_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_ROWS", 6)
    docs = spark.createDataFrame([(None, f"word{i} " * 5) for i in range(80)] + [(7, f"other{i}") for i in range(40)] + [(8, None)], "doc_id long, text string")
    files = token_files.token_blocks(docs)
    assert files.select("part").distinct().count() > 10
    rows = token_files.read_blocks(files).collect()
    assert len(rows) == 121 and sorted(r.start for r in rows)[0] == 0
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None] * 80 + [7] * 40 + [8]
