"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from chronolith.llm import exact_dedup, near_dedup, surrogates

SF = "/root/testdata/sf0.001"


def test_stages(spark, monkeypatch):
    from tests.llm.test_operators import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() <= len(rows)
    single = stages["exact_dedup"](spark, docs, SF).cache()
    newest: dict[str, int] = {}
    for r in rows:
        newest[r[1] or ""] = max(newest.get(r[1] or "", -1), r[0])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(newest.values())
    apart = stages["near_dedup"](spark, single, SF)
    left = [tuple(r) for r in single.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(d for d, _, _, k in brute_classes(left, 5, 80) if k)
    safe = stages["pii"](spark, docs, SF)
    cipher = surrogates.Cipher(surrogates.PUBLIC_KEY)
    assert Counter((r.doc_id, r.text) for r in safe.collect()) == Counter((r[0], surrogates.replace(r[1], cipher)[0]) for r in rows)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and near_dedup.BANDS == 20
    for p in pieces:
        assert 0 < p.length <= 1024


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (None, "b", "z"), (None, "b", "z"), (None, "a", "z"), (3, None, "x"), (3, "", "x"), (4, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, SF)
    assert one.columns == docs.columns
    assert Counter((r.doc_id, r.text or "", r.source) for r in one.collect()) == Counter([(2, "a", "y"), (None, "b", "z"), (3, "", "x"), (4, "c", "x")])
    index = exact_dedup.fresh_index(spark)
    index.add(docs)
    assert exact_dedup.deduplicated(docs, index, single=True).count() == 0


def test_near_copies_under_repeated_ids(spark):
    first, second = ([f"{x}{i}" for i in range(100)] for x in "ab")
    texts = [(1, first), (2, second), (3, [*first, "tail"]), (3, [*second, "tail"]), (4, [*second, "end"]), (2, ["other", *"xyz"]), (4, ["alone", *"xyz"]), (None, first)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3)
    apart = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert apart.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in apart.collect()) == Counter((i, " ".join(t)) for i, t in [texts[0], texts[1], texts[5], texts[6], texts[7]])
