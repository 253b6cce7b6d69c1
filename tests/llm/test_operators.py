"""Each operator against brute force on a small table with nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronolith.llm import exact_dedup, html_text, near_dedup, packing, quality_rules, queries, repeated_text, sampled_pieces, surrogates, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, rid int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer(file: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(file))


def make_rows() -> list[tuple]:
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    texts: list[str | None] = [text(r.randint(1, 300)) for _ in range(25)]
    base = text(200)
    texts += [None, "", " \n\t ", base, base, base.replace(" ", "  "), base + " tail", text(6000), "a", "a b", "A B"]
    for _ in range(6):
        words = base.split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = text(60)
    texts += [text(20) + " " + passage + " " + text(30), passage, passage[5:] + "é" * 120, "é" * 300, "Ther " * 300, "ab\x1cc don't, I'M. <|endoftext|> 日本 🎉\n\nx", "a<|endoftext|><|startoftext|>B <|ENDOFTEXT|> <|end é<|endoftext|>\u0301x"]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "k", "d", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base, None, None, None, None, None, None), (None, "only null id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is not None, v) if not isinstance(v, float) else (True, v) for v in x)


# 1
def test_packing(docs, rows, empty):
    got = packing.packed(docs, 64).collect()
    t = tokenizer("byte_bpe_50k.json")
    expected = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x, *_ in rows)
    by_sequence = defaultdict(list)
    for p in got:
        by_sequence[p.sequence_id].append(p)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= 64 and at & (at - 1) == 0
    assert sum(p.length for p in got) == sum(len(i) * n for (_, i), n in expected.items())
    allowed = defaultdict(list)
    for (d, i), _ in expected.items():
        allowed[d].append(i)
    for p in got:
        assert any(p.doc_tokens == len(i) and zlib.crc32(np.array(i[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for i in allowed[p.doc_id])
    assert packing.packed(empty).count() == 0


def test_hilbert_neighbours():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_rank_file_gives_the_tokenizers_ids(rows):
    t, fast = tokenizer("byte_bpe_50k.json"), packing.byte_bpe("byte_bpe_50k.tiktoken")
    for _, x, *_ in rows:
        assert packing.ids_of(fast, x or "") == t.encode(x or "", add_special_tokens=False).ids


# 2
def test_exact_dedup(spark, docs, rows, empty):
    index = exact_dedup.fresh_index(spark)
    index.add(docs)
    got = sorted((tuple(r) for r in index.members(docs).collect()), key=key)
    groups = defaultdict(list)
    for d, x, *_ in rows:
        groups[x or ""].append(d)
    best = {x: max((d for d in ids if d is not None), default=None) for x, ids in groups.items()}
    expected = sorted(((d, best[x or ""], len(groups[x or ""]), d == best[x or ""], hashlib.sha256((x or "").encode()).hexdigest()) for d, x, *_ in rows), key=key)
    assert got == expected
    again = spark.createDataFrame([(900, rows[0][1], None, None, None, None, None, None), (901, "new", None, None, None, None, None, None)], SCHEMA)
    index.add(again)
    assert {r.doc_id: r.keep_id for r in index.members(again).collect()} == {900: best[rows[0][1]], 901: 901}
    assert index.rows().groupBy("digest").count().where("count > 1").count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, x, *_ in rows if d == best[x or ""])
    assert exact_dedup.deduplicated(empty).count() == 0
    clash = docs.withColumnsRenamed({"key": "__own", "digest": "digest", "source": "__row", "lang": "__one"})
    for single in (False, True):
        assert sorted(exact_dedup.deduplicated(clash, single=single).columns) == sorted(clash.columns)


@pytest.mark.parametrize("forgotten", [False, True])
def test_digest_index_persists(spark, tmp_path, forgotten):
    name = f"kept_index_{int(forgotten)}"
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.DigestIndex(spark, name, 3, f"file://{tmp_path}/index").add(batch((1, "a"), (2, "a"), (3, "b")))
    if forgotten:  # as in a later driver run without a shared catalog
        spark.sql(f"DROP TABLE {name}")
    again = exact_dedup.DigestIndex(spark, name, None, f"file://{tmp_path}/index")
    assert again.buckets == 3 and again.rows().count() == 2
    new = batch((8, "a"), (9, "c"))
    assert [r.doc_id for r in exact_dedup.deduplicated(new, again).collect()] == [9]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.DigestIndex(spark, name).members(new).collect()) == [(8, 2, 3, False), (9, 9, 1, True)]
    assert again.rows().groupBy("digest").count().where("count > 1").count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_blocks_meet_the_index(spark, docs, rows):
    parts = exact_dedup.in_blocks(docs, 3)
    assert sorted((r.doc_id or -1 for p in parts for r in p.collect())) == sorted(d or -1 for d, *_ in rows)
    assert all(min(r.doc_id for r in a.collect()) > max(r.doc_id for r in b.collect() if r.doc_id is not None) for a, b in zip(parts, parts[1:]))
    whole, index = exact_dedup.fresh_index(spark), exact_dedup.fresh_index(spark)
    whole.add(docs)
    for p in parts:
        index.add(p)
    everything = lambda i: sorted((tuple(r) for r in i.members(docs).collect()), key=key)
    assert everything(index) == everything(whole)
    plan = docs.select(exact_dedup.digest_of().alias("digest")).distinct().join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1  # none on the index's side


# 3
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a>b">Home</a><li><a href='#'>News</a></ul></nav><div class="cookie-notice">We use cookies, a lot of them, on this site.</div>
<article><h1>Head&nbsp;line &amp; more</h1><p>One <b>bold</b>
 word<p>Short.<div class="ad">Buy this now, it is cheap and good.</div><p>Tail &#233;&lt;p&gt;<script>var x="</p>"</script> end</article>
<section id=comments><p>First comment is here and it is long enough to count as text.</p></section><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    expected = "Head line & more\nOne bold word\nShort.\nTail é<p> end"
    assert html_text.main_text(PAGE) == expected
    plain = "<div id=menu><a href=x>Home</a></div><div><h1>Name of it</h1><p>" + "long text here " * 20 + "<p>short.<p>" + "more words " * 12 + "</div><div class=comments><p>" + "bla " * 50 + "</div><p>foot</p>"
    assert html_text.main_text(plain).split("\n")[0] == "Name of it" and "bla" not in html_text.main_text(plain) and "foot" not in html_text.main_text(plain)
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (None, "u", "<p>", "x")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extracted(pages).collect()))
    assert got == [(0, "", 0), (1, expected, len(expected)), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert html_text.extracted(pages.limit(0)).count() == 0


def windows_by_brute_force(lines, marked, window=3):
    """Kept lines by sums over every run of lines: level, dives and surges looked up one position at a time."""
    n = len(lines)
    best, level = 0, 0.0
    for s in range(n):
        run = [lines[i] for i in range(s, min(s + window, n))]
        if sum(x[1] for x in run) > best:
            best = sum(x[1] for x in run)
            level = best / sum(len(x[0]) for x in run if x[1])
    keep = [i for i in range(n) if lines[i][1] and lines[i][1] / len(lines[i][0]) >= level / 16]
    if not keep:
        return []
    parts = [[keep[0]]]
    for before, i in zip(keep, keep[1:]):
        gap, shallow = i - before - 1, min(lines[j][2] for j in parts[-1])
        ends = lines[i][3] != lines[before][3] or not lines[i][3] and (gap >= window or gap > 0 and lines[i][2] < shallow)
        if ends:
            parts.append([])
        parts[-1].append(i)
    sums = [max(sum(lines[j][1] for j in own if s <= j < s + window) for s in range(own[0], own[-1] + 1)) for own in parts]
    top = max(sums)
    text = []
    for own, most in zip(parts, sums):
        in_article = lines[own[0]][3]
        if in_article or (most >= 80 * 64 or 8 * most >= top) and (not marked or 4 * most >= top):
            text += [lines[i][0] for i in own]
    return text


def test_html_windows_decide(spark):
    r = random.Random(5)
    tags = ["<p>{}</p>", "<div>{}</div>", "<div class=ad>{}</div>", "<nav>{}</nav>", "<p><a href=x>{}</a></p>", "<article><p>{}</p></article>", "<div><p>{}</p><p>{}</p></div>", "<footer>{}</footer>", "<main><p>{}</p><div class=ad>{}</div><p>{}</p></main>"]
    text = lambda: "word " * r.choice([1, 3, 8, 20, 60])
    pages = ["".join(t.format(*[text() for _ in range(t.count("{}"))]) for t in r.choices(tags, k=r.randint(1, 14))) for _ in range(400)]
    real = [x.html for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    without = 0
    for page in pages + real:
        lines, marked = html_text.lines_of(page, 3)
        assert html_text.main_text(page) == "\n".join(windows_by_brute_force(lines, marked))
        without += html_text.main_text(page) != "\n".join(x[0] for x in lines if x[1])
    assert without > 250
    for page in real:  # adverts weigh something everywhere: only the level that windows set drops them
        lines, _ = html_text.lines_of(page, 3)
        assert html_text.main_text(page) != "\n".join(x[0] for x in lines if x[1])


def test_html_weights_apart():
    """Lines whose weights are known as the page is made, and the text that windows over those give."""
    r = random.Random(8)
    kinds = {  # kind: (markup of a line, weight of a code point, depth, whether in the article)
        "menu": ("<nav>{}</nav>", 0, 0, False),
        "advert": ("<div class=ad>{}</div>", 1, 1, False),
        "link": ("<p><a href=x>{}</a></p>", 0, 0, False),
        "aside": ("<p>{}</p>", 64, 0, False),
        "text": ("<p>{}</p>", 256, 1, True),
        "advert inside": ("<div class=ad>{}</div>", 1, 2, True),
        "menu inside": ("<nav>{}</nav>", 0, 1, True),
    }
    around, within = ["menu", "advert", "link", "aside"], ["text", "text", "text", "advert inside", "menu inside"]
    for _ in range(300):
        order = [r.choices(around, k=r.randint(0, 5)), ["text", *r.choices(within, k=r.randint(0, 8))], r.choices(around, k=r.randint(0, 5))]
        texts = [[" ".join(["word"] * r.choice([1, 3, 8, 20, 60])) for _ in part] for part in order]
        before, article, after = ("".join(kinds[k][0].format(t) for k, t in zip(ks, ts)) for ks, ts in zip(order, texts))
        lines = [(t, kinds[k][1] * len(t), kinds[k][2], kinds[k][3]) for ks, ts in zip(order, texts) for k, t in zip(ks, ts)]
        page = f"<body>{before}<article>{article}</article>{after}</body>"
        got, marked = html_text.lines_of(page)
        assert marked and got == lines
        assert html_text.main_text(page) == "\n".join(windows_by_brute_force(lines, True))


def test_html_level_by_hand():
    """Windows keep what markup hints at where it is the page's text, and drop it where other text is heavier."""
    body, more = "long text here " * 20, "other words " * 30
    for page in (f"<div class=ad>Buy this, it is cheap.</div><article><p>{body}</p></article>", f"<div class=ad>Buy this, it is cheap.</div><div><p>{body}</p></div>"):
        assert html_text.main_text(page) == body.strip()
    # half named and half not: the heaviest window is the plain one
    assert html_text.main_text(f"<div class=promo><p>{body}</p></div><div><p>{more}</p></div>") == more.strip()
    # most of the text has a name of furniture: a wrapper
    assert html_text.main_text(f"<div class=promo><p>{body}</p><p>{body}</p></div><nav>Menu</nav>").split("\n") == [body.strip()] * 2
    # names on every part, none of which holds most of the text: the level sinks to theirs
    parts = "".join(f"<div class=promo><p>{body}</p></div>" for _ in range(3))
    assert html_text.main_text(parts + "<footer>foot</footer>").split("\n") == [body.strip()] * 3


def test_html_ablation():
    """Without windows short lines apart from the text would stay beside articles; inside them nothing is lost."""
    body, noise = "long text here " * 20, "<div class=ad>Buy</div>" * 3
    for page in (f"<div><p>{body}</p></div>{noise}<div><p>Print me</p></div>", f"<article><p>{body}</p></article><div>A word on us, of forty code points or so.</div>"):
        lines, _ = html_text.lines_of(page, 3)
        assert html_text.main_text(page) == body.strip() and sum(1 for x in lines if x[1] > len(x[0])) == 2
    for close in ("A closing paragraph of its own.", "Bye."):
        assert html_text.main_text(f"<article><p>{body}</p>{noise}<p>{close}</p></article>").split("\n") == [body.strip(), close]
    page = f"<article><p>{body}</p><ins class='adsbygoogle'>Buy</ins><div class='share-price'><p>It costs ten.</p></div><div class='share-buttons'>Send it</div><div class='related-reading'>Read also</div><p>End.</p></article>"
    assert html_text.main_text(page).split("\n") == [body.strip(), "It costs ten.", "End."]


def test_html_short_text():
    assert html_text.main_text("<h1>Name</h1><p>By me</p><p>All of it.</p>") == "Name\nBy me\nAll of it."
    close = "A closing paragraph that is shorter than what a surge needs."
    for inline in ("<div class=ad>Buy</div>", "<p><a href=x>More of this</a></p>", "<div class=notice>Note</div><p><a href=x>Link</a></p>"):
        page = "<div><h1>Name</h1><p>By me</p><p>Today</p><p>" + "long text here " * 20 + f"</p>{inline}<p>{close}</p></div><footer>foot</footer>"
        assert html_text.main_text(page).split("\n") == ["Name", "By me", "Today", ("long text here " * 20).strip(), close]


def test_html_wrappers_and_raw_elements():
    body = "long text here " * 20
    for wrapper in ("div class='content with-sidebar'", "div id=page-banner-wrap", "div class=commentary", "form id=all"):
        for inner in (f"<article><p>{body}</p></article>", f"<p>{body}</p>", f"<main><p>{body}</p></main><div class=sidebar><p>{'side ' * 30}</p></div>"):
            assert html_text.main_text(f"<body><{wrapper}>{inner}</{wrapper.split()[0]}><footer>foot</footer>") == body.strip()
    comments = f"<div class=comments><article><p>{'bla ' * 9}</p></article><article><p>{'bla ' * 9}</p></article></div>"
    assert html_text.main_text(f"<article><p>{body}</p></article>{comments}") == body.strip()
    for tag in ("object", "video", "svg", "select", "canvas"):
        assert html_text.main_text(f"<article><p>One<div><{tag} x=y></div><p>{body}<{tag}>none</{tag}></article>") == "One\n" + body.strip()
    assert html_text.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</article>") == "So x=2 holds."
    assert html_text.main_text("<article><p>One<script>var x = 1<p>two</article>") == "One"


def test_html_links_in_articles():
    menu = "<ul>" + "".join(f"<li><a href={i}>Item {i}</a>" for i in range(4)) + "</ul>"
    page = f"<main>{menu}<h1><a href=x>Name</a></h1><p>First of it.<p><a href=x>The source of this</a><p>Second.<p><a href=1>Share</a> <a href=2>Send</a></p></main>"
    assert html_text.main_text(page).split("\n") == ["Name", "First of it.", "The source of this", "Second."]
    assert html_text.main_text(f"<article>{menu}</article>").split("\n") == [f"Item {i}" for i in range(4)]
    long = "long text here " * 20
    assert html_text.main_text(f"<!-- <article> --><div>{long}</div><nav>a<p>b<p>c</nav><p>foot") == long.strip()


# 4
def brute_statistics(text: str) -> tuple[int, ...]:
    w = WORD.findall(text)
    seen, windows = set(), Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality(spark, docs, rows, empty):
    rules = quality_rules.learn(np.random.default_rng(0).random((600, 10)), np.zeros(600, bool))
    assert rules == []
    x = np.random.default_rng(0).random((2000, len(quality_rules.FEATURES)))
    bad = ((x[:, 0] > 0.8) & (x[:, 3] <= 0.5)) | (x[:, 5] > 0.95)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, x)
    assert (hit == bad).mean() > 0.97
    got = sorted((tuple(r) for r in quality_rules.judged(docs, []).collect()), key=key)
    expected = []
    for d, t, *_ in rows:
        s = brute_statistics(t or "")
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        expected.append((d, *s, failed, not failed))
    assert got == sorted(expected, key=key)
    own = quality_rules.judged(docs, [(quality_rules.Test(8, True, 0.0),)])
    assert own.where("kept").count() == 0
    assert quality_rules.judged(empty, []).count() == 0
    assert quality_rules.fitted(docs, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_quality_verdict_by_brute_force(spark):
    """Rules of the real labels: the conditional expression against plain loops, and their worth on labels that they haven't seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rules = quality_rules.fitted(docs, seen.unionByName(seen))
    assert rules and rules == quality_rules.fitted(docs, seen)
    marked = docs.join(unseen.select("doc_id", "quality"), "doc_id")
    counts = {r.doc_id: r for r in quality_rules.statistics(marked.select("doc_id", "text")).collect()}
    quality = {r.doc_id: r.quality for r in unseen.collect()}
    right = 0
    for r in quality_rules.judged(marked.select("doc_id", "text"), rules).collect():
        c = counts[r.doc_id]
        bad = c.n_words < 20 or 100 * c.n_repeat_words > 30 * c.n_words
        for rule in rules:
            values = [c[quality_rules.FEATURES[t.feature][1]] / max(c[quality_rules.FEATURES[t.feature][2]], 1) for t in rule]
            bad = bad or all(v > t.threshold if t.above else v <= t.threshold for v, t in zip(values, rule))
        assert r.kept == (not bad)
        right += int(r.kept) == quality[r.doc_id]
    assert right / len(quality) > max(sum(quality.values()) / len(quality), 0.8)


# 5
@pytest.mark.parametrize("top", [1, 2, 60, 50_000, 1 << 31])
def test_simple8b_round_trip(top):
    r = np.random.default_rng(top)
    for n in (0, 1, 59, 240, 241, 5000):
        values = r.integers(0, top, n).astype(np.uint32)
        values[: n // 3] = 0
        words, escapes, _ = token_files.simple8b(values)
        assert (token_files.from_simple8b(words, escapes, n) == values).all()
        payload = token_files.block([1], [values])
        assert (token_files.from_block(payload)[1][0] == values).all()
        assert (token_files.block_slice(payload, n // 4, n // 2) == values[n // 4 : n // 2]).all()


def test_token_files(docs, rows, empty):
    got = sorted((tuple(r) for r in token_files.read_blocks(token_files.token_blocks(docs)).collect()), key=lambda x: x[1])
    t = tokenizer("word_bpe_49k.json")
    ids = {(d, x): np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for d, x, *_ in rows}
    assert [(d is not None, d) for d, *_ in got] == sorted((d is not None, d) for d, *_ in rows)
    at = 0
    for d, start, n, crc in got:
        assert start == at and any(n == len(i) and crc == zlib.crc32(i.tobytes()) for (e, _), i in ids.items() if e == d)
        at += n
    assert token_files.read_blocks(token_files.token_blocks(empty)).count() == 0


# 6
def test_toxicity_gradients():
    net = toxicity.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    slots, bounds = toxicity.word_slots(["alpha beta gamma delta " * 20, "one two", ""])
    first, count, text = toxicity.window_starts(bounds)
    index, target = toxicity._index(first, count), (text % 2).astype(float)
    _, grads = net.gradients(slots, index, count, target)
    for k, g in grads.items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, losses = net.w[k][i], []
        for e in (0.01, -0.01):
            net.w[k][i] = kept + e
            losses.append(net.gradients(slots, index, count, target)[0])
        net.w[k][i] = kept
        assert abs((losses[0] - losses[1]) / 0.02 - g[i]) < 1e-4


def test_toxicity_scores_by_brute_force():
    """The scorer against plain loops: a step at a time, a window at a time."""
    net = toxicity.Network()
    texts = ["alpha beta gamma " * 30, "one", "", "a b c d e f g " * 8]
    net.w = {k: v + 0.05 * np.random.default_rng(len(k)).standard_normal(v.shape).astype(v.dtype) for k, v in net.w.items()}
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def window_logit(x):
        sides = []
        for d in (0, 1):
            state, seen = np.zeros(h), []
            for row in x[:: 1 if d == 0 else -1]:
                g, u = row @ net.w["in"][d] + net.w["bias"][d][0], state @ net.w["re"][d]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                c = np.tanh(g[2 * h :] + r * u[2 * h :])
                state = c + z * (state - c)
                seen.append(state)
            sides.append(seen if d == 0 else seen[::-1])
        both = np.array([np.concatenate(p) for p in zip(*sides)])
        e = np.exp(np.tanh(both @ net.w["att"]) @ net.w["pick"])
        return (e / e.sum()) @ both @ net.w["out"] + net.w["shift"][0]

    for text, got in zip(texts, net.logits(texts)):
        slots, bounds = toxicity.word_slots([text])
        x = net.words(slots) if len(slots) else np.zeros((0, 2 * toxicity.WIDTH))
        first, count, _ = toxicity.window_starts(bounds)
        assert abs(max([window_logit(x[a : a + n]) if n else net.w["shift"][0] for a, n in zip(first, count)]) - got) < 1e-4
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-5)  # no text depends on its neighbours
    assert np.allclose(net.scores(texts * 3)[:4], together, atol=1e-5) and ((0 <= together) & (together <= 1)).all()


def test_toxicity_windows_cover_every_word():
    _, bounds = toxicity.word_slots(["w " * n for n in (0, 1, 47, 48, 49, 200)])
    first, count, text = toxicity.window_starts(bounds)
    for i in range(6):
        own = {w for a, c, t in zip(first, count, text) if t == i for w in range(a, a + c)}
        assert own == set(range(bounds[i], bounds[i + 1])) and (text == i).any()


def test_toxicity_learns(spark, docs, rows, empty):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    make = lambda bad: " ".join([*r.choices(words, k=60), *["nastyword"] * bad, *r.choices(words, k=60)])
    labels = [i % 4 == 0 for i in range(400)]
    net = toxicity.train([make(b) for b in labels], [int(b) for b in labels])
    check = [i % 2 == 0 for i in range(60)]
    assert ((net.scores([make(b) for b in check]) >= 0.5) == np.array(check)).mean() > 0.9
    got = toxicity.scored(docs, net).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, *_ in rows)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    kept = toxicity.clean(docs, net)
    assert kept.columns == docs.columns and Counter(x.doc_id for x in kept.collect()) == Counter(x.doc_id for x in got if not x.predicted)
    assert toxicity.scored(empty, net).count() == 0
    assert toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int")).constant == 0.0


# 7
def brute_classes(rows, width, percent):
    sets = []
    for d, x, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = {d: d for d, *_ in rows if d is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, *_), s in zip(rows, sets)), key=key)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, rows, width, percent):
    got = sorted((tuple(r) for r in near_dedup.classes(docs, width, percent).collect()), key=key)
    assert got == brute_classes(rows, width, percent)


def test_near_dedup_large_buckets(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    assert sorted((tuple(r) for r in near_dedup.classes(docs).collect()), key=key) == brute_classes(rows, 3, 85)
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, _, k in brute_classes(rows, 5, 80) if k)
    assert near_dedup.classes(empty).count() == 0


def test_near_dedup_of_clashing_ids(spark):
    r = random.Random(8)
    a, b = (["".join(r.choices("abcdef", k=6)) for _ in range(100)] for _ in "ab")
    texts = [(1, a), (1, b), (7, [*b, "tail"]), (8, [*a, "tail"]), (9, [*b, "end"]), (9, ["other", "words"]), (9, ["other", "words"]), (None, a)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in near_dedup.classes(docs).collect()), key=key)
    size = lambda t: max(1, len(t) - 2)
    expected = [1, 1, 1, 1, 1, 9, 9, None]
    assert got == sorted(((i, size(t), c, i is None or i == c) for (i, t), c in zip(texts, expected)), key=key)


def test_bit_estimate():
    r = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        shared, other = r.integers(0, 1 << 63, 700, dtype=np.uint64), r.integers(0, 1 << 63, 100, dtype=np.uint64)
        bits = [np.frombuffer(near_dedup.packed_bits(near_dedup.minima(np.unique(x))), np.uint64) for x in (shared, np.concatenate([shared, other]))]
        errors.append(near_dedup.estimates(bits[0], bits[1][None])[0] - 7 / 8)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# 8
def test_surrogates(docs, rows, empty):
    c = surrogates.Cipher(b"test")
    assert len({surrogates.surrogate(c, "phone", f"+1 (017) 555-{i:04d}") for i in range(3000)}) == 3000
    assert len({c.within("x", i, 37) for i in range(37)}) == 37
    card = surrogates.surrogate(c, "card", "4111 1111 1111 1111")
    digits = [int(x) for x in card if x.isdigit()]
    assert re.fullmatch(r"\d{4}( \d{4}){3}", card) and surrogates._luhn(digits[:-1]) == digits[-1]
    assert surrogates.surrogate(c, "ip", "192.168.1.2").startswith("192.168.")
    iban = surrogates.surrogate(c, "iban", "DE89 3704 0044 0532 0130 00").replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert surrogates._GENDER[surrogates.surrogate(c, "name", "Maria Lopez").split()[0]] == ("f", "latin")
    assert surrogates._GENDER[surrogates.surrogate(c, "name", "Иван Петров").split()[0]] == ("m", "cyrillic")
    text = 'Mail ab.1@x.example.com or AB.1@X.EXAMPLE.COM, call +1 (017) 555-7713, from 97.51.17.173. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"### 4111111111111111 Mrs Novak. GPL 3.0, CC BY-NC 4.0.'
    new, found = surrogates.replace(text, c)
    assert [k for *_, k in found] == ["email", "email", "phone", "ip", "secret", "card", "name"] and len(new) == len(text)
    for a, b, _ in found:
        assert text[a:b] not in new
    emails = re.findall(r"\S+@\S+\.(?:com|COM)", new)
    assert emails[0].lower() == emails[1].lower() and new.endswith("GPL 3.0, CC BY-NC 4.0.")
    got = surrogates.replaced(docs, b"test").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, x) for d, x, *_ in rows)
    out = surrogates.anonymised(docs, b"test")
    assert out.columns == docs.columns and Counter((r.doc_id, r.n_chars) for r in out.collect()) == Counter((r[0], r[4]) for r in rows)
    assert surrogates.replaced(empty, b"test").count() == 0


def test_surrogates_corefer():
    c = surrogates.Cipher(b"test")
    digits = lambda x: "".join(d for d in x if d.isdigit())
    new = [surrogates.replace(x, c)[0] for x in ("+1 (017) 555-7713", "+10175557713", "+1-017-555-7713", "(017) 555-7713", "017-555-7713")]
    assert digits(new[0]) == digits(new[1]) == digits(new[2]) == "1" + digits(new[3]) == "1" + digits(new[4]) and digits(new[0]) != "10175557713"
    london = [surrogates.replace(x, c)[0] for x in ("+44 (0)20 7946 0958", "+442079460958", "+44 20 7946 0958")]
    assert london[0].startswith("+44 (0)") and digits(london[0].replace("(0)", "")) == digits(london[1]) == digits(london[2]) and digits(london[1])[:2] == "44"
    new, found = surrogates.replace("Dr. Novak came. Novak said that NOVAK's case, and Maria Lopez and Lopez, were done. So said Maria. No Novakia here; will Mr Will will it, will he? Will.", c)
    name = surrogates.surrogate(c, "name", "Novak")
    given, other = surrogates.surrogate(c, "name", "Maria Lopez").split()
    assert name != "Novak" and f"Dr. {name} came. {name} said that {name.upper()}'s case, and {given} {other} and {other}, were done. So said {given}. No Novakia" in new
    assert new.endswith("it, will he? Will.") and surrogates.surrogate(c, "name", "MARIA") == given.upper()


def test_surrogates_of_dates_addresses_and_numbers():
    c = surrogates.Cipher(b"test")
    one = lambda text, kind: [(text[a:b], surrogates.surrogate(c, k, text[a:b])) for a, b, k in surrogates.entities(text) if k == kind]
    # every way of writing one date gives one date, of the same century, and other dates others
    ways = ["born on 12 March 1980", "DOB: 1980-03-12", "date of birth: 12/03/1980", "Born March 12, 1980", "née le 12 mars 1980", "geboren am 12. März 1980", "nacido el 12 de marzo de 1980"]
    new = [one(w, "birth_date") for w in ways]
    assert all(len(x) == 1 for x in new) and len({surrogates._date_of(x[0][1])[:3] for x in new}) == 1
    days = [d for d in pd.date_range("1900-01-01", "1999-12-31").strftime("%Y-%m-%d")]
    images = [surrogates.surrogate(c, "birth_date", d) for d in days]
    assert sorted(images) == days  # a bijection of the century's dates, 29 February among them
    assert surrogates.surrogate(c, "birth_date", "25/03/1980")[3:5] == surrogates.surrogate(c, "birth_date", "03/25/1980")[:2]
    assert not one("born 31/02/1980 or on 1980-03-12", "birth_date") and not one("published on 12 March 1980", "birth_date")
    # house numbers keep their length, kinds of street stay
    for text, kept in (("12 Baker Street", "Street"), ("221 Old Mill Road", "Road"), ("5, rue de Rivoli", "rue de"), ("Hauptstraße 12", "straße"), ("Calle de Alcalá, 45", "Calle de")):
        ((old, fresh),) = one(f"at {text}.", "address")
        assert old == text and fresh != text and kept in fresh and len(fresh) == len(text)
    assert len({surrogates.surrogate(c, "address", f"{i} Baker Street") for i in range(1, 1000)}) == 999
    assert not one("In 1999 The Wall Street fell", "address")
    # local phone numbers keep their 0 and their shape and stay apart from North American ones
    for text in ("020 7946 0958", "06 12 34 56 78", "0151-2345-6789"):
        ((old, fresh),) = one(f"call {text} now", "phone")
        assert old == text and fresh[0] == "0" and [x.isdigit() for x in fresh] == [x.isdigit() for x in text]
    assert not one("on 05.11.2020 or 01.02.03", "phone")
    assert len({surrogates.surrogate(c, "phone", f"020 7946 {i:04d}") for i in range(2000)}) == 2000
    ((old, fresh),) = one("host 2001:db8::ff00:42:8329 up", "ip")
    assert old == "2001:db8::ff00:42:8329" and fresh.startswith("2001:") and ipaddress.ip_address(fresh).version == 6
    assert surrogates.surrogate(c, "ip", "2001:0db8:0:0:0:ff00:42:8329") == fresh
    assert not one("std::vector, abc::def at 12:30:45 and ::1", "ip")


def test_surrogates_of_given_names_before_known_ones():
    c = surrogates.Cipher(b"test")
    new = surrogates.replace("John Smith met Mr Smith. John said no.", c)[0]
    assert "John" not in new and "Smith" not in new and new.split()[0] == new.split(". ")[1].split()[0]
    for text in ("Then Smith saw Herr Smith", "the Old Smith, an old friend of Herr Smith"):
        assert surrogates.replace(text, c)[0].split()[:2] == [text.split()[0], *surrogates.replace(text, c)[0].split()[1:2]]
        assert {text[a:b] for a, b, _ in surrogates.entities(text)} == {"Smith"}
    for text in ("Miss Universe came", "Dr Pepper is cold", "Mr President, yes"):
        assert surrogates.replace(text, c) == (text, [])


def test_surrogates_by_brute_force(spark):
    """Over a whole corpus: one entity, one surrogate; two entities, two; the same shape; nothing left in its document."""
    c = surrogates.Cipher(b"test")
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in corpus.collect() if r.text]
    people = ["Mrs {0} wrote. Later {0} and +44 20 7946 09{1:02d} came from 10.0.{1}.7, said {0}.", "My name is {0}: card 4111-1111-1111-1111, not 4111-1111-1111-1112, {0}."]
    r = random.Random(3)
    texts += [people[i % 2].format("".join(r.choices("bcdfgk", k=1)).upper() + "".join(r.choices("aeioulnrst", k=7)), i) for i in range(60)]
    to, back, kinds = {}, {}, Counter()
    for t in texts:
        new, found = surrogates.replace(t, c)
        at = 0
        for a, b, kind in found:
            kinds[kind] += 1
            own = t[a:b]
            put = new[a + at : b + at]  # shapes are kept, so places stay
            assert len(put) == len(own) and [x.isdigit() for x in put] == [x.isdigit() for x in own] or kind == "name" or kind == "ip" or kind == "secret"
            at += len(surrogates.surrogate(c, kind, own)) - len(own)
            if kind != "name":
                key_, value = (kind, surrogates._same_entity(kind, own)), (kind, surrogates._same_entity(kind, surrogates.surrogate(c, kind, own)))
                assert to.setdefault(key_, value) == value and back.setdefault(value, key_) == key_
                assert own not in new
    assert min(kinds[k] for k in ("card", "email", "ip", "phone", "secret", "name")) >= 10
    assert "4111-1111-1111-1112" in surrogates.replace(people[1].format("Bosten", 1), c)[0]
    everything = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert surrogates.collisions(everything, b"test").count() == 0


# 9
def test_merged_transforms():
    r = np.random.default_rng(1)
    for trial in range(40):
        n = (8, 10, 12)[trial % 3]
        texts = list({bytes(r.integers(97, 99 + trial % 3, r.integers(n, 40)).astype(np.uint8)) for _ in range(r.integers(1, 12))})
        counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        for t, hit in zip(texts, repeated_text.repeated_windows(texts, n)):
            assert hit.tolist() == [counts[t[i : i + n]] > 1 for i in range(len(t) - n + 1)]


@pytest.mark.parametrize("length", [200, 70])
def test_repeats(docs, rows, empty, length, monkeypatch):
    monkeypatch.setattr(repeated_text, "BATCH", 2000)
    monkeypatch.setattr(repeated_text, "CELL", 2)
    raw = [(d, (x or "").encode()) for d, x, *_ in rows]
    counts = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    expected = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        expected.append((d, len(b), int(gone.sum()), len(repeated_text._runs(gone)), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = sorted((tuple(r) for r in repeated_text.without_repeats(docs, length).collect()), key=key)
    assert got == sorted(expected, key=key)
    assert repeated_text.without_repeats(empty).count() == 0


# 10
def test_samples_follow_the_lattice():
    m = sampled_pieces.model("piece_bpe_32k.model")
    pieces = {m.processor.id_to_piece(i): i for i in range(m.processor.get_piece_size()) if np.isfinite(m.weight[i]) and not m.processor.is_byte(i)}

    def every(s):
        return [((), 0.0)] if not s else [((pieces[s[:n]], *x), w + m.weight[pieces[s[:n]]]) for n in range(1, len(s) + 1) if s[:n] in pieces for x, w in every(s[n:])]

    all_ = every(m.processor.normalize("the"))
    total = np.log(sum(np.exp(w) for _, w in all_))
    chance = {x: float(np.exp(w - total)) for x, w in all_}
    got = sampled_pieces.samples_of(m, ["the"] * 3000, np.arange(3000), 3)
    first = Counter(tuple(g[0][0].tolist()) for g in got)
    assert all(abs(first[x] / 3000 - p) < 0.03 for x, p in chance.items())
    assert all(len({tuple(s[0].tolist()) for s in g}) == 3 for g in got)
    assert abs(np.mean([sum(np.exp(lp) / q for _, lp, _, q in g) for g in got]) - 1) < 0.01
    everything = sampled_pieces.samples_of(m, ["the"], np.arange(1), 100)[0]
    assert len(everything) == len(chance) and all(q == 1 for *_, q in everything)


def test_samples(docs, rows, empty):
    m = sampled_pieces.model("piece_bpe_32k.model")
    got = sampled_pieces.sampled(docs, 3).collect()
    texts = defaultdict(set)
    for d, x, *_ in rows:
        texts[d].add(x or "")
    by_row = defaultdict(set)
    for r in got:
        assert sampled_pieces.decoded(m, np.array(r.ids)) in texts[r.doc_id] and 0 <= r.inclusion <= 1
        by_row[r.doc_id].add((r.sample, tuple(r.ids)))
    assert len({i for _, i in by_row[3]}) == len({s for s, _ in by_row[3]}) == 3
    back = sampled_pieces.decoded_samples(sampled_pieces.sampled(docs, 3)).collect()
    assert Counter((r.doc_id, r.sample) for r in back) == Counter((r.doc_id, r.sample) for r in got)
    assert all(r.text in texts[r.doc_id] for r in back)
    other = sampled_pieces.sampled(docs.repartition(1), 3).collect()
    assert Counter((r.doc_id, r.sample, r.ids_crc32) for r in other) == Counter((r.doc_id, r.sample, r.ids_crc32) for r in got)
    assert sampled_pieces.sampled(empty).count() == 0


def test_every_operator_has_its_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
