"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element).  A line weighs its code points times what one weighs there:
MARKED inside an article that the page marks, PLAIN elsewhere, NAMED where only the names of classes or a form hint
that it is no article text, and nothing where markup says so (navigation, page headers and footers, sidebars, what is
hidden) or where it is mostly links.  Names hint so only of elements that hold neither <main> nor the page's only
article nor, on pages without either, most of the text; others are wrappers of the layout.  Inside a marked article
lines of links weigh nothing where they fill a window or hold several links, unless all its lines do.

Weights are summed over sliding windows of lines, and the page's heaviest window sets the level of the rest.  A line
that weighs less than 1 in DIVE of what its code points would weigh there is a dive.  Outside a marked article, a
window of dives, or dives before text that has left the block's elements, end a block; the article's ends do always,
and nothing inside it does.  A block is text where its sums surge over 1 in SHARE of the page's largest (or over SURGE
code points of plain text, if that is less) and, beside a marked article, over 1 in BESIDE; lines of text blocks that
are no dives are kept.

Defined results: null or empty html, or a page without text, gives the empty string and 0; unclosed tags and
quotes are read as browsers do for the block structure; repeated rows are returned each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, table

WINDOW = 3
#: What a code point weighs inside a marked article, elsewhere, and where names hint at no text.
MARKED, PLAIN, NAMED = 256, 64, 1
#: A line is a dive where a code point weighs less than this share of what one weighs in the heaviest window.
DIVE = 16
#: A block's sums must surge over this share of the page's largest, or over so many code points of plain text.
SHARE, SURGE = 8, 80
#: The share of the page's largest sum that a block beside a marked article must reach.
BESIDE = 4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_RAW = frozenset("script style noscript template iframe svg textarea title object canvas audio video select annotation annotation-xml noframes".split())
#: Raw elements that browsers read to the end of the page where they are not closed.
_SCRIPT = frozenset(("script", "style"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end tag closes what was left open inside them.
_HOLDER = frozenset("article aside blockquote body button center dd details dialog div dl dt fieldset figure footer form head header ins label li main menu nav ol p a search section table td th tr ul h1 h2 h3 h4 h5 h6 span".split())
#: Elements inside lines that may be no text by themselves.
_INLINE = frozenset(("ins", "span"))
#: Elements that hold text rather than are part of it.
_LAYOUT = frozenset("div section article main td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCK - {'option'}))})(?![\w:-])", re.I)
_NO_TEXT = frozenset("nav footer aside button dialog menu search head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Parts of names that say what an element is for, then such as do so only at a name's end or before a word for furniture.
_PLAIN_NAMES = "ads?|adsbygoogle|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|nav|navbar|navigation|menu|sidebar|footer|comments?|disqus|replies|sharing|breadcrumbs?|newsletter|subscribe|subscription|popup|modal|overlay|toolbar|pagination|pager|masthead|topbar|skip|login|signup"
_OTHER_NAMES = "banner|notice|share|social|related|widget"
_FURNITURE = "area|articles?|bar|block|box|buttons?|container|icons?|items?|links?|list|media|panel|posts?|reading|section|stories|text|tools?|wrap|wrapper"
_NAMES = re.compile(
    rf"(?:^|[\s_-])(?:{_PLAIN_NAMES})(?:$|[\s_-])|(?:^|[\s_-])(?:{_OTHER_NAMES})(?:$|\s|[_-](?:{_FURNITURE})(?:$|[\s_-]))|(?:^|[\s_-])(?:comment|cookie|sidebar|advert|newsletter)",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:site|page|top|global|main)?[_-]?header(?:$|[\s_-])", re.I)


def _no_text(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether tag or attributes say that an element is no text, whatever it holds."""
    if tag in _NO_TEXT or tag == "header" and not in_article or attributes and _HIDDEN.search(attributes):
        return True
    return any(name.lower() == "role" and value.strip("\"'").lower() in _ROLES for name, value in _ATTRIBUTE.findall(attributes or ""))


def _named(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether names hint that an element is no text."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    values = [value.strip("\"'") for name, value in _ATTRIBUTE.findall(attributes) if name.lower() != "role"]
    return any(_NAMES.search(x) or not in_article and _HEADER.search(x) for x in values)


def _pairs(page: str, tag: str) -> dict[int, tuple[int, int]]:
    """Of each closed element of a tag: the end of its start tag, and its end tag's start and end."""
    pairs, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?![\w:-])[^>]*>", page, re.I):
        if m[1]:
            if opened:
                pairs[opened.pop()] = m.span()
        elif not m[0].endswith("/>"):
            opened.append(m.end())
    return pairs


def _raw_end(page: str, tag: str, at: int, pairs: dict[str, dict[int, tuple[int, int]]]) -> int:
    """Where a raw element ends: at its end tag, else at the next block; scripts end with the page."""
    if tag in _SCRIPT:
        stop = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
        return stop.end() if stop else len(page)
    if tag not in pairs:
        pairs[tag] = _pairs(page, tag)
    if at in pairs[tag]:
        return pairs[tag][at][1]
    stop = _NEXT_BLOCK.search(page, at)
    return stop.start() if stop else len(page)


def lines_of(page: str, window: int = WINDOW) -> tuple[list[tuple[str, int, int, bool]], bool]:
    """(text, weight, depth in layout elements, whether in a marked article) of every line of a page, and whether markup names its article."""
    lines: list[tuple[str, tuple[int, ...], int, int, int]] = []  # text, named elements around it, article around it or 0, links if they are most of it, depth
    total, held = 0, Counter()  # code points of text, and of it in each named element
    articles: list[tuple[str, tuple[int, ...]]] = [("", ())]  # tag, named elements around it
    run: list[str] = []
    stack: list[tuple[str, bool, tuple[int, ...], int, bool]] = []  # tag, no text, named elements, article, link; the last four hold for all inside
    linked = links = names = 0
    pairs: dict[str, dict[int, tuple[int, int]]] = {}

    def flush() -> None:
        nonlocal linked, links, total
        if text := " ".join("".join(run).split()):
            none, named, article, _ = stack[-1][1:] if stack else (False, (), 0, False)
            lines.append((text, (0,) if none else named, article, max(links, 1) if 2 * linked > len(text) and not any(x[0] in _HEADINGS for x in stack) else 0, sum(x[0] in _LAYOUT for x in stack)))
            if not none:
                total += len(text)
                held.update(dict.fromkeys(named, len(text)))
        run.clear()
        linked = links = 0

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        text = page[at : found.start() if found else end]
        if text:
            run.append(text := html.unescape(text))
            if stack and stack[-1][4]:
                linked += len(text)
        if not found:
            break
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if not close and tag in _RAW and not attributes.endswith("/"):
            at = _raw_end(page, tag, at, pairs)
            run.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID or tag not in _HOLDER or not close and attributes.endswith("/"):
            continue
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _INLINE and stack[i][1:3] != (stack[i - 1][1:3] if i else (False, ())):
                        flush()  # no text inside a line of text
                    del stack[i:]
                    break
                if tag in ("p", "a", "ins", "span", "label") and stack[i][0] not in ("p", "a", "ins", "span", "label"):
                    break  # an inline end tag closes no block
        else:
            while tag in _BLOCK and stack and stack[-1][0] in ("p", "a", "span", "label"):
                stack.pop()  # a block ends a paragraph that was left open
            if tag in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
                stack.pop()
            none, named, article, link = stack[-1][1:] if stack else (False, (), 0, False)
            inside = bool(article) or tag in ("article", "main") and not none
            none_here = none or _no_text(tag, attributes, inside)
            if not none_here and tag in ("article", "main"):
                articles.append((tag, named))
                article = len(articles) - 1
            if not none_here and _named(tag, attributes, inside):
                names += 1
                named = (*named, names)
            if tag in _INLINE and (none_here, named) != (none, stack[-1][2] if stack else ()):
                flush()
            links += tag == "a"
            stack.append((tag, none_here, named, article, link or tag == "a"))
    flush()
    # wrappers: elements with a name that hold <main>, the only article or most of the text
    around = [x for tag, x in articles[1:] if tag == "main"] or [x for _, x in articles[1:]][:1] * (len(articles) == 2)
    wrapping = {n for x in around for n in x} if around else {n for n in held if 2 * held[n] > total}
    apart = lambda named: any(n not in wrapping for n in named)
    marked = any(not apart(named) for _, named in articles[1:])
    may = [not apart(named) for _, named, *_ in lines]
    inside = [marked and article > 0 and not apart(articles[article][1]) for _, _, article, *_ in lines]
    own = [links for _, _, _, links, _ in lines]
    if marked and any(i and m and not o for i, m, o in zip(inside, may, own)):
        # one link may be a line of the article; several, and lines of links in a row that fill a window, are a menu
        at = 0
        while at < len(lines):
            stop = at
            while stop < len(lines) and inside[stop] and may[stop] and own[stop]:
                stop += 1
            if stop - at < window:
                own[at:stop] = [o if o > 1 else 0 for o in own[at:stop]]
            at = max(stop, at + 1)
    elif marked:
        own = [0 if i else o for i, o in zip(inside, own)]  # an article that is all links
    each = [0 if o or 0 in named else NAMED if not m else MARKED if i else PLAIN for (_, named, *_), m, o, i in zip(lines, may, own, inside)]
    return [(text, weight * len(text), depth, i) for (text, *_, depth), weight, i in zip(lines, each, inside)], marked


def level_of(lines: list[tuple[str, int, int, bool]], window: int) -> float:
    """What a code point weighs in the page's heaviest window (the first of equal ones)."""
    starts = range(len(lines))
    heaviest = max(starts, key=lambda i: sum(x[1] for x in lines[i : i + window]), default=0)
    held = [x for x in lines[heaviest : heaviest + window] if x[1]]
    return sum(x[1] for x in held) / max(sum(len(x[0]) for x in held), 1)


def blocks_of(lines: list[tuple[str, int, int, bool]], window: int, level: float) -> list[list[tuple[str, int, int, bool]]]:
    """Lines between dives; those of no text inside a block stand as lines of no weight."""
    blocks: list[list[tuple[str, int, int, bool]]] = []
    nothing, least = 0, 0  # dives so far, least depth of the block's text
    for line in lines:
        text, weight, depth, inside = line
        if not weight or DIVE * weight < level * len(text):
            nothing += 1
            continue
        if not blocks or inside != blocks[-1][-1][3] or not inside and (nothing >= window or nothing and depth < least):
            blocks.append([])
            least = depth
        else:
            blocks[-1] += [("", 0, 0, inside)] * nothing
        nothing, least = 0, min(least, depth)
        blocks[-1].append(line)
    return blocks


def main_text(page: str | None, window: int = WINDOW) -> str:
    """Text between the surges and dives of the line-block distribution."""
    lines, marked = lines_of(page or "", window)
    blocks = blocks_of(lines, window, level_of(lines, window))
    peaks = [max(sum(x[1] for x in block[i : i + window]) for i in range(len(block))) for block in blocks]
    top = max(peaks, default=0)
    surge = min(SURGE * PLAIN, top / SHARE)
    is_text = [block[0][3] or peak >= surge and (not marked or BESIDE * peak >= top) for block, peak in zip(blocks, peaks)]
    return "\n".join(text for block, kept in zip(blocks, is_text) if kept for text, weight, *_ in block if weight)


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html"):
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_column).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
