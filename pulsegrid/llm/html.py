"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: boilerplate containers (by tag
or by words of their class and id) and blocks of links are bad; blocks of some length with many stop words are good; the
rest is ambiguous. In the second pass an ambiguous block takes the label of its nearest decided neighbours, inside an
article those of the same article. Where a page marks an article with text, blocks outside it are boilerplate. Class words that
name the layout (a sidebar, a banner) say nothing of an article inside; those of comments, adverts or teasers do.

Defined cases: null or empty html gives an empty text; broken or cut markup is read to its end (an open comment, script
or tag runs to the end), in time linear in its length; a page without any decided block keeps its ambiguous blocks that have a stop word or stand in an
article; repeated rows return as often as they stand; an empty table gives an empty result; columns other than page_id,
url and html are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame

from pulsegrid.llm.common import map_rows

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or an have not but had which they his he you we".split()
    + "de la le et les des en un une du que est pour qui dans sur par pas plus ne se au avec ce il son nous vous ou mais".split()
    + "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an er hat aus bei nach wie oder".split()
    + "el los y que del las por con para su al lo como mas pero sus una esta este son entre cuando muy sin sobre".split()
)
#: Tags that start a new block, containers that are followed, containers that are never main text.
BREAKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
TRACKED = frozenset("article aside body button details dialog div dl fieldset figure footer form head header main menu nav ol section select table td ul".split())
NEVER = frozenset("aside button dialog fieldset footer form head menu nav select".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|canvas|audio|video"
#: Words in a class, id or role that name boilerplate.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments respond disqus share sharing social related recommended recommendations teaser widget toolbar login signup search pagination pager copyright masthead skip banner alert contentinfo complementary".split())

#: Of these words those that also count against an article inside the container, or with the word itself.
STRICT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription comment comments respond disqus related recommended recommendations teaser".split())
#: Words of a class that turn the others into a remark on the page or the state of a block.
REMARKS = frozenset("has no not with without is free open closed enabled disabled type format status category tag".split())

#: A quote counts only behind an equals sign, and what is not closed runs to the end, so no match is tried twice.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^>]*/>|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPLIT = re.compile(r"[^a-z0-9]+")

GOOD, BAD, OPEN = 1, -1, 0
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


CLEAN, SOFT, HARD, NEVER_TEXT = 0, 1, 2, 3


def _hinted(attrs: str) -> int:
    """What class, id and role say of a container: nothing, a part of the layout (SOFT), or no article (HARD)."""
    if HIDDEN.search(attrs):
        return NEVER_TEXT
    found = CLEAN
    for m in ATTRS.finditer(attrs):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = {*SPLIT.split(token.lower()), *SPLIT.split(CAMEL.sub(" ", token).lower())}
            if words & HINTS and not words & REMARKS:
                found = max(found, HARD if words & STRICT else SOFT)
    return found


def blocks_of(page: str) -> list[tuple[str, int, int, int]]:
    """(text, characters inside links, kind of boilerplate container, number of the article or 0) of each block."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, kind of boilerplate, article
    depth: Counter[str] = Counter()  # open containers by tag
    parts: list[str] = []
    state = {"bad": CLEAN, "article": 0, "links": 0, "in_a": False, "in_p": False}
    opened = (0, False)  # of the link: depth, and whether a paragraph was open
    articles = 0

    def close() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, min(state["links"], len(text)), state["bad"], state["article"]))
            parts.clear()
        state["links"] = 0

    def add(piece: str) -> None:
        if piece:
            parts.append(piece)
            if state["in_a"]:
                state["links"] += len(" ".join(_html.unescape(piece).split()))

    last, end = 0, page.rfind(">") + 1  # behind the last end of a tag all is text
    for m in TOKEN.finditer(page, 0, end):
        add(page[last : m.start()])
        last = m.end()
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag == "a":
            state["in_a"] = not closing
            opened = len(stack), state["in_p"]
        elif tag == "br":
            parts.append(" ")
        if tag not in BREAKS:
            continue
        close()
        state["in_p"] = tag == "p" and not closing
        if tag == "p" and opened[1]:  # a link that began in a paragraph ends with it
            state["in_a"] = False
        if tag not in TRACKED:
            continue
        if not closing:
            if m[4].endswith("/"):
                continue
            if tag == "body":  # a head that was never closed ends here
                stack.clear()
                depth.clear()
            bad, article = (stack[-1][1], stack[-1][2]) if stack else (CLEAN, 0)
            own = _hinted(m[4]) if m[4] and tag != "body" else CLEAN
            if tag in ("article", "main"):
                own = CLEAN if own == SOFT else own
                if not article:
                    articles += 1
                    article, bad = articles, CLEAN if bad == SOFT else bad
            if tag in NEVER or (tag == "header" and not article):
                own = NEVER_TEXT
            stack.append((tag, max(bad, own), article))
            depth[tag] += 1
        elif depth[tag]:
            while True:
                top = stack.pop()[0]
                depth[top] -= 1
                if top == tag:
                    break
        state["bad"], state["article"] = (stack[-1][1], stack[-1][2]) if stack else (CLEAN, 0)
        if len(stack) < opened[0] or opened[1]:  # the container of the link is over
            state["in_a"] = False
    add(page[last:])
    close()
    return out


def first_pass(text: str, links: int, bad: int, article: int, short: int, long: int, stop_low: float, stop_high: float, link_max: float) -> tuple[int, float]:
    words = WORD.findall(text.lower())
    stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if bad or links > link_max * len(text):
        return BAD, stop
    if len(text) < short:
        return OPEN, stop
    if stop >= stop_high and len(text) >= long or stop >= stop_high and article:
        return GOOD, stop
    return (OPEN if article or stop >= stop_low else BAD), stop


def main_text(page: str | None, short: int = 70, long: int = 140, stop_low: float = 0.06, stop_high: float = 0.12, link_max: float = 0.33) -> str:
    blocks = blocks_of(page or "")
    first = [first_pass(*b, short, long, stop_low, stop_high, link_max) for b in blocks]
    marked = {b[3] for b, (k, _) in zip(blocks, first, strict=True) if b[3] and k != BAD}
    labels = [BAD if marked and not b[3] else k for b, (k, _) in zip(blocks, first, strict=True)]
    before: dict[int, tuple[int, int]] = {}  # of an article: place and label of the last decided block
    left, right = [None] * len(labels), [None] * len(labels)
    for side, order in ((left, range(len(labels))), (right, range(len(labels) - 1, -1, -1))):
        before.clear()
        for i in order:
            side[i] = before.get(blocks[i][3])
            if labels[i] != OPEN and not (blocks[i][3] and labels[i] == BAD):  # inside an article, an advert or a list of links says nothing of its neighbours
                before[blocks[i][3]] = (i, labels[i])
    keep = []
    for i, (b, k) in enumerate(zip(blocks, labels, strict=True)):
        if k == OPEN:
            near = [x for x in (left[i], right[i]) if x]
            if not near:
                k = GOOD if b[3] or first[i][1] >= stop_low else BAD
            else:
                least = min(abs(j - i) for j, _ in near)
                k = min(x for j, x in near if abs(j - i) == least)
        if k == GOOD:
            keep.append(b[0])
    return "\n".join(keep)


def _extract():
    def fn(c: dict) -> dict:
        text = [main_text(h) for h in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": text, "n_chars": [len(t) for t in text]}

    return fn


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    return map_rows(pages.select("page_id", "url", "html"), _extract, SCHEMA)


def html_query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
