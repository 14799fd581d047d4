"""The main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of block tags and of blocks of text. Words score positive and tags negative; weights are
log-odds of lying inside the main text, counted over labelled pages. A linear scan finds the contiguous run of largest total, and of its blocks those
are kept whose log-odds aren't negative.

The labels: pages that mark their text by one `article` or `main` element label themselves, all of them are counted; beside
them stand the small labelled pages in `SEEDS`, with as much weight as all others together, for the kinds of blocks that
the corpus may lack. What lies in an element that names itself as a menu, header, footer, sidebar, notice, advert, form or comment, by its
tag, role, class or id, has the log-odds of that kind; any other block those of its tag, told apart by whether nearly all of it is linked.

Scripts, styles, comments, hidden elements and markup are no text. Character references are decoded once; white space within a block
becomes one space; blocks are joined in page order by one space. Inline tags don't part words. An unclosed
script or comment runs to the end of the page; where a quote does so, it is none; a `<` that begins no tag is text. A null, empty or textless html gives the empty text, with
0 characters. Pages of any length are read whole, in one task. Rows that repeat a page_id each get a row; columns other than page_id,
url and html are not read. With no labelled page at all the seeds alone decide.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import thrifty

#: Elements of HTML that don't begin a block, whose content is no markup, and that have no end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Kinds of elements beside the main text, by tag, by role, and by words of class or id.
TAG_KINDS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "select": "form", "dialog": "notice"} | dict.fromkeys("noscript template svg canvas object audio video".split(), "hidden")
ROLE_KINDS = {"navigation": "menu", "menu": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice"}
WORD_KINDS = {
    word: kind
    for kind, words in {
        "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager",
        "header": "header masthead topbar",
        "footer": "footer colophon copyright",
        "sidebar": "sidebar aside rail widget widgets related recommended recommendations trending share sharing social",
        "notice": "notice cookie cookies consent gdpr popup modal overlay alert",
        "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner adsense",
        "form": "form newsletter subscribe signup login search",
        "comment": "comment comments respond reply replies disqus",
    }.items()
    for word in words.split()
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
#: Tags with weights of their own; others count as "other".
BLOCKS = frozenset("p div section li ul ol dl dt dd td th tr table tbody thead caption blockquote pre figure figcaption address details summary br hr center fieldset legend".split()) | HEADINGS | MAIN

_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|data-main)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in RAW}
_NOT_A_BOX = frozenset(["html", "body"])
_OWN = frozenset("entry post article story content title".split())  # beside "header": the text's own

#: Labelled pages: data-main marks what belongs to the main text.
SEEDS = [
    """<body><div class=top>Daily News <a href=/>Home</a></div><ul><li><a href=/a>World</a></li><li><a href=/b>Sports and games</a></li></ul><div data-main><h1>Rain ends the drought</h1><p>After months
    without water the rain came at last, and farmers could sow.</p><h2>What comes next</h2><ul><li>Fields will be sown in a week</li><li>Dams will fill by winter, experts say</li></ul><p>More rain is expected on Sunday.</p></div>
    <div><a href=/x>Older story</a></div><div><a href=/y>Newer story</a></div></body>""",
    """<body><table><tr><td><a href=/1>Index</a></td><td><a href=/2>Contact</a></td></tr></table><div data-main><div>The first part of this old page stands in plain boxes, as many old pages do, and goes on for a while.</div><div>The second part is
    another box with a longer run of words and no link at all.</div><blockquote>A quotation that belongs to it.</blockquote><pre>some code of the text</pre></div><center><a href=/z>Back</a></center></body>""",
    """<body><header><a href=/>Site</a> the best site</header><nav><a href=/m>Menu</a></nav><main data-main><h1>How to bake</h1><p>Flour, water and salt are all that you need for it.</p><table><tr><th>Flour</th><td>500 grams of it</td></tr></table>
    <figure><figcaption>A loaf of bread</figcaption></figure><dl><dt>Salt</dt><dd>Ten grams are enough</dd></dl></main><aside><h3>Also read</h3><p>Other recipes that readers liked</p></aside>
    <section class=comments><h3>Comments</h3><p>I liked this one, thanks.</p></section><form><p>Write to us here</p></form><footer><p>All rights reserved by the site</p></footer></body>""",
    """<body><div class=cookie-notice><p>We use cookies on this site</p></div><div id=sidebar><ul><li>Top of the week</li></ul></div><section data-main><h2>A short notice from the town</h2><p>The bridge is closed until May.</p></section>
    <div class=ad><p>Buy now, while stocks last</p></div><div class=related><p>You may like these too</p></div><div class=header>The town</div><div class=menu>Start</div><form class=newsletter>Your name</form><div class=footer>Imprint</div></body>""",
]


@dataclass
class Page:
    """What a page is made of: (feature, 0, "") for each block tag, (feature, words, text) for each block; and which lie in the marked text."""

    feature: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    marks: int = 0


def _kind(name: str, attributes: str, in_main: bool) -> tuple[str | None, bool]:
    """The kind that an element names itself as, and whether data-main marks it."""
    kind, marked = TAG_KINDS.get(name), False
    if name == "header" and in_main:
        kind = None
    if attributes and name not in _NOT_A_BOX:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "data-main":
                marked = True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return "hidden", marked
            elif key == "role":
                kind = ROLE_KINDS.get(value.lower(), kind)
            elif key in ("class", "id") and kind is None:
                kind = _word_kind(name, value, in_main)
    return kind, marked


def _word_kind(name: str, value: str, in_main: bool) -> str | None:
    for token in value.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if not parts or parts[0] in ("has", "no", "with"):
            continue
        for part in parts:
            kind = WORD_KINDS.get(part)
            if kind in ("header", "footer") and (in_main or name in HEADINGS or not _OWN.isdisjoint(parts)):
                continue
            if kind and (name not in MAIN or kind in ("comment", "ad")):
                return kind
    return None


def read(page: str) -> Page:
    """One pass over the tokens; the stack holds (name, kind, in the marked text, in an article or main)."""
    out = Page()
    stack: list[tuple[str, str | None, bool, bool]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked, plain, links = 0, 0, 0

    def emit(feature: str, words: int, text: str) -> None:
        out.feature.append(feature)
        out.words.append(words)
        out.text.append(text)
        out.inside.append(bool(stack) and stack[-1][2])

    def flush() -> None:
        nonlocal linked, plain
        if parts:
            words = "".join(parts).split()
            if words:
                kind = stack[-1][1] if stack else None
                tag = next((x[0] for x in reversed(stack) if x[0] in BLOCKS), "none")
                feature = f"kind {kind}" if kind else f"block {tag}{' linked' if linked >= 4 * plain else ''}"
                emit(feature, len(words), " ".join(words))
            parts.clear()
        linked = plain = 0

    def tag(name: str, kind: str | None) -> None:
        emit(f"tag {kind or (name if name in BLOCKS else 'other')}", 0, "")

    def said(raw: str) -> None:
        nonlocal linked, plain
        if "&" in raw:
            raw = entities.unescape(raw)
        parts.append(raw)
        n = len(raw) if not raw.isspace() else 0
        if links:
            linked += n
        else:
            plain += n

    def close(name: str) -> None:
        nonlocal links
        links = 0  # a link that its block doesn't close ends there
        while stack:
            top = stack.pop()
            opened[top[0]] -= 1
            if top[0] == name:
                return

    at, end, last, quotes = 0, len(page), page.rfind(">"), True
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            said(page[at:])
            break
        if begin > at:
            said(page[at:begin])
        at = begin
        if m := _ASIDE.match(page, at):
            at = m.end()
            continue
        m = _TAG.match(page, at) if quotes and at < last else None
        if m is None and at < last and page[at + 1 : at + 3].strip("/")[:1].isalpha():
            quotes = False  # one is left open to the end of the page: from here on tags end at the first >
            m = _LOOSE.match(page, at)
        if m is None:
            said("<")
            at += 1
            continue
        at = m.end()
        name, ends = m[2].lower(), bool(m[1])
        if name in INLINE:
            if name == "a":
                links = 0 if ends else 1
            continue
        if name in RAW:
            if not ends:
                over = _RAW_ENDS[name].search(page, at)
                at = over.end() if over else end
            continue
        flush()
        if ends:
            if opened[name]:
                kind = next(x[1] for x in reversed(stack) if x[0] == name)
                tag(name, kind)
                close(name)
            continue
        if stack and ((stack[-1][0] == "p" and name != "br") or (stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"))):
            close(stack[-1][0])
        before = stack[-1] if stack else ("", None, False, False)
        kind, marked = _kind(name, m[3], before[3])
        in_main = before[3] or name in MAIN
        if name in MAIN and kind is None and before[1] is None:
            out.marks += not before[3]
        # A form around a whole page is none; else the outer kind holds.
        whole = before[1] == "form" and name in MAIN
        held = kind if before[1] is None or whole else before[1]
        if name in VOID:
            tag(name, held)
            continue
        stack.append((name, held, marked or before[2], in_main))
        opened[name] += 1
        tag(name, held)
    flush()
    return out


def _labels(page: Page, seed: bool) -> list[bool] | None:
    """Whether each part lies in the main text; None: the page doesn't say. No box of another kind belongs to it."""
    if seed:
        return page.inside
    if page.marks != 1:
        return None
    first = page.feature.index("tag article") if "tag article" in page.feature else page.feature.index("tag main")
    name = page.feature[first]
    last = len(page.feature) - 1 - page.feature[::-1].index(name)
    beside = lambda f: f.startswith("kind ") or f[4:] in _KINDS
    return [first <= i <= max(last, first) and not beside(f) for i, f in enumerate(page.feature)] if last > first else [i >= first and not beside(f) for i, f in enumerate(page.feature)]


_KINDS = frozenset(WORD_KINDS.values()) | {"hidden"}


def _counted(pages: Iterator[str | None], seed: bool) -> dict[str, list[int]]:
    """(inside, outside) of each feature: its words, or how often the tag comes."""
    out: dict[str, list[int]] = {}
    for html in pages:
        page = read(html or "")
        labels = _labels(page, seed)
        if labels is None:
            continue
        for f, n, inside in zip(page.feature, page.words, labels, strict=True):
            out.setdefault(f, [0, 0])[not inside] += n or 1
    return out


@dataclass(frozen=True)
class Weights:
    odds: dict[str, float]  # of blocks' words; of tags
    least_word: float = 0.01
    least_tag: float = 0.1

    def score(self, feature: str, words: int) -> float:
        odds = self.odds.get(feature, 0.0)
        return words * max(odds, self.least_word) if words else min(odds, -self.least_tag)


def _weights(corpus: dict[str, tuple[int, int]], most: float = 8.0) -> Weights:
    """Log-odds of each feature among words, and among tags, the corpus and the seeds having an equal share."""
    seeds = _counted(iter(SEEDS), True)
    odds: dict[str, float] = {}
    for group in (("block ",), ("tag ",)):
        share: dict[str, list[float]] = {}
        total = [0.0, 0.0]
        for counts in (corpus, seeds):
            some = {f: c for f, c in counts.items() if f.startswith(group)}
            n = max(1, sum(a + b for a, b in some.values()))
            for f, (a, b) in some.items():
                have = share.setdefault(f, [0.0, 0.0])
                have[0], have[1] = have[0] + a / n, have[1] + b / n
                total[0], total[1] = total[0] + a / n, total[1] + b / n
        for f, (a, b) in share.items():
            odds[f] = max(-most, min(most, math.log((a + 1e-4) / (b + 1e-4))))
    for f in {*corpus, *seeds}:
        if f.startswith("kind "):
            a, b = (sum(c.get(f, (0, 0))[i] for c in (corpus, seeds)) for i in (0, 1))
            odds[f] = max(-most, min(most, math.log((a + 0.01) / (b + 0.01))))
    for kind in _KINDS:
        odds.setdefault(f"kind {kind}", -most)
    return Weights(odds)


def fit(pages: DataFrame) -> Weights:
    """Weights from all pages that mark their text; the driver gets two sums for each of about 200 features."""

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _counted((x.as_py() for batch in batches for x in batch.column(0)), False)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([a for a, _ in got.values()], pa.int64()), pa.array([b for _, b in got.values()], pa.int64())], names=["feature", "a", "b"])

    sums = pages.select("html").mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return _weights({r["feature"]: (r["a"], r["b"]) for r in sums})


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first and the last place + 1 of the run with the largest sum, the earliest and shortest of equal ones; (0, 0) if none is positive."""
    best, found = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(html: str | None, weights: Weights) -> str:
    page = read(html or "")
    first, last = best_run([weights.score(f, n) for f, n in zip(page.feature, page.words, strict=True)])
    return " ".join(page.text[i] for i in range(first, last) if page.words[i] and weights.odds.get(page.feature[i], 0.0) >= 0)


def extractor(weights: Weights, spark) -> Column:
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("string")
    @thrifty
    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([main_text(x.as_py(), shared.value) for x in part], pa.string())

    return texts


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    out = pages.select("page_id", "url", extractor(weights, pages.sparkSession)(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
