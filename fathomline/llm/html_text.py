"""HTML main text by line-block distribution.

Markup is stripped into lines: one for each block with text, and a blank one
wherever a container (div, section, table and the like) opens or closes. Sums of
text lengths over windows of `WINDOW` lines give the page's distribution. Text
runs on from a surge until a dive, where a window is empty; a run is kept if
its highest window reaches the threshold, with all its lines in page order.

What a line weighs and what a window has to reach depend on the markup:

- Lines in navigation, headers, footers, sidebars, notices, adverts, forms,
  comments and so on, by tag or by a word of class, id or role, are no text and
  leave the distribution. A wrapper doesn't count as such if it holds the
  article itself, and if nothing else is left, less certain marks are ignored.
- Outside article and main, lines made of links weigh nothing. The threshold is
  `SURGE`, or the page's highest window if no window reaches that.
- Within article and main elements containers leave no blank lines, so their
  text has no dives. A page with such elements has two thresholds: for them the
  usual one divided by `BONUS`, outside `BONUS` times their highest window. So
  text outside is kept only where the elements are mere teasers beside it.

Pages are independent rows, so the job is a map: no shuffle, memory and time
linear in each page's own length, however long.

Defined cases: null or empty html, or html without text, gives an empty text;
unclosed elements end with the page, an unclosed excluded element only covers
its own text; closing tags without an opener are ignored; repeated rows are
treated alike; an empty table gives an empty table. The result columns replace
columns of the same name, others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 3
#: Window weight at which text surges.
SURGE = 80
#: How much less text needs to surge within article and main elements, and how much more beside them.
BONUS = 3
LINK_SHARE = 0.6

RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "title", "math", "audio", "video"}
BLOCKS = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul caption button label".split()
)
CONTAINERS = set("address article aside center details dialog div fieldset figure footer form header main nav section table".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
#: Tags of excluded elements; a header counts only outside article and main.
EXCLUDED = set("nav footer aside form button select menu head dialog header".split())
#: Words of class, id or role that mark an excluded element.
MARKS = set(
    "ad ads adv advert adverts adbox announcement advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply replies disqus "
    "share sharing social related recommended recommendations pagination pager toolbar widget widgets search skip "
    "copyright complementary contentinfo form".split()
)
#: Marks that count only outside article and main.
OUTER_MARKS = {"header", "side"}
#: Marks that may stand on a wrapper of the text, too.
UNSURE = set(
    "header side sidebar banner promo promotion notice notices alert announcement popup modal overlay share sharing social related "
    "recommended recommendations toolbar widget widgets search form".split()
)
#: Marks of lists of other articles or of comments: articles inside them are not the text.
OTHERS = set("comment comments commentlist respond reply replies disqus related recommended recommendations".split())
#: A name with one of these words tells of something elsewhere, as in `has-sidebar`.
ABOUT = {"has", "with", "no", "without"}

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")


class Exclusion(NamedTuple):
    """Why an element is excluded: it may wrap the text (unsure), or lists articles that aren't the text (others)."""

    unsure: bool
    others: bool = False
    form: bool = False


def exclusion(tag: str, attributes: str, in_article: bool) -> Exclusion | None:
    """Whether and how an element is excluded by its tag and attributes."""
    if tag == "form":
        return Exclusion(True, form=True)
    if tag in EXCLUDED and not (tag == "header" and in_article):
        return Exclusion(False)
    if tag in ("body", "html", "main") or not attributes.strip():
        return None
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return Exclusion(False)
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return Exclusion(False)
        elif name != "aria-hidden":
            for words in map(set, map(WORD.findall, value.split())):
                hit = words & MARKS | (set() if in_article else words & OUTER_MARKS)
                if hit and not words & ABOUT:
                    return Exclusion(hit <= UNSURE, bool(hit & OTHERS))
    return None


class Line(NamedTuple):
    """A block's text, its characters in links, its innermost excluded element, whether it is in article or main, blank lines before it."""

    text: str
    links: int
    node: int
    framed: bool
    gap: int


class Page:
    """The lines of a page and its tree of excluded elements."""

    def __init__(self, html: str) -> None:
        self.lines: list[Line] = []
        #: Excluded elements: kind, enclosing excluded element, what it holds; element 0 is the page.
        self.kinds: list[Exclusion | None] = [None]
        self.above = [0]
        self.holds = [[0, 0]]  # articles and first headings inside
        self.lone: set[int] = set()  # never closed
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, excluded element or 0, article or main
        blocks: list[int] = []  # places of the blocks on the stack
        opened: Counter[str] = Counter()
        parts: list[str] = []
        seen = [0, 0]  # articles and first headings so far
        node = links = in_link = article = gap = 0
        at, end = 0, len(html)
        last_tag = html.rfind(">")  # no tag begins after it

        def flush() -> None:
            nonlocal links, gap
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.lines.append(Line(text, links, node, article > 0, gap))
                    gap = 0
                parts.clear()
            links = 0

        def close(upto: int) -> None:
            nonlocal node, article
            for tag, n, framed in stack[upto:]:
                opened[tag] -= 1
                article -= framed
                if n:
                    self.holds[n] = [b - a for a, b in zip(self.holds[n], seen)]
                    node = self.above[n]
            del stack[upto:]
            while blocks and blocks[-1] >= upto:
                blocks.pop()

        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                piece = html[at:lt]
                parts.append(piece)
                if in_link:
                    links += len(piece.strip())
            if lt == end:
                break
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
                continue
            m = (TAG.match(html, lt) or LOOSE_TAG.match(html, lt)) if lt < last_tag else None
            if not m:
                parts.append("<")
                at = lt + 1
                continue
            at = m.end()
            closing, tag, attributes = m[1], m[2].lower(), m[3]
            if tag in BLOCKS:
                flush()
                gap += tag in CONTAINERS and not node and not article
            if closing:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = end if stop is None else stop.end()
                continue
            if tag in VOID:
                continue
            if tag in BLOCKS and blocks:
                # a block ends an open paragraph, and an item the item before it
                before = stack[blocks[-1]][0]
                if before == "p" or (before in ITEMS and tag in ITEMS[before]):
                    close(blocks[-1])
            if tag == "a":
                in_link += 1
            elif tag in BLOCKS or attributes:
                kind, n = exclusion(tag, attributes, article > 0), 0
                framed = tag in ("article", "main")
                seen[0] += framed
                seen[1] += tag == "h1"
                if kind:
                    n = len(self.kinds)
                    self.kinds.append(kind)
                    self.above.append(node)
                    self.holds.append(list(seen))
                    node = n
                if tag in BLOCKS:
                    blocks.append(len(stack))
                stack.append((tag, n, framed))
                opened[tag] += 1
                article += framed
        flush()
        self.lone = {n for _, n, _ in stack if n}
        close(0)

    def text_lines(self, unsure: bool) -> list[Line]:
        """The lines outside excluded elements; unsure: leave out also what may be excluded."""
        inside = [False]
        for n in range(1, len(self.kinds)):
            kind = self.kinds[n]
            articles, headings = self.holds[n]
            wraps = (articles and not kind.others and kind.unsure) or (kind.form and headings)
            own = n not in self.lone and not wraps and (unsure or not kind.unsure)
            inside.append(own or inside[self.above[n]])
        out, met = [], set()
        for line in self.lines:
            first = line.node in self.lone and line.node not in met
            met.add(line.node)
            if not (first or inside[line.node]):
                out.append(line)
        return out


def _runs(lines: list[Line]) -> Iterator[tuple[list[Line], int]]:
    """The runs between dives, without link lines at their rims, and the highest window of each."""
    run: list[Line] = []
    weights: list[int] = []

    def done() -> tuple[list[Line], int]:
        window = sum(weights[:WINDOW])
        highest = window
        for k in range(WINDOW, len(weights)):
            window += weights[k] - weights[k - WINDOW]
            highest = max(highest, window)
        return run, highest

    idle: list[Line] = []
    blank = 0
    for line in lines:
        weight = len(line.text) if line.framed or line.links <= LINK_SHARE * len(line.text) else 0
        blank += line.gap
        if run and (blank >= WINDOW or line.framed != run[-1].framed):
            yield done()
            run, weights, idle = [], [], []
        if not weight:
            blank += 1
            idle.append(line)
            continue
        if run:
            run.extend(idle)
            weights.extend([0] * blank)
        run.append(line)
        weights.append(weight)
        idle, blank = [], 0
    if run:
        yield done()


def main_text(html: str | None) -> str:
    """The main text of a page, blocks joined by one space."""
    if not html:
        return ""
    page = Page(html)
    runs = list(_runs(page.text_lines(unsure=True)))
    usual = min(SURGE, max((high for _, high in runs), default=0))
    if not runs:
        runs, usual = list(_runs(page.text_lines(unsure=False))), SURGE
    inner = max((high for run, high in runs if run[0].framed), default=0)
    if inner:
        usual = min(SURGE, inner)
    kept = []
    for run, high in runs:
        if high * BONUS >= usual if run[0].framed else high >= (max(SURGE, BONUS * inner) if inner else usual):
            kept.extend(line.text for line in run)
    return " ".join(kept)


def _extract(place: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, place):
        texts = [main_text(h) for h in batch.column(place).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*names, "text", "n_chars"],
        )


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns `keep`) with the main text of column html and its length in code points."""
    names = [c for c in keep or pages.columns if c not in ("text", "n_chars")]
    read = pages.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), F.col(html).alias("_html"))
    inner = [f"c{k}" for k in range(len(names))]
    fields = ", ".join(f"{n} {read.schema[n].dataType.simpleString()}" for n in inner)
    out = read.mapInArrow(partial(_extract, len(names), inner), f"{fields + ', ' if fields else ''}text string, n_chars bigint")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), "text", "n_chars")
