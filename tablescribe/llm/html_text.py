"""Main text of web pages, by text-to-tag ratios over parser events.

The events of the standard library's HTML parser are read in one pass. They give the page's lines, one per block element, each
with its characters outside of links per tag. The ratios are smoothed with a Gaussian over neighbouring lines, and a threshold at
their standard deviation divides the lines into two clusters; runs above it, but for lines that are mostly links, are the content regions. The element
that holds the regions (an article or main element where there is one) is the article: its lines stay, short ones as well,
except those in elements that say that they are something else: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments, by their tag, role, class or id.

Unclosed and crossed tags are closed as browsers do for the elements that matter here. Null and empty pages, and pages without
a line of text, have an empty text. Pages are rows of their own: repeated ones give repeated results, null ids and urls stay null,
a table without rows gives none, other columns aren't looked at. A page of any length is read in one pass, in time that
grows with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown as text of the page.
_UNSEEN = frozenset("applet audio button canvas datalist head iframe math meter noframes noscript object option progress script select style svg template textarea title video".split())
_IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ASIDE = frozenset("aside dialog footer form label menu nav search".split())
_ARTICLES = frozenset(("article", "main"))
_SECTIONS = frozenset("article body center div html main section table tbody td".split())
#: A start tag closes these, up to the second ones.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Attributes that say what an element is.
_TOLD = frozenset("aria-hidden class hidden id itemprop role style".split())
#: Words in a class or id.
_COMMENTS = re.compile(r"comment(s|er|list|form|area|box|section|thread|body|text)?|repl(y|ies)|respond|disqus|discussion|guestbook")
_ELSEWHERE = re.compile(
    r"nav(bar|igation|list)?|(sub|drop|mega)?menu|breadcrumbs?|masthead|banner|(page|site)?footer|sidebar|sidenav|aside|widgets?|related|recommend(ed|ations?)|trending|popular|teasers?|shar(e|ing)|social|follow"
    r"|ads?|adv|advert(s|isement|isements|ising|orial)?|adsense|adslot|sponsor(s|ed)?|promos?|promoted|promotions?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscri(be|ption)|signup|signin|login|paywall|search(box|form)?|pag(ination|er)|toolbar|disclaimer"
)
_HEADER = re.compile(r"(page|site)?header")
_MAIN = re.compile(r"content|article(body)?|post(content|body)?|entry(content)?|story(body)?|main(content)?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NEGATED = frozenset(("has", "no", "not", "with", "without", "hide"))


class Element:
    __slots__ = ("tag", "parent", "depth", "unseen", "aside", "article", "header", "candidate", "weight", "index", "upto")

    def __init__(self, tag: str, parent: Element | None, attrs: list[tuple[str, str | None]], index: int = 0) -> None:
        self.tag, self.parent, self.weight = tag, parent, 0
        self.index = self.upto = index  # of the elements in page order: this one, the last one inside of it
        if parent is None:
            self.depth, self.unseen, self.aside, self.article, self.header = 0, False, False, False, False
        else:
            self.depth, self.unseen, self.aside, self.article, self.header = parent.depth + 1, parent.unseen, parent.aside, parent.article, parent.header
        self.candidate = 0
        if tag in _UNSEEN:
            self.unseen = True
        elif tag in _ASIDE:
            self.aside = True
        elif tag == "header":
            self.header = True
        elif tag in _ARTICLES:
            self.candidate, self.header = 2, False
        if any(name in _TOLD for name, _ in attrs):
            self._read(tag, dict(attrs))
        self.article |= self.candidate == 2 and not self.aside

    def _read(self, tag: str, attrs: dict[str, str | None]) -> None:
        role = (attrs.get("role") or "").lower()
        if role == "main" or attrs.get("itemprop") == "articleBody":
            self.candidate = 2
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            self.unseen = True
        if tag in ("html", "body"):
            return
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        words: list[str] = []
        for name in names.split():
            own = [w.lower() for w in _WORD.findall(name)]
            own = next((own[:k] for k, w in enumerate(own) if w in _NEGATED), own)
            words += own + [a + b for a, b in zip(own, own[1:])]
        if any(map(_COMMENTS.fullmatch, words)):
            self.aside = True
        elif tag in _ARTICLES or self.candidate == 2:
            self.aside |= any(w in ("ad", "ads", "related", "sponsored", "promo", "teaser") for w in words)
        elif role in _ROLES or any(map(_ELSEWHERE.fullmatch, words)):
            self.aside = True
        elif any(map(_HEADER.fullmatch, words)):
            self.header |= tag not in _HEADINGS
        elif tag in _SECTIONS and any(map(_MAIN.fullmatch, words)):
            self.candidate = max(self.candidate, 1)


class Line:
    __slots__ = ("text", "ratio", "block", "links")

    def __init__(self, text: str, links: int, tags: int, block: Element) -> None:
        self.text, self.links, self.block = text, links, block
        self.ratio = 0.0 if self.out() else max(0, len(text) - links) / max(1, tags)

    def out(self) -> bool:
        """Whether its element says that it is something else than the article."""
        b = self.block
        return b.aside or b.header and not (b.article and b.tag in _HEADINGS)


class PageReader(HTMLParser):
    """Gives the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, [])
        self.block = self.top
        self.elements = [self.top]
        self.open: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.links = self.tags = self.in_link = 0

    def _end_line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append(Line(text, self.links, self.tags, self.block))
            self.pieces.clear()
        self.links = self.tags = 0

    def _close(self, upto: Element) -> None:
        """Closes all open elements up to this one, itself included."""
        e = self.top
        while True:
            if e.tag in _BLOCKS:
                self._end_line()
            self.open[e.tag] -= 1
            if e.tag == "a":
                self.in_link -= 1
            if e is upto:
                break
            e = e.parent
        self.top = self._shown(upto.parent)

    def _shown(self, e: Element) -> Element:
        self.block = e
        while self.block.parent is not None and self.block.tag not in _BLOCKS:
            self.block = self.block.parent
        return e

    def _close_before(self, tag: str) -> None:
        if tag in _CLOSES:
            closing, border = _CLOSES[tag]
            e = self.top
            while e.parent is not None and e.tag not in border:
                if e.tag in closing:
                    self._close(e)
                    break
                e = e.parent
        if self.open["head"] and tag not in _IN_HEAD:  # an element of the body ends the head
            e = self.top
            while e.tag != "head":
                e = e.parent
            self._close(e)
        if tag in _BLOCKS:  # and a block ends the paragraph
            e = self.top
            while e.parent is not None and (e.tag not in _BLOCKS or e.tag == "p"):
                if e.tag == "p":
                    self._close(e)
                    break
                e = e.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in _VOID and tag != "hr":
            self.tags += 1
            return
        if self.top.parent is not None:
            self._close_before(tag)
        if tag in _BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "hr":
            return
        if tag in ("td", "th"):
            self.pieces.append(" ")
        if tag == "a":
            self.in_link += 1
        self.top = Element(tag, self.top, attrs, len(self.elements))
        self.elements.append(self.top)
        self.open[tag] += 1
        if tag in _BLOCKS or self.top.aside != self.block.aside or self.top.header != self.block.header:
            if tag not in _BLOCKS:
                self._end_line()  # an inline advert or notice is a line of its own
            self.block = self.top

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag in _BLOCKS
        if not self.open[tag]:
            return
        e = self.top
        while e.parent is not None:
            if e.tag == tag:
                if e is self.block and not block:
                    self._end_line()
                self._close(e)
                return
            if not block and e.tag in _BLOCKS:
                return
            e = e.parent

    def handle_data(self, data: str) -> None:
        if self.top.unseen:
            return
        self.pieces.append(data)
        if self.in_link > 0:
            self.links += len(data)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def read(self, html: str) -> list[Line]:
        self.feed(html)
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian over the neighbours up to two sigma away; at the ends over those that there are."""
    radius = int(np.ceil(2 * sigma))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    here = slice(radius, radius + len(ratios))
    return np.convolve(ratios, weights)[here] / np.convolve(np.ones(len(ratios)), weights)[here]


def main_lines(lines: list[Line], elements: list[Element]) -> list[Line]:
    """The lines of the article, in page order. elements: of the page in order, the whole page first."""
    inside = [x for x in lines if not x.out()]
    if not inside:
        return []
    ratios = smoothed(np.array([x.ratio for x in lines]))
    least = ratios.std()
    content = [x for x, r in zip(lines, ratios) if r >= least and not x.out() and 2 * x.links < len(x.text)] or inside
    for x in content:
        x.block.weight += max(1, len(x.text) - x.links)
    for e in reversed(elements[1:]):
        e.parent.weight += e.weight
        e.parent.upto = max(e.parent.upto, e.upto)
    total = elements[0].weight
    for kind, share in ((2, 0.0), (1, 0.5)):
        best = [e for e in elements if e.candidate == kind and e.weight and not e.aside]
        if best and (most := max(e.weight for e in best)) > share * total:
            article = max((e for e in best if 2 * e.weight > most), key=lambda e: (e.depth, e.weight))
            return [x for x in inside if _within(x.block, article)]
    around = [e for e in elements if e.weight == total and e.tag in _SECTIONS]
    article = max(around, key=lambda e: e.depth, default=None)
    beside = {id(x.block.parent) for x in content}
    chosen = {id(x) for x in content}
    at = [k for k, x in enumerate(lines) if id(x) in chosen]
    return [x for k, x in enumerate(lines) if not x.out() and (article is None or _within(x.block, article)) and (at[0] <= k <= at[-1] or id(x.block.parent) in beside and 2 * x.links < len(x.text))]


def _within(e: Element, article: Element) -> bool:
    return article.index <= e.index <= article.upto


def main_text(html: str | None) -> str:
    page = PageReader()
    return "\n".join(x.text for x in main_lines(page.read(html), page.elements)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the article's lines), n_chars (its code points) of each page."""
    ids = pages.select("page_id", "url", "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(ids.dtypes)
    return ids.mapInArrow(read, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
