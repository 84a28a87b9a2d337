"""Main text of web pages by the distribution of line blocks.

1. Markup is stripped. Every block element starts a line, every bound of a container
   (div, section, table and the like) leaves an empty line; comments, scripts, styles and
   other elements without readable text go, as do elements that are furniture by their
   kind (nav, footer, aside, form, or a role of that sort).
2. Lines run in flows: that of the page, one for each article or main element, and one for
   each element whose class or id holds a name of furniture. A line weighs its length; one
   that is mostly links weighs nothing, unless it stands alone between two lines of prose.
   In an article a line weighs RAISE times as much; behind a name of furniture a part of
   it, DOUBTED, or DISMISSED where the element has no other name. An article within such
   an element is a flow of its own and not doubted.
3. The weights are summed over windows of WINDOW lines of a flow. A window of sum 0 is a
   dive point; what lies between two dives is a block. A block with a window whose sum
   exceeds the surge has a surge point. On a page with an article the surge asked for is
   MARKED times as high. Without any surge the block that weighs most is taken.
4. The lines with weight of the blocks with a surge are kept, in page order.

So neither a tag nor a name decides by itself: an article surges by more than 40
characters in three lines, text beside it by more than 320, text behind a name of
furniture by eight or sixty-four times as many as without it. A short article beside
text that surges is lost, and furniture without any usual name within an article is kept.

Within a line character references are decoded and white space is folded; lines are
joined by one space. The end tags that HTML lets out (p, li, dt, dd, option, tr, td, th)
are implied, so an element ends where the next one begins. A paragraph in an article whose
class only hints at furniture (HINTS) is like any other if it has SURGE characters or more.

Defined cases: a null or empty page has the empty text, as has one of furniture only; of
blocks that weigh the same the first is taken; repeated rows give equal texts; unclosed
elements end with the page; an empty table gives an empty result; other columns are
ignored, also those called text or n_chars.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: What a character weighs: on the page, in an article (RAISE times as much), and behind a name of furniture.
ONE, RAISE, DOUBTED, DISMISSED = 64, 8, 1 / 8, 1 / 64
#: How many times the surge is asked for on a page with an article.
MARKED = 4
LINKED = 0.5

# Element names of the HTML standard and usual names of page furniture.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas")
FURNITURE = frozenset("head nav header footer aside form menu dialog button select fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo "
    "related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
HINTS = frozenset("ad ads banner comment comments header menu notice related reply share sharing social widget".split())
LINES = frozenset("address br caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option p pre summary td th title tr".split())
CONTAINERS = frozenset(
    "article aside blockquote body center details dialog dir div dl fieldset figure footer form head header html main menu nav ol section table tbody tfoot thead ul".split()
)
BLOCKS = LINES | CONTAINERS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out, and the start tags that imply it.
IMPLIED = {
    "p": BLOCKS - {"br"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")

# What a line is: prose, mostly links, or furniture and empty.
PROSE, LINKS, EMPTY = range(3)


def _named(name: str, rest: str) -> tuple[bool, float, bool]:
    """(whether an element is furniture by its kind, what its names leave of a line's weight, whether no more than hints say so)."""
    if name in FURNITURE:
        return True, 0, False
    if not rest or name in ("html", "body", "article", "main") or "=" not in rest:
        return False, 1, False
    found, parts = set(), set()
    for kind, *value in _NAMED.findall(rest):
        own = set(filter(None, _PARTS.split("".join(value).lower())))
        if kind.lower() == "role":
            if ROLES & own:
                return True, 0, False
        else:
            found |= NAMES & own
            parts |= own
    return False, 1 if not found else DISMISSED if found == parts else DOUBTED, found <= HINTS


class Line:
    """A line of text: what it is, its flow, and its share of a full weight."""

    __slots__ = ("text", "kind", "flow", "share")

    def __init__(self, text: str, kind: int, flow: int, share: float):
        self.text, self.kind, self.flow, self.share = text, kind, flow, share


class _Scope:
    """An open element that decides for what stands in it, with the flow and share around it."""

    __slots__ = ("flow", "hinted", "kind", "opened", "share")

    def __init__(self, kind: int, name: str, flow: int, share: float, hinted: bool = False):
        self.kind, self.opened, self.flow, self.share, self.hinted = kind, [name], flow, share, hinted


#: Scopes: furniture by its kind, an element with a name of furniture, an article.
BARRED, NAMED, ARTICLE = range(3)


class _Page:
    """The lines of a page, built tag by tag."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.flow, self.flows, self.share = 0, 1, 1.0
        self.scopes: list[_Scope] = []
        self.marked = False
        self.in_link = self.fresh_link = False

    def within(self, kind: int) -> bool:
        return bool(self.scopes) and self.scopes[-1].kind == kind

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.in_link:
            self.linked += len(piece.strip())

    def empty(self, n: int = 1) -> None:
        """Empty lines part the blocks of the page; an article and what has a name of furniture are one block each."""
        if self.flow == 0:
            self.lines += [Line("", EMPTY, 0, 1)] * n

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text and self.within(BARRED):
                self.empty()
            elif text:
                links = self.linked > LINKED * len(text)
                plain = self.within(NAMED) and self.scopes[-1].hinted and len(text) >= SURGE and not links
                flow, share = (self.scopes[-1].flow, self.scopes[-1].share) if plain else (self.flow, self.share)
                self.lines.append(Line(text, LINKS if links else PROSE, flow, share))
            self.parts.clear()
        self.linked = 0

    def enter(self, kind: int, name: str, share: float, hinted: bool = False) -> None:
        self.scopes.append(_Scope(kind, name, self.flow, self.share, hinted))
        if kind != BARRED:
            self.flow, self.flows, self.share = self.flows, self.flows + 1, share

    def leave(self) -> None:
        scope = self.scopes.pop()
        self.flow, self.share = scope.flow, scope.share

    def tag(self, name: str, end: bool, rest: str) -> None:
        if name in BLOCKS:
            self.flush()
            if end and self.fresh_link:  # a link that its block leaves open ends with it
                self.in_link = False
            self.fresh_link = False
        if self._inside(name, end):
            return
        if name in ("article", "main"):
            self._article(name, end)
            return
        if name == "a":
            self.in_link = self.fresh_link = not end
        if not end and name not in VOID:
            furniture, share, hints = _named(name, rest)
            if furniture or (share < 1 and not self.within(NAMED)):
                self.flush()
                article = self.within(ARTICLE)
                self.enter(BARRED if furniture else NAMED, name, self.share * share, hints and name == "p" and article)
                return
        if name in CONTAINERS:
            self.empty()

    def _article(self, name: str, end: bool) -> None:
        if not end:
            self.empty(WINDOW)
            self.enter(ARTICLE, name, RAISE)
            self.marked = True
        elif any(x.kind == ARTICLE for x in self.scopes):
            while not self.within(ARTICLE):
                self.leave()
            self.leave()
            self.empty(WINDOW)

    def _inside(self, name: str, end: bool) -> bool:
        """Follows the elements of the scopes; whether the tag is done with."""
        while self.scopes and self.scopes[-1].kind != ARTICLE:
            scope = self.scopes[-1]
            if end and name not in scope.opened and any(name in x.opened for x in self.scopes[:-1]):
                self.leave()  # what stands around it ends, and so does it
                continue
            if scope.kind == NAMED and name in ("article", "main", "a"):
                return False  # an article within a mere name is one of its own
            belongs = self._follow(scope.opened, name, end)
            if scope.opened:
                return belongs and (scope.kind == BARRED or end)
            self.leave()
            if belongs:
                return True
        return False

    def _follow(self, opened: list[str], name: str, end: bool) -> bool:
        """Notes an element's begin or end among the open ones; whether it belongs to them."""
        if name not in BLOCKS and name not in opened:
            return True
        if end:
            if name in opened:
                del opened[len(opened) - 1 - opened[::-1].index(name) :]
                return True
            if name in BLOCKS and all(x in IMPLIED for x in opened):
                opened.clear()  # the end of what it stands in
                return False
            return True
        while opened and name in IMPLIED.get(opened[-1], ()):
            opened.pop()
        if opened == ["head"] and name == "body":
            opened.clear()
        if not opened:
            return False
        if name not in VOID:
            opened.append(name)
        return True


def lines_of(page: str) -> tuple[list[Line], bool]:
    """(the lines of a page in its order, whether it marks an article)."""
    made = _Page()
    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            made.text(page[at : m.start()])
        at = m.end()
        if m["name"] is not None:
            made.tag(m["name"].lower(), bool(m["end"]), m["rest"])
    if at < len(page):
        made.text(page[at:])
    made.flush()
    return made.lines, made.marked


def weights(lines: list[Line]) -> list[int]:
    """What each line of a flow weighs."""
    texts = [i for i, x in enumerate(lines) if x.kind != EMPTY]
    alone = set()
    for before, i, after in zip(texts, texts[1:], texts[2:], strict=False):
        if after <= before + 2 + 2 * (after - before > 2) and lines[before].kind == PROSE == lines[after].kind:
            alone.add(i)
    return [int(ONE * x.share * len(x.text)) if x.kind == PROSE or i in alone or (x.kind == LINKS and x.share > 1) else 0 for i, x in enumerate(lines)]


def blocks(weighed: list[int]) -> list[tuple[int, list[int]]]:
    """(greatest sum of a window, places of the lines with weight) of what lies between two dives."""
    padded = [*weighed, *[0] * WINDOW]
    sums = sum(padded[:WINDOW])
    found: list[tuple[int, list[int]]] = []
    most, places = 0, []
    for i, weight in enumerate(weighed):
        if weight:
            places.append(i)
            most = max(most, sums)
        elif not sums and places:
            found.append((most, places))
            most, places = 0, []
        sums += padded[i + WINDOW] - weight
    return [*found, (most, places)] if places else found


def between_surge_and_dive(lines: list[Line], surge: int) -> list[int]:
    """The places of the lines that are kept."""
    flows: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        flows.setdefault(x.flow, []).append(i)
    found = []
    for places in flows.values():
        weighed = weights([lines[i] for i in places])
        found += [(most, sum(weighed[i] for i in kept), [places[i] for i in kept]) for most, kept in blocks(weighed)]
    surged = sorted(i for most, _, kept in found if most > surge for i in kept)
    return surged or max(found, key=lambda b: (b[1], -b[2][0]), default=(0, 0, []))[2]


def main_text(page: str | None) -> str:
    """The text between the surge and dive points of a page."""
    lines, marked = lines_of(page or "")
    return " ".join(lines[i].text for i in between_surge_and_dive(lines, ONE * SURGE * (MARKED if marked else 1)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per page."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
