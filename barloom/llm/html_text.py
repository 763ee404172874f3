"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import by_pieces, input_columns

#: Spread of the smoothing, in lines.
SIGMA = 1.5
#: A line's smoothed ratio counts as content from this share of the page's deviation.
THRESHOLD = 0.5

# Names of elements as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input label math menu nav noembed noframes noscript object option script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# Words in a class or id that say what a container is for.
PURPOSE = frozenset(
    """ad ads adbox adsense adslot advert adverts advertisement advertising banner billboard sponsor sponsored sponsors promo promos promoted
    promotion cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay toast paywall subscribe
    subscription newsletter signup signin login register nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pager pagination
    sidebar sidebars aside rail footer footnav header masthead topbar toolbar social share sharing sharebar follow comment comments commentlist
    reply replies respond disqus discussion responses related recommended recommendations widget widgets search searchbox skip""".split()
)
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion responses".split())
# Before such a word, a class or id speaks of the layout: "with-sidebar", "no-header".
MODIFIERS = frozenset("with without no has".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


_P = frozenset(["p"])
# Open elements that a start tag ends, where they are the innermost block, as the HTML standard has it.
ENDS = {t: _P for t in "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()}
ENDS |= {"li": _P | {"li"}} | dict.fromkeys(["dt", "dd"], _P | {"dt", "dd"}) | dict.fromkeys(["option", "optgroup"], frozenset(["option"]))
ENDS |= dict.fromkeys(["td", "th"], _P | {"td", "th"}) | {"tr": _P | {"td", "th", "tr"}}
ENDS |= dict.fromkeys(["tbody", "thead", "tfoot"], _P | {"td", "th", "tr", "tbody", "thead", "tfoot"})


class Lines(HTMLParser):
    """Turns parser events into lines, one per block: text, tags seen, innermost open container, boilerplate, nothing but links.

    Containers are numbered as they open; each keeps the number of the one around
    it, so a line costs the same at any depth. Boilerplate is ``None`` inside
    elements that are it by tag or role, else the innermost open container that is
    it by name alone, -1 without one; an article is not inside what is open around it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int | None]] = []  # name, number, boilerplate
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
        self.blocks: list[int] = []  # where in the stack the elements that are not inline are
        self.names: list[str] = []
        self.parents: list[int] = []
        self.readers: list[bool] = []  # whether a container is, or is inside, a part of readers
        self.articles: list[bool] = []  # whether it is, or is inside, an article or main element that is not one of readers
        self.linked: list[bool] = []  # whether it is, or is inside, a link
        self.lines: list[tuple[str, int, int, int | None, bool]] = []
        self.around: dict[int, int] = {}  # of a container that is boilerplate by name: the next one outside it
        self.only_named: set[int] = set()  # containers whose names say nothing but boilerplate, or readers
        self.text: list[str] = []
        self.plain = False  # whether the line has text outside links
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.lines.append((text, self.tags, self._innermost(), self.stack[-1][2] if self.stack else -1, not self.plain))
            self.tags = 0
        self.plain = False

    def _innermost(self) -> int:
        return self.stack[-1][1] if self.stack else -1

    def _close(self, at: int) -> None:
        """Close the open elements from a place in the stack on."""
        for name, _, _ in reversed(self.stack[at:]):
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        ended = ENDS.get(tag, ())
        while ended and self.blocks and self.stack[self.blocks[-1]][0] in ended:
            self._close(self.blocks[-1])
        self.tags += 1
        if tag in VOID:
            return
        outer = self.stack[-1][2] if self.stack else -1
        inside = self._innermost()
        by_tag = tag in BOILERPLATE or bool(attrs) and marked(attrs)
        by_name = not by_tag and bool(attrs) and named(tag, attrs)
        own = by_tag or by_name
        if own and outer is not None:
            self.flush()  # an inline element may be boilerplate too
        if tag == "main" or tag == "article" and not own and not (inside >= 0 and self.readers[inside]):
            outer = -1  # whatever was left open before does not hold the article
        if by_name and outer is not None:
            self.around[len(self.names)] = outer
            outer = len(self.names)
            if reader_marked(attrs) or _words(attrs) <= PURPOSE:
                self.only_named.add(outer)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, len(self.names), None if by_tag else outer))
        self.names.append(tag)
        self.parents.append(inside)
        of_readers = own and reader_marked(attrs)
        self.readers.append(of_readers or inside >= 0 and self.readers[inside])
        self.articles.append(tag in ("article", "main") and not of_readers or inside >= 0 and self.articles[inside])
        self.linked.append(tag == "a" and any(k == "href" for k, _ in attrs) or inside >= 0 and self.linked[inside])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.places.get(tag)
        at = places[-1] if places else None
        if tag not in INLINE or at is not None and self.stack[at][2] != (self.stack[at - 1][2] if at else -1):
            self.flush()
        if at is not None and not (tag in INLINE and self.blocks and self.blocks[-1] > at):
            self._close(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if not self.plain and not data.isspace():
            self.plain = not (self.stack and self.linked[self._innermost()])

    def path(self, element: int) -> list[int]:
        """The containers around an element, outermost first, itself last."""
        found = []
        while element >= 0:
            found.append(element)
            element = self.parents[element]
        return found[::-1]

    def inside(self, element: int) -> tuple[int, int]:
        """First and last number of an element and those inside it."""
        last = element
        while last + 1 < len(self.parents) and self.parents[last + 1] >= element:
            last += 1
        return element, last

    def at_depth(self, depth: int) -> list[int | None]:
        """For each container the one around it, or itself, that has ``depth`` others around it."""
        levels: list[int] = []
        found: list[int | None] = []
        for e, outer in enumerate(self.parents):
            levels.append(levels[outer] + 1 if outer >= 0 else 0)
            found.append(e if levels[e] == depth else found[outer] if outer >= 0 else None)
        return found


def _words(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words of class and id, without those that a modifier stands before."""
    names = [[w.lower() for w in _TOKENS.findall(name)] for k, v in attrs if k in ("class", "id") and v for name in v.split()]
    return {w for words in names for i, w in enumerate(words) if i == 0 or words[i - 1] not in MODIFIERS}


def reader_marked(attrs: list[tuple[str, str | None]]) -> bool:
    return bool(_words(attrs) & READERS)


def marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's role or style makes it boilerplate."""
    given = dict(attrs)
    if (given.get("role") or "").strip().lower() in ROLES or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
        return True
    return "display:none" in (given.get("style") or "").replace(" ", "").lower()


def named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's class or id names it as boilerplate."""
    return tag not in ("body", "html", "main") and bool(_words(attrs) & (READERS if tag == "article" else PURPOSE))


def smoothed_ratios(lines: list[tuple[int, int]], sigma: float = SIGMA) -> np.ndarray:
    """Characters per tag of each line, smoothed by a Gaussian over its neighbours."""
    ratio = np.array([chars / max(1, tags) for chars, tags in lines], float)
    reach = min(len(ratio) - 1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def core_lines(lines: list[tuple]) -> tuple[list[int], list[int], list[int]]:
    """Lines whose smoothed ratio reaches the threshold, those of them that are more than links next to text, and those that reach it by their own."""
    ratios = smoothed_ratios([(len(x[0]), x[1]) for x in lines])
    limit = min(THRESHOLD * ratios.std(), ratios.max())
    core = np.flatnonzero(ratios >= limit).tolist()
    own = [i for i in core if len(lines[i][0]) / max(1, lines[i][1]) >= limit]
    reached = set(own)
    return core, [i for i in core if i in reached or not lines[i][4]] or core, own


def outside_boilerplate(parser: Lines) -> list[tuple]:
    """Lines outside boilerplate, where a name counts unless its container holds most of the page's text.

    Names that say nothing but boilerplate, and those of readers' parts, count
    unless there is no text but theirs; with an article or main element on the
    page, every name counts.
    """
    lines = [x for x in parser.lines if x[3] is not None]
    if all(x[3] == -1 for x in lines):
        return lines
    _, ends, own = core_lines(lines)
    held = dict.fromkeys(parser.around, 0) | {-1: 0}
    for i in ends:
        held[lines[i][3]] += len(lines[i][0])
    total = sum(held.values())
    for e in sorted(parser.around, reverse=True):
        if parser.around[e] != -1:
            held[parser.around[e]] += held[e]
    free = {-1}
    for e in sorted(e for e in parser.around if 2 * held[e] > total):  # each lies in the one before
        if e in parser.only_named and any(lines[i][3] in free for i in own):
            break
        free.add(e)
    if len(free) > 1:
        if any(x[3] == -1 and x[2] >= 0 and parser.articles[x[2]] for x in lines):
            free = {-1}
    return [x for x in lines if x[3] in free]


def common(parser: Lines, elements: list[int]) -> list[int]:
    """The containers around all of some elements: those around the first and the last of them."""
    low, high = parser.path(min(elements)), parser.path(max(elements))
    return low[: next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by one space.

    Lines outside boilerplate are clustered by their smoothed ratio; the region
    of content is the article or main element that holds most of the text of the
    lines above the threshold, else the lowest container around all of those
    lines, with its short lines too. A line of nothing but links that is above the
    threshold by its neighbours alone does not widen the container. Null and empty
    pages, and pages of boilerplate tags or roles alone, give empty text; plain
    text counts as one line.
    """
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = outside_boilerplate(parser)
    if not lines:
        return ""
    core, ends, _ = core_lines(lines)
    weight = [0] * len(parser.names)
    for i in core:
        if lines[i][2] >= 0:
            weight[lines[i][2]] += len(lines[i][0])
    for e in range(len(weight) - 1, 0, -1):  # the inner ones have the larger numbers
        if parser.parents[e] >= 0:
            weight[parser.parents[e]] += weight[e]
    total = sum(len(lines[i][0]) for i in core)
    inner = next((e for e in range(len(weight) - 1, -1, -1) if weight[e] >= 0.8 * total), -1)
    article = next((e for e in parser.path(inner) if parser.names[e] in ("article", "main")), None)
    around = common(parser, [lines[i][2] for i in ends])
    region = next((e for e in reversed(around) if parser.names[e] in ("div", "section", "td", "center")), None)
    if article is not None or region is not None:
        first, last = parser.inside(region if article is None else article)
        return " ".join(x[0] for x in lines if first <= x[2] <= last)
    depth = next((i for i, e in enumerate(around) if parser.names[e] not in ("html", "body")), len(around))
    holders = [*parser.at_depth(depth), None]  # the last for lines outside all containers
    first, last = ends[0], ends[-1]
    while first > 0 and holders[lines[first][2]] is not None and holders[lines[first - 1][2]] == holders[lines[first][2]]:
        first -= 1
    while last + 1 < len(lines) and holders[lines[last][2]] is not None and holders[lines[last + 1][2]] == holders[lines[last][2]]:
        last += 1
    first, last = min(first, core[0]), max(last, core[-1])
    return " ".join(x[0] for x in lines[first : last + 1])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; rows that repeat stay, other columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = input_columns(pages, page_id=page_id, url=url, html=html)
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return source.withColumn("html", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
