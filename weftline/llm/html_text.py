"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and each line has the length of its text; lines of menus,
notices, forms and the like, by their tags, roles and names, count as empty, as do lines that are mostly links. The sums
of lengths over windows of WINDOW lines rise at a surge point where the article begins and fall to nothing at a dive point
after its end; a run also ends where a mark (article, main) begins or ends. The runs that reach a share of the largest sum
are kept. A mark is only extra weight in this: MARK times for a page's one mark or a large one, and as many times less for
one of several that are small beside the text outside, such as teasers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape

from pyspark.sql import DataFrame

from .arrow import map_texts

WINDOW = 3
SURGE = 0.2  # of the largest window sum: what a run of lines must reach
LINKS = 0.5  # share of a line's characters in links from which it counts as empty, or as 1 / MARK of its length in a mark
MARK = 3  # weight of a mark
#: Elements whose text is never read, blocks, elements outside any article, and void elements.
RAW = frozenset("script style noscript template svg textarea title iframe object canvas math select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice alert newsletter subscribe subscription signup popup modal overlay nav navbar navigation menu breadcrumb"
    " breadcrumbs footer sidebar aside widget share sharing social related recommended recommendations comment comments"
    " commentlist replies disqus respond login search pagination pager toc skip".split()
)
#: Words beside names in a name of one part: "comment-list" is one, "related-work" and "has-sidebar" are none.
PARTS = frozenset("area block body bottom box container content entry form holder inner item items left list main outer panel post posts right section slot thread top wrap wrapper".split())
HEADS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements that their parent's end tag closes as well.
OPTIONAL = frozenset("p li dd dt td th tr tbody thead tfoot option".split())
#: A comment, a declaration, or the beginning of a tag: (end tag, name).
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.S)
#: The rest of a tag, in which quotes hide its end.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
DEPTH = 512  # open elements that a page can have, as in browsers; elements further in are not told apart
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|\b(hidden)\b")
_TOKENS = re.compile(r"[a-z0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(value: str, strict: bool) -> bool:
    """Whether a class or id names a part outside the article: by any token or, if strict, by a word of nothing else."""
    if not strict:
        return not NAMES.isdisjoint(_TOKENS.findall(value))
    for word in value.split():
        tokens = _TOKENS.findall(word)
        if not NAMES.isdisjoint(tokens) and all(t in NAMES or t in PARTS or t.isdigit() for t in tokens):
            return True
    return False


def _outside(tag: str, attributes: str, in_mark: bool) -> bool:
    """Whether an element is none of the article's by its tag, role, name or style."""
    if tag in OUTSIDE or (tag == "header" and not in_mark):
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and tag not in HEADS and _named(value, in_mark or tag in MARKS):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _HIDING.search(value):
            return True
    return False


class _Tags:
    """Finds tags in one pass: once quotes hide the end of a tag up to the end of the page, they hide no more."""

    def __init__(self, html: str):
        self.html, self.quotes, self.open = html, True, True

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, end tag, name, attributes) of the next tag from a place on; the name of a comment is empty."""
        while m := _OPEN.search(self.html, at):
            if not m[2]:
                return m.start(), m.end(), False, "", ""
            rest = _REST.match(self.html, m.end()) if self.quotes else None
            if rest:
                return m.start(), rest.end(), bool(m[1]), m[2].lower(), rest[1]
            self.quotes = False
            end = self.html.find(">", m.end()) if self.open else -1
            if end >= 0:
                return m.start(), end + 1, bool(m[1]), m[2].lower(), self.html[m.end() : end]
            self.open, at = False, m.end()  # no tag ends any more: the rest is text, but for comments
        return None


class _Element:
    """An open element that matters; `closed` tells whether it had its end tag, or a parent's if that is enough."""

    __slots__ = ("tag", "outside", "mark", "nth", "closed")

    def __init__(self, tag: str, outside: bool, mark: bool, nth: int):
        self.tag, self.outside, self.mark, self.nth, self.closed = tag, outside, mark, nth, False


def lines_of(html: str) -> list[tuple[str, int, bool, int]]:
    """The page's lines: (text, characters in links, whether it is outside by its elements, outermost mark or 0).

    An outside element hides the marks in it, unless it is never closed."""
    out: list[tuple[str, int, bool, int, tuple[_Element, ...]]] = []
    stack: list[_Element] = []
    parents: list[_Element] = []  # outside elements around marks, which hide these if they turn out to be closed
    parts: list[str] = []
    over: tuple[_Element, ...] = ()  # those of them that are open
    linked, links, outside, at, nth, mark, marks = 0, 0, 0, 0, 0, 0, 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def end_line() -> None:
        nonlocal linked
        line = " ".join("".join(parts).split())
        if line:
            out.append((line, linked, outside > 0, mark, over))
        parts.clear()
        linked = 0

    def pop(to: int, closed: bool) -> None:
        nonlocal outside, mark, over
        while len(stack) > to:
            e = stack.pop()
            opened[e.tag] -= 1
            e.closed = closed and (len(stack) == to or e.tag in OPTIONAL)
            if not e.closed and e.tag not in OPTIONAL:  # which of the two was left open nobody can tell
                for x in parents:
                    if x.nth > e.nth and x.tag == e.tag:
                        x.closed = False
            outside -= e.outside
            if e.mark:
                mark = 0
                outside += len(over)  # text after the mark is outside as before it
                over = ()

    n, tags = len(html), _Tags(html)
    opened: Counter = Counter()  # open elements by tag
    while found := tags.next(at):
        begin, end, closes, tag, attributes = found
        text(html[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if tag in BLOCKS:
                end_line()
            if opened[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        pop(i, True)
                        break
            if tag == "a":
                links = max(0, links - 1)
            continue
        if tag in RAW and not attributes.endswith("/"):
            closing = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
            at = closing.end() if closing else n
            continue
        if tag in BLOCKS:
            end_line()
            links = 0  # no link goes on over blocks
            if stack and stack[-1].tag == "p":  # a block ends an open paragraph
                pop(len(stack) - 1, True)
        elif tag == "br":
            parts.append(" ")
        if tag == "a":
            links += 1
        elif tag not in VOID:
            is_outside = _outside(tag, attributes, mark > 0)
            if (is_outside or tag in BLOCKS) and len(stack) < DEPTH:
                nth += 1
                begins = tag in MARKS and not mark
                if begins:
                    marks += 1
                    mark = marks
                    over = tuple(e for e in stack if e.outside)
                    parents += [e for e in over if e not in parents[-len(over) :]]
                    outside = 0
                stack.append(_Element(tag, is_outside, begins, nth))
                opened[tag] += 1
                outside += is_outside
    text(html[at:])
    end_line()
    pop(0, False)
    return [(line, linked, hidden or any(e.closed for e in above), mark) for line, linked, hidden, mark, above in out]


def window_sums(lengths: list[int]) -> list[int]:
    """Sums over WINDOW lines from each line on."""
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds; empty for null, empty pages and pages without an article."""
    # Parts of a mark that are outside leave no gap in it.
    lines = [x for x in (lines_of(html) if html else []) if not (x[2] and x[3])]
    lengths: list[float] = []
    held: dict[int, int] = {}  # text of each mark, of none under 0
    for line, linked, outside, mark in lines:
        links = linked >= LINKS * len(line)
        length = 0 if outside else (len(line) / MARK if mark else 0) if links else len(line)
        lengths.append(length)
        held[mark] = held.get(mark, 0) + (len(line) if length else 0)
    free = held.pop(0, 0)
    weights = {mark: MARK if len(held) == 1 or 2 * n >= free else 1 / MARK for mark, n in held.items()}
    runs = []  # (mark, largest sum, lines): from a surge to a dive
    start = 0
    while start < len(lines):
        mark, stop = lines[start][3], start
        while stop < len(lines) and lines[stop][3] == mark:
            stop += 1
        sums = window_sums(lengths[start:stop])
        at = 0
        while at < len(sums):
            end = at
            while end < len(sums) and sums[end]:
                end += 1
            if end > at:
                runs.append((mark, max(sums[at:end]), [lines[start + i][0] for i in range(at, end) if lengths[start + i]]))
            at = end + 1
        start = stop
    plain = max((top for _, top, _ in runs), default=0)
    weighted = max((top * weights.get(mark, 1) for mark, top, _ in runs), default=0)
    kept: list[str] = []
    for mark, top, texts in runs:
        # A mark is held against sums as they are, the text outside against sums with the weights of marks.
        if top * weights[mark] >= SURGE * plain if mark else top >= SURGE * weighted:
            kept += texts
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep=("url",)) -> DataFrame:
    """(key, *keep, text, n_chars) of every row of pages; n_chars counts code points.

    Null and empty pages give an empty text. Repeated rows stay; no rows give no rows. There is no shuffle."""

    def texts() -> Callable:
        def run(htmls: list[str | None]) -> list[list]:
            found = [main_text(h) for h in htmls]
            return [found, [len(t) for t in found]]

        return run

    return map_texts(pages, html, {key: key, **{c: c for c in keep}}, "text string, n_chars long", texts)
