"""Text lines of an HTML page, each with the kind of place it stands in."""

from __future__ import annotations

import html
import re
from functools import reduce

OUTSIDE, ARTICLE, FURNITURE, MAIN = 0, 1, 2, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[!?/a-zA-Z][^>]*\Z",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")

#: Elements by their part in a page (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "head"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "label", "fieldset"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Names in class, id or role that say by themselves that something isn't the article (fixed values).
MARKS = re.compile(
    r"(?:^|[\s\"'])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead"
    r"|comments?|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|subscription|popup|modal|overlay|login|search|contentinfo|complementary|toolbar|widget"
    r"|(?:ads?|advert|cookie|consent|comment|sidebar|share|sharing|social|related|newsletter|promo|sponsor|banner|notice|nav|menu)s?[-_]"
    r"(?:area|bar|block|box|buttons?|container|content|form|icons?|inner|items?|left|links?|list|main|notice|panel|posts?|primary|right|section|slot|thread|top|unit|widget|wrap|wrapper)"
    r"|(?:site|page|main|top|global|user|reader|bottom|cookie|side)[-_](?:header|footer|nav|menu|comments?|notice|bar|banner|ads?))(?=$|[\s\"'])",
    re.I,
)
#: Names that only begin like those: what they name goes if it is mostly links, or if the nearest page has it too (fixed values).
HINTS = re.compile(r"(?:^|[\s\"'])(?:ad|advert|cookie|consent|comment|sidebar|share|social|related|newsletter|promo|sponsor|banner|notice|nav|menu)s?[-_][\w-]+(?=$|[\s\"'])", re.I)
#: Elements whose names mark nothing, since they are around the article or are it; those that tell that a form is the whole page.
FRAMES, PARTS = {"html", "body", "main", "article"}, {"nav", "header", "footer", "main", "article"}
BY_ELEMENT, BY_NAME, BY_HINT = 1, 2, 3


class _Area:
    """An element that marks what stands in it, or an article or main."""

    __slots__ = ("chars", "cleared", "links", "mark", "name", "outer", "state")

    def __init__(self, name: str, mark: int, outer: _Area | None):
        self.name, self.mark, self.outer = name, mark, outer
        self.chars = self.links = 0
        self.cleared, self.state = False, None

    def around(self) -> list[_Area]:
        found, area = [], self.outer
        while area:
            found.append(area)
            area = area.outer
        return found


def _mark(name: str, attributes: str, in_article: bool) -> int:
    """What an element's name and its class, id and role say."""
    if name in FRAMES:
        return 0
    if name in CHROME and not (name == "header" and in_article):  # an article's header is its title
        return BY_ELEMENT
    said = [x.strip("\"'") for x in _NAMES.findall(attributes)]
    if any(m[0].strip(" \t\r\n\f\"'").lower() != "header" or not in_article for x in said for m in MARKS.finditer(x)):
        return BY_NAME
    return BY_HINT if any(HINTS.search(x) for x in said) else 0


def _kind(area: _Area | None, least: int) -> tuple[int, bool]:
    """(kind, whether a hint is around it) of what stands in the area; marks below `least` count."""
    if area is None:
        return OUTSIDE, False
    if area.state is None:
        kind, hinted = _kind(area.outer, least)
        if kind != FURNITURE:
            counts = area.mark and area.mark <= least and not area.cleared
            if counts and (area.mark != BY_HINT or 2 * area.links >= area.chars):
                kind = FURNITURE
            elif counts:
                hinted = True
            elif area.name == "article":
                kind = ARTICLE
            elif area.name == "main" and kind != ARTICLE:
                kind = MAIN
        area.state = kind, hinted
    return area.state


def lines(page: str) -> list[tuple[str, int, bool]]:
    """Blocks of the page in order, white space made single blanks, without empty ones: text, kind, and whether only a hint marks it or it is mostly links.

    A mark counts for all that stands in its element, but if every article (without one, every main) stands
    in marked elements, those around the longest one mark nothing; nor does a form around a page's parts. If
    nothing is left of a page, names mark nothing in it, and if that isn't enough elements don't either.
    """
    out: list[tuple[str, _Area | None, bool]] = []
    areas: list[_Area] = []
    stack: list[tuple[str, _Area | None]] = []
    forms: list[_Area] = []  # open ones that aren't cleared
    open_: dict[str, int] = {}  # open elements by name, so that an end without a start costs nothing
    area: _Area | None = None
    text, linked, at = [], 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            if line := _SPACE.sub(" ", html.unescape("".join(text))).strip():
                links = min(linked, len(line))
                out.append((line, area, 2 * links >= len(line)))
                if area:
                    area.chars += len(line)
                    area.links += links
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal area
        for name, own in stack[depth:]:
            open_[name] -= 1
            if name == "form" and forms and forms[-1] is own:
                forms.pop()
        del stack[depth:]
        now = stack[-1][1] if stack else None
        if now is not area:
            flush()
            area = now

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            if open_.get("a"):
                linked += m.start() - at
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends = bool(m[1] or m[4])
        if name not in INLINE:
            flush()
        if ends:
            if open_.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                body = re.compile(r"<body\b", re.I).search(page, at) if name == "head" else None
                at = min(end.end() if end else len(page), body.start() if body else len(page))
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            if stack and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or stack and stack[-1][0] == "p":
                _imply(name, stack, close)
        if name in PARTS:
            for form in forms:
                form.cleared = True
            forms.clear()
        mark = _mark(name, attributes, bool(open_.get("article")))
        inside = area
        if mark or name in ("article", "main"):
            flush()
            inside = _Area(name, mark, area)
            areas.append(inside)
            if name == "form":
                forms.append(inside)
        stack.append((name, inside))
        open_[name] = open_.get(name, 0) + 1
        area = inside
    text.append(page[at:])
    flush()
    for a in reversed(areas):
        if a.outer:
            a.outer.chars += a.chars
            a.outer.links += a.links
    for a in areas:  # from the outside in, so that each asks its outer one's kind only
        _kind(a, BY_HINT)
    for name in ("article", "main"):
        own = [a for a in areas if a.name == name]
        if own:
            if all(a.state[0] == FURNITURE for a in own):
                for a in max(own, key=lambda a: a.chars).around():
                    a.cleared = True
            break
    found: list[tuple[str, int, bool]] = []
    for least in (BY_HINT, BY_ELEMENT, 0):
        for a in areas:
            a.state = None
        for a in areas:
            _kind(a, least)
        found = [(line, (kind := _kind(a, least))[0], kind[1] or links) for line, a, links in out]
        if any(kind != FURNITURE for _, kind, _ in found):
            break
    return found


def _imply(name: str, stack: list[tuple[str, _Area | None]], close) -> None:
    """Ends that HTML leaves out: a paragraph before a block, an item before the next one."""
    ended = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
    for i in range(len(stack) - 1, -1, -1):
        open_ = stack[i][0]
        if open_ == "p" or open_ in ended:
            close(i)
            return
        if open_ not in INLINE:
            return


#: Places of a line from which on their bits are kept.
OFTEN = 64


def shared(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b, by bit-parallel rows."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = {*range(low), *range(len(a) - high, len(a))}
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    # a line's places in b as bits: kept for lines that are there often, made anew for the others, so that they take little memory
    often = {x: reduce(lambda bits, j: bits | 1 << j, at, 0) for x, at in places.items() if len(at) > OFTEN}
    full = (1 << len(b)) - 1

    def bits(x) -> int:
        found = often.get(x)
        return reduce(lambda made, j: made | 1 << j, places.get(x, ()), 0) if found is None else found

    def below(row: int, items: list) -> list[int]:
        """Rows from `row` on; a zero at j in row i: a[:i] matches one more line of b[: j + 1] than of b[:j]."""
        out = [row]
        for x in items:
            u = out[-1] & bits(x)
            out.append(((out[-1] + u) | (out[-1] - u)) & full)
        return out

    step = int(len(a) ** 0.5) + 1
    kept = [full]  # each step-th row; the others are made again on the way back, so that long pages take little memory
    for first in range(0, len(a) - step, step):
        kept.append(below(kept[-1], a[first : first + step])[-1])
    j = len(b)
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        rows = below(kept[block], a[first : first + step])
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.add(low + first + i)
    return found
