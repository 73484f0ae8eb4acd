"""Leaf blocks of an HTML page: the text between block-level tags, with its open elements."""

from __future__ import annotations

import html
import re
from collections import Counter

# Elements that stay inside a block; every other tag ends one.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
                   "nobr q s samp small span strike strong sub sup time tt u var wbr "
                   # formulas are part of their sentence
                   "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
                   "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page; one that is never closed has no content.
RAW = frozenset("script style title textarea iframe svg annotation annotation-xml".split())
# Elements that may stand in a paragraph and count as open only if they are closed somewhere.
CLOSED = frozenset("noscript object select template".split())
# What may stand in a head; anything else, and text, ends it.
HEAD = frozenset("base link meta noscript object script style template title".split())
# An opening tag on the left ends an open element of the kinds on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead"}

OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
# where no ">" follows, only these can begin anything
UNENDED = re.compile(r"<!--|<!\[CDATA\[")
SPECIAL = re.compile("[>\"']")
DEPTH = 256                     # innermost open elements that a block's path names
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|itemprop|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Block:
    __slots__ = ("text", "path", "link")

    def __init__(self, text, path, link):
        self.text, self.path, self.link = text, path, link


def names(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role; 'hidden' for an element that is not shown."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("style", "hidden", "aria-hidden"):
            if kind == "hidden" or value == "true" or SPLIT.sub("", value).find("displaynone") >= 0:
                out.append("hidden")
        else:
            out += [x for x in SPLIT.split(value) if x]
    return tuple(out)


class _Marks:
    """Finds the marks of a page from left to right in linear time, whatever is left open.

    A tag ends at the first ">" outside quotes; if none follows, at the first ">" at all. A
    place from which no ">" outside quotes follows is remembered, and so is where a kind of
    quote last occurs, so no stretch is read again and again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")
        self.last_special = max(self.last_end, page.rfind('"'), page.rfind("'"))
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def tag_end(self, at: int) -> int:
        """End of a tag whose name ends at ``at`` (a ">" follows somewhere)."""
        passed, place = [], at
        while place <= self.last_special:
            m = SPECIAL.search(self.page, place)
            if m[0] == ">":
                return m.end()
            if self.last_quote[m[0]] < m.end():
                break
            place = self.page.find(m[0], m.end()) + 1
            if place in self.dead:
                break
            passed.append(place)
        self.dead.update(passed)
        return self.page.find(">", at) + 1

    def next(self, at: int):
        """(begin, end, closing, tag or None, attributes) of the next mark from ``at``; None: there is none."""
        page = self.page
        while True:
            m = (OPENING if at <= self.last_end else UNENDED).search(page, at)
            if not m:
                return None
            if m[0] in ("<!--", "<![CDATA["):
                close = "-->" if m[0] == "<!--" else "]]>"
                end = page.find(close, m.end())
                return m.start(), len(page) if end < 0 else end + 3, False, None, ""
            if m.end() > self.last_end:
                at = m.start() + 1                      # it never ends: text
                continue
            if m[0] in ("<!", "<?"):
                return m.start(), page.find(">", m.end()) + 1, False, None, ""
            end = self.tag_end(m.end())
            return m.start(), end, bool(m[1]), m[2].lower(), page[m.end():end - 1]


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. ``path``: (tag, names) of the open block elements, the
    innermost ``DEPTH``. Time is linear in the page, also where marks are never closed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked, links = 0, 0
    at, n = 0, len(page)
    head = False
    ends: dict[str, tuple[int, int]] = {}
    marks = _Marks(page)
    opened: Counter = Counter()

    def cut(k):
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    def closing_tag(tag):
        """(begin, end) of the next closing tag; begin is ``n`` if there is none."""
        if ends.get(tag, (-1, 0))[0] < at:
            m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(page, at)
            ends[tag] = (m.start(), page.find(">", m.end()) + 1) if m and m.end() <= marks.last_end else (n, n)
        return ends[tag]

    def end_head():
        nonlocal head
        if head:
            stack[:] = [x for x in stack if x[0] != "head"]
            opened["head"] = 0
            head = False

    def flush():
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, tuple(stack[-DEPTH:]), min(linked, len(text))))
            parts, linked = [], 0

    while at < n:
        mark = marks.next(at)
        stop = mark[0] if mark else n
        if stop > at:
            if stack and stack[-1][0] == "head" and not page[at:stop].isspace():
                end_head()
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not mark:
            break
        _, at, closing, tag, attributes = mark
        if tag is None:
            if page.startswith("<![CDATA[", stop):
                parts.append(html.escape(page[stop + 9:at].removesuffix("]]>"), quote=False))
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                begin, end = closing_tag(tag)
                if begin < n:                           # never closed: read on after the opening tag
                    at = end
            continue
        if closing:
            if opened[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in VOID:
            continue
        if tag not in HEAD:                             # also a second head
            end_head()
        if tag in CLOSED and closing_tag(tag)[0] == n:
            continue
        if stack and stack[-1][0] == "p" and tag not in CLOSED:
            cut(len(stack) - 1)                         # a block element ends an open paragraph
        if tag in ENDS and any(opened[x] > 0 for x in ENDS[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS[tag]:
                    cut(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        head = head or tag == "head"
        opened[tag] += 1
        stack.append((tag, names(attributes) if attributes else ()))
    flush()
    return out
