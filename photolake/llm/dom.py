"""Text blocks of a web page, with what the markup around each says of it. One pass, linear in the page."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

# Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript textarea title iframe noembed noframes svg math canvas audio video select object xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE_TAGS = frozenset("nav footer aside form menu search dialog button fieldset".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar status".split())
# Words of class and id that name what stands beside an article, alone or as the beginning of a word.
BESIDE_WORDS = frozenset(
    "ad ads adv advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social follow "
    "related recommended trending popular breadcrumb breadcrumbs menu menus nav navbar navigation sidebar sidebars aside rail widget widgets footer masthead topbar header comment comments disqus "
    "reply replies respond discussion form search pagination pager toolbar copyright legal disclaimer skip tagcloud".split()
)
BESIDE_STEMS = ("advert", "sponsor", "cookie", "newsletter", "subscri", "recommend", "breadcrumb", "navig", "navbar", "sidebar", "footer", "comment", "paginat", "copyright", "disclaim")
QUALIFIERS = frozenset("has with without no open closed enabled disabled count".split())
MAIN_WORDS, BODY_WORDS = frozenset("article entry post story main".split()), frozenset("content body text prose articlebody maincontent".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SUBWORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in SKIPPED}
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
NEUTRAL, BESIDE, MAIN, HINT = 0, 1, 2, 3


def named(words: str) -> int:
    """What a class or id says: BESIDE an article, MAIN for its text, HINT for perhaps, or NEUTRAL."""
    main = hint = False
    for word in words.split():
        parts = {p.lower() for p in _SUBWORD.findall(word)}
        if parts & QUALIFIERS:
            continue
        beside = {p for p in parts if p in BESIDE_WORDS or p.startswith(BESIDE_STEMS)}
        if beside and not (beside == {"header"} and parts & (MAIN_WORDS | {"section"})):
            return BESIDE
        main |= bool(parts & MAIN_WORDS and parts & BODY_WORDS)
        hint |= bool(parts & (MAIN_WORDS | BODY_WORDS))
    return MAIN if main else HINT if hint else NEUTRAL


def evidence(name: str, attributes: str, inside_main: bool) -> int:
    """What an element says of the text in it."""
    if name in ("html", "body"):
        return NEUTRAL
    by_tag = BESIDE if name in BESIDE_TAGS or (name == "header" and not inside_main) else MAIN if name in ("article", "main") else NEUTRAL
    if by_tag == BESIDE or not _TELLING.search(attributes):
        return by_tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    if role in BESIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style:
        return BESIDE
    by_name = named(f"{found.get('class', '')} {found.get('id', '')}")
    if by_name == BESIDE:
        return BESIDE
    if by_tag == MAIN or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return MAIN
    return by_name


@dataclass(slots=True)
class Block:
    """A run of text between block borders: its leaf element, the two block elements above it (0 for the page itself), and what these say."""

    text: str
    linked: int  # characters in links
    tag: str
    parent: int
    grandparent: int
    beside: int  # innermost element that stands beside an article, -1 for none
    zone: int  # NEUTRAL, MAIN or HINT


class Page:
    """Parses in one pass. ``blocks`` are in page order; white space of a block is one space, references are decoded.

    Comments, scripts, styles and other parts that show no text are left out. An unclosed comment, skipped element or tag
    reaches to the end of the page.
    """

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.beside: list[tuple[int, str, int]] = []  # of each such element the one around it, its name, mains before it
        self.mains, self.mains_at_end, self.first_block, self.last_block = 0, {}, {}, {}
        self._stack = [("html", True, -1, NEUTRAL, 0)]  # name, is it a block, innermost beside, zone, number
        self._blocks = [0]  # places of blocks in the stack
        self._open = defaultdict(list)  # places in the stack by name
        self._number, self._link, self._parts, self._linked = 0, False, [], 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            here = html.find("<", at)
            if here < 0:
                here = n
            if here > at:
                self._text(html[at:here])
            if here == n:
                break
            after = html[here + 1 : here + 2]
            if html.startswith("<!--", here):
                if html.startswith((">", "->"), here + 4):
                    at = html.index(">", here) + 1
                    continue
                end = html.find("-->", here + 4)
                at = n if end < 0 else end + 3
            elif after in ("!", "?") or (after == "/" and not html[here + 2 : here + 3].isalpha()):
                end = html.find(">", here)
                at = n if end < 0 else end + 1
            elif after.isascii() and after.isalpha() or after == "/":
                tag = _TAG.match(html, here)
                if tag is None:  # no end before the page's
                    break
                at = tag.end()
                name = tag[2].lower()
                if tag[1]:
                    self._end(name)
                elif name in SKIPPED:
                    end = _END[name].search(html, at)
                    at = n if end is None else end.start()
                    self._number += 1
                else:
                    self._start(name, tag[3])
            else:
                self._text("<")
                at = here + 1
        self._flush()
        while len(self._stack) > 1:
            self._pop(len(self._stack) - 1)

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self._parts.append(text)
        if self._link:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts = []
            if text:
                name, _, beside, zone, _ = self._stack[-1]
                leaf, parent, grand = ([self._stack[p][4] for p in self._blocks[-3:]][::-1] + [0, 0])[:3]
                self.blocks.append(Block(text, min(self._linked, len(text)), self._stack[self._blocks[-1]][0], parent, grand, beside, zone))
        self._linked = 0

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._flush()
            elif name == "br":
                self._parts.append(" ")
            return
        block = name in BLOCK
        top = self._stack[self._blocks[-1]][0]
        if block and (top == "p" or (top in HEADINGS and name in HEADINGS)):
            self._close(self._blocks[-1])
        if name in CLOSED_BY:
            for place in reversed(self._blocks):
                inner = self._stack[place][0]
                if inner in CLOSED_BY[name]:
                    self._close(place)
                    if name in ("li", "dt", "dd", "option", "td", "th"):
                        break
                elif inner not in ("address", "div", "p"):
                    break
        _, _, beside, zone, _ = self._stack[-1]
        said = evidence(name, attributes, zone == MAIN)
        self._number += 1
        number = 0 if name in ("html", "body") else self._number
        if block or said == BESIDE:
            self._flush()
            block = True
            self._blocks.append(len(self._stack))
        if said == BESIDE:
            self.beside.append((beside, name, self.mains))
            beside = len(self.beside) - 1
            self.first_block[beside] = len(self.blocks)
        elif said == MAIN:
            self.mains += 1
            zone = MAIN
        elif said == HINT and zone == NEUTRAL:
            zone = HINT
        if name == "a":
            self._link = "href" in attributes.lower()
        self._open[name].append(len(self._stack))
        self._stack.append((name, block, beside, zone, number))

    def _end(self, name: str) -> None:
        if name in ("html", "body") or name in VOID:
            if name == "br":
                self._parts.append(" ")
            return
        if name == "a":
            self._link = False
        places = self._open.get(name)
        if not places:
            return
        place = places[-1]
        if self._stack[place][1]:
            cell = max(self._open["td"][-1:] + self._open["th"][-1:] + [0])
            if place < cell and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                return
            self._close(place)
        elif place > self._blocks[-1]:
            self._pop(place)

    def _close(self, place: int) -> None:
        self._flush()
        self._pop(place)

    def _pop(self, place: int) -> None:
        while len(self._stack) > place:
            name, block, beside, _, _ = self._stack.pop()
            self._open[name].pop()
            if block:
                self._blocks.pop()
                if beside >= 0 and beside != self._stack[-1][2]:
                    self.mains_at_end[beside] = self.mains
                    self.last_block[beside] = len(self.blocks)
            if name == "a":
                self._link = False

    def set_aside(self) -> list[bool]:
        """For each block: does it stand beside the article by its markup?

        An element holds the page rather than stands beside it when all articles and most of the text are in it, or, on a
        page without an article, its first heading and most of the text: a form around the page, or a menu that is never closed.
        """
        lengths = [0]
        for b in self.blocks:
            lengths.append(lengths[-1] + len(b.text) - b.linked)
        heading = next((i for i, b in enumerate(self.blocks) if b.tag == "h1"), None)
        out: list[bool] = []
        for k, (around, _, before) in enumerate(self.beside):
            a, b = self.first_block[k], self.last_block.get(k, len(self.blocks))
            all_mains = self.mains_at_end.get(k, self.mains) - before == self.mains if self.mains else heading is not None and a <= heading < b
            holds = all_mains and 10 * (lengths[b] - lengths[a]) >= 6 * lengths[-1]
            out.append(not holds or (around >= 0 and out[around]))
        return [b.beside >= 0 and out[b.beside] for b in self.blocks]
