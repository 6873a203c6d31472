"""A tolerant HTML parser: elements as flat lists, in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Elements of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source svg path math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody", "tfoot"), "tbody": ("tr", "td", "th", "thead", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
WALL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Dom:
    """Elements (0 is the page itself) by tag, parent and attributes; texts: (element, raw text, block), where texts of one number stand in one block; media: (element, place among texts)."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, str, int]] = field(default_factory=list)
    media: list[tuple[int, int]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class Scanner:
    """Where tags end, in time that follows the page's length whatever is in it: what was looked for in vain isn't looked for again."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.absent: dict[str, int] = {}  # from where on
        self.dead: set[int] = set()

    def find(self, what: str, at: int, text: str | None = None) -> int:
        if at >= self.absent.get(what, len(self.html) + 1):
            return -1
        found = (self.html if text is None else text).find(what, at)
        if found < 0:
            self.absent[what] = at
        return found

    def close(self, at: int) -> int:
        """The > that ends a tag whose attributes begin at at, outside quotes if there is one; -1 if none."""
        passed = []
        here = at
        while True:
            here = _PLAIN.match(self.html, here).end()
            if here >= len(self.html) or here in self.dead:
                break
            if self.html[here] == ">":
                return here
            passed.append(here)
            end = self.find(self.html[here], here + 1)
            if end < 0:
                break
            here = end + 1
        self.dead.update(passed)
        return self.find(">", at)


class Stack:
    """The open elements, with the places of each tag and of block elements among them."""

    def __init__(self, dom: Dom) -> None:
        self.dom = dom
        self.items = [0]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, element: int) -> None:
        name = self.dom.tag[element]
        self.places.setdefault(name, []).append(len(self.items))
        if name not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append(element)

    def nearest(self, names: tuple[str, ...]) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def cut(self, place: int) -> int:
        """Closes all from a place on; the number of block elements among them."""
        blocks = 0
        while len(self.items) > place:
            name = self.dom.tag[self.items.pop()]
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
                blocks += 1
        return blocks


def parse(html: str) -> Dom:
    dom = Dom()
    stack, scan = Stack(dom), Scanner(html)
    block = at = 0
    lower = None

    def text(piece: str) -> None:
        if piece:
            dom.texts.append((stack.items[-1], piece, block))

    begun = 0  # where text that isn't given yet begins
    while True:
        mark = html.find("<", at)
        if mark < 0:
            text(html[begun:])
            return dom
        if html.startswith("<!--", mark):
            text(html[begun:mark])
            end = scan.find("-->", mark + 4)
            at = begun = len(html) if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", mark):
            text(html[begun:mark])
            end = scan.find("]]>", mark + 9)
            text(html[mark + 9 : len(html) if end < 0 else end])
            at = begun = len(html) if end < 0 else end + 3
            continue
        closing = html.startswith("/", mark + 1)
        m = _NAME.match(html, mark + 1 + closing)
        end = scan.close(m.end()) if m else -1
        if end < 0:
            if html[mark + 1 : mark + 2] in ("!", "?", "/"):
                text(html[begun:mark])
                end = scan.find(">", mark + 2)
                at = begun = len(html) if end < 0 else end + 1
            else:
                at = mark + 1
            continue
        text(html[begun:mark])
        at = begun = end + 1
        name = m[0].lower()
        if closing:
            if place := stack.nearest((name,)):
                block += stack.cut(place + 1)
                stack.cut(place)
            if name not in INLINE:
                block += 1
            continue
        if name in CLOSES_P and dom.tag[stack.items[stack.blocks[-1]]] == "p":
            stack.cut(stack.blocks[-1])
        if name in SAME:
            while (place := stack.nearest(SAME[name])) > stack.nearest(WALL[name]):
                stack.cut(place)
                if name not in ("tr", "thead", "tbody", "tfoot"):
                    break
        if name not in INLINE:
            block += 1
        dom.tag.append(name)
        dom.parent.append(stack.items[-1])
        dom.attributes.append(html[m.end() : end])
        own = len(dom.tag) - 1
        if name in ("br", "hr"):
            dom.texts.append((stack.items[-1], " ", block))
        if name in ("img", "video", "audio", "source", "embed", "object"):
            dom.media.append((own, len(dom.texts)))
        if name in VOID or dom.attributes[own].endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            lower = lower if lower is not None else html.lower() if html.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            end = scan.find("</" + name, at, lower)
            close = scan.find(">", end) if end >= 0 else -1
            if end < 0 and name in ("noscript", "template", "iframe"):
                continue
            at = begun = close + 1 if close >= 0 else len(html)
            continue
        stack.push(own)
