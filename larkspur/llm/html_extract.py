"""HTML extraction by a tree-structured graphical model over the DOM.

Each element and each piece of text is a node with one of three states: mixed
(holds both), main (all of it is main text) or other. A node's features give
emission potentials: its role and its parent's, every group of words in its class and id (what a
name is, what it is of, what it says of the page's state), its share of link
text, its amount of text, its share of the page's prose, its place and how often
it is repeated beside itself. None of them decides alone. Parent and child are tied by a potential. Messages
are passed from the leaves up and from the root down; their product is each
text's marginal of being main text. Potentials are smoothed counts over
labelled pages. labelled_pages() makes such pages from a grammar of common page
designs; fit() takes any others.

What browsers never show as text (scripts, styles, head, templates) is no node.
Nulls: a null html is an empty page and gives an empty text; so does a page
without main text. Pages of any size are read whole.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.dom import INLINE, Dom, parse
from larkspur.llm.shared import plus, ready
from larkspur.llm.words import strings

MIXED, MAIN, OTHER = range(3)

#: Words in class, id, role and aria-label, by what they say.
KEYWORDS = {
    "main": "article content main post entry story body text hentry prose page document blog news single read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar toc skip sitemap",
    "head": "header masthead topbar logo branding site-title hero-banner",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside widget rail related recommended popular trending more also recent tags tagcloud archive categories",
    "notice": "cookie consent notice gdpr alert banner popup modal overlay disclaimer message announcement privacy toast",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp adsense commercial",
    "reply": "comment comments comment-list disqus replies reply respond discussion reader-comments reviews responses",
    "form": "form search login signin signup register subscribe newsletter input button submit contact",
    "share": "share sharing social follow twitter facebook like bookmark rss print",
    "by": "meta byline author date time published caption credit",
}
_WHICH = {w: k for k, v in KEYWORDS.items() for w in v.split()}
#: Words that make a name say how a page is set up, not what the element is (has-sidebar, comments-open).
STATES = frozenset("has no is not with without enabled disabled free open closed on off show hide hidden active layout template theme supports tag category format status type single logged js".split())
_NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_ROLE = {t: t for t in "html body article main nav header footer aside section div p ul ol li a form button select label fieldset table td th tr blockquote pre figure figcaption iframe dialog details summary".split()} | {f"h{k}": "h" for k in range(1, 7)} | dict.fromkeys(("dl", "dt", "dd"), "li") | dict.fromkeys(("input", "option", "optgroup", "datalist"), "button") | {"legend": "label"}


@lru_cache(maxsize=20_000)
def names(raw: str) -> tuple[tuple, ...]:
    """The features of an element's names: for each name the group of its last telling word (name), the groups of those before (part); for a name of the page's state only those (state)."""
    if not raw:
        return (("name", "-"),)
    if _HIDDEN.search(raw):
        return (("name", "hidden"),)
    found: dict[tuple, None] = {}
    for m in _NAMED.finditer(raw):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _SPLIT.split(name) if w]
            if (k := _WHICH.get(name.lower())) is not None:
                found["name", k] = None
                continue
            groups = [k for w in words if (k := _WHICH.get(w)) is not None]
            if len(words) > 1 and not STATES.isdisjoint(words):
                found |= {("state", k): None for k in groups}
            elif groups:
                found["name", groups[-1]] = None
                found |= {("part", k): None for k in groups[:-1]}
    if not any(f[0] == "name" for f in found):
        found["name", "-"] = None
    return tuple(found)


def bin_of(n: int) -> int:
    return 0 if n == 0 else min(6, 1 + int(math.log(n, 4)))


@dataclass
class Nodes:
    """Elements, then texts (as leaves), with their parents and features."""

    parent: list[int]
    features: list[tuple]
    first_text: int


#: From so many characters on a text outside links is prose.
PROSE = 60


def share_bin(part: int, whole: int) -> int:
    return 0 if not part else 1 + sum(part >= x * whole for x in (0.15, 0.5, 0.85))


def nodes(dom: Dom) -> Nodes:
    n = len(dom.tag)
    chars, links, prose = [0] * n, [0] * n, [0] * n
    begin: list[int | None] = [None] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = dom.tag[k] == "a" or in_link[dom.parent[k]]
    own, passed = [], 0
    for e, t, _ in dom.texts:
        c = len(t) if not t.isspace() else 0
        own.append(c)
        chars[e] += c
        if c and begin[e] is None:
            begin[e] = passed
        passed += c
        if in_link[e]:
            links[e] += c
        elif c >= PROSE:
            prose[e] += c
    beside: dict[tuple, int] = {}
    for k in range(n - 1, 0, -1):
        up = dom.parent[k]
        chars[up] += chars[k]
        links[up] += links[k]
        prose[up] += prose[k]
        if begin[k] is not None and (begin[up] is None or begin[k] < begin[up]):
            begin[up] = begin[k]
        same = (up, dom.tag[k], dom.attributes[k])
        beside[same] = beside.get(same, 0) + 1
    features, roles = [], []
    for k in range(n):
        share = links[k] / chars[k] if chars[k] else 0.0
        role = _ROLE.get(dom.tag[k], "inline" if dom.tag[k] in INLINE else "box")
        roles.append(role)
        again = 0 if role in ("p", "li", "td", "tr", "th", "h", "inline", "a", "button") or k == 0 else min(3, beside[dom.parent[k], dom.tag[k], dom.attributes[k]])
        place = min(3, 4 * (begin[k] or 0) // max(1, passed))
        features.append((("role", role), ("under", roles[dom.parent[k]] if k else "", role), *names(dom.attributes[k]), ("links", role == "a" or 0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.6 else 3), ("chars", bin_of(chars[k])), ("prose", share_bin(prose[k], prose[0])), ("again", again), ("place", place)))
    parent = list(dom.parent)
    for (e, t, _), c in zip(dom.texts, own, strict=True):
        parent.append(e)
        features.append((("leaf", in_link[e]), ("length", bin_of(c)), ("ends", t.rstrip()[-1:] in ".!?:…\"”")))
    return Nodes(parent, features, n)


#: The ties of parent and child that can be: below a mixed element any state, else the parent's own.
TIES = {(MIXED, MIXED): 0, (MIXED, MAIN): 1, (MIXED, OTHER): 2, (MAIN, MAIN): 3, (OTHER, OTHER): 4}


@dataclass
class Potentials:
    """For each feature, its potential with each tie; the ties' own, for elements and for texts; the root's states."""

    emission: dict[tuple, tuple[float, ...]]
    unknown: tuple[float, ...]
    pair: tuple[float, ...]
    pair_text: tuple[float, ...]
    root: tuple[float, float, float]


def marginals(x: Nodes, p: Potentials) -> list[float]:
    """Each text's marginal of being main text, by sum-product messages up and down the tree."""
    n = len(x.parent)
    emission, unknown = p.emission, p.unknown
    ties: list[tuple[float, ...]] = [(1.0,) * 5] * n
    for k in range(1, n):
        a, b, c, d, e = p.pair_text if k >= x.first_text else p.pair
        for f in x.features[k]:
            v = emission.get(f, unknown)
            a, b, c, d, e = a * v[0], b * v[1], c * v[2], d * v[3], e * v[4]
        s = a + b + c + d + e
        ties[k] = (a / s, b / s, c / s, d / s, e / s)
    belief = [[1.0, 1.0, 1.0] for _ in range(n)]
    up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
    for part in (range(n - 1, x.first_text - 1, -1), range(x.first_text - 1, 0, -1)):
        for k in part:
            a, b, c, d, e = ties[k]
            u, v, w = belief[k]
            m = (a * u + b * v + c * w, d * v, e * w)
            s = m[0] + m[1] + m[2]
            up[k] = m = (max(m[0] / s, 1e-30), max(m[1] / s, 1e-30), max(m[2] / s, 1e-30))
            q = belief[x.parent[k]]
            q[0], q[1], q[2] = q[0] * m[0], q[1] * m[1], q[2] * m[2]
            s = max(q)
            q[0], q[1], q[2] = max(q[0] / s, 1e-30), max(q[1] / s, 1e-30), max(q[2] / s, 1e-30)
    root = belief[0]
    for s in range(3):
        root[s] *= p.root[s]
    out = []
    for k in range(1, n):
        q, m = belief[x.parent[k]], up[k]
        a, b, c, d, e = ties[k]
        u, v, w = q[0] / m[0], q[1] / m[1], q[2] / m[2]
        z = belief[k]
        z[0], z[1], z[2] = z[0] * u * a, z[1] * (u * b + v * d), z[2] * (u * c + w * e)
        s = z[0] + z[1] + z[2]
        if s > 0:
            z[0], z[1], z[2] = z[0] / s, z[1] / s, z[2] / s
        if k >= x.first_text:
            out.append(z[1])
    return out


def joined(dom: Dom, keep: list[bool]) -> str:
    """The kept texts: references decoded, white space within a block made one space, blocks joined by line ends."""
    blocks: list[str] = []
    current: list[str] = []
    number = None
    for (_, t, b), k in zip(dom.texts, keep, strict=True):
        if not k:
            continue
        if b != number:
            blocks.append("".join(current))
            current, number = [], b
        current.append(t)
    blocks.append("".join(current))
    lines = (" ".join((entities.unescape(x) if "&" in x else x).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str, p: Potentials) -> str:
    dom = parse(page)
    if not dom.texts:
        return ""
    return joined(dom, [m >= 0.5 for m in marginals(nodes(dom), p)])


#: The features of a node aren't independent: each kind's potential is raised to a power, chosen on pages of the grammar that fit doesn't see.
POWERS = {"role": 0.22, "under": 0.3, "name": 1.2, "part": 0.24, "state": 0.36, "links": 0.1, "chars": 0.07, "prose": 0.17, "again": 0.53, "place": 0.17, "leaf": 0.07, "length": 0.21, "ends": 0.06}


def fit(pages: Iterable[tuple[str, object]], smooth: float = 0.05, powers: dict[str, float] = POWERS) -> Potentials:
    """From (html, is_main), where is_main(text piece) says whether a piece is main text (None: it doesn't count)."""
    seen: dict[tuple, list[float]] = {}
    total: dict[str, list[float]] = {}
    ties = {False: [smooth] * 5, True: [smooth] * 5}
    root = [smooth] * 3
    for page, is_main in pages:
        dom = parse(page)
        x = nodes(dom)
        mains, others = [0] * len(x.parent), [0] * len(x.parent)
        for k, (_, t, _) in enumerate(dom.texts):
            said = is_main(t)
            if said is not None:
                (mains if said else others)[x.first_text + k] = 1
        for k in range(len(x.parent) - 1, 0, -1):
            mains[x.parent[k]] += mains[k]
            others[x.parent[k]] += others[k]
        state = [MIXED if a and b else MAIN if a else OTHER for a, b in zip(mains, others, strict=True)]
        root[state[0]] += 1
        for k in range(1, len(x.parent)):
            if not (mains[k] or others[k]):
                continue  # nothing to say
            tie = TIES[state[x.parent[k]], state[k]]
            ties[k >= x.first_text][tie] += 1
            for f in x.features[k]:
                seen.setdefault(f, [0.0] * 5)[tie] += 1
                total.setdefault(f[0], [0.0] * 5)[tie] += 1
    values = {k: sum(1 for f in seen if f[0] == k) for k in total}
    emission = {f: tuple(((v + smooth) / (t + smooth * (values[f[0]] + 1))) ** powers[f[0]] for v, t in zip(c, total[f[0]], strict=True)) for f, c in seen.items()}

    def own(t: list[float], text: bool) -> tuple[float, ...]:
        mixed = t[1] + t[2] if text else t[0] + t[1] + t[2]
        return (0.0 if text else t[0] / mixed, t[1] / mixed, t[2] / mixed, 1.0, 1.0)  # a text is never mixed

    return Potentials(emission, (0.02,) * 5, own(ties[False], False), own(ties[True], True), tuple(v / sum(root) for v in root))


def labelled_pages(count: int = 1200, seed: int = 7) -> Iterator[tuple[str, object]]:
    """Pages of a grammar of common designs. Words of main text begin with m, all others with o."""
    r = random.Random(seed)

    def words(mark: str, lo: int, hi: int, stop: bool = True) -> str:
        out = " ".join(mark + "".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 8))) for _ in range(r.randint(lo, hi)))
        return out + (r.choice(".....!?") if stop else "")

    noise = [w for k, v in KEYWORDS.items() if k != "main" for w in v.split()]
    every = [w for v in KEYWORDS.values() for w in v.split()]
    inner_words = "body content text story main article post entry".split()
    plain = "row col box wrap inner container x1 grid block lead intro message list item".split()

    def state() -> str:
        return r.choice([f"{r.choice(['has', 'no', 'is', 'with', 'without', 'tag', 'category', 'layout'])}-{r.choice(every)}", f"{r.choice(every)}-{r.choice(['enabled', 'open', 'free', 'closed', 'on', 'off', 'layout'])}"])

    def named(tag: str, mark: str, names: str, chance: float = 0.7) -> str:
        if r.random() > chance:
            return f"<{tag}>" if r.random() < 0.8 else f'<{tag} class="{r.choice(plain)}">'
        which = r.choice(names.split())
        if mark == "m" and r.random() < 0.35:  # what it is of: a result's body, a recent story
            which = f"{r.choice(noise)}-{r.choice(inner_words)}"
        elif mark == "o" and r.random() < 0.2:  # a comment's body, a footer's content
            which = f"{which}-{r.choice(inner_words)}"
        if r.random() < 0.3:
            which += f" {state()}"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{which}{r.choice(["", "", "-1", " x", "-box", "_wrap"])}">'

    def link(mark: str, lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{r.randint(1, 999)}">{words(mark, lo, hi, False)}</a>'

    def links(mark: str, tag: str = "ul") -> str:
        if r.random() < 0.75:
            return f"<{tag}>" + "".join(f"<li>{link(mark)}</li>" for _ in range(r.randint(3, 9))) + f"</{tag}>"
        return r.choice([" | ", " ", " &middot; "]).join(link(mark) for _ in range(r.randint(2, 8)))

    def menu() -> str:
        tag = r.choice(["nav", "nav", "nav", "div", "ul"])
        if tag == "ul":
            return named("ul", "o", KEYWORDS["menu"], 1.0) + "".join(f"<li>{link('o')}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
        return named(tag, "o", KEYWORDS["menu"], 0.5 if tag == "nav" else 0.95) + links("o") + f"</{tag}>"

    def head() -> str:
        tag = r.choice(["header", "header", "div"])
        inner = r.choice([f"<h1>{words('o', 1, 4, False)}</h1>", f"<a href='/'>{words('o', 1, 3, False)}</a>", f"<p>{words('o', 2, 9)}</p>", menu(), ""])
        return named(tag, "o", KEYWORDS["head"], 0.4 if tag == "header" else 1.0) + inner + (menu() if r.random() < 0.5 else f"<span>{words('o', 1, 6, False)}</span>") + f"</{tag}>"

    def foot() -> str:
        tag = r.choice(["footer", "footer", "footer", "div"])
        inner = r.choice([f"&copy; {words('o', 2, 25)}", f"<p>&copy; {words('o', 3, 30)}</p>", links("o"), f"<p>{words('o', 4, 20)}</p>{links('o')}"])
        return named(tag, "o", KEYWORDS["foot"], 0.4 if tag == "footer" else 1.0) + inner + f"</{tag}>"

    def side() -> str:
        tag = r.choice(["aside", "aside", "div", "section"])
        inner = (f"<h{r.randint(2, 4)}>{words('o', 1, 4, False)}</h3>" if r.random() < 0.7 else "") + r.choice([links("o"), f"<p>{words('o', 4, 40)}</p>", f"<p>{words('o', 4, 30)}</p>{links('o')}"])
        return named(tag, "o", KEYWORDS["side"], 0.5 if tag == "aside" else 1.0) + inner + f"</{tag}>"

    def box(kind: str, lo: int, hi: int) -> str:
        tag = r.choice(["div", "div", "section", "p", "span", "aside"])
        inner = words("o", lo, hi)
        if tag not in ("p", "span") and r.random() < 0.5:
            inner = f"<p>{inner}</p>"
        if r.random() < 0.4:
            inner += f" {r.choice([link('o'), '<button>' + words('o', 1, 2, False) + '</button>'])}"
        return named(tag, "o", KEYWORDS[kind], 1.0) + inner + f"</{tag}>"

    def form() -> str:
        return named("form", "o", KEYWORDS["form"], 0.5) + f"<label>{words('o', 1, 5, False)}</label><input type=text>" + r.choice(["", f"<p>{words('o', 3, 25)}</p>", f"<select><option>{words('o', 1, 2, False)}<option>{words('o', 1, 2, False)}</select>"]) + f"<button>{words('o', 1, 3, False)}</button></form>"

    def replies() -> str:
        tag = r.choice(["div", "section", "ol", "aside"])
        one = lambda: r.choice([f"<p>{words('o', 4, 60)}</p>", f"<p><b>{words('o', 1, 2, False)}</b> {words('o', 4, 60)}</p>", f"<div class=comment>{words('o', 4, 60)}</div>", f"<article class='comment'><p>{words('o', 4, 50)}</p></article>"])
        inner = (f"<h3>{words('o', 1, 3, False)}</h3>" if r.random() < 0.6 else "") + "".join((f"<li>{one()}</li>" if tag == "ol" else one()) for _ in range(r.randint(1, 6)))
        return named(tag, "o", KEYWORDS["reply"], 1.0) + inner + f"</{tag}>"

    def other() -> str:
        return r.choice([menu, side, form, replies, lambda: box("advert", 3, 40), lambda: box("advert", 3, 25), lambda: box("notice", 3, 40), lambda: box("share", 1, 8), lambda: box("side", 2, 20)])()

    def sentence(lo: int = 3, hi: int = 60) -> str:
        out = words("m", lo, hi, r.random() < 0.85)
        if r.random() < 0.3:
            out = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>{words('m', 1, 12, False)}</{t}> {out}"
        if r.random() < 0.25:
            out += f" {link('m')} {words('m', 1, 15)}"
        return out

    def part() -> str:
        kind = r.random()
        if kind < 0.66:
            return named("p", "x", "message lead intro first dropcap text " + " ".join(noise), 0.08) + sentence() + r.choice(["</p>", "</p>", "", "<br></p>"])
        if kind < 0.76:
            return f"<h{(k := r.randint(2, 4))}>{words('m', 1, 10, False)}</h{k}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{sentence(1, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{sentence()}</blockquote>"
        if kind < 0.91:
            return f"<pre>{words('m', 3, 30)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words('m', 1, 6, False)}</td><td>{words('m', 1, 6, False)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x.png><figcaption>{words('m', 3, 15)}</figcaption></figure>"
        return f"<div>{sentence()}</div>"

    def article() -> str:
        title = f"<h1>{words('m', 1, 12, False)}</h1>"
        design = r.random()
        if design < 0.9 and r.random() < 0.3:  # a title in a header of the article's own
            title = named("header", "x", "entry-header article-header header title", 0.4) + title + "</header>"
        parts = [title] if r.random() < 0.8 else []
        parts += [part() for _ in range(r.randint(1, 12))]
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), r.choice([box("advert", 3, 25), side(), box("share", 1, 8), box("notice", 3, 20), form()]))
        if r.random() < 0.15:
            parts.append(replies())
        inner = "".join(parts)
        if design < 0.5:
            return named("article", "m", KEYWORDS["main"], 0.4) + inner + "</article>"
        if design < 0.7:
            return named("main", "m", KEYWORDS["main"], 0.3) + (inner if r.random() < 0.5 else f"<article>{inner}</article>") + "</main>"
        if design < 0.9:
            return named(r.choice(["div", "section"]), "m", KEYWORDS["main"], 0.9) + inner + "</div>"
        return inner

    for _ in range(count):
        before = [f() for f, c in ((head, 0.5), (menu, 0.6), (other, 0.6), (other, 0.3)) if r.random() < c]
        after = [f() for f, c in ((side, 0.3), (replies, 0.25), (other, 0.5), (other, 0.3), (foot, 0.8)) if r.random() < c]
        if r.random() < 0.12:
            before = after = []
        body = "".join(before) + (article() if r.random() < 0.97 else "") + "".join(after)
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
            body = f'<div {r.choice(["id=wrapper", "class=container", "class=row", "class=page", "id=content", "class=site-main"])}>{body}</div>'
        names_of_page = " ".join(r.choice([r.choice(every), state()]) for _ in range(r.choice([0, 0, 1, 2, 3])))
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body{f' class="{names_of_page}"' if names_of_page else ""}>{body}</body></html>" if r.random() < 0.95 else body
        yield page, lambda t: None if t.isspace() else (True if t.lstrip().startswith("m") else False if t.lstrip()[:1] in "o|&" else None)


@lru_cache(maxsize=1)
def default() -> Potentials:
    return fit(labelled_pages())


def _texts(batches: Iterator[pa.RecordBatch], p: Potentials) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [extract(x, p) for x in strings(batch["html"])]
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c != "html"} | {"_text": pa.array(out, pa.string())})


def main_text(pages: DataFrame, p: Potentials | None = None) -> DataFrame:
    """pages with _text in place of html; a column of that name is replaced."""
    ready(pages.sparkSession, 500)
    p = p or default()
    pages = pages.drop("_text")
    return pages.mapInArrow(lambda it: _texts(it, p), plus(pages.drop("html"), "_text string"))
