"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text that no block-level element
interrupts, with the tags, classes and ids of the elements around them. Binary
features of these and of the text score each block as main text or not, a
transition score ties neighbours, and Viterbi finds the best labelling. Weights
come from gradient ascent on the conditional likelihood (forward-backward) over
labelled pages, which ``training_pages`` composes from layouts of menus, headers,
footers, sidebars, notices, adverts, forms and comments around articles.

The model is small and fixed; each page is read once, whole, without a shuffle.

Edge cases: null and empty html give an empty text; unclosed, misnested and
unknown tags are taken as they come, at any depth; script, style, title and other hidden
content never make blocks; pages without a main block have an empty text;
repeated rows each have their row; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template svg math head title iframe object canvas audio video textarea select datalist".split())
#: Raw content up to the end tag, whatever stands in it.
RAW_TAGS = frozenset("script style title textarea noscript iframe".split())
#: An opening tag of the first kind closes an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = BLOCK_TAGS - frozenset("button option select summary caption legend tbody td tfoot th thead tr body html".split())

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
#: One attribute after another, so that no name is looked for inside another's value.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]+))?")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


# Names that pages give to their parts.
MAIN_NAMES = "article content main post entry story body text page primary single".split()
PART_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar tabs pager pagination toc".split(),
    "header": "header masthead banner branding logo hero toolbar search".split(),
    "footer": "footer colophon copyright legal credits bottom".split(),
    "sidebar": "sidebar aside widget related recommended popular trending secondary rail tags archive".split(),
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay message warning newsletter subscribe".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted commercial".split(),
    "form": "form login signup search contact feedback".split(),
    "comments": "comment comments reply replies discussion respond thread disqus".split(),
    "share": "share social sharing follow meta byline author".split(),
}
_MAINS, _PARTS = frozenset(MAIN_NAMES), frozenset(x for names in PART_NAMES.values() for x in names)


class Node:
    """An open element: linked to the one around it, so that blocks share what is around them."""

    __slots__ = ("parent", "tag", "parts", "label", "own", "block_at", "depth", "named", "kind", "marked", "fresh", "closed", "veils", "total")

    def __init__(self, parent: Node | None, tag: str, parts: tuple[str, ...], label: str | None, at: int):
        self.parent, self.tag, self.parts = parent, tag, parts
        block = tag in BLOCK_TAGS
        #: The nearest block-level tag, and where on the stack it stands.
        self.own = tag if block else parent.own if parent else ""
        self.block_at = at if block else parent.block_at if parent else -1
        self.label = label if label is not None else parent.label if parent else None
        self.depth = parent.depth + 1 if parent else 1
        self.named = bool(parts) or (parent.named if parent else False)
        #: What the nearest named element is called like: main text, another part, or neither.
        self.kind = ("part" if _PARTS & {*parts} else "main" if _MAINS & {*parts} else "other") if parts else parent.kind if parent else ""
        self.marked = tag in ("article", "main") or (parent.marked if parent else False)
        #: Features that no element around it has.
        self.fresh: list[str] = []
        self.closed = False
        self.veils = 0
        self.total: float | None = None


class Block:
    __slots__ = ("raw", "linked", "node")

    def __init__(self, node: Node | None):
        self.raw: list[str] = []
        self.linked = 0
        self.node = node

    @property
    def own(self) -> str:
        return self.node.own if self.node else ""

    @property
    def marked(self) -> bool:
        return self.node.marked if self.node else False

    @property
    def label(self) -> str | None:
        return self.node.label if self.node else None

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.raw)).split())


@lru_cache(maxsize=20_000)
def _names(attributes: str) -> tuple[tuple[str, ...], bool, str | None]:
    """Name parts of class, id and role; whether the element is hidden; its label on labelled pages."""
    parts: list[str] = []
    hidden, label = False, None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-label":
            label = value
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none", value) is not None
        elif name in ("class", "id", "role"):
            parts += _PART.findall(_CAMEL.sub(" ", value).lower())
    return tuple(parts), hidden, label


class _Stack:
    """The open elements, with counts that answer every question about them at once."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}  # of each tag's open elements
        self.features: dict[str, int] = {}
        self.hidden = self.links = 0

    @property
    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, tag: str, parts: tuple[str, ...], veiled: bool, label: str | None) -> None:
        node = Node(self.top, tag, parts, label, len(self.nodes))
        for f in _own_features(node):
            n = self.features.get(f, 0)
            self.features[f] = n + 1
            if not n:
                node.fresh.append(f)
        node.veils = (tag in HIDDEN_TAGS) + veiled
        self.hidden += node.veils
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def _close(self, node: Node) -> None:
        if not node.closed:
            node.closed = True
            self.hidden -= node.veils
            self.links -= node.tag == "a"
            self.places[node.tag].pop()

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            for f in _own_features(node):
                self.features[f] -= 1
            self._close(node)

    def end(self, tag: str) -> None:
        """An end tag: closes its element and what is in it; an inline one leaves the blocks in it open."""
        places = self.places.get(tag)
        if not places:
            return
        depth = places[-1]
        if tag in BLOCK_TAGS or self.nodes[-1].block_at <= depth:
            self.cut(depth)
        else:
            self._close(self.nodes[depth])  # it stays on the stack until what is in it goes

    def shut(self, tags: tuple[str, ...]) -> None:
        """Close the nearest block while it is one of ``tags``."""
        while self.nodes and self.nodes[-1].block_at >= 0 and self.nodes[-1].own in tags:
            self.cut(self.nodes[-1].block_at)


def _own_features(node: Node) -> list[str]:
    mine = [f"in={node.tag}"] if node.tag in BLOCK_TAGS else []
    return mine + [f"name={x}" for x in dict.fromkeys(node.parts)]


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order; time is linear in the page, however deep its tags."""
    out: list[Block] = []
    stack = _Stack()
    now: Block | None = None
    at, n = 0, len(page)
    while at < n:
        m = _PIECE.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1 or stack.hidden:
                continue
            if now is None:
                if piece.isspace():
                    continue
                now = Block(stack.top)
                out.append(now)
            now.raw.append(piece)
            if stack.links:
                now.linked += len(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                now = None
            stack.end(tag)
            continue
        if tag in BLOCK_TAGS:
            now = None
            shut = CLOSES.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            if shut:
                stack.shut(shut)
        elif tag == "br":
            if now is not None:
                now.raw.append(" ")
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if tag in RAW_TAGS:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag == "body":
            # The body shows even where the head was never closed.
            stack = _Stack()
        parts, veiled, label = _names(m[3])
        stack.push(tag, parts, veiled, label)
    return [b for b in out if not "".join(b.raw).isspace()]


_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW_TAGS}


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


_ENDS = re.compile(r"[.!?…:;][\"'»”)]*$")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_HINTS = re.compile(r"©|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bprivacy\b|\blog ?in\b|\bsign (?:in|up)\b|\bcopyright\b|\badvertisement\b|\bsponsored\b|\breply\b|\bshare\b|\brights reserved\b", re.I)


def _around(node: Node | None) -> list[str]:
    """The features of a block's surroundings that aren't those of single elements."""
    return ["bias", f"own={node.own if node else ''}", f"called={node.kind if node else ''}", f"called={node.kind if node else ''},own={node.own if node else ''}", f"named={bool(node and node.named)},deep={_step(node.depth if node else 0, (3, 5, 8))}"]


def outer_features(node: Node | None) -> list[str]:
    """What the elements around a block say."""
    f = _around(node)
    while node:
        f += node.fresh
        node = node.parent
    return f


def inner_features(b: Block, text: str, place: str, marked: bool) -> list[str]:
    """What a block's own text says, and its place on a page that does or doesn't mark an article; hints are words of short blocks."""
    own = b.own
    size = _step(len(text), (15, 30, 60, 120, 250, 500))
    linked = _step(min(1.0, b.linked / max(1, sum(map(len, b.raw)))), (0.05, 0.3, 0.7, 0.95)) if b.linked else 0
    head = text[:200]
    return [
        place, f"apart={marked and not b.marked}", f"size={size}", f"linked={linked}", f"own={own},size={size}",
        f"end={_ENDS.search(text, max(0, len(text) - 8)) is not None}",
        f"words={_step(text.count(' ') + 1, (2, 4, 8, 16, 32))}",
        f"hint={len(text) < 200 and _HINTS.search(text) is not None}",
        f"bars={_step(text.count(' | ') + text.count(' · ') + text.count('»'), (1, 3))}",
        f"capitals={_step(len(_CAPITALS.findall(head)) / max(1, len(head)), (0.1, 0.3, 0.6))}",
    ]


def _place(k: int, n: int) -> str:
    return "only" if n == 1 else "first" if k == 0 else "last" if k == n - 1 else "between"


def features(page: list[Block], texts: list[str]) -> list[list[str]]:
    """Binary features of each block: of the elements around it, and of the text."""
    marked = any(b.marked for b in page)
    return [outer_features(b.node) + inner_features(b, t, _place(k, len(page)), marked) for k, (b, t) in enumerate(zip(page, texts))]


class Field:
    """A two-label linear-chain conditional random field: 1 is main text."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.w = np.zeros(0)
        self.t = np.zeros((2, 2))

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 15, rate: float = 0.5, decay: float = 1e-4, seed: int = 4) -> Field:
        """Stochastic gradient ascent with per-weight rates on the conditional log-likelihood."""
        for fs, _ in pages:
            for f in fs:
                for x in f:
                    self.place.setdefault(x, len(self.place))
        self.w, seen = np.zeros(len(self.place)), np.full(len(self.place), 1e-8)
        seen_t = np.full((2, 2), 1e-8)
        rng = random.Random(seed)
        for _ in range(rounds):
            for fs, ys in rng.sample(pages, len(pages)):
                if not fs:
                    continue
                at = [np.array([self.place[x] for x in f]) for f in fs]
                p, pair = self._marginals(np.array([self.w[a].sum() for a in at]))
                slope = np.array(ys) - p
                g = np.zeros(len(self.w))
                for a, s in zip(at, slope):
                    g[a] += s
                touched = np.unique(np.concatenate(at))
                gt = g[touched] - decay * self.w[touched]
                seen[touched] += gt * gt
                self.w[touched] += rate * gt / np.sqrt(seen[touched])
                g_t = -pair
                for a, b in zip(ys, ys[1:]):
                    g_t[a, b] += 1
                g_t -= decay * self.t
                seen_t += g_t * g_t
                self.t += rate * g_t / np.sqrt(seen_t)
        self.weight = {x: float(self.w[k]) for x, k in self.place.items()}
        return self

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 of each block, and expected counts of label pairs."""
        n = len(score)
        e = np.stack([np.zeros(n), score], axis=1)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = e[0]
        for k in range(1, n):
            a[k] = e[k] + np.logaddexp(a[k - 1, 0] + self.t[0], a[k - 1, 1] + self.t[1])
        for k in range(n - 2, -1, -1):
            x = e[k + 1] + b[k + 1]
            b[k] = np.logaddexp(self.t[:, 0] + x[0], self.t[:, 1] + x[1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        p = np.exp(a + b - z)
        pair = np.zeros((2, 2))
        for k in range(1, n):
            pair += np.exp(a[k - 1][:, None] + self.t + (e[k] + b[k])[None, :] - z)
        return p[:, 1], pair

    def _outer(self, node: Node | None) -> float:
        """Score of a block's surroundings; sums over elements are kept with them."""
        get, chain, up = self.weight.get, [], node
        while up is not None and up.total is None:
            chain.append(up)
            up = up.parent
        total = up.total if up is not None else 0.0
        for x in reversed(chain):
            total = x.total = total + sum(get(f, 0.0) for f in x.fresh)
        return total + sum(get(f, 0.0) for f in _around(node))

    def scores(self, page: list[Block], texts: list[str]) -> list[float]:
        """Score of label 1 for each block."""
        get, n = self.weight.get, len(page)
        marked = any(b.marked for b in page)
        out = []
        for k, (b, text) in enumerate(zip(page, texts)):
            e = self._outer(b.node)
            for x in inner_features(b, text, _place(k, n), marked):
                e += get(x, 0.0)
            out.append(e)
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """The best labelling, by Viterbi; label 0 wins ties."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        back, s0, s1 = [], 0.0, scores[0]
        for e in scores[1:]:
            back.append((0 if s0 + t00 >= s1 + t10 else 1, 0 if s0 + t01 >= s1 + t11 else 1))
            s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11) + e
        y = [0 if s0 >= s1 else 1]
        for pair in reversed(back):
            y.append(pair[y[-1]])
        return y[::-1]


def _prose(rng: random.Random, words: int) -> str:
    """Invented words in sentences."""
    parts = ("an", "be", "cor", "de", "el", "fi", "gra", "ho", "in", "ka", "lo", "mi", "no", "or", "pe", "qua", "ri", "sé", "ta", "ün", "vo")
    out = []
    while words > 0:
        n = min(words, rng.randint(3, 18))
        sentence = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
        out.append(" ".join(sentence).capitalize() + rng.choice(".....!?"))
        words -= n
    return " ".join(out)


def _worn(rng: random.Random, text: str) -> str:
    """Article text as it is often found: with marks, bars, capitals or repeats."""
    ws = text.split(" ")
    kind = rng.random()
    if kind < 0.6:
        return text
    if kind < 0.7:
        return " | ".join(ws) + rng.choice(["", " |"])
    if kind < 0.8:
        return " ".join(w + rng.choice(["$$$", "###", "%%%", "***", "&amp;&amp;"]) for w in ws)
    if kind < 0.9:
        return text.upper() + rng.choice(["", "!!"])
    return " ".join([ws[0]] * len(ws))


def _item(rng: random.Random, kind: str) -> str:
    short = _prose(rng, rng.randint(1, 3)).rstrip(".!?")
    if kind == "menu":
        cell = rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a>", "<span><a href='#'>{}</a></span> | ", "<td><a href='/y'>{}</a></td>"])
        inner = "".join(cell.format(_prose(rng, rng.randint(1, 2)).rstrip(".!?")) for _ in range(rng.randint(3, 9)))
        return f"<ul>{inner}</ul>" if cell.startswith("<li") else f"<table><tr>{inner}</tr></table>" if cell.startswith("<td") else inner
    if kind == "header":
        return rng.choice([f"<h1>{short}</h1>", f"<div><a href='/'>{short}</a></div>", f"<p>{short}</p>", f"<h2>{short}</h2><p>{_prose(rng, 6)}</p>"])
    if kind == "footer":
        return rng.choice(["&copy; {} {}", "<p>&copy; {} &middot; {}</p>", "<p>Copyright {} {}</p>", "<div>{}</div><p>{}</p>", "<ul><li><a href='/p'>{}</a></li><li>{}</li></ul>"]).format(short, _prose(rng, rng.randint(2, 14)))
    if kind == "sidebar":
        return f"<h3>{short}</h3>" + rng.choice(["<ul>{}</ul>".format("".join(f"<li><a href='/r'>{_prose(rng, rng.randint(2, 8))}</a></li>" for _ in range(rng.randint(2, 6)))), f"<p>{_prose(rng, rng.randint(5, 40))}</p>"])
    if kind == "notice":
        return rng.choice(["<p>{}</p><button>OK</button>", "<div>{}</div>", "{} <a href='/c'>x</a>", "<p>{}</p>"]).format(_prose(rng, rng.randint(4, 30)))
    if kind == "advert":
        return rng.choice(["{}", "<p>{}</p>", "<a href='//z'>{}</a>", "<div><b>{}</b></div>"]).format(_prose(rng, rng.randint(2, 30)))
    if kind == "form":
        return f"<label>{short}</label><input><label>{_prose(rng, 2)}</label><select><option>{short}</option></select><button>{short}</button>"
    if kind == "comments":
        return "".join(rng.choice(["<div><b>{}</b><p>{}</p></div>", "<li><p>{}</p><p>{}</p></li>", "<p>{}: {}</p>"]).format(_prose(rng, 1).rstrip("."), _prose(rng, rng.randint(3, 60))) for _ in range(rng.randint(1, 4)))
    return rng.choice(["<p>{}</p>", "<a href='#'>{}</a>", "<span>{}</span>"]).format(_prose(rng, rng.randint(1, 5)))


def _part(rng: random.Random, kind: str) -> str:
    plain = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
    style = rng.random()
    tag = plain if style < 0.55 else rng.choice(["div", "section", "div"])
    name = rng.choice(PART_NAMES[kind])
    joined = rng.choice([name, name, f"{name}-{rng.choice(['box', 'wrap', 'area', 'list', 'inner', 'top', 'x'])}", f"{rng.choice(['site', 'page', 'js', 'block'])}-{name}"])
    named = f" {rng.choice(['class', 'class', 'id', 'role'])}=\"{joined}\"" if tag != plain or plain in ("div", "section") or rng.random() < 0.4 else ""
    return f"<{tag}{named} data-label='0'>{_item(rng, kind)}</{tag}>"


def training_pages(count: int = 900, seed: int = 11) -> list[str]:
    """Labelled pages: articles amid the other parts that pages have."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        inside: list[str] = [f"<h1>{_worn(rng, _prose(rng, rng.randint(3, 14)))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            text = _worn(rng, _prose(rng, rng.choice([1, 2, 5, 12, 30, 80, 150])))
            inside.append(rng.choice([
                f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f"<h2>{_prose(rng, 4)}</h2><p>{text}</p>",
                f"<p>{text} <a href='/q'>{_prose(rng, 2)}</a> {_prose(rng, 8)}</p>", "<ul>" + "".join(f"<li>{_prose(rng, rng.randint(2, 15))}</li>" for _ in range(3)) + "</ul>", f"<pre>{text}</pre>",
                f"<table><tr><td>{_prose(rng, 2)}</td><td>{_prose(rng, 3)}</td></tr></table>", f"<figure><img src='i'><figcaption>{_prose(rng, 7)}</figcaption></figure>",
            ]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            inside.insert(rng.randint(0, len(inside)), _part(rng, rng.choice(["advert", "share", "notice", "sidebar", "form"])))
        if rng.random() < 0.3:
            inside.append(_part(rng, "comments"))
        kind = rng.random()
        name = rng.choice(MAIN_NAMES)
        name = rng.choice([name, name, f"{name}-{rng.choice(MAIN_NAMES)}", f"{rng.choice(['site', 'page', 'js', 'block'])}-{name}"])
        begin, end = ("<article>", "</article>") if kind < 0.4 else ("<main>", "</main>") if kind < 0.55 else (f"<div class='{name}'>", "</div>") if kind < 0.8 else (f"<div id='{name}'>", "</div>") if kind < 0.92 else ("", "")
        before = [_part(rng, k) for k in rng.sample(["menu", "header", "notice", "advert", "sidebar", "form", "share"], rng.randint(0, 4))]
        after = [_part(rng, k) for k in rng.sample(["menu", "footer", "footer", "sidebar", "advert", "comments", "form", "notice", "share"], rng.randint(0, 4))]
        body = "".join([*before, begin.replace(">", " data-label='1'>"), *inside, end, *after])
        out.append(f"<html><head><title>t</title></head><body{'' if begin else " data-label='1'"}>{rng.choice(['{}', '<div class=wrapper>{}</div>', '<div id=page><div class=container>{}</div></div>']).format(body)}</body></html>")
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    pages = []
    for page in training_pages():
        found = blocks(page)
        pages.append((features(found, [b.text() for b in found]), [int(b.label or 0) for b in found]))
    return Field().train(pages)


def extract(field: Field, page: str | None) -> str:
    """The main text of one page: main blocks in page order, one to a line."""
    if not page:
        return ""
    found = blocks(page)
    texts = [b.text() for b in found]
    both = [(b, t) for b, t in zip(found, texts) if t]
    if not both:
        return ""
    found, texts = map(list, zip(*both))
    return "\n".join(t for t, y in zip(texts, field.decode(field.scores(found, texts))) if y)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    field = trained()
    shared = pages.sparkSession.sparkContext.broadcast((field.weight, field.t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field()
        f.weight, f.t = shared.value
        for b in batches:
            texts = [extract(f, h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
