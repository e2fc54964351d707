"""Main text of web pages: gradient-boosted trees score DOM nodes, a tree decoding makes the choices agree.

Each block-level element is a node with features of its subtree (text, links, tags), its attributes, its depth and
its siblings. The trees give the log-odds that it is main text; the decoding then finds the best set of subtrees to
drop, by dynamic programming, so that nothing below a dropped node is kept. The trees are trained here, on the
driver, on generated pages; they go to the tasks with the function (a few hundred KB).

Defined cases: a null or empty page has an empty text; pages are read whole, with broken markup read as browsers do
in the common cases (unclosed paragraphs, items, buttons and drawings, stray ends, missing heads), in time in
proportion to their length and depth; all that Python counts as white space, no-break spaces too, becomes one space;
repeated rows are read each; equal scores keep a node; an empty table gives an empty table; columns but those named are
not read, and results get underscores before their names until these are free.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

#: Fixed sets of HTML elements: what ends a block, what has no content, what is never text, what ends implicitly.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SILENT = frozenset("template noscript svg iframe object select button datalist canvas audio video map annotation annotation-xml".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements inside which an open paragraph outside is none of theirs.
KEEPS_PARAGRAPH = ("td", "th", "li", "table", "article", "section", "div")
#: Characters of pages that are scored at once.
PACK_CHARS = 500_000
#: A value behind an equals sign goes up to its quote, whatever it holds; a quote that never ends is a plain character.
VALUE = r"=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|)"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|{VALUE})*+)>")
ATTRIBUTE = re.compile(rf"([^\s=/]++)\s*+(?:({VALUE}))?")
NAMED = frozenset(("class", "id", "role", "style", "aria-hidden", "hidden"))
TOKEN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

GOOD = frozenset("article content main post entry story text body prose copy page".split())
BAD = {
    "menu": frozenset("nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager links toc skip".split()),
    "frame": frozenset("header head masthead footer foot topbar bottom copyright legal logo site".split()),
    "side": frozenset("sidebar side aside rail widget related recommended recommendations more popular trending teaser tags archive".split()),
    "ad": frozenset("ad ads adslot adv advert advertisement advertising adsense banner sponsor sponsored promo promotion commercial outbrain taboola".split()),
    "notice": frozenset("cookie cookies consent gdpr notice alert warning popup modal overlay dialog toast message newsletter subscribe signup paywall".split()),
    "talk": frozenset("comment comments reply replies respond disqus discussion reader readers thread review reviews feedback".split()),
    "form": frozenset("form login signin search contact input field".split()),
    "share": frozenset("share social sharing follow twitter facebook print".split()),
}
TAGS = ("article", "main", "section", "div", "p", "h", "ul", "li", "table", "nav", "header", "footer", "aside", "form", "blockquote", "figure", "pre", "body")
FEATURES = (
    *(f"tag_{t}" for t in TAGS), *(f"in_{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form", "li", "table")),
    "good", *(f"bad_{k}" for k in BAD), "in_good", *(f"in_bad_{k}" for k in BAD), "hidden",
    "depth", "chars", "link_share", "tag_density", "blocks", "chars_a_block", "stops", "paragraph_share", "page_share", "parent_share", "siblings", "like_siblings", "before", "inputs",
)
AT = {f: i for i, f in enumerate(FEATURES)}


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "hidden", "chars", "links", "tags", "blocks", "stops", "paragraph", "inputs", "texts", "start", "children", "drop")

    def __init__(self, tag, parent, depth, tokens, hidden, start):
        self.tag, self.parent, self.depth, self.tokens, self.hidden, self.start = tag, parent, depth, tokens, hidden, start
        self.chars = self.links = self.tags = self.blocks = self.stops = self.paragraph = self.inputs = 0
        self.texts: list[tuple[int, str]] = []
        self.children: list[int] = []
        self.drop = tag == "head"


def _attributes(raw: str) -> tuple[frozenset[str], bool]:
    tokens, hidden = set(), False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "")[1:].strip().strip("\"'")
        if name not in NAMED:
            continue
        if name in ("class", "id", "role"):
            tokens |= {t.lower() for t in TOKEN.findall(value)}
        elif name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        else:
            hidden |= value.lower() != "false"
    return frozenset(tokens), hidden


class Stack:
    """The open elements, and for each tag the places where it is open: what a tag closes is found without a search."""

    def __init__(self):
        self.nodes, self.tags, self.places = [0], ["root"], {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, to: int) -> None:
        while len(self.nodes) > to:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()

    def inmost(self, tags) -> int:
        """The inmost place where one of the tags is open, 0 if none is."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


class Silence:
    """Whether the reading is inside an element that is never text.

    Such an element ends with its end tag, or with that of an enclosing block; one whose end tag does not follow in
    the page is read as if it were not there.
    """

    def __init__(self, page: str):
        self.page, self.names, self.places, self.inner, self.ends = page, [], {}, {}, {}

    def ended_after(self, tag: str, at: int) -> bool:
        if tag not in self.ends:
            self.ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", self.page, re.I)), default=-1)
        return self.ends[tag] >= at

    def tag(self, tag: str, close: bool, empty: bool, at: int) -> None:
        if close:
            if places := self.places.get(tag):
                to = places[-1]
                while len(self.names) > to:
                    self.places[self.names.pop()].pop()
                if not self.names:
                    self.inner = {}
        elif not empty and self.ended_after(tag, at):
            self.places.setdefault(tag, []).append(len(self.names))
            self.names.append(tag)

    def block(self, tag: str, close: bool, open_outside: bool) -> bool:
        """Take note of a block's tag inside; True if it ends the silence, as the end of a block around it."""
        n = self.inner.get(tag, 0)
        if not close:
            self.inner[tag] = n + 1
        elif n:
            self.inner[tag] = n - 1
        elif open_outside:
            self.names, self.places, self.inner = [], {}, {}
            return True
        return False


def parse(page: str) -> list[Node]:
    """Nodes in page order, the first a root; each text block belongs to the block-level element it stands in.

    Time is in proportion to the page, however deep or broken it is.
    """
    nodes = [Node("root", -1, 0, frozenset(), False, 0)]
    stack, silence, run, links, block = Stack(), Silence(page), [], 0, 0
    in_link, at, n = False, 0, len(page)

    def flush():
        nonlocal run, links, block
        if run:
            text = " ".join("".join(run).split())
            if text:
                node = nodes[stack.nodes[-1]]
                node.texts.append((block, text))
                block += 1
                node.chars += len(text)
                node.links += min(links, len(text))
                node.blocks += 1
                node.stops += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                if node.tag == "p" or node.tag == "blockquote":
                    node.paragraph += len(text)
            run = []
        links = 0

    def leave(to: int):
        flush()
        stack.cut(to)

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > at:
            if not silence.names:
                text = html.unescape(page[at : lt if lt >= 0 else n])
                run.append(text)
                if in_link:
                    links += len(text)
            if lt < 0:
                break
            at = lt
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, at)
        if not m:
            if page.startswith(("<!", "<?"), at) or page.startswith("</", at):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            elif at + 1 < n and page[at + 1].isalpha():
                break  # a tag that never ends
            else:
                if not silence.names:
                    run.append("<")
                at += 1
            continue
        close, tag, at = bool(m[1]), m[2].lower(), m.end()
        if tag in RAW and not close:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag == "textarea":
                nodes[stack.nodes[-1]].inputs += 1
            continue
        if tag in SILENT:
            silence.tag(tag, close, m[3].rstrip().endswith("/"), at)
            if tag in ("select", "button") and not close:
                nodes[stack.nodes[-1]].inputs += 1
            if not silence.names:
                run.append(" ")
            continue
        if silence.names and not (tag in BLOCKS and silence.block(tag, close, bool(stack.places.get(tag)))):
            continue
        nodes[stack.nodes[-1]].tags += not close
        if tag == "br" or tag == "hr":
            if tag == "hr":
                flush()
            run.append(" ")
        elif tag == "input":
            nodes[stack.nodes[-1]].inputs += 1
        elif tag == "a":
            in_link = not close
        elif tag in BLOCKS:
            if tag in ("html", "body"):
                if tag == "body" and not close:
                    leave(1)
                else:
                    continue
            if close:
                if to := stack.inmost((tag,)):
                    leave(to)
                else:
                    flush()
                continue
            flush()
            if tag in CLOSES and (to := stack.inmost(CLOSES[tag])) > stack.inmost(SCOPES[tag]):
                stack.cut(to)
            if (to := stack.inmost(("p",))) > stack.inmost(KEEPS_PARAGRAPH):
                stack.cut(to)
            tokens, hidden = _attributes(m[3]) if m[3].strip() else (frozenset(), False)
            parent = stack.nodes[-1]
            nodes[parent].children.append(len(nodes))
            stack.push(len(nodes), tag)
            nodes.append(Node(tag, parent, len(stack.nodes) - 1, tokens, hidden, block))
    flush()
    return nodes


@functools.lru_cache(maxsize=10_000)
def meanings(token: str) -> frozenset[str]:
    """Kinds of an attribute token: its own, or those of a name of five letters or more that begins it."""
    kinds = {"good": GOOD} | {f"bad_{k}": names for k, names in BAD.items()}
    return frozenset(k for k, names in kinds.items() if token in names or any(len(x) >= 5 and token.startswith(x) for x in names))


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node."""
    n = len(nodes)
    x = np.zeros((n, len(FEATURES)), np.float32)
    total = np.array([[v.chars, v.links, v.tags, v.blocks, v.stops, v.paragraph, v.inputs] for v in nodes], np.float64)
    parents = [v.parent for v in nodes]
    for i in range(n - 1, 0, -1):
        total[parents[i]] += total[i]
    page, last = max(total[0, 0], 1), max(total[0, 3], 1)
    inside: list[int] = []  # marks of a node and of those above it, one bit a feature
    alike = [Counter(nodes[k].tag for k in v.children) for v in nodes]
    tag_at = {t: AT[f"tag_{t}"] for t in TAGS}
    in_at = {t: AT[f"in_{t}"] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "li", "table")}
    for i, v in enumerate(nodes):
        row, t = x[i], v.tag
        t = "h" if len(t) == 2 and t[0] == "h" else "ul" if t in ("ol", "menu", "dl") else "li" if t in ("dd", "dt") else "table" if t in ("td", "th", "tr", "tbody", "thead") else t
        if t in tag_at:
            row[tag_at[t]] = 1
        own = inside[v.parent] if v.parent >= 0 else 0
        marks = own
        while marks:
            low = marks & -marks
            row[low.bit_length() - 1] = 1
            marks ^= low
        if t in in_at:
            own |= 1 << in_at[t]
        if v.tokens:
            for k in frozenset().union(*map(meanings, v.tokens)):
                row[AT[k]] = 1
                own |= 1 << AT[f"in_{k}"]
        if v.hidden:
            row[AT["hidden"]] = 1
            own |= 1 << AT["hidden"]
        inside.append(own)
        chars, links, tags, blocks, stops, paragraph, inputs = total[i]
        up = nodes[v.parent].children if v.parent >= 0 else ()
        row[AT["depth"]] = v.depth
        row[AT["chars"]] = np.log1p(chars)
        row[AT["link_share"]] = links / chars if chars else 0
        row[AT["tag_density"]] = tags / (chars + 20) * 100
        row[AT["blocks"]] = np.log1p(blocks)
        row[AT["chars_a_block"]] = np.log1p(chars / blocks) if blocks else 0
        row[AT["stops"]] = stops / (chars + 1) * 100
        row[AT["paragraph_share"]] = paragraph / chars if chars else 0
        row[AT["page_share"]] = chars / page
        row[AT["parent_share"]] = chars / max(total[v.parent, 0], 1) if v.parent >= 0 else 1
        row[AT["siblings"]] = min(len(up), 50)
        row[AT["like_siblings"]] = min(alike[v.parent][v.tag], 50) if up else 0
        row[AT["before"]] = v.start / last
        row[AT["inputs"]] = min(inputs, 10)
    return x


class Trees:
    """Boosted regression trees of a fixed depth for the logistic loss."""

    DEPTH, BINS = 3, 24

    def __init__(self, rounds: int = 110, rate: float = 0.25):
        self.rounds, self.rate, self.base = rounds, rate, 0.0
        self.split: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, self.BINS))) for k in range(m)]
        bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
        width, inner = self.BINS + 1, 2**self.DEPTH - 1
        share = np.average(y, weights=weight)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(self.DEPTH):
                first, count = 2**level - 1, 2**level
                local = (at - first) * width
                best = np.full(count, 1e-6)
                for k in range(m):
                    if not len(cuts[k]):
                        continue
                    cell = local + bins[k]
                    gs = np.bincount(cell, g, count * width).reshape(count, width)
                    hs = np.bincount(cell, h, count * width).reshape(count, width)
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < 2) | (ht - hl < 2)] = 0
                    gain[:, len(cuts[k]) :] = 0
                    top = gain.argmax(1)
                    for c in np.flatnonzero(gain[range(count), top] > best):
                        best[c] = gain[c, top[c]]
                        feature[first + c], cut[first + c] = k, cuts[k][top[c]]
                at = 2 * at + 1 + (x[range(n), feature[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, 2**self.DEPTH) / (np.bincount(leaf, h, 2**self.DEPTH) + 1)
            self.split.append((feature, cut.astype(np.float32), value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.DEPTH - 1
        for feature, cut, value in self.split:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes to keep: the best choice in which all nodes below a dropped one are dropped."""
    n = len(nodes)
    keep, drop = odds.astype(float).copy(), -odds.astype(float)
    for i in range(n - 1, 0, -1):
        if nodes[i].drop:
            keep[i] = -np.inf
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def main_text(nodes: list[Node], odds: np.ndarray) -> str:
    kept = decode(nodes, odds)
    blocks = sorted(b for v, k in zip(nodes, kept) if k for b in v.texts)
    return "\n\n".join(t for _, t in blocks)


def generated(rnd: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    pool = ["the", "of", "and", "to", "in", "with", "la", "der", "que", "tion", "anea", "erst", "blewh", "éreau", "sch", "keit", "ción", "ando", "on", "for", "as", "it"]
    word = lambda: rnd.choice(pool) + rnd.choice(("", "", rnd.choice(pool)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))

    def prose(a=5, b=90):
        out = words(a, b).split()
        for i in range(0, len(out), 9):
            out[i] += rnd.choice((",", ".", "."))
        return (" ".join(out).capitalize() + rnd.choice((".", ".", "", "!"))).strip()

    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9))) + "</ul>"
    name = lambda *names: rnd.choice((f' class="{rnd.choice(names)}"', f' id="{rnd.choice(names)}"', f' class="{rnd.choice(names)} {word()}"'))

    def menu():
        return rnd.choice((f"<nav>{items()}</nav>", f"<div{name('menu', 'nav-main', 'navbar', 'breadcrumbs')}>{items()}</div>", f"<nav{name('nav')}>{' | '.join(link() for _ in range(5))}</nav>", items()))

    def header():
        return rnd.choice((f"<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>{menu() if rnd.random() < 0.5 else ''}</header>", f"<div{name('header', 'masthead', 'site-header', 'topbar')}><p>{prose(3, 20)}</p></div>", f"<header><p>{prose(3, 30)}</p></header>"))

    def footer():
        return rnd.choice((f"<footer>&copy; {words(1, 4)} &middot; {prose(3, 20)}</footer>", f"<footer><p>{prose(3, 40)}</p>{items()}</footer>", f"<div{name('footer', 'site-footer', 'copyright')}><p>{prose(3, 30)}</p></div>"))

    def extra():
        body = "".join(f"<{t}>{prose(3, 60)}</{t}>" for t in ["p"] * rnd.randint(1, 4)) if rnd.random() < 0.7 else prose(3, 40)
        kind = rnd.randrange(8)
        if kind == 0:
            return f"<aside{name('sidebar', 'related') if rnd.random() < 0.6 else ''}>{'<h3>' + words(1, 4) + '</h3>' if rnd.random() < 0.5 else ''}{body if rnd.random() < 0.6 else items()}</aside>"
        if kind == 1:
            return f"<div{name('sidebar', 'widget', 'related-posts', 'right-rail', 'side')}>{body}{items() if rnd.random() < 0.5 else ''}</div>"
        if kind == 2:
            return f"<div{name('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo')}>{body}</div>"
        if kind == 3:
            return f"<{(t := rnd.choice(('div', 'section', 'p')))}{name('notice', 'cookie-notice', 'cookie-banner', 'alert', 'consent', 'newsletter')}>{prose(3, 40) if t == 'p' else body}</{t}>"
        if kind == 4:
            return f"<form{name('search', 'login', 'contact-form') if rnd.random() < 0.5 else ''}><p>{prose(2, 12)}</p><label>{words(1, 3)}</label><input name=q><textarea>{words(0, 9)}</textarea><button>{words(1, 2)}</button></form>"
        if kind == 5:
            return f"<{(t := rnd.choice(('div', 'section')))}{name('comments', 'comment-list', 'discussion', 'reader-comments')}><h3>{words(1, 3)}</h3>" + "".join(f'<div class="{rnd.choice(("comment", "reply", "comment-body"))}"><p>{prose(4, 70)}</p></div>' for _ in range(rnd.randint(1, 5))) + f"</{t}>"
        if kind == 6:
            return f"<ol{name('comments', 'commentlist')}>" + "".join(f"<li><p>{prose(4, 60)}</p></li>" for _ in range(rnd.randint(1, 5))) + "</ol>"
        return f"<div{name('share', 'social', 'tags')}>{''.join(link() for _ in range(3))}</div>"

    blocks, main = [], ""
    if rnd.random() < 0.8:
        blocks.append(words(2, 10))
        main += f"<h1>{blocks[-1]}</h1>"
        if rnd.random() < 0.15:  # a heading in a frame of its own
            main = rnd.choice((f"<div{name('post-header', 'entry-header', 'article-header', 'story-head')}>{main}</div>", f"<header>{main}</header>"))
    inner_extras = rnd.random() < 0.3
    for k in range(rnd.choice((1, 1, 1, 2, 4, 8, 14))):
        t = prose(1, 4) if rnd.random() < 0.15 else prose(8, 120)
        kind = rnd.random()
        if kind < 0.06:
            parts = [prose(2, 12) for _ in range(rnd.randint(2, 5))]
            blocks += parts
            main += "<ul>" + "".join(f"<li>{x}</li>" for x in parts) + "</ul>"
        elif kind < 0.12:
            blocks += [words(2, 6), t]
            main += f"<h2>{blocks[-2]}</h2><p>{t}</p>"
        elif kind < 0.16:
            blocks.append(t)
            main += f"<blockquote>{t}</blockquote>"
        elif kind < 0.2:
            cells = [words(1, 4) for _ in range(4)]
            blocks += cells
            main += f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>"
        elif kind < 0.3:
            blocks.append(t)
            main += f"<p><b>{t}<br>"
        elif kind < 0.36:
            blocks.append(t)
            main += f"<div>{t}</div>"
        else:
            blocks.append(t)
            w = t.split(" ")
            if rnd.random() < 0.2:
                w[len(w) // 2] = f'<a href="/x">{w[len(w) // 2]}</a>'
            main += f"<p>{' '.join(w)}</p>"
        if inner_extras and rnd.random() < 0.3:
            main += extra()
    wrap = rnd.choice(("article", "article", "article", "main", "good", "good", "article in main", "section", "bare"))
    main = {"article": f"<article>{main}</article>", "main": f"<main>{main}</main>", "good": f"<div{name('content', 'post', 'entry-content', 'article-body', 'story', 'main-content')}>{main}</div>", "article in main": f"<main><article{name('post', 'entry')}>{main}</article></main>", "section": f"<section{name('content', 'article')}>{main}</section>", "bare": f"<div>{main}</div>"}[wrap]
    before = [f() for f in rnd.sample((header, menu, extra, extra), rnd.randint(0, 3))]
    after = [f() for f in rnd.sample((footer, extra, extra, menu), rnd.randint(0, 3))]
    if rnd.random() < 0.2:
        main = f'<div{name("wrapper", "container", "row")}>{main}{extra() if rnd.random() < 0.5 else ""}</div>'
    return f"<html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>", blocks


def labelled(page: str, blocks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, whether most text below is main text, and weights of the nodes of a generated page."""
    nodes = parse(page)
    wanted = [" ".join(html.unescape(b).split()) for b in blocks]
    found = sorted(b for v in nodes for b in v.texts)
    good, k = set(), 0
    for place, text in found:  # main blocks stand in page order
        if k < len(wanted) and text == wanted[k]:
            good.add(place)
            k += 1
    yes, total = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        v = nodes[i]
        yes[i] += sum(len(t) for p, t in v.texts if p in good)
        total[i] += sum(len(t) for _, t in v.texts)
        if v.parent >= 0:
            yes[v.parent] += yes[i]
            total[v.parent] += total[i]
    # a node with any main text is kept: what else stands in it is dropped below
    return features(nodes), (yes > 0).astype(float), np.where(total > 0, 1.0, 0.05) * np.where([v.tag == "root" for v in nodes], 0.0, 1.0)


@functools.lru_cache(maxsize=1)
def trained(pages: int = 900, seed: int = 5) -> Trees:
    rnd = random.Random(seed)
    parts = [labelled(*generated(rnd)) for _ in range(pages)]
    x, y, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return Trees().fit(x[w > 0], y[w > 0], w[w > 0])


def _packs(pages: pa.Array) -> Iterator[list[str]]:
    """The pages in packs of a bounded size, a larger page by itself; the trees score a pack at once."""
    pack, size = [], 0
    for p in pages:
        pack.append(p.as_py())
        size += len(pack[-1])
        if size >= PACK_CHARS:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row the columns `keep`, `text` and `n_chars`."""
    trees = trained()

    def read(pages: pa.Array) -> list[pa.Array]:
        out: list[str] = []
        for some in _packs(pages):
            parsed = [parse(p) for p in some]
            odds = trees.predict(np.concatenate([features(p) for p in parsed]))
            k = 0
            for p in parsed:
                out.append(main_text(p, odds[k : k + len(p)]))
                k += len(p)
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    return map_text(df, page, keep, read, [("text", "string"), ("n_chars", "long")])
