"""Main text of web pages by a tree-structured graphical model.

A page is parsed leniently into a tree of elements and texts. Each node is main text or not; its tag,
the words of its class, id and role, its amount of text, of links and of sentence marks speak for one
or the other, and potentials between parent and child, by kind of child, tie neighbours together.
Sum-product messages go up from the leaves and down from the root, for many pages at once and level by
level, and give each node's exact probability. Weights are trained once, on the driver, by likelihood from
labelled pages, which `labelled_page` makes in many layouts, and broadcast. Texts more likely main text than
not are joined. Reading a page takes time linear in its length, whatever tags, quotes or comments stay open.

Defined cases: null, empty or tagless html is no page or all text and gives what text there is; a page
without main text gives an empty string; an empty table gives an empty result; repeated rows give
repeated rows; other columns are kept, those with an output's name replaced. What scripts, styles,
templates, buttons, option lists, text areas and the head hold is never text.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_batches, once, table, text_or_empty

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
STOP = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
#: Characters in which the end of a tag is looked for first.
NEAR = 1024
ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template iframe svg select textarea button title head".split()}
#: Without an end tag these hold nothing; the others hold the rest of the page.
OPTIONAL = frozenset("head button select svg template title".split())
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A tag that opens ends an open one of these, up to the nearest of the bounds.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ENDS_P = BLOCK - {"br", "html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
MARKS = re.compile(r"[.!?;:,。、]")
ROWS = 1 << 14
#: Character that marks main text in labelled pages.
MAIN = "\ue000"


class Ends:
    """Where tags of one page end: the first > outside quotes. What fails is noted, so that all calls together take linear time."""

    def __init__(self, page: str):
        self.page, self.dead, self.first, self.last = page, set(), 0, -1
        self.open = {'"': len(page), "'": len(page), ">": len(page)}  # from here on none of these follows

    def find(self, mark: str, at: int) -> int:
        found = -1 if at >= self.open[mark] else self.page.find(mark, at)
        if found < 0:
            self.open[mark] = min(self.open[mark], at)
        return found

    def tag(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at `at`, else -1."""
        end = ATTRIBUTES.match(self.page, at, at + NEAR).end()
        return end if self.page[end : end + 1] == ">" else self._far(at)

    def _far(self, at: int) -> int:
        if not self.first <= at <= self.last:
            m = STOP.search(self.page, at)
            self.first, self.last = at, m.start() if m else len(self.page)
        place, passed = self.last, []
        while place < len(self.page) and place not in self.dead:
            mark = self.page[place]
            if mark == ">":
                return place
            passed.append(place)
            close = self.find(mark, place + 1)
            if close < 0:
                break
            m = STOP.search(self.page, close + 1)
            place = m.start() if m else len(self.page)
        self.dead.update(passed)
        return -1


class Tree:
    """Nodes in page order, each subtree a range: parent, end, depth, what it is (tag and names), text of leaves, breaks before."""

    __slots__ = ("depth", "end", "key", "link", "parent", "text", "breaks")

    def __init__(self, page: str):
        self.parent, self.end, self.depth, self.key, self.text, self.link, self.breaks = [-1], [0], [0], ["#root"], [""], [False], [False]
        stack, tags, places, at, links, broken = [0], ["#root"], {}, 0, 0, False  # places: of each tag the open ones in the stack
        parent, end, depth, key, text, link, breaks = self.parent, self.end, self.depth, self.key, self.text, self.link, self.breaks
        ends, missing = Ends(page), set()
        size = len(page)

        def add(name: str, words: str) -> None:
            nonlocal broken
            parent.append(stack[-1])
            end.append(0)
            depth.append(len(stack))
            key.append(name)
            text.append(words)
            link.append(links > 0)
            breaks.append(broken)
            broken = False

        def pop() -> None:
            nonlocal links, broken
            node, tag = stack.pop(), tags.pop()
            end[node] = len(parent)
            places[tag].pop()
            links -= tag == "a"
            broken |= tag in BLOCK

        def close(names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
            """End the outermost open one of `names` above the nearest of `bounds`, with all that it holds."""
            bound = max((places[n][-1] for n in bounds if places.get(n)), default=0)
            above = [places[n][i] for n in names if places.get(n) and (i := bisect.bisect_right(places[n], bound)) < len(places[n])]
            while above and len(tags) > min(above):
                pop()

        def words(upto: int) -> None:
            if upto > at:
                raw = page[at:upto]
                if not raw.isspace():
                    add("#text", html.unescape(raw) if "&" in raw else raw)
                elif parent:
                    add("#space", raw)

        start = page.find("<")
        while start >= 0:
            m, named, stop = NAME.match(page, start), None, -1
            if m:
                stop = ends.tag(m.end())
                named = m if stop >= 0 else None
            if page.startswith("<!--", start):
                last = COMMENT_END.search(page, start + 4)
                stop = last.end() - 1 if last else size - 1
            elif not named and page[start + 1 : start + 2] in ("!", "?", "/"):
                stop = ends.find(">", start + 2)
            if stop < 0:
                start = page.find("<", start + 1)
                continue
            words(start)
            at = stop + 1
            start = page.find("<", at)
            if not named:
                continue
            tag, alone = m[2].lower(), page[stop - 1] == "/"
            if not m[1] and tag in ENDS and (page[m.end()] in "/>" or page[m.end()].isspace()):
                last = None if alone or tag in missing else ENDS[tag].search(page, at)
                if not last and not alone:
                    missing.add(tag)
                at = last.end() if last else at if tag in OPTIONAL or alone else size
                start = page.find("<", at)
                continue
            if m[1]:
                if tag == "br":
                    broken = True
                elif tag == "p" and not places.get("p"):
                    broken = True
                elif places.get(tag):
                    while tags[-1] != tag:
                        pop()
                    pop()
                continue
            if tag in ENDS_P and places.get("p"):
                close(("p",), ("table", "td", "th", "button", "object"))
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in BLOCK:
                broken = True
            if tag in VOID:
                continue
            given = stop > m.end() and NAMED.findall(page, m.end(), stop)
            add(tag if not given else tag + " " + " ".join(p.lower() for group in given for value in group for p in PARTS.findall(value)), "")
            places.setdefault(tag, []).append(len(stack))
            stack.append(len(parent) - 1)
            tags.append(tag)
            links += tag == "a"
        words(size)
        while len(stack) > 1:
            pop()
        end[0] = len(parent)
        for i, e in enumerate(end):
            if not e:
                end[i] = i + 1

    def join(self, chosen) -> str:
        out = []
        for i, words in enumerate(self.text):
            if self.breaks[i]:
                out.append(" ")
            if words and (chosen[i] or self.key[i] == "#space"):
                out.append(words)
        return " ".join("".join(out).split())


class Forest:
    """Many trees as arrays."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees])
        begin = np.cumsum(sizes) - sizes
        flat = lambda name, kind: np.fromiter((x for t in trees for x in getattr(t, name)), kind, int(sizes.sum()))
        shift = np.repeat(begin, sizes)
        self.begin, self.sizes = begin, sizes
        self.parent = flat("parent", "int64") + shift
        self.depth, end, linked = flat("depth", "int64"), flat("end", "int64") + shift, flat("link", bool)
        self.parent[self.depth == 0] = -1
        self.keys = [k for t in trees for k in t.key]
        texts = [x for t in trees for x in t.text]
        chars = np.array([len(x.replace(MAIN, "")) if not x.isspace() else 0 for x in texts])
        marks = np.array([len(MARKS.findall(x)) if x else 0 for x in texts])
        main = np.array([len(x) if MAIN in x else 0 for x in texts])
        at = np.arange(len(end))
        under = lambda own: (c := np.concatenate([[0], np.cumsum(own)]))[end] - c[at]
        self.chars, self.linked, self.marks, self.main = under(chars), under(chars * linked), under(marks), under(main)
        nodes = under(np.ones(len(end), "int64"))
        self.leaf = np.array([k[0] == "#" and k != "#root" for k in self.keys])
        share = self.linked / np.maximum(self.chars, 1)
        rank = lambda x, cuts: np.searchsorted(cuts, x, "right")
        length, links = rank(self.chars, [1, 10, 25, 60, 140, 400, 1500]), rank(share, [0.01, 0.2, 0.5, 0.9])
        said, kids = rank(self.marks, [1, 2, 4, 12]), rank(nodes, [2, 4, 10, 40])
        page = np.repeat(self.chars[begin], sizes)
        part = rank(self.chars / np.maximum(page, 1), [0.05, 0.2, 0.5])
        leaf = self.leaf.astype("int64")
        self.measures = np.stack([length + 8 * leaf, 16 + links + 5 * leaf, 26 + said + 5 * leaf, 36 + kids, 41 + part + 4 * leaf, 49 + links * 8 + length], 1)
        tags = [k.split(" ", 1)[0] for k in self.keys]
        inline = np.array([t not in BLOCK for t in tags])
        self.kind = np.where(self.leaf, 0, np.where(inline, 1, 2))
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)] if len(self.depth) and self.depth.max() < 300 else self._deep()

    def _deep(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)


class Model:
    def __init__(self, named: np.ndarray | None = None, measured: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.named = np.zeros(ROWS) if named is None else named
        self.measured = np.zeros(89) if measured is None else measured
        self.pairs = np.zeros((3, 2, 2)) if pairs is None else pairs
        self.scores: dict[str, float] = {}

    @staticmethod
    def rows_of(key: str, above: str) -> list[int]:
        tag, *names = key.split(" ")
        above_tag = above.split(" ", 1)[0]
        found = [f"t{tag}", f"u{above_tag}/{tag}", *(f"n{n}" for n in dict.fromkeys(names) if n)]
        return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % ROWS for f in found]

    def unary(self, forest: Forest) -> np.ndarray:
        out = self.measured[forest.measures].sum(1)
        keys, parent = forest.keys, forest.parent.tolist()
        if len(self.scores) > 200_000:
            self.scores.clear()
        named = np.empty(len(keys))
        for i, k in enumerate(keys):
            above = keys[parent[i]] if parent[i] >= 0 else ""
            pair = above + "\n" + k
            if (s := self.scores.get(pair)) is None:
                s = self.scores[pair] = float(self.named[self.rows_of(k, above)].sum())
            named[i] = s
        return out + named

    def messages(self, forest: Forest, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upward beliefs, beliefs (both log odds), and the parent's log odds without each child."""
        up, sent, full, rest = unary.copy(), np.zeros(len(unary)), np.empty(len(unary)), np.zeros(len(unary))
        p = self.pairs[forest.kind]
        for level in forest.levels[:0:-1]:
            s, q = up[level], p[level]
            sent[level] = np.logaddexp(q[:, 1, 0], q[:, 1, 1] + s) - np.logaddexp(q[:, 0, 0], q[:, 0, 1] + s)
            np.add.at(up, forest.parent[level], sent[level])
        full[forest.levels[0]] = up[forest.levels[0]]
        for level in forest.levels[1:]:
            t, q = full[forest.parent[level]] - sent[level], p[level]
            rest[level] = t
            full[level] = up[level] + np.logaddexp(q[:, 0, 1], q[:, 1, 1] + t) - np.logaddexp(q[:, 0, 0], q[:, 1, 0] + t)
        return up, full, rest

    def probabilities(self, forest: Forest) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.messages(forest, self.unary(forest))[1], -500, 500)))

    @classmethod
    def train(cls, pages: list[str], rounds: int = 150, rate: float = 0.3, decay: float = 2e-4) -> Model:
        """Weights of greatest likelihood for pages whose main text is marked."""
        self, forest = cls(), Forest([Tree(p) for p in pages])
        gold = (2 * forest.main > forest.chars).astype(float)
        rows = [self.rows_of(k, forest.keys[p] if p >= 0 else "") for k, p in zip(forest.keys, forest.parent, strict=True)]
        node = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        row = np.fromiter((x for r in rows for x in r), "int64")
        child = np.flatnonzero(forest.parent >= 0)
        a, b, kind = gold[forest.parent[child]].astype(int), gold[child].astype(int), forest.kind[child]
        counts = np.zeros((3, 2, 2))
        np.add.at(counts, (kind, a, b), 1)
        seen, n = [np.full(x.shape, 1e-6) for x in (self.named, self.measured, self.pairs)], len(gold)
        for _ in range(rounds):
            unary = self.measured[forest.measures].sum(1) + np.bincount(node, self.named[row], n)
            up, full, rest = self.messages(forest, unary)
            miss = gold - 1 / (1 + np.exp(-np.clip(full, -500, 500)))
            log = self.pairs[kind] + rest[child][:, None, None] * np.array([[0, 0], [1, 1]]) + up[child][:, None, None] * np.array([[0, 1], [0, 1]])
            both = np.exp(log - log.max((1, 2), keepdims=True))
            both /= both.sum((1, 2), keepdims=True)
            expected = np.stack([both[kind == k].sum(0) for k in range(3)])
            grads = np.bincount(row, miss[node], ROWS) / n, np.bincount(forest.measures.ravel(), np.repeat(miss, forest.measures.shape[1]), len(self.measured)) / n, (counts - expected) / n
            for i, (weights, grad) in enumerate(zip((self.named, self.measured, self.pairs), grads, strict=True)):
                grad = grad - decay * weights / 10
                seen[i] += grad**2
                weights += rate * grad / np.sqrt(seen[i])
        return self


def labelled_page(r: np.random.Generator) -> str:
    """A page in one of many layouts; its main text begins with the mark at each text."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    chance = lambda p: r.random() < p
    syllables = pick("er in an st th re on ti", "ción os es do ra ue la ta", "en ch der un ge ver be sch", "le ou ai eau de tre ment é", "ka mo ri to shi na ku ha").split()
    word = lambda: "".join(pick(*syllables) for _ in range(int(r.integers(1, 5))))
    some = lambda a, b: " ".join(word() for _ in range(int(r.integers(a, b))))

    def sentences(a: int, b: int) -> str:
        return " ".join(some(3, 14).capitalize() + pick(".", ".", ".", "!", "?", ",") for _ in range(int(r.integers(a, b))))

    def links(a: int, b: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{word()}">{some(1, 4)}</a></{item}>' for _ in range(int(r.integers(a, b))))

    def rich(text: str) -> str:
        """Main text with some inline marks in it."""
        out = []
        for w in text.split(" "):
            if chance(0.03):
                tag = pick("b", "i", "em", "strong", "span", 'a href="/x"', "code")
                w = f"<{tag}>{MAIN}{w}</{tag.split(' ')[0]}>{MAIN}" if chance(0.9) else f"<{tag.split(' ')[0]}>{MAIN}{w}"
            out.append(w)
        return MAIN + " ".join(out)

    def named(*names: str) -> str:
        n = pick(*names)
        extra = pick("", "", f" {word()}", " wrapper", " box", " clearfix", " col-4")
        return pick(f'class="{n}{extra}"', f"class='{n}'", f'id="{n}"', f'class="{n}"', f'class="site-{n}"', f'class="{n}-{word()}"')

    def paragraph() -> str:
        if chance(0.12):
            return f"<p>{rich(some(1, 4).capitalize())}." + pick("</p>", "")
        return f"<p>{rich(sentences(1, 7))}" + pick("</p>", "</p>", "</p>", "", "<br>")

    def block() -> str:
        kind = int(r.integers(14))
        if kind == 0:
            return f"<h{pick(2, 3, 4)}>{rich(some(2, 7))}</h2>"
        if kind == 1:
            return f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{rich(pick(sentences(1, 3), some(1, 6)))}" + pick("</li>", "") for _ in range(int(r.integers(2, 6)))) + f"</{t}>"
        if kind == 2:
            return f"<blockquote>{paragraph()}</blockquote>"
        if kind == 3:
            return f"<pre>{rich(some(4, 30))}</pre>"
        if kind == 4:
            return f'<figure><img src="x.png"><figcaption>{rich(some(3, 12))}</figcaption></figure>'
        if kind == 5:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{rich(some(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind == 6:
            return f"<div>{rich(sentences(2, 6))}</div>"
        if kind == 7 and chance(0.5):
            return pick(advert, share, notice, related)()
        return paragraph()

    def advert() -> str:
        body = pick(sentences(1, 3), some(3, 12), f'<a href="/b">{some(2, 8)}</a>', f"<p>{sentences(1, 3)}</p>", f"<h3>{some(1, 4)}</h3><p>{sentences(1, 2)}</p>")
        return f"<{(t := pick('div', 'div', 'section', 'aside', 'ins'))} {named('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner', 'adbox', 'promotion')}>{body}</{t}>"

    def notice() -> str:
        body = pick(f"<p>{sentences(1, 4)}</p>", sentences(1, 3)) + pick("", "<button>OK</button>", '<a href="#">OK</a>')
        return f"<div {named('cookie', 'cookie-notice', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'paywall', 'warning', 'announcement', 'disclaimer', 'cookies')}{pick('', ' role="alert"', ' role="dialog"')}>{body}</div>"

    def share() -> str:
        return f"<div {named('share', 'social', 'sharing', 'tags', 'toolbar', 'buttons')}>{links(2, 6, 'span')}</div>"

    def related() -> str:
        return f"<{(t := pick('div', 'section', 'aside'))} {named('related', 'recommended', 'more', 'trending', 'popular', 'links', 'teaser')}><h3>{some(1, 3)}</h3><ul>{links(2, 7)}</ul></{t}>"

    def menu() -> str:
        t = pick("nav", "nav", "div", "ul", "div")
        name = "" if t == "nav" and chance(0.6) else " " + named("nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "topnav")
        inner = links(2, 10) if t == "ul" else pick(f"<ul>{links(2, 10)}</ul>", links(2, 8, "span"))
        return f"<{t}{name}{pick('', ' role=\"navigation\"')}>{inner}</{t}>"

    def header() -> str:
        t = pick("header", "header", "div")
        name = "" if t == "header" and chance(0.7) else " " + named("header", "masthead", "topbar", "top", "branding", "logo", "hero")
        return f"<{t}{name}>{pick(some(1, 4), f'<h2>{some(1, 4)}</h2>', f'<a href=\"/\">{some(1, 3)}</a>', f'<p>{sentences(1, 3)}</p>')}{menu() if chance(0.5) else ''}</{t}>"

    def sidebar() -> str:
        t = pick("aside", "aside", "div", "section")
        name = "" if t == "aside" and chance(0.6) else " " + named("sidebar", "side", "widget", "widgets", "rail", "column-right", "aside")
        body = "".join(pick(f"<h3>{some(1, 4)}</h3>", f"<p>{sentences(1, 4)}</p>", f"<ul>{links(2, 8)}</ul>", advert(), form(), f"<div>{sentences(1, 3)}</div>") for _ in range(int(r.integers(1, 4))))
        return f"<{t}{name}>{body}</{t}>"

    def form() -> str:
        return f"<form{pick('', ' ' + named('search', 'login', 'subscribe', 'newsletter', 'contact', 'signup'))}>{pick('', f'<p>{sentences(1, 3)}</p>', f'<h3>{some(1, 4)}</h3>')}<label>{some(1, 3)}</label><input name=q>{pick('', f'<textarea>{some(1, 5)}</textarea>', f'<select><option>{word()}</option></select>')}<button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: f"<{(t := pick('div', 'li', 'article'))} {named('comment', 'comment-body', 'reply', 'response')}>{pick('', f'<b>{word()}</b>', f'<span class=\"author\">{word()}</span>')}<p>{sentences(1, 5)}</p></{t}>"
        body = "".join(one() for _ in range(int(r.integers(1, 6))))
        return f"<{(t := pick('div', 'section', 'ol'))} {named('comments', 'comment-list', 'discussion', 'responses', 'replies', 'disqus', 'reader-comments', 'commentlist')}>{pick('', f'<h3>{some(1, 3)}</h3>')}{body}{form() if chance(0.3) else ''}</{t}>"

    def footer() -> str:
        t = pick("footer", "footer", "div")
        name = "" if t == "footer" and chance(0.7) else " " + named("footer", "bottom", "copyright", "legal", "colophon", "foot")
        return f"<{t}{name}>{pick('&copy; ', '')}{pick(some(1, 8), sentences(1, 3), f'<p>{sentences(1, 3)}</p>')} {pick('', f'<ul>{links(1, 6)}</ul>')}</{t}>"

    title = f"<h1>{rich(some(3, 10))}</h1>" if chance(0.85) else ""
    body = title + "".join(block() if chance(0.5) else paragraph() for _ in range(int(r.integers(1, 14))))
    kind = int(r.integers(8))
    if kind <= 2:
        body = f"<article{pick('', '', ' ' + named('post', 'article', 'story', 'entry'))}>{body}</article>"
    elif kind == 3:
        body = f"<main>{pick(body, f'<article>{body}</article>')}</main>"
    elif kind <= 5:
        body = f"<div {named('content', 'post', 'entry', 'entry-content', 'article', 'article-body', 'story', 'text', 'main', 'body', 'page-content')}>{body}</div>"
    elif kind == 6:
        body = f"<section>{body}</section>"
    before = "".join(f() for f in (header, menu, notice, advert, form, sidebar) if chance(0.35))
    after = "".join(f() for f in (comments, related, sidebar, advert, share, form, notice, footer) if chance(0.35))
    if chance(0.25):
        body = f"<div {named('container', 'wrapper', 'page', 'row', 'layout', 'site')}>{body}{sidebar() if chance(0.4) else ''}{comments() if chance(0.3) else ''}</div>"
    if chance(0.5):
        after += f"<footer>&copy; {some(1, 10)}.</footer>"
    page = f"{before}{body}{after}"
    if chance(0.06):
        page = f"<form>{page}</form>"
    elif chance(0.08):
        page = f"<table><tr><td>{before}</td><td>{body}</td><td>{after}</td></tr></table>"
    return f"<!DOCTYPE html><html><head><title>{some(1, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>" if chance(0.9) else page


TRAIN_PAGES = 700
_trained: list[Model] = []


def model() -> Model:
    """The model of this process, trained when first asked for."""
    if not _trained:
        r = np.random.default_rng(5)
        _trained.append(Model.train([labelled_page(r) for _ in range(TRAIN_PAGES)]))
    return _trained[0]


#: Characters of html whose trees are handled together.
TOGETHER = 1 << 20


def main_texts(pages: list[str], using: Model | None = None) -> Iterator[str]:
    using = using or model()
    from .memo import groups_by_chars

    for group in groups_by_chars(pages, TOGETHER):
        trees = [Tree(p) for p in group]
        forest = Forest(trees)
        chosen = (using.probabilities(forest) > 0.5).tolist()
        for tree, at, n in zip(trees, forest.begin.tolist(), forest.sizes.tolist(), strict=True):
            yield tree.join(chosen[at : at + n])


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`df` with the main text of each whole page."""

    weights = model()
    sent = df.sparkSession.sparkContext.broadcast((weights.named, weights.measured, weights.pairs))  # 130 kB

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        using = Model(*sent.value)
        for pages in batches:
            yield pd.Series(list(main_texts(pages.tolist(), using)), dtype=object)

    return df.withColumn(out_col, once(run)(text_or_empty(html_col)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
