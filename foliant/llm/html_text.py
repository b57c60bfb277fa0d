"""Main text of web pages by a tree-structured graphical model.

A page's elements and text blocks are the nodes of a tree; each is content or not. Unary potentials see a
node's tag, the words of its class, id and role, and its share of links; pairwise ones tie child to
parent, by the parent's kind. Sum-product messages up and down the tree give exact content marginals.
The potentials are learned by gradient ascent on the likelihood of labelled pages.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import answered, extended, table, without

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_STOP = re.compile(r"[<>]|=\s*[\"']")
_BARE = re.compile(r"(?<![^\s/])[^\s/>=\"'<]+(?=[\s/]|\Z)(?!\s*=)")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Fixed values of HTML: elements without an end, elements whose inside is text up to their own end tag, elements that show nothing, choices of a form, inline elements, what a start tag closes and how far up, other elements, attributes without a value, others that often stand without one.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"template", "svg", "math", "noscript"}
CHOICES = {"select", "datalist", "optgroup", "option"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist", "optgroup"}, "optgroup": {"select", "datalist"}}
OTHERS = {"acronym", "address", "applet", "article", "aside", "audio", "big", "blockquote", "body", "button", "canvas", "caption", "center", "colgroup", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "main", "map", "marquee", "menu", "meter", "nav", "nobr", "object", "ol", "output", "p", "param", "picture", "pre", "progress", "rp", "rt", "ruby", "search", "section", "slot", "strike", "summary", "table", "tbody", "tfoot", "thead", "ul", "video"}
ELEMENTS = VOID | RAW | HIDDEN | CHOICES | INLINE | OTHERS | set(CLOSES)
VALUELESS = {"allowfullscreen", "async", "autofocus", "autoplay", "checked", "compact", "controls", "default", "defer", "disabled", "download", "formnovalidate", "hidden", "inert", "ismap", "itemscope", "loop", "multiple", "muted", "nomodule", "noshade", "novalidate", "nowrap", "open", "playsinline", "readonly", "required", "reversed", "selected"}
OFTEN_BARE = {"alt", "charset", "class", "content", "contenteditable", "data", "dir", "draggable", "height", "href", "id", "lang", "media", "name", "preload", "rel", "role", "src", "srcset", "style", "tabindex", "target", "title", "type", "value", "width"}

TAGS = ["html", "head", "body", "main", "article", "section", "div", "p", "h", "ul", "li", "table", "quote", "nav", "header", "footer", "aside", "form", "figure", "button", "text", "other"]
_ALIASES = {f"h{k}": "h" for k in range(1, 7)} | {"ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "input": "form", "select": "form", "datalist": "form", "optgroup": "form", "option": "form", "dialog": "aside"}
#: What names of classes, ids and roles say about an element.
HINTS = {
    "advert": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"},
    "menu": {"nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pager", "pagination", "navbar", "tabs"},
    "side": {"sidebar", "side", "aside", "rail", "widget", "widgets", "related", "recommended", "complementary", "more", "trending", "popular"},
    "notice": {"cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "subscription", "paywall", "overlay", "toast", "signup", "login"},
    "comment": {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "feedback"},
    "foot": {"footer", "copyright", "legal", "imprint", "foot", "bottom", "contentinfo", "disclaimer"},
    "head": {"header", "masthead", "top", "logo", "branding", "topbar", "hero"},
    "share": {"share", "social", "sharing", "follow", "tags", "byline", "author", "meta", "print"},
    "form": {"form", "search", "contact", "poll"},
    "content": {"article", "content", "post", "entry", "story", "main", "text", "body"},
}
_HINT_OF = {w: k for k, words in enumerate(HINTS.values()) for w in words}
FEATURES = 1 + len(TAGS) + len(HINTS) + 2
KINDS = {"html": 0, "head": 0, "body": 0, "main": 1, "section": 1, "div": 1, "article": 2}
OTHER_KIND = 3


class Node:
    __slots__ = ("tag", "parent", "features", "text", "links", "label")

    def __init__(self, tag: str, parent: int, attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.text: list[str] = []
        self.links = 0
        self.label = 0
        known = _ALIASES.get(tag, tag)
        self.features = [0, 1 + (TAGS.index(known) if known in TAGS else len(TAGS) - 1)]
        if attributes:
            hints = {_HINT_OF[w.lower()] for _, value in _ATTRIBUTE.findall(attributes) for w in _WORDS.findall(value) if w.lower() in _HINT_OF}
            self.features += sorted(1 + len(TAGS) + h for h in hints)


class Tags:
    """Where the tags of a page end. Each place is looked at a few times, whatever stands there."""

    def __init__(self, page: str) -> None:
        self.page, self.gt = page, -1

    def _next_gt(self, at: int) -> int:
        """The next > from ``at`` on, which never falls; the page's length if there is none."""
        if self.gt < at:
            found = self.page.find(">", at)
            self.gt = found if found >= 0 else len(self.page)
        return self.gt

    def end(self, at: int) -> tuple[int, bool]:
        """Behind the tag whose attributes begin at ``at``, and True; or where the next < comes before it ends, and False; -1 if the page ends first.

        A quoted value that no quote ends in its place ends with the tag.
        """
        page = self.page
        while True:
            m = _STOP.search(page, at)
            if not m:
                return -1, False
            if m.group() in "<>":
                return (m.end(), True) if m.group() == ">" else (m.start(), False)
            gt = self._next_gt(m.end())
            if gt == len(page):
                return -1, False
            shut = page.find(m.group()[-1], m.end())
            if shut < 0 or (gt < shut and page[shut + 1 : shut + 2] not in {"", " ", "\t", "\n", "\r", "\f", "/", ">", '"', "'"}):
                return gt + 1, True
            at = shut + 1


def _is_sign(page: str, lt: int, name: str, attributes: str) -> bool:
    """Whether what looks like a tag is a sign between values (a<b and c>d): behind a letter or digit, a name of one letter, then words that are no attributes."""
    if len(name) > 1 or "=" in attributes or not (lt and page[lt - 1].isalnum()):
        return False
    return not all(x in VALUELESS or x in OFTEN_BARE or "-" in x for x in map(str.lower, _BARE.findall(attributes)))


def inline(tag: str) -> bool:
    """Inline elements, and unknown ones but those of components, whose names have a hyphen or colon."""
    return tag in INLINE or (tag not in ELEMENTS and "-" not in tag and ":" not in tag)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: text, start tags with their attributes, end tags. Comments and the inside of raw elements are left out."""
    at, text = 0, 0  # text: where the text before this place begins
    tags = Tags(page)
    while (lt := page.find("<", at)) >= 0:
        ahead = page[lt + 1 : lt + 2]
        if ahead in ("!", "?"):
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(close, lt + 2)
            if lt > text:
                yield "text", "", page[text:lt]
            at = text = end + len(close) if end >= 0 else len(page)
            continue
        ends = ahead == "/"
        m = _NAME.match(page, lt + 1 + ends)
        if not m:
            at = lt + 1
            continue
        name = m.group().lower()
        end, whole = tags.end(m.end())
        if end < 0:  # an unfinished tag ends the page
            break
        if not whole:  # another < comes before this one's tag would end: it is a sign in running text
            at = end
            continue
        attributes = page[m.end() : end - 1]
        if not ends and _is_sign(page, lt, name, attributes):
            at = end
            continue
        if lt > text:
            yield "text", "", page[text:lt]
        at = text = end
        yield ("end" if ends else "start"), name, attributes
        if name in RAW and not ends:
            shut = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, end)
            at = text = shut.start() if shut else len(page)
    else:
        lt = len(page)
    if lt > text:
        yield "text", "", page[text:lt]


class Open:
    """The open elements, each with the node that holds its text (-1: nothing is shown). Every step costs what it opens and closes, however deep the page."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.where: dict[str, list[int]] = {}  # places of each name
        self.blocks: list[int] = []  # places of elements that are not inline

    def push(self, tag: str, node: int) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if not inline(tag):
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def close(self, at: int) -> bool:
        """Close all elements from a place on; whether one of them is a block."""
        deep = len(self.blocks)
        while len(self.stack) > at:
            tag, _ = self.stack.pop()
            self.where[tag].pop()
            if not inline(tag):
                self.blocks.pop()
        return len(self.blocks) < deep

    def innermost(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[-1] if places else 0

    def make_way(self, tag: str) -> None:
        """Implied ends before a start tag: a block ends an open paragraph, an item ends an item of its list."""
        shut = CLOSES.get(tag)
        if not shut:
            if self.stack[self.blocks[-1]][0] == "p" and tag not in CHOICES:
                self.close(self.blocks[-1])
            return
        top = max(map(self.innermost, SCOPE[tag]))
        firsts = [self.where[t][k] for t in shut | (set() if tag in CHOICES else {"p"}) if t in self.where and (k := bisect_right(self.where[t], top)) < len(self.where[t])]
        if firsts:
            self.close(min(firsts))


def parse(page: str) -> list[Node]:
    """The page's block elements and text blocks, parents before children, in page order. Inline elements belong to their block."""
    nodes = [Node("html", -1)]
    up = Open()
    up.push("html", 0)
    leaf = -1  # the text block that text goes to
    for kind, tag, rest in tokens(page):
        holder = up.stack[-1][1]
        if kind == "text":
            if holder < 0:
                continue
            if leaf < 0:
                if not rest.strip():
                    continue
                leaf = len(nodes)
                nodes.append(Node("text", holder))
            nodes[leaf].text.append(rest)
            if up.where.get("a"):
                nodes[leaf].links += len(rest.strip())
        elif kind == "end":  # closes the innermost element of that name, if any
            at = up.innermost(tag)
            if at and up.close(at):
                leaf = -1
        elif tag in RAW:
            continue
        elif tag in VOID:
            if tag == "br" and leaf >= 0:
                nodes[leaf].text.append(" ")
            elif tag == "hr":
                leaf = -1
        elif tag in HIDDEN:
            if not rest.rstrip().endswith("/"):
                up.push(tag, -1)
        elif inline(tag) or holder < 0:
            up.push(tag, holder)
        else:
            leaf = -1
            if tag == "html" or (tag == "body" and up.where.get("body")):
                continue
            up.make_way(tag)
            holder = up.stack[-1][1]
            if holder < 0:
                up.push(tag, holder)
                continue
            nodes.append(Node(tag, holder, rest))
            up.push(tag, len(nodes) - 1)
    for n in nodes:
        if n.text:
            joined = " ".join(html.unescape("".join(n.text)).split())
            n.text = [joined]
            share = n.links / max(1, len(joined))
            n.features.append(FEATURES - 2 if share > 0.5 else FEATURES - 1)
    return nodes


class Model:
    """weights: one number a feature, the log-odds it gives a node; ties: by parent's kind the log-potentials [parent][child]."""

    def __init__(self, weights: list[float], ties: list[list[list[float]]]) -> None:
        self.weights, self.ties = weights, ties

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[list[float]]]:
        """Each node's probability of being content, and the joint probabilities of (parent, child) for each node but the first."""
        n = len(nodes)
        belief = [sum(self.weights[f] for f in x.features) for x in nodes]
        up, down = [0.0] * n, [0.0] * n
        tie = [self.ties[KINDS.get(nodes[x.parent].tag, OTHER_KIND)] if k else None for k, x in enumerate(nodes)]
        for k in range(n - 1, 0, -1):  # children come after their parents
            (a, b), (c, d) = tie[k]
            up[k] = _lse(c, d + belief[k]) - _lse(a, b + belief[k])
            belief[nodes[k].parent] += up[k]
        joint: list[list[float]] = [[]] * n
        for k in range(1, n):
            (a, b), (c, d) = tie[k]
            rest = belief[nodes[k].parent] - up[k]
            down[k] = _lse(b, d + rest) - _lse(a, c + rest)
            cells = [a, b + belief[k], c + rest, d + rest + belief[k]]
            top = max(cells)
            e = [exp(x - top) for x in cells]
            joint[k] = [x / sum(e) for x in e]
            belief[k] += down[k]
        return [1 / (1 + exp(-max(-500.0, min(500.0, b)))) for b in belief], joint


def _lse(x: float, y: float) -> float:
    return max(x, y) + log1p(exp(-abs(x - y)))


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, str]]:
    """Pages made by rule, with their main text: articles of any length amid menus, notices, adverts, side bars, forms and comments, in many layouts."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))) + rng.choice([".", "", "!", " ***"])

    def clutter(where: str) -> str:
        kind = rng.choice(["nav", "ad", "side", "notice", "comments", "form", "share"] if where == "in" else ["nav", "nav", "ad", "side", "notice", "comments", "form", "share", "related"])
        attribute = rng.choice(["class", "id"])

        def name(key: str) -> str:
            return rng.choice(sorted(HINTS[key])) + rng.choice(["", "-box", "-1", " wide"])

        links = "".join(f'<li><a href="/{k}">{words(1, 6)}</a></li>' for k in range(rng.randint(1, 8)))
        if kind == "nav":
            return rng.choice([f"<nav><ul>{links}</ul></nav>", f'<div {attribute}="{name("menu")}"><ul>{links}</ul></div>', f'<ul class="{name("menu")}">{links}</ul>'])
        if kind == "ad":
            return rng.choice([f'<div {attribute}="{name("advert")}">{words(1, 40)}</div>', f'<aside class="{name("advert")}"><p>{words(1, 40)}</p></aside>', f'<div class="{name("advert")}"><a href="#">{words(1, 9)}</a><p>{words(1, 30)}</p></div>'])
        if kind in ("side", "related"):
            return rng.choice([f"<aside><h3>{words(1, 4)}</h3><p>{words(3, 60)}</p></aside>", f'<div {attribute}="{name("side")}"><h4>{words(1, 3)}</h4><ul>{links}</ul><p>{words(2, 50)}</p></div>', f"<aside>{words(2, 60)}</aside>"])
        if kind == "notice":
            return f'<{(t := rng.choice(["div", "section", "p"]))} {attribute}="{name("notice")}">{words(4, 60)}<button>{words(1, 2)}</button></{t}>'
        if kind == "comments":
            each = "".join(f'<div class="{name("comment")}"><p>{words(2, 70)}</p></div>' for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["section", "div"]))} {attribute}="{name("comment")}"><h3>{words(1, 3)}</h3>{each}</{t}>'
        if kind == "form":
            return f'<form action="/x"><label>{words(1, 4)}</label><input name="q"><p>{words(1, 20)}</p><button>{words(1, 2)}</button></form>'
        return f'<div class="{name("share")}">{words(1, 12)}</div>'

    out = []
    for _ in range(n):
        blocks, parts = [], []
        for k in range(rng.randint(1, 9)):
            t = words(1, rng.choice([2, 8, 60, 200]))
            form = "h1" if k == 0 and rng.random() < 0.8 else rng.choice(["p"] * 8 + ["h2", "li", "blockquote", "pre", "div", "td"])
            blocks.append(" ".join(t.split()))
            body = t if rng.random() < 0.8 else f"<b>{t}</b>" if rng.random() < 0.5 else f'<a href="/y">{t}</a>'
            parts.append({"li": f"<ul><li>{body}</li></ul>", "td": f"<table><tr><td>{body}</td></tr></table>"}.get(form, f"<{form}>{body}</{form}>"))
            if rng.random() < 0.12:
                parts.append(clutter("in"))
        inner = "".join(parts)
        shell = rng.choice(["<article>{}</article>"] * 4 + ["<main><article>{}</article></main>", '<div class="content"><article>{}</article></div>', '<div id="post-body">{}</div>', "<main>{}</main>", "{}", "<div>{}</div>", '<div class="entry"><div class="story">{}</div></div>'])
        head = rng.choice(["", f"<header><h1>{words(1, 4)}</h1><p>{words(1, 12)}</p></header>", f'<div class="{rng.choice(sorted(HINTS["head"]))}">{words(1, 6)}</div>', f"<header>{words(1, 9)}</header>"])
        foot = rng.choice([f"<footer>{words(1, 30)}</footer>", f"<footer><p>{words(1, 9)}</p><ul><li><a href='/'>{words(1, 3)}</a></li></ul></footer>", f'<div class="{rng.choice(sorted(HINTS["foot"]))}"><p>{words(1, 30)}</p></div>', ""])
        before, after = ("".join(clutter("out") for _ in range(rng.randint(0, 3))) for _ in range(2))
        main = shell.format(inner)
        if rng.random() < 0.4:
            main = f'<div class="wrap">{before}{main}{after}</div>'
            before = after = ""
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{head}{before}{main}{after}{foot}</body></html>"
        out.append((page, "\n".join(blocks)))
    return out


def train(pages: list[tuple[str, str]], *, rounds: int = 60, step: float = 0.15, decay: float = 1e-3) -> Model:
    """Learn from (html, main text) pages: a text block is content if the main text lists it in its place, an element if anything in it is."""
    trees = []
    for page, text in pages:
        nodes, left = parse(page), text.split("\n")
        for x in nodes:
            if x.text and left and x.text[0] == left[0]:
                left.pop(0)
                x.label = 1
        for x in reversed(nodes[1:]):
            nodes[x.parent].label |= x.label
        trees.append(nodes)
    w, t = np.zeros(FEATURES), np.zeros((OTHER_KIND + 1, 2, 2))
    mw, mt, vw, vt = np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)
    for r in range(1, rounds + 1):
        model = Model(w.tolist(), t.tolist())
        gw, gt = -decay * w * len(trees), -decay * t * len(trees)
        for nodes in trees:
            p, joint = model.marginals(nodes)
            for k, x in enumerate(nodes):
                gw[x.features] += x.label - p[k]
                if k:
                    kind = KINDS.get(nodes[x.parent].tag, OTHER_KIND)
                    gt[kind] -= np.reshape(joint[k], (2, 2))
                    gt[kind, nodes[x.parent].label, x.label] += 1
        for x, g, m, v in ((w, gw, mw, vw), (t, gt, mt, vt)):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += step * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(w.tolist(), t.tolist())


def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    if len(nodes) < 2:
        return ""
    p, _ = model.marginals(nodes)
    return "\n".join(x.text[0] for x, q in zip(nodes, p, strict=True) if x.text and x.text[0] and q >= 0.5)


def extract(pages: DataFrame, model: Model, *, html_col: str = "html", out_col: str = "text", keep_html: bool = True) -> DataFrame:
    """pages plus ``out_col``: the main text, blocks in page order joined by newline, white space in a block made one space; less the html if ``keep_html`` is false.

    Null or empty html, and pages without content, give the empty text. Whole pages are read, each row
    by itself, so repeated rows and null ids pass through; a column named ``out_col`` is replaced. Empty
    in, empty out.
    """
    whole = without(pages, out_col)
    place = whole.columns.index(html_col)
    less = () if keep_html else (html_col,)
    schema = extended(whole, f"`{out_col}` string", less)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", shared.value) for h in batch.column(place)]
            yield answered(batch, less, schema, pa.array(texts, pa.string()))

    return whole.mapInArrow(run, schema)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, train(labelled_pages(120)), keep_html=False)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
