"""Main-text extraction with a tree-structured graphical model over the DOM.

Block elements of a page are the nodes of a tree; every node carries the binary variable "main content".  Unary
potentials come from the node's tag, class words, text and links; parent-child potentials tie a node to its parent.
Sum-product messages run upward and then downward, level by level and for a whole batch of pages at once, and give
exact marginals.  All weights are trained from labelled pages by maximising the likelihood of the labels, with the same messages.

Text of nodes with a marginal of at least 0.5 is the result: character references decoded, white space inside a block
one space, blocks in page order joined by ``\\n``.  Null and empty html give an empty text; markup that is cut off or
badly nested is read as far as it goes; repeated rows are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, texts

# Element kinds of HTML.
BLOCKS = frozenset(
    "html body article main section div nav aside header footer form fieldset address blockquote center details dialog dd dl dt figure figcaption h1 h2 h3 h4 h5 h6 hgroup hr li ol ul p pre "
    "summary table thead tbody tfoot tr td th caption menu search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button option head canvas audio video".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "td", "th", "tr", "dd", "dt", "thead", "tbody", "tfoot", "caption"}
SAME_CLOSES = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPE = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "tr": "table", "td": "tr table", "th": "tr table"}
# Class words of page regions.
REGIONS = {
    "comment": "comment comments commentlist reply replies respond disqus discussion",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs",
    "foot": "foot footer copyright legal colophon imprint",
    "head": "header masthead topbar logo branding toolbar",
    "side": "side sidebar aside widget related recommended popular trending rail more",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall message",
    "social": "share social follow likes tags tag byline author meta",
    "sign": "subscribe newsletter signup login register form search",
    "main": "article content post entry story main body text page",
}
REGION_OF = {w: k for k, v in REGIONS.items() for w in v.split()}
TAGS = "body article main section div nav aside header footer form h1 h2 h3 p li ul ol table td blockquote pre figure figcaption address dl".split()
# A quote opens a value only after "=", and one that isn't closed before white space, "/" or ">" is an ordinary character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = [f"tag:{t}" for t in TAGS] + [f"class:{r}" for r in REGIONS] + ["hidden", "no text", "short", "middle", "long", "mostly links", "some links", "ends a sentence", "commas", "child of main tag", "bias"]
INDEX = {f: i for i, f in enumerate(FEATURES)}


class Node:
    __slots__ = ("tag", "parent", "level", "on", "chars", "links", "ends", "commas", "label")

    def __init__(self, tag: str, parent: int, level: int, on: list[int], label: int | None):
        self.tag, self.parent, self.level, self.on, self.label = tag, parent, level, on, label
        self.chars = self.links = self.ends = self.commas = 0


@lru_cache(maxsize=4096)
def attribute_features(attributes: str) -> tuple[int, ...]:
    on = set()
    for m in NAMED.finditer(attributes):
        for word in PART.findall(m[1] or m[2] or m[3] or ""):
            if region := REGION_OF.get(word.lower()):
                on.add(INDEX[f"class:{region}"])
    if HIDDEN.search(attributes):
        on.add(INDEX["hidden"])
    return tuple(sorted(on))


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order and the text blocks (node, text) in page order."""
    nodes = [Node("html", -1, 0, [], None)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones point to the block around them
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    links = 0
    at, n = 0, len(html)

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((stack[-1][1], text))
                node = nodes[stack[-1][1]]
                node.chars += len(text)
                node.ends += text[-1] in ".!?…:;\"”"
                node.commas += text.count(",") + text.count(". ")

    def close(to: int) -> None:
        nonlocal links
        for tag, _ in stack[to:]:
            links -= tag == "a"
        if any(tag in BLOCKS for tag, _ in stack[to:]):
            flush()
        del stack[to:]

    def add(text: str) -> None:
        run.append(text)
        if links:
            nodes[stack[-1][1]].links += len(text)

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            add(unescape(html[at:]))
            break
        if m.start() > at:
            add(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if tag in BLOCKS or tag == "a" or tag in ("b", "i", "em", "strong", "span"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag not in BLOCKS and stack[k][0] in BLOCKS:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else (n if tag != "head" else at)
            if tag == "head":
                continue
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                run.append(" " if tag == "br" else "")
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if tag in SAME_CLOSES:
                same, scope = SAME_CLOSES[tag].split(), SCOPE.get(tag, "").split()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in same:
                        close(k)
                        break
                    if stack[k][0] in scope:
                        break
            flush()
            while stack[-1][0] not in BLOCKS:  # an inline element left open doesn't hold blocks
                links -= stack[-1][0] == "a"
                stack.pop()
            up = stack[-1][1]
            label = re.search(r'data-main="([01])"', attributes)
            on = list(attribute_features(attributes)) if attributes else []
            nodes.append(Node(tag, up, nodes[up].level + 1, on, int(label[1]) if label else nodes[up].label))
            stack.append((tag, len(nodes) - 1))
        elif not attributes.rstrip().endswith("/"):
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), len(FEATURES)))
    total = [[n.chars, n.links] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up = nodes[i].parent
        total[up][0] += total[i][0]
        total[up][1] += total[i][1]
    for i, n in enumerate(nodes):
        on, (chars, links) = n.on, total[i]
        row = x[i]
        for k in on:
            row[k] = 1
        if (k := INDEX.get(f"tag:{n.tag}")) is not None:
            row[k] = 1
        row[INDEX["bias"]] = 1
        row[INDEX["no text" if not n.chars else "short" if n.chars < 40 else "middle" if n.chars < 160 else "long"]] = 1
        if chars and links > 0.5 * chars:
            row[INDEX["mostly links"]] = 1
        elif links:
            row[INDEX["some links"]] = 1
        row[INDEX["ends a sentence"]] = n.ends > 0
        row[INDEX["commas"]] = n.commas > 0
        row[INDEX["child of main tag"]] = n.parent >= 0 and nodes[n.parent].tag in ("article", "main")
    return x


SECTIONS = frozenset("article main section div nav aside header footer form ul ol table dl body figure blockquote".split())


class Forest:
    """The nodes of many pages, sorted by depth, and exact sum-product messages on them."""

    def __init__(self, pages: list[list[Node]]):
        size = np.cumsum([0] + [len(p) for p in pages])
        self.starts = size[:-1]
        self.parent = np.concatenate([[n.parent + s if n.parent >= 0 else -1 for n in p] for p, s in zip(pages, size)]).astype(np.int64)
        level = np.concatenate([[n.level for n in p] for p in pages])
        self.kind = np.concatenate([[int(n.tag in SECTIONS) for n in p] for p in pages]).astype(np.int64)
        self.levels = [np.flatnonzero(level == k) for k in range(level.max() + 1)]
        self.x = np.concatenate([features(p) for p in pages])

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's, own) of each edge; ``pair[kind, parent's, own]`` is a log potential."""
        n = len(self.parent)
        own = np.stack([np.zeros(n), unary], 1)  # log potentials, then with all messages from below
        up = np.zeros((n, 2))
        for at in reversed(self.levels[1:]):
            m = np.logaddexp.reduce(pair[self.kind[at]] + own[at][:, None, :], axis=2)
            up[at] = m - m.max(1, keepdims=True)
            np.add.at(own, self.parent[at], up[at])
        down = np.zeros((n, 2))
        edge = np.zeros((n, 2, 2))
        for at in self.levels[1:]:
            around = own[self.parent[at]] + down[self.parent[at]] - up[at]  # all of the parent but this child
            both = around[:, :, None] + pair[self.kind[at]]
            m = np.logaddexp.reduce(both, axis=1)
            down[at] = m - m.max(1, keepdims=True)
            e = both + own[at][:, None, :]
            e = np.exp(e - e.max((1, 2), keepdims=True))
            edge[at] = e / e.sum((1, 2), keepdims=True)
        belief = own + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), edge


def train(pages: list[str], steps: int = 300, rate: float = 0.1, shrink: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials that maximise the likelihood of the labels (``data-main`` attributes) of the pages."""
    forest = Forest([parse(h)[0] for h in pages])
    y = np.concatenate([[n.label or 0 for n in parse(h)[0]] for h in pages]).astype(int)
    w, pair = np.zeros(len(FEATURES)), np.zeros((2, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    first = [np.zeros_like(w), np.zeros_like(pair)]
    second = [np.zeros_like(w), np.zeros_like(pair)]
    for t in range(1, steps + 1):
        p, edge = forest.marginals(forest.x @ w, pair)
        expected = np.stack([edge[child[forest.kind[child] == k]].sum(0) for k in (0, 1)])
        grads = [forest.x.T @ (y - p) / len(pages) - shrink * w, (seen - expected) / len(pages) - shrink * pair]
        for value, g, a, b in zip((w, pair), grads, first, second):  # Adam
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            value += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return w, pair


def labelled_pages(count: int = 160, seed: int = 7) -> list[str]:
    """Labelled pages composed by rule: regions whose role is known, in many layouts, with words that mean nothing."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: f"{words(3, 9).capitalize()}{', ' + words(2, 8) if r.random() < 0.5 else ''}."
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda f, a=3, b=8: "<ul>" + "".join(f"<li>{f()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    named = lambda kind: f'{r.choice(["class", "id"])}="{r.choice(["", "site-", "x ", "page_"])}{r.choice(REGIONS[kind].split())}"'

    def noise() -> str:
        kind = r.choice("menu menu foot head side side advert advert notice social sign comment comment hidden form".split())
        if kind == "hidden":
            return f'<div style="display:none">{prose()}</div>'
        if kind == "form":
            return f"<form><p>{prose(1, 2)}</p><label>{words(1, 3)}</label><input><button>{word()}</button></form>"
        tag = {"menu": "nav", "foot": "footer", "head": "header", "side": "aside", "sign": "form"}.get(kind, "div")
        plain, mark = r.random() < 0.5 and tag != "div", named(kind)
        tag, mark = (tag, mark if r.random() < 0.3 else "") if plain else ("div" if r.random() < 0.7 else "section", mark)
        inner = {
            "menu": lambda: items(link), "head": lambda: f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>" + items(link, 2, 5),
            "foot": lambda: r.choice(["", "<p>"]) + f"&copy; {word()} &middot; {prose(1, 2)}", "side": lambda: f"<h3>{words(1, 3)}</h3>" + (items(link) if r.random() < 0.5 else f"<p>{prose(1, 3)}</p>"),
            "comment": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(r.choice(["<p>{}</p>", "<div><p>{}</p></div>", "<p>{}</p>", "<article class=comment><p>{}</p></article>", "<li>{}</li>"]).format(prose(1, 4)) for _ in range(r.randint(1, 5))),
        }.get(kind, lambda: r.choice(["{}", "<p>{}</p>"]).format(prose(1, 3)) + (link() if r.random() < 0.3 else ""))()
        return f'<{tag} data-main="0" {mark}>{inner}</{tag}>'

    def content() -> str:
        parts = [f"<h1>{words(2, 7).capitalize()}{r.choice(['', '.'])}</h1>"] if r.random() < 0.7 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 8, 9])):
            x = r.random()
            parts.append(
                f"<p>{sentence()}</p>" if x < 0.1 else f"<p>{prose(1, 8)}</p>" if x < 0.56 else f"<p>{words(2, 60)}</p>" if x < 0.6 else f"<p><b>{prose()}<br>" if x < 0.66 else f"<h2>{words(1, 6)}</h2><p>{prose()}</p>" if x < 0.75 else items(sentence, 2, 5) if x < 0.82
                else f"<blockquote><p>{prose()}</p></blockquote>" if x < 0.87 else f"<p>{prose(1, 3)} {link()} {prose(1, 2)}</p>" if x < 0.92 else f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
                if x < 0.95 else f"<div>{prose(1, 5)}</div>" if x < 0.97 else f"<p>{words(1, 3).capitalize()}.</p>"
            )
        if r.random() < 0.25:
            parts.insert(r.randint(0, len(parts)), noise())
        return "".join(parts)

    pages = []
    for _ in range(count):
        tag, mark = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", named("main")), ("section", named("main")), ("div", "")])
        body = [noise() for _ in range(r.randint(0, 4))] + [f'<{tag} data-main="1" {mark}>{content()}</{tag}>'] + [noise() for _ in range(r.randint(0, 3))]
        inner = "".join(body)
        pages.append(f"<html><body>{f'<div class=wrap>{inner}</div>' if r.random() < 0.3 else inner}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def extract(pages: list[str], model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> list[str]:
    parsed = [parse(h) for h in pages]
    if not parsed:
        return []
    forest = Forest([p[0] for p in parsed])
    content = forest.marginals(forest.x @ model[0], model[1])[0] >= least
    return ["\n".join(t for k, t in blocks if content[s + k]) for (_, blocks), s in zip(parsed, forest.starts)]


def main_text(pages: DataFrame, key: list[str], html: str = "html", model: tuple | None = None, at_once: int = 64) -> DataFrame:
    """``key`` columns, the main text and its code points for every page."""
    model = model or default_model()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "text string", "n_chars long"])
    schema = arrow_schema(pages, ddl)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, at_once):
                part = batch.slice(s, at_once)
                out = extract([t.decode("utf-8", "replace") for t in texts(part.column(len(key)))], model)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=schema)

    return pages.select(*[F.col(f"`{k}`") for k in key], F.col(f"`{html}`")).mapInArrow(run, ddl)
