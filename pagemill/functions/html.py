"""HTML pages read once, by the standard library's parser, in one Arrow function: metadata, links and content.

The tree is tolerant: void elements close themselves, paragraphs, list items, table cells and options are closed by
their like, and what is left open ends with the page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import fixed

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_STOPS = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"div", "article", "section", "td", "li", "body"}}
MOST_CHARS, DEEPEST_PATHS = 200, 8

SCHEMA = (
    "struct<title: string, h1: string, best_heading: string, canonical_url: string, refresh_url: string, og_url: string, data_urls: array<string>, "
    "links: array<struct<url: string, source: string, text: string>>, markdown: string, selector: string, main_content_chars: int>"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def text(self) -> str:
        """The stripped strings below, without anything between."""
        return "".join(s.strip() for s in self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close({"p"}, _STOPS["p"])
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _STOPS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tags, stops):
        node = self.at
        while node.parent is not None and node.tag not in stops:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"([a-z0-9]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(\*?=)'([^']*)'\])?")


class Selector:
    """A selector ``step`` or ``outer inner``, read once; a step is a tag, a class, an id or an attribute's value or part of it."""

    def __init__(self, text: str):
        self.text = text
        *self.outer, self.inner = [_STEP.fullmatch(step).groups() for step in text.split(" ")]

    @staticmethod
    def _step(node: Node, step: tuple) -> bool:
        tag, klass, ident, attr, sign, value = step
        if tag and node.tag != tag:
            return False
        if klass:
            return klass in node.attrs.get("class", "").split()
        if ident:
            return node.attrs.get("id") == ident
        own = node.attrs.get(attr) if attr else None
        return not attr or own is not None and (value in own if sign == "*=" else own == value)

    def matches(self, node: Node) -> bool:
        if not node.tag or not self._step(node, self.inner):
            return False
        above, need = node.parent, len(self.outer)
        while need and above is not None:
            need -= bool(above.tag) and self._step(above, self.outer[need - 1])
            above = above.parent
        return not need


@lru_cache(None)
def _selector(text: str) -> Selector:
    return Selector(text)


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements a selector matches, in document order."""
    held = _selector(selector)
    return (node for node in root.walk() if held.matches(node))


def first(root: Node, selector: str) -> Node | None:
    return next(select(root, selector), None)


def _short(node: Node | None) -> str:
    return node.text()[:MOST_CHARS] if node else ""


def _strings_of(value, depth: int = 0) -> Iterator[str]:
    if depth > DEEPEST_PATHS:
        return
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings_of(v, depth + 1)


def _json(node: Node):
    try:
        return json.loads("".join(node.strings()))
    except ValueError:
        return None


def _below(item, *path: str):
    for key in path:
        item = item.get(key) if isinstance(item, dict) else None
    return item


def _linked(item) -> Iterator[str]:
    """What the keys of linked data tell: a text, or what stands below them, the first that is there."""
    for key in fixed.LINKED_DATA_KEYS:
        told = (_below(item, key), *(_below(item, key, below) for below in fixed.LINKED_DATA_KEYS_BELOW))
        yield next((t for t in told if isinstance(t, str) and t), "")


def data_urls(root: Node, url: str) -> list[str]:
    """Addresses in linked data, then paths in the data of a server-rendered application."""
    documents = [_json(s) for s in select(root, "script") if s.attrs.get("type") == "application/ld+json"]
    items = [item for document in documents for item in (document if isinstance(document, list) else [document])]
    addresses = [told for item in items for told in _linked(item) if told.startswith("http")]
    application = first(root, "script#__NEXT_DATA__")
    paths = _strings_of(_json(application)) if application else ()
    return addresses + [_join(url, path) for path in paths if len(path) > 1 and path[0] == "/"]


def _join(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def links(root: Node, url: str) -> list[tuple[str, str, str]]:
    """(address, source, text) of each element with a link attribute, then of click handlers; unusable ones left out."""
    out, handlers = [], []
    for node in root.walk():
        names = fixed.LINK_ATTRIBUTES if node.tag in ("a", "area") else [n for n in fixed.LINK_ATTRIBUTES[1:] if n in node.attrs]
        raw = next((node.attrs[n] for n in (names and fixed.LINK_ATTRIBUTES) if node.attrs.get(n)), "").strip() if names else ""
        text = (" ".join("".join(node.strings()).split()) or node.attrs.get("title", "") or node.attrs.get("aria-label", "")).strip()[:MOST_CHARS]
        if usable(raw):
            out.append((_join(url, raw), "canonical" if "canonical" in node.attrs.get("rel", "").lower() else "dom_post_interaction", text))
        if node.attrs.get("onclick"):
            handlers.extend((_join(url, t), "onclick_attr", text) for t in _SCRIPT.findall(node.attrs["onclick"]) if usable(t))
    return out + handlers


_SCRIPT = re.compile(fixed.SCRIPT_TARGET_PATTERN, re.I)


def usable(raw: str) -> bool:
    low = raw.strip().lower()
    return low not in fixed.PLACEHOLDER_HREFS and low != "/" and "{" not in low and not low.startswith(tuple(fixed.BLOCKED_SCHEMES))


def _without_noise(root: Node) -> Node:
    """The tree without the elements of noise, in one walk; what is below one goes with it."""
    rules = [_selector(s) for s in fixed.NOISE_SELECTORS]
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not any(r.matches(c) for r in rules)]
        stack.extend(c for c in node.children if isinstance(c, Node))
    return root


def content(root: Node) -> tuple[Node, str, int]:
    """The element with the most text among the first of each content selector, its selector and its number of characters.

    Selectors count in their order up to the first that is not wide and has, as the longest so far, more than ENOUGH_CONTENT
    characters; of equally long ones the earlier is taken.
    """
    firsts: dict[str, Node] = {}
    for node in _without_noise(root).walk():
        for selector in fixed.CONTENT_SELECTORS:
            if selector not in firsts and _selector(selector).matches(node):
                firsts[selector] = node
    sizes = [(len(firsts[s].text()), s) for s in fixed.CONTENT_SELECTORS if s in firsts]
    longest = [0, *accumulate((n for n, _ in sizes), max)]
    ends = (k + 1 for k, (n, s) in enumerate(sizes) if n > max(longest[k], fixed.ENOUGH_CONTENT) and s not in fixed.WIDE_SELECTORS)
    chars, selector = max(sizes[: next(ends, None)], key=lambda x: x[0], default=(0, ""))
    if chars:
        return firsts[selector], selector, chars
    whole = first(root, "body") or root
    return whole, "body_fallback", len(whole.text())


def _inline(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _markdown(c) for c in node.children)


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _wrapped(node: Node, mark: str) -> str:
    inner = _squeezed(_inline(node)).strip()
    return f"{mark}{inner}{mark}" if inner else ""


def _markdown(node: Node) -> str:
    tag = node.tag
    if re.fullmatch("h[1-6]", tag):
        inner = _squeezed(_inline(node)).strip()
        return f"\n\n{'#' * int(tag[1])} {inner}\n\n" if inner else ""
    if tag == "p":
        return f"\n\n{_inline(node).strip()}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("b", "strong"):
        return _wrapped(node, "**")
    if tag in ("i", "em"):
        return _wrapped(node, "*")
    if tag == "code" and (node.parent is None or node.parent.tag != "pre"):
        return _wrapped(node, "`")
    if tag == "pre":
        return "\n\n```\n" + "".join(node.strings()).strip("\n") + "\n```\n\n"
    if tag == "a":
        inner = _squeezed(_inline(node)).strip()
        return f"[{inner}]({node.attrs['href']})" if node.attrs.get("href") and inner else inner
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag in ("ul", "ol"):
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        rows = [("* " if tag == "ul" else f"{k}. ") + _inline(item).strip().replace("\n", "\n  ") for k, item in enumerate(items, 1)]
        return "\n\n" + "\n".join(rows) + "\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join("> " + line for line in _inline(node).strip().split("\n")) + "\n\n"
    if tag == "table":
        rows = [[_squeezed(_inline(c)).strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        table = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n\n" + "\n".join(table[:1] + ["| " + " | ".join("---" for _ in rows[0]) + " |"] + table[1:]) + "\n\n" if rows else ""
    if tag in _RAW or tag == "title":
        return ""
    inner = _inline(node)
    return f"\n{inner}\n" if tag in _BLOCKS else inner


def to_markdown(node: Node) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", _markdown(node)) if first(node, "pre") is None else _markdown(node))
    return re.sub(r"[ \t]+", " ", text.strip()).strip()


def read(html: str | None, url: str | None) -> tuple:
    """All of a page, in the order of SCHEMA; empty values for an empty page."""
    root, url = parse(html), url or ""
    heading = next((t for t in (_short(first(root, s)) for s in fixed.HEADING_SELECTORS) if len(t) > 2), "")
    canonical = next((n.attrs["href"].strip() for n in select(root, "link") if "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href")), "")
    refresh = next((n.attrs.get("content", "") for n in select(root, "meta") if "refresh" in n.attrs.get("http-equiv", "").lower()), "")
    target = re.search(fixed.REFRESH_TARGET, refresh, re.I)
    social = next((n.attrs.get("content", "").strip() for n in select(root, "meta") if n.attrs.get("property") == "og:url"), "")
    meta = (_short(first(root, "title")), _short(first(root, "h1")), heading, _join(url, canonical) if canonical else "", _join(url, target.group(1).strip().strip("'\"")) if target else "", social, data_urls(root, url), links(root, url))
    best, selector, chars = content(root)
    return (*meta, to_markdown(best), selector, chars)


def _read_batch(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    names = ["title", "h1", "best_heading", "canonical_url", "refresh_url", "og_url", "data_urls", "links", "markdown", "selector", "main_content_chars"]
    rows = [read(h, u) for h, u in zip(html, url)]
    rows = [(*r[:7], [dict(zip(("url", "source", "text"), x)) for x in r[7]], *r[8:]) for r in rows]
    return pd.DataFrame(rows, columns=names)


def read_page(html: Column | str, url: Column | str) -> Column:
    """A struct of SCHEMA for each page; one pass over its HTML for all that is asked of it."""
    return F.pandas_udf(_read_batch, SCHEMA)(html, url)


HEADINGS = "array<struct<tag: string, text: string, class: string>>"
MOST_HEADINGS, HEADING_CHARS, CLASS_CHARS = 10, 120, 60
MOST_ROUTES, DEEPEST_ROUTES = 200, 6


def headings(html: str | None) -> list[dict]:
    """Headings of the first four ranks and elements whose class speaks of a title or heading, in order."""
    out = []
    for node in parse(html).walk():
        name = node.attrs.get("class", "")
        if node.tag in ("h1", "h2", "h3", "h4") or "title" in name or "heading" in name:
            out.append({"tag": node.tag, "text": " ".join("".join(node.strings()).split())[:HEADING_CHARS], "class": name[:CLASS_CHARS]})
            if len(out) == MOST_HEADINGS:
                break
    return out


def spa_routes(state: str | None, url: str | None) -> list[str]:
    """Paths in the JSON state of a single-page application, resolved; at most MOST_ROUTES, none deeper than DEEPEST_ROUTES."""
    try:
        found = _strings_of(json.loads(state or "null"), DEEPEST_PATHS - DEEPEST_ROUTES)
        return [_join(url or "", s) for s in found if s.startswith("/")][:MOST_ROUTES]
    except ValueError:
        return []


def _heading_batch(html: pd.Series) -> pd.Series:
    return html.map(headings)


def _route_batch(state: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([spa_routes(s, u) for s, u in zip(state, url)])
