"""Residue of HTML, wiki and LaTeX markup in markdown (problem 7).

A text is cut into flat blocks at blank lines, code apart. Each block has its number of words, its link density, the
same of the blocks before and after, counts of the signs of each markup, and the strongest signs of its neighbours. One
decision tree for each markup, grown on the labelled pages of ``labelled``, decides whether the block holds it.
``clean`` rewrites the blocks so judged and keeps headings, lists, tables, links, code and formulas.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.code_spans import code_lines, without_spans
from pagemill.llm.labelled import labelled_pages
from pagemill.shared import spread

KINDS = ("html", "wiki", "latex")
DEPTH = 9

# Tag names a tag is known by.
TAGS = "a abbr article aside b blockquote body br button caption center cite code dd div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main meta nav ol option p pre s script section select small span strong style sub sup table tbody td tfoot th thead title tr u ul video"
#: Attributes that stand without a value.
BARE_ATTRIBUTES = "async autofocus autoplay checked controls default defer disabled hidden loop multiple muted novalidate open readonly required reversed selected"
_NAMES = "|".join(TAGS.split())
_BARE = "|".join(BARE_ATTRIBUTES.split())
#: 'x <b and c> y' compares numbers: a tag has no words behind its name but attributes, of which one has a value or all need none.
_TAG = re.compile(rf"</?(?:{_NAMES})(?:\s+(?:{_BARE}))*\s*/?>|<(?:{_NAMES})\s[^<>]*=[^<>]*>|<!--|<!doctype", re.I)
_TAG_LIKE = re.compile(rf"</?(?:{_NAMES})\s[^<>=]*>", re.I)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_WIKI = {
    "wiki_link": re.compile(r"\[\[(?![\d\s.,;:–-]*\]\])[^\[\]\n{}]+\]\]"),
    "wiki_bold": re.compile(r"(?<!')'{2,3}(?![\s'])[^'\n]+(?:'[^'\n]+)*?'{2,3}(?!')"),
    "wiki_heading": re.compile(r"^[^\S\n]*(={2,6})[^\S\n]*[^=\n]+?[^\S\n]*\1[^\S\n]*\r?$", re.M),
    "wiki_template": re.compile(r"\{\{[^{}|]+\|[^{}]*\}\}"),
    "wiki_table": re.compile(r"^[^\S\n]*(?:\{\|(?!\})|\|\}(?!\}))", re.M),
}
_LATEX = {
    "latex_command": re.compile(r"\\(?!begin|end)[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    "latex_environment": re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}"),
    "latex_bracket": re.compile(r"\\\((?=[^\n]*\\\))|\\\[(?=[\s\S]*?\\\])"),
    "latex_formula": re.compile(r"(?<![\w$\\])\$(?![\s\d{$])[^$\n]*[\\^_=<>][^$\n]*(?<![\s{])\$(?![\w{])"),
    "latex_display": re.compile(r"\$\$[^$]+\$\$"),
    "latex_sign": re.compile(r"\\(?:alpha|beta|gamma|delta|lambda|sigma|omega|pi|le|leq|ge|geq|neq|approx|sum|int|times|cdot|infty|item|ldots|dots|to)\b"),
}
#: Rows of tables cut off from their beginning: alone they are not sure to be of that markup, beside it they are.
_WIKI_ROW = re.compile(r"^[^\S\n]*(?:\|-|[|!][^|\n]*(?:\|\||!!))", re.M)
_LATEX_ROW = re.compile(r"&[^&\n]*\\\\[^\S\n]*$", re.M)
_HOLDER = re.compile(r"\{\{[^{}|\n]*\}\}|\$\{[^{}\n]*\}|<%[^%\n]*%>")
_PRICE = re.compile(r"\$\s?\d[\d,.]*")
_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)|<a\s[^>]*>([^<]*)</a>", re.I)
_SIGN = re.compile(r"[<&\[\]'={}\\$|]")
#: Words and link density of a block and its neighbours, signs of its own, and the strongest sign of each markup beside it.
FEATURES = ["words", "link_density", "words_before", "links_before", "words_after", "links_after", "html_tag", "tag_like", "html_entity", *_WIKI, *_LATEX, "wiki_row", "latex_row", "holder", "price", "odd_share", "html_beside", "wiki_beside", "latex_beside"]
_AT = {name: k for k, name in enumerate(FEATURES)}
_OF_KIND = [[_AT[f] for f in names] for names in (("html_tag", "html_entity"), tuple(_WIKI), tuple(_LATEX))]

def block_features(text: str) -> list[float]:
    """The block's own features; those of its neighbours are filled in by ``features``."""
    out = [0.0] * len(FEATURES)
    out[0] = float(text.count(" ") + text.count("\n") + 1)
    if not _SIGN.search(text):
        return out
    linked = sum(len((a or b).split()) for a, b in _LINK.findall(text)) if "](" in text or "<a" in text else 0
    out[1] = linked / out[0]
    if "<" in text:
        out[_AT["html_tag"]] = float(len(_TAG.findall(text)))
        out[_AT["tag_like"]] = float(len(_TAG_LIKE.findall(text)))
    if "&" in text:
        out[_AT["html_entity"]] = float(sum(1 for e in _ENTITY.findall(text) if e[0] == "#" or e + ";" in html5))
    for table in (_WIKI, _LATEX):
        if table is _LATEX and "\\" not in text and "$" not in text or table is _WIKI and not ("[[" in text or "''" in text or "==" in text or "{{" in text or "{|" in text or "|}" in text):
            continue
        for name, pattern in table.items():
            out[_AT[name]] = float(len(pattern.findall(text)))
    if "|" in text:
        out[_AT["wiki_row"]] = float(len(_WIKI_ROW.findall(text)))
    if "&" in text and "\\\\" in text:
        out[_AT["latex_row"]] = float(len(_LATEX_ROW.findall(text)))
    if "{" in text or "<%" in text:
        out[_AT["holder"]] = float(len(_HOLDER.findall(text)))
    if "$" in text:
        out[_AT["price"]] = float(len(_PRICE.findall(text)))
    out[_AT["odd_share"]] = sum(1 for c in text if not c.isalnum() and not c.isspace()) / max(1, len(text))
    return out


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line + 1, text without code spans) of each block outside fenced code."""
    lines = text.split("\n")
    out, start = [], -1
    code = code_lines(lines) if "```" in text or "~~~" in text else None
    for k, line in enumerate(lines):
        if not line.strip() or code is not None and code[k]:
            if start >= 0:
                out.append((start, k, without_spans("\n".join(lines[start:k]))))
                start = -1
        elif start < 0:
            start = k
    if start >= 0:
        out.append((start, len(lines), without_spans("\n".join(lines[start:]))))
    return out


def features(texts: list[str]) -> list[list[float]]:
    rows = [block_features(t) for t in texts]
    own = [[max(r[k] for k in places) for places in _OF_KIND] for r in rows]
    for k in range(len(rows)):
        if k:
            rows[k][2:4] = rows[k - 1][0:2]
        if k + 1 < len(rows):
            rows[k][4:6] = rows[k + 1][0:2]
        rows[k][-3:] = [max(own[k - 1][j] if k else 0.0, own[k + 1][j] if k + 1 < len(rows) else 0.0) for j in range(3)]
    return rows


class Tree:
    """A binary decision tree: (feature, cut, tree if at most the cut, tree if more), or the leaf's answer."""

    def __init__(self, root):
        self.root = root

    def answer(self, row: list[float]):
        node = self.root
        while node.__class__ is tuple:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    @staticmethod
    def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH) -> Tree:
        """The tree of the splits that lower the Gini impurity most, until answers are pure or no split helps. Of equal splits the
        first feature's has it, with the cut half way."""
        names, answers = np.unique(labels, return_inverse=True)
        labels = answers

        def counts(y):
            return np.bincount(y, minlength=len(names)).astype(float)

        def impurity(y):
            c = counts(y)
            return len(y) - (c**2).sum() / len(y) if len(y) else 0.0

        def build(x, y, left):
            usual = names[int(counts(y).argmax())].item()
            if left == 0 or (y == y[0]).all():
                return usual
            best = None
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for a, b in zip(values[:-1], values[1:]):
                    low = x[:, f] <= (a + b) / 2
                    cost = impurity(y[low]) + impurity(y[~low])
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, float((a + b) / 2), low)
            if best is None or best[0] >= impurity(y) - 1e-12:
                return usual
            _, f, cut, low = best
            return (f, cut, build(x[low], y[low], left - 1), build(x[~low], y[~low], left - 1))

        return Tree(build(rows, labels, depth))


def trees(pages: list | None = None) -> dict[str, Tree]:
    """One tree for each markup, grown on labelled pages."""
    pages = labelled_pages() if pages is None else pages
    rows = np.array([row for page in pages for row in features([without_spans(block) for _, block in page])])
    return {kind: Tree.grow(rows, np.array([kind in kinds for page in pages for kinds, _ in page])) for kind in KINDS}


# Labelled pages: the type of each block and the block, in the order of the page; pages end with a line of dashes.
LABELLED_PAGES = """
menu | [Home](/) / [News](/n) / [About](/a) / [Contact](/c)
heading | # The new bridge
text | The bridge was opened in May and has been used by all of the people who live near the river since then.
list | - one small thing / - another small thing / - a third thing
text | It will be closed for two days in the winter, as the steel has to be looked at by the team of the town.
table | | a | b | / |---|---| / | 1 | 2 |
menu | [Imprint](/i) [Privacy](/p) [Terms](/t)
-----
heading | == Older bridges ==
text | There were three older bridges, of which one is still there; the others were taken down when the new one was built.
formula | $$ / \\frac{a}{b} = c / $$
text | The load is given by this formula, which holds for every bridge of the same kind and size in the whole valley.
list | * stone bridge / * wooden bridge
heading | A closing word
text | We thank all who have helped us with this work, and we hope that the bridge will stand for many more years to come.
-----
menu | Home | News | About | Contact
heading | <h2>Plans</h2>
text | <p>The plans are kept in the town hall, where everyone may look at them in the morning and in the afternoon.</p>
table | {| class=x / |- / | a || b / |- / | c || d / |}
list | <ul> / <li>first plan</li> / <li>second plan</li> / </ul>
formula | \\( a + b = c \\)
-----
list | 1. walk over / 2. look down / 3. walk back
text | This is all there is to do on the bridge in the evening, when the shops near the river are closed.
heading | \\section{Ways to the bridge}
list | \\begin{itemize} / \\item by train / \\item by bus / \\end{itemize}
table | name;length;year / old;20;1890 / new;45;2020
text | Short note.
-----
heading | ### Visit us
text | You can visit the bridge at any time of the day, and there is no fee to be paid by those who walk over it.
menu | [Back](/b) | [Next](/n)
text | A ticket for the museum is sold at the gate, and it may be used on the next day as well if it was not used.
formula | $x = y^2$
text | so that the height follows from the width, as it was shown in the first part of the text on the old bridge.
menu | * [Home](/home) / * [News](/news) / * [Team](/team)
-----
menu | Home / News / About / Contact / Team / Search
heading | # A much longer heading of eleven words about the old bridge
text | We use cookies to make this page work as it should
list | 1. small red lamp / 2. large blue lamp / - old green lamp / * new lamp
text | This text has no mark at its end but it goes on for a good while with words of all kinds in one long line
heading | ## One more heading (with a remark)
text | Written by Jo Miller, 3 May 2020
table | 5 | 6 | 7 / 8 | 9 | 10 / 1 | 2 | 3
heading | ## How the lamp was made
text | <div class="x"> / The lamp was made by hand in the town, and it took the team four weeks to do so. / </div>
menu | Home > Lamps > The old lamp
text | A line of text that speaks of one thing / and goes on in a second line about it / and then in a third one.
table | a lamp    5    red / b lamp    6    blue / c lamp    7    green
menu | Start › Shop › Lamps › Team › About
text | © 2020 The Lamp Shop. All rights reserved.
-----
""".strip()  # fmt: skip
_HEAD = re.compile(r"^\s*(?:#{1,6}\s*\S|={2,6}[^=]+={2,6}\s*$|\\\\(?:sub)*section\*?\{|<h[1-6][ >])")
_ITEM = re.compile(r"^\s*(?:[-*+•]\s|\d{1,3}[.)]\s|<li[ >]|\\\\item\b)")
_ROW = re.compile(r"^\s*\|.*\||^\s*(?:\{\||\|\}|\|-)|<t[dr][ >]|^\s*\|[^|]+\|\|")
_CELLS = re.compile(r"[;\t]| {3,}")
_MENU_SIGN = re.compile(r"\s[|›»]\s")
TYPE_FEATURES = ["head", "formula", "row_share", "cell_share", "item_share", "menu_signs", "link_density", "ends", "words", "lines", "words_before", "links_before", "words_after", "links_after"]


def type_features(texts: list[str]) -> list[list[float]]:
    """Features of the blocks of a page in order: words and link density of each and its neighbours, and signs of form."""
    rows = []
    for t in texts:
        own = block_features(t)
        lines = t.strip("\n").split("\n")
        n = len(lines)
        formulas = sum(own[_AT[f]] for f in ("latex_bracket", "latex_formula", "latex_display"))
        # a formula is what is left when nothing much besides is
        plain = len(re.findall(r"[^\W\d_]{3,}", re.sub(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\\\(.*?\\\\\)|\\\\[a-z]+", " ", t, flags=re.S)))
        rows.append([
            float(bool(_HEAD.match(t)) and n <= 2), float(formulas > 0 and plain < 3), sum(bool(_ROW.search(x)) for x in lines) / n, sum(bool(_CELLS.search(x.strip())) for x in lines) / n * (n > 1),
            sum(bool(_ITEM.match(x)) for x in lines) / n, float(len(_MENU_SIGN.findall(t)) * (n == 1)), own[1] if "](" in t or "<a" in t else 0.0,
            float(bool(re.search(r"[.!?][\"'”»)]*\s*(?:</p>)?\s*$", t))), own[0], float(n), 0.0, 0.0, 0.0, 0.0,
        ])
    for k, row in enumerate(rows):
        if k:
            row[10:12] = rows[k - 1][8], rows[k - 1][6]
        if k + 1 < len(rows):
            row[12:14] = rows[k + 1][8], rows[k + 1][6]
    return rows


def type_tree() -> Tree:
    """The tree of block types, grown on the labelled pages."""
    rows, labels = [], []
    for page in LABELLED_PAGES.split("-----\n"):
        own = [line.split(" | ", 1) for line in page.removesuffix("-----").strip("\n").split("\n") if " | " in line]
        rows += type_features([block.replace(" / ", "\n").replace("\\\\", "\\") for _, block in own])
        labels += [label for label, _ in own]
    return Tree.grow(np.array(rows), np.array(labels))


def judge(text: str, grown: dict[str, Tree]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first line, last line + 1, markups) of each block."""
    found = blocks(text)
    rows = features([b[2] for b in found])
    return [(a, b, tuple(k for k in KINDS if grown[k].answer(row))) for (a, b, _), row in zip(found, rows)]


def _cells(rows: list[list[str]]) -> str:
    """A table of markdown, its first row as the head."""
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows if r]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines else ""


_ROW_OF = re.compile(r"<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\Z)", re.I | re.S)
_CELL_OF = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dhr]\b|</tr>|\Z)", re.I | re.S)


def _html_table(m: re.Match) -> str:
    return "\n" + _cells([_CELL_OF.findall(row) for row in _ROW_OF.findall(m.group(1))]) + "\n"


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m.group(0).split("\n"):
        line = line.strip()
        if line.startswith(("{|", "|}", "|+")):
            continue
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in ("|", "!"):
            for cell in re.split(r"\|\||!!", line[1:]):
                # what stands before a single bar are the cell's attributes
                rows[-1].append(re.sub(r"^[^\[|]*=[^\[|]*\|", "", cell))
        elif line and rows[-1]:
            rows[-1][-1] += " " + line
    return _cells(rows)


def _template(m: re.Match) -> str:
    """What a template shows: its values without names, of a measure the number and its unit, or the one that names the thing."""
    name, *values = [v.strip() for v in m.group(1).split("|")]
    named = dict(v.split("=", 1) for v in values if "=" in v)
    plain = [v for v in values if "=" not in v and v]
    if name.lower() in ("convert", "cvt"):
        return " ".join(plain[:2])
    return " ".join(plain) or next((v.strip() for k, v in named.items() if k.strip().lower() in ("title", "name", "text")), "")


def _numbered(m: re.Match) -> str:
    number = iter(range(1, len(m.group(1)) + 2))
    return re.sub(r"<li[^>]*>\s*", lambda _: f"\n{next(number)}. ", m.group(1), flags=re.I)


_LINK_TAG = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\s\"'<>]*)[\"']?[^<>]*>(.*?)</a>", re.I | re.S)
_HTML_RULES = [
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"<table\b[^>]*>(.*?)</table>", re.I | re.S), _html_table),
    (_LINK_TAG, r"[\2](\1)"),
    (re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>", re.I | re.S), lambda m: "\n" + "#" * int(m.group(1)) + " " + m.group(2) + "\n"),
    (re.compile(r"<ol[^>]*>(.*?)(?:</ol>|\Z)", re.I | re.S), _numbered),
    (re.compile(r"<li[^>]*>\s*", re.I), "\n- "),
    (re.compile(r"</?(?:strong|b)(?:\s[^<>]*=[^<>]*)?>", re.I), "**"),
    (re.compile(r"</?(?:em|i)(?:\s[^<>]*=[^<>]*)?>", re.I), "_"),
    (re.compile(r"</?code(?:\s[^<>]*=[^<>]*)?>", re.I), "`"),
    (re.compile(r"</t[dh]>\s*<t[dh][^>]*>", re.I), " | "),
    (re.compile(r"<br\s*/?>|</(?:p|div|tr|li|ul|ol|table|section|article)>", re.I), "\n"),
]
_WIKI_RULES = [
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), r"\1"),
    (re.compile(r"(?<!\[)\[(https?://\S+)\s+([^\[\]\n]+)\](?!\()"), r"[\2](\1)"),
    (re.compile(r"\'\'\'(.+?)\'\'\'"), r"**\1**"),
    (re.compile(r"\'\'(.+?)\'\'"), r"_\1_"),
    (re.compile(r"^[^\S\n]*(={2,6})[^\S\n]*([^=\n]+?)[^\S\n]*\1[^\S\n]*$", re.M), lambda m: "#" * len(m.group(1)) + " " + m.group(2)),
    (re.compile(r"\{\{([^{}|]+\|[^{}]*)\}\}"), _template),
    (re.compile(r"^[^\S\n]*\{\|.*?(?:^[^\S\n]*\|\}[^\S\n]*$|\Z)", re.M | re.S), _wiki_table),
    (re.compile(r"^[^\S\n]*\|\}[^\S\n]*$\n?", re.M), ""),
]
_LATEX_RULES = [
    (re.compile(r"\\((?:sub)*)section\*?\{([^{}]*)\}"), lambda m: "#" * (2 + len(m.group(1)) // 3) + " " + m.group(2)),
    (re.compile(r"\\textbf\{([^{}]*)\}"), r"**\1**"),
    (re.compile(r"\\(?:emph|textit)\{([^{}]*)\}"), r"_\1_"),
    (re.compile(r"\\texttt\{([^{}]*)\}"), r"`\1`"),
    (re.compile(r"\\href\{([^{}]*)\}\{([^{}]*)\}"), r"[\2](\1)"),
    (re.compile(r"\\begin\{enumerate\}(.*?)(?:\\end\{enumerate\}|\Z)", re.S), lambda m: _enumerated(m.group(1))),
    (re.compile(r"^[^\S\n]*\\item\s*", re.M), "- "),
    (re.compile(r"^[^\S\n]*\\(?:begin|end)\{(?:itemize|enumerate|center|document|quote)\}[^\S\n]*\n?", re.M), ""),
]


def _enumerated(items: str) -> str:
    number = iter(range(1, items.count("\\item") + 2))
    return re.sub(r"\\item\s*", lambda _: f"{next(number)}. ", items)


_UNSEEN = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_PRE = re.compile(r"<pre\b[^>]*>(.*?)</pre\s*>", re.I | re.S)


def _fenced(m: re.Match) -> str:
    code = html.unescape(re.sub(r"</?code\b[^>]*>", "", m.group(1), flags=re.I)).strip("\n")
    fence = "~~~" if "```" in code else "```"
    return f"\n{fence}\n{code}\n{fence}\n"


def _without_code(text: str) -> str:
    """Scripts and styles out, preformatted text into fences; these may have blank lines inside. Fenced code stays."""
    if "<" not in text or not (_UNSEEN.search(text) or _PRE.search(text)):
        return text
    lines = text.split("\n")
    code, out, start = code_lines(lines), [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or code[k] != code[start]:
            part = "\n".join(lines[start:k])
            out.append(part if code[start] else _PRE.sub(_fenced, _UNSEEN.sub("", part)).strip("\n"))
            start = k
    return "\n".join(out)


def clean(text: str, grown: dict[str, Tree]) -> str:
    """The text with its residue rewritten as markdown; code, formulas and everything else stay as they are."""
    text = _without_code(text)
    lines = text.split("\n")
    for a, b, kinds in reversed(judge(text, grown)):
        if not kinds:
            continue
        spans: list[str] = []

        def hide(m):
            spans.append(m.group(0))
            return f"\x00{len(spans) - 1}\x00"

        block = re.sub(r"(`+)(?:(?!`).)+?\1|\$\$[^$]+\$\$|\\\(.*?\\\)|(?<![\w$])\$(?![\s\d{])[^$\n]+\$", hide, "\n".join(lines[a:b]), flags=re.S)
        for kind, rules in (("html", _HTML_RULES), ("wiki", _WIKI_RULES), ("latex", _LATEX_RULES)):
            if kind in kinds:
                for pattern, value in rules:
                    block = pattern.sub(value, block)
        if "html" in kinds:
            block = html.unescape(_TAG.sub("", block)).replace("\xa0", " ")
        block = re.sub(r"\n{2,}", "\n", block).strip("\n")
        block = re.sub(r"\x00(\d+)\x00", lambda m: spans[int(m.group(1))], block)
        lines[a:b] = block.split("\n")
    return "\n".join(lines)


def _apply(grown, rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if rewrite:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(t, grown) if t is not None else None for t in texts], pa.string())], ["id", "text"])
                continue
            ids, kinds = [], []
            for page, text in zip(batch.column(0).to_pylist(), texts):
                found = {k for _, _, own in judge(text, grown) for k in own} if text and _SIGN.search(text) else ()
                for k in KINDS:
                    if k in found:
                        ids.append(page)
                        kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["id", "markup"])

    return run


def markup_kinds(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, markup), once for each row and kind of markup outside code. Null and empty texts have none; a repeated row
    gives its kinds again; other columns are ignored; an empty table gives no rows."""
    rows = spread(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_apply(trees(), False), "id long, markup string")


def clean_texts(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): each row's text with residue of markup rewritten; a null text stays null."""
    rows = spread(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_apply(trees(), True), "id long, text string")


def _typed(grown, types):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(text) if text else []
                kinds = judge(text, grown) if found else []
                for (a, b, _), (_, _, own), row in zip(found, kinds, type_features([x[2] for x in found])):
                    for column, value in zip(out, (page, a, b, types.answer(row), " ".join(own))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["id", "first_line", "stop_line", "block_type", "markup"])

    return run


def typed_blocks(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first_line, stop_line, block_type, markup) of each block outside fenced code: heading, text, list, table, menu or
    formula, and the markups found in it. Null and empty texts have no block; a repeated row gives its blocks again."""
    rows = spread(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_typed(trees(), type_tree()), "id long, first_line int, stop_line int, block_type string, markup string")
