"""The main body of a page's markdown (problem 2): text-to-tag ratios, smoothed, and threshold clustering.

Each line goes through the standard library's streaming HTML parser; its text and its tags are counted, markdown's own
marks (bullets, links, buttons, emphasis, separators of menus) as tags like HTML's. The ratios of text to tags are
smoothed by a Gaussian over the lines, and the logarithms are split into two clusters. The threshold between them says
how much each line speaks for content. A line model adds what the words and the form of a line say: log odds by naive
Bayes, fitted to a bounded sample of labelled pages, namely those where just one region of lines has as many characters as
the crawler has counted in the body.

The body is the region of lines, of all there are, for which lines and the forms of its ends speak most. Where there is a
count of the body's characters, a region of another size loses by its distance from it, up to a limit, so that an outdated
count does not decide against the lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.shared import spread

SIGMA = 1.0
_RADIUS = 3
_KERNEL = np.exp(-0.5 * (np.arange(-_RADIUS, _RADIUS + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
#: Log-ratio units that a character of difference from the crawler's count costs, and the most it costs.
MISS = 0.5
MOST_MISS = 8.0
#: Weight of the line model's log odds against the smoothed ratios, and the most the odds of a line are.
LEARNED = 0.5
MOST_ODDS = 8.0
#: Labelled pages the line model is fitted to, at most; occurrences from which a feature is kept; smoothing.
LABELLED = 4_000
LEAST_COUNT = 4
SMOOTHING = 3.0
#: Characters of a line from which it supports content in full; what a code block cut in two costs.
SHORT_LINE = 130
BROKEN_CODE = 4.0
_ITEM = re.compile(r"\s*(?:[-*+•–]|\d{1,3}[.)])\s")
_STOPS, _CLOSERS = frozenset(".!?…"), "\"'”»“)*_"
_MENU = re.compile(r"\s[|›»]\s|^\S+ > ")
_MARKS = re.compile(r"^\s*(?:[-*+•>]|\d+[.)])\s|\]\(|\[[^\]]*\]|\s[|›»·]\s|\s>\s|\*\*|>>|©|\([cC]\)")


#: Signs of which each mark but a leading one has one, and the leading one.
_MARK_SIGN = re.compile(r"[\[\]|›»·>*©]|\([cC]\)")
_LEAD = re.compile(r"\s*(?:[-*+•>]|\d+[.)])\s")


class TagCounter(HTMLParser):
    """Counts text and tags of the lines fed to it; a tag may stretch over lines."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.text = self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1

    def handle_data(self, data):
        self.text += len(data)

    def handle_entityref(self, name):
        self.text += 1

    def handle_charref(self, name):
        self.text += 1

    def line(self, line: str) -> tuple[int, int]:
        self.text = self.tags = 0
        self.feed(line)
        return self.text, self.tags


def ratios(lines: list[str]) -> np.ndarray:
    """Text-to-tag ratio of each line; a line without tags counts as one with one."""
    counter, inside = TagCounter(), False
    out = np.empty(len(lines))
    for k, line in enumerate(lines):
        if inside or "<" in line:
            text, tags = counter.line(line + "\n")
            inside = bool(counter.rawdata)
        else:
            text, tags = len(line), 0
        out[k] = text / max(1, tags + (_short_marks(line) if len(line) < 80 else _marks(line)))
    return out


def _marks(line: str) -> int:
    return len(_MARKS.findall(line)) if _MARK_SIGN.search(line) else bool(_LEAD.match(line))


@lru_cache(100_000)
def _short_marks(line: str) -> int:
    return _marks(line)


def two_means(values: list[float], rounds: int = 20) -> float:
    """Threshold between two clusters of numbers: the middle of their means."""
    held = sorted(values)
    total, n = list(accumulate(held, initial=0.0)), len(held)
    cut = (held[0] + held[-1]) / 2
    for _ in range(rounds):
        below = bisect_right(held, cut)
        if below in (0, n):
            break
        new = ((total[n] - total[below]) / (n - below) + total[below] / below) / 2
        if abs(new - cut) < 1e-6:
            break
        cut = new
    return cut


def support(lines: list[str]) -> np.ndarray:
    """How much each line speaks for content: log smoothed ratio less the threshold of the text's two clusters."""
    raw = ratios(lines)
    padded = np.concatenate([np.full(_RADIUS, raw[0]), raw, np.full(_RADIUS, raw[-1])])
    smooth = sum(w * padded[k : k + len(raw)] for k, w in enumerate(_KERNEL))
    value = (np.log1p(raw) + np.log1p(smooth)) / 2
    return value - two_means(value.tolist())


def _own_features(line: str, before: bool, after: bool) -> tuple[list[str], list[str]]:
    """Features of a line's words and form, and those it lends to the items of a list below it; before, after: blank lines there."""
    text = line.strip()
    words = list(dict.fromkeys(text.lower().split()))
    n = len(words)
    size = f"n{n}" if n < 6 else f"n{6 + int(2 * math.log2(n / 6))}"
    first, final = text[0], text[-1]
    begins = "#" if text.startswith("# ") else "##" if first == "#" else first if not first.isalnum() else "A" if first.isupper() else "0" if first.isdigit() else "a"
    own = [*words, size, "<" + begins, ">" + ("." if text.rstrip(_CLOSERS)[-1:] in _STOPS else final if not final.isalnum() else "a"), f"{before:d}|{after:d}"]
    if text.isupper():
        own.append("^")
    if len(text) != len(line):
        own.append("_")
    return own, [*words, size]


def line_features(lines: list[str]) -> list[list[str]]:
    """Features of each line that is not blank: its words, its form and, for an item of a list, the words of the line above it."""
    out, lead, last = [], [], len(lines) - 1
    blank = [not line.strip() for line in lines]
    for k, line in enumerate(lines):
        if blank[k]:
            continue
        own, words = _own_features(line, k == 0 or blank[k - 1], k == last or blank[k + 1])
        if _ITEM.match(line):
            own.extend(lead)
        else:
            lead = ["/" + w for w in words]
        out.append(own)
    return out


class LineModel:
    """Log odds that a line is body: ``bias`` plus the weights of its features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict = {}

    def odds(self, lines: list[str]) -> np.ndarray:
        """As the features of ``line_features`` add up; short lines, which pages of a site share, are looked up."""
        get, out, leads, last = self.weights.get, [], 0.0, len(lines) - 1
        blank = [not line or line.isspace() for line in lines]
        for k, line in enumerate(lines):
            if blank[k]:
                continue
            key = (line, k == 0 or blank[k - 1], k == last or blank[k + 1])
            known = self.seen.get(key)
            if known is None:
                own, words = _own_features(*key)
                item = bool(_ITEM.match(line))
                known = (self.bias + sum(filter(None, map(get, own))), None if item else sum(filter(None, map(get, ["/" + w for w in words]))))
                if len(line) < 80:
                    if len(self.seen) >= 100_000:
                        self.seen.clear()
                    self.seen[key] = known
            value = known[0]
            if known[1] is None:
                value += leads
            else:
                leads = known[1]
            out.append(max(-MOST_ODDS, min(MOST_ODDS, value)))
        return np.array(out)

    @classmethod
    def train(cls, pages: Iterable[tuple[list[str], tuple[int, int]]]) -> LineModel | None:
        """A model of pages with known bodies (first line, last + 1); None if there is no line of either kind."""
        on, off, n_on, n_off = Counter(), Counter(), 0, 0
        for lines, (first, stop) in pages:
            for k, own in zip([k for k, line in enumerate(lines) if line.strip()], line_features(lines)):
                if first <= k < stop:
                    on.update(own)
                    n_on += 1
                else:
                    off.update(own)
                    n_off += 1
        if not n_on or not n_off:
            return None
        weights = {}
        for f, n in (on + off).items():
            if n >= LEAST_COUNT:
                credit = SMOOTHING * n / (n_on + n_off)
                weights[f] = math.log((on[f] + credit) / (n_on + SMOOTHING)) - math.log((off[f] + credit) / (n_off + SMOOTHING))
        return cls(weights, math.log(n_on / n_off))


def start_form(line: str, after_blank: bool) -> float:
    """How well a line begins a body: a main heading, after a blank line, no menu."""
    form = 1.5 * after_blank
    if line.startswith("#"):
        return form + 4.0 * (not line.startswith("##"))
    return form - 2.5 * (_short_menu(line) if len(line) < 80 else bool(_MENU.search(line)))


@lru_cache(100_000)
def _short_menu(line: str) -> bool:
    return bool(_MENU.search(line))


def stop_form(line: str, alone: bool, before_blank: bool) -> float:
    """How well a line ends a body: before a blank line, not as a short line by itself, as prompts and notices are."""
    return 1.5 * before_blank - 2.5 * (alone and len(line) < SHORT_LINE)


def forms(lines: list[str], own: list[int]) -> tuple[list[float], list[float]]:
    """Of each of the ``own`` lines how well it begins and how well it ends a body."""
    held, last = set(own), len(lines) - 1
    starts = [start_form(lines[k], k == 0 or k - 1 not in held) for k in own]
    stops = [stop_form(lines[k], k > 0 and k - 1 not in held, k == last or k + 1 not in held) for k in own]
    return starts, stops


def _fences(lines: list[str]) -> list[int]:
    """Parity of the number of code fences before each line."""
    return list(accumulate((line.lstrip().startswith(("```", "~~~")) for line in lines), lambda a, b: a ^ b, initial=0))


def line_scores(lines: list[str], own: list[int], model: LineModel | None) -> np.ndarray:
    """How much each of the ``own`` lines, those not blank, speaks for content; without a model short lines speak less."""
    value = support([lines[k] for k in own])
    if model is None:
        return value * np.array([min(1.0, len(lines[k]) / SHORT_LINE + 0.2) for k in own])
    return value + LEARNED * model.odds(lines)


def best_region(own: list[int], sums: list[float], sides: list[int], starts: list[float], stops: list[float]) -> tuple[float, int, int]:
    """(merit, a, b) of the region own[a:b] with the best sum of scores and form, over all regions, in one pass."""
    open_ = {0: (-math.inf, 0), 1: (-math.inf, 0)}  # the best start so far, by the parity of the fences before it
    best = (-math.inf, 0, 1)
    for b, k in enumerate(own):
        start = starts[b] - sums[b]
        if start > open_[sides[k]][0]:
            open_[sides[k]] = (start, b)
        end, here = sums[b + 1] + stops[b], sides[k + 1]
        for side, (merit, a) in open_.items():
            value = end + merit - BROKEN_CODE * (side != here)
            if value > best[0]:
                best = (value, a, b + 1)
    return best


def near_count(before: np.ndarray, body_chars: int) -> list[tuple[int, int]]:
    """Of each end the starts whose sizes enclose the count; ``before``: characters before each line."""
    ends = np.arange(1, len(before))
    starts = np.searchsorted(before, before[1:] - body_chars)
    pairs = np.concatenate([np.stack([starts - 1, ends], 1), np.stack([starts, ends], 1)])
    return pairs[(pairs[:, 0] >= 0) & (pairs[:, 0] < pairs[:, 1])].tolist()


def counted_regions(lines: list[str], body_chars: int) -> list[tuple[int, int]]:
    """The regions (first line, last + 1) that begin and end with text and have exactly that many characters."""
    sizes = [len("".join(line.split())) for line in lines]
    own = [k for k, n in enumerate(sizes) if n]
    before = np.cumsum([0, *(sizes[k] for k in own)])
    return [(own[a], own[b - 1] + 1) for a, b in near_count(before, body_chars) if before[b] - before[a] == body_chars]


def body_range(lines: list[str], body_chars: int | None, model: LineModel | None = None) -> tuple[int, int]:
    """(first, last + 1) of the body's lines; (0, 0) if there is none."""
    sizes = [len("".join(line.split())) for line in lines]
    own = [k for k, n in enumerate(sizes) if n]
    if not own or body_chars == 0:
        return 0, 0
    sums, sides = [0.0, *np.cumsum(line_scores(lines, own, model)).tolist()], _fences(lines)
    starts, stops = forms(lines, own)
    merit, a, b = best_region(own, sums, sides, starts, stops)
    if body_chars is not None:
        before = list(accumulate((sizes[k] for k in own), initial=0))
        best = (merit - min(MOST_MISS, MISS * abs(before[b] - before[a] - body_chars)), a, b)
        for x, y in near_count(np.array(before), body_chars):
            miss = MISS * abs(before[y] - before[x] - body_chars)
            if miss < MOST_MISS:
                here = sums[y] - sums[x] - miss + starts[x] + stops[y - 1] - BROKEN_CODE * (sides[own[x]] != sides[own[y - 1] + 1])
                if here > best[0]:
                    best = (here, x, y)
        _, a, b = best
    return own[a], own[b - 1] + 1


def fit_lines(pages: DataFrame, id_col: str, text_col: str, chars_col: str, most: int = LABELLED) -> LineModel | None:
    """The line model of at most ``most`` pages, taken by the hash of their ids, whose count fits one region."""
    rows = pages.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("x"), F.col(chars_col).cast("int").alias("n")).where("x is not null and n > 0")
    share = max(1, pages.count() // most)
    sample = rows.where(F.pmod("h", F.lit(share)) == 0).orderBy("h", "x").limit(most).select("x", "n").collect()
    labelled = ((lines, found[0]) for lines, found in ((x.split("\n"), counted_regions(x.split("\n"), n)) for x, n in sample) if len(found) == 1)
    return LineModel.train(labelled)


def _rows(pages: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    return spread(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(chars_col).cast("int").alias("chars")))


def _bodies(lines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, chars in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = (text or "").split("\n")
                first, stop = body_range(own, chars, lines.value)
                out.append((first, stop, None if text is None else "\n".join(own[first:stop])))
            kinds = (pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["id", "first", "stop", "body"])

    return run


def bodies(pages: DataFrame, id_col: str, text_col: str, chars_col: str, model: LineModel | None = None) -> DataFrame:
    """(id, first, stop, body): each page's lines first to stop - 1, counted from 0 at line feeds, without the others.

    Empty texts have (0, 0) and an empty body, null texts (0, 0) and a null one; a null count is no constraint; each row
    gives its own row, also where ids repeat; other columns are ignored; an empty table gives no rows. Without a model
    one is fitted to the pages.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or fit_lines(pages, id_col, text_col, chars_col))
    return _rows(pages, id_col, text_col, chars_col).mapInArrow(_bodies(held), "id long, first int, stop int, body string")


def _outside(judge, found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = judge.value if judge is not None else None
        for batch in batches:
            ids, numbers = [], []
            for page, text, chars in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text or model is not None and model.record(text) > 0:
                    continue
                lines = text.split("\n")
                first, stop = body_range(lines, chars, found.value)
                for k, line in enumerate(lines):
                    if not first <= k < stop and line.strip():
                        ids.append(page)
                        numbers.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], ["id", "line_no"])

    return run


def chrome_lines(pages: DataFrame, id_col: str, text_col: str, chars_col: str, judge=None, model: LineModel | None = None) -> DataFrame:
    """(id, line_no) of each non-blank line outside the body; with ``judge``, a broadcast model, of the pages it passes.

    Null and empty texts have no line; a repeated row gives its lines again; otherwise as ``bodies``.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or fit_lines(pages, id_col, text_col, chars_col))
    return _rows(pages, id_col, text_col, chars_col).mapInArrow(_outside(judge, held), "id long, line_no int")
