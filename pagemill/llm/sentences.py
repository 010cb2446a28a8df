"""Sentences in many languages and scripts (problem 10) by a hidden-event n-gram language model.

Between two words there may be a hidden event: the end of a sentence. Where a paragraph has end marks, the marks, and
spaces between Thai letters, are the places looked at; in a long one without any, every space between two words is. For
each place the model has the probability of the event after the word before (with its mark, quotes and brackets), the
probability of the next word at the start and inside of a sentence, and the probability that two ends are only a word or
two apart. Forward and backward passes over the places of a paragraph give the posterior of each event; from one half on
it is a boundary.

The model is trained without labels: paragraph ends and starts are certain, and expectation-maximization does the rest.
Every text is read once: its places are written to the shared folder, and what is counted is summed over all texts. A
posterior depends on the places it is linked with by nearness alone, so chains fall into short segments; expectation goes
over the distinct segments and their counts. Only classes met ``LEAST_COUNT`` times reach the driver. The finished model
is then applied to the written places.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.shared import materialize, spread

#: Texts whose places are one row of the table of places.
TEXTS_A_ROW = 200
ROUNDS = 4
LEAST_COUNT = 4
#: Count from which a word's own rate stands alone, and end rates a rarer one may have.
COMMON_COUNT = 40
GRID = (0.0005, 0.05, 0.2, 0.5, 0.8, 1.0)
#: Words between two ends that are near each other.
NEAR_WORDS = 2
#: Words of a paragraph without any end mark from which the spaces between words are places, too.
LONG_UNIT = 40
#: The same of characters, in scripts that write no spaces; there every two characters have a place between them.
LONG_SCRIPT = 60
#: Occurrences of a word, at the rate of all words, that its own rate of closing a sentence leans on.
GAP_LEAN = 20.0
#: Distinct counts a task holds before it hands them on.
_MOST_COUNTS = 200_000

END_MARKS = ".!?。！？｡।॥؟۔…"
CLOSERS = "\"'»”’“」』）)\\]"
OPENERS = "\"'«“„‘「『（([¿¡"
_WIDE = "。！？｡"
_BLANK = re.compile(r"(?:\r\n|\r|\n| )[^\S\r\n]*(?:\r\n|\r|\n| )\s*")
_LINE = re.compile(r"\r\n|\r|\n| ")
_MARKER = re.compile(r"[^\S\r\n]*(?:[-*•·–—+‣▪◦]\s|#{1,6}\s|(?:\d{1,3}|[a-zA-Z])[.)]\s|\(\w{1,3}\)\s)")
_PLACE = re.compile(rf"([^\s{END_MARKS}]*)([{END_MARKS}]+(?:\s(?=»))?[{CLOSERS}]*)(\s*)(?=(\S?\S?\S{{0,18}}))|(?<=[฀-๿])([^\S\r\n]+)(?=([฀-๿]\S?\S?))")
_GAP = re.compile(r"(\S+)[^\S\r\n]+(?=(\S{1,20}))|(\S+)(?:\r\n|\r|\n)[^\S\r\n]*(?=(\S{1,20}))")
_SCRIPT = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+")
_MARK = re.compile(rf"[{END_MARKS}]")
_INSIDE = re.compile(rf"(?<=[^\s{END_MARKS}{CLOSERS}])[^\S\r\n]+([{OPENERS}]|[^\W\d_]+|\d)")


def next_class(token: str) -> str:
    """The first word of what follows: the word, an opening mark, or the beginning of a word without letters' case."""
    if not token:
        return ""
    head = token[0]
    if not head.isalnum():
        return head
    if head.isdigit():
        return "<digit>"
    if ord(head) >= 0x0E00 and not head.isupper() and not head.islower():
        return token[:2]
    word = re.match(r"[^\W\d_]+", token)
    return word.group(0) if word else head


def _shape(word: str) -> str:
    if len(word) == 1 and word.isalpha():
        return "<letter>"
    if word.isdigit():
        return "<number>" if len(word) > 2 else "<short number>"
    if word[:1].isupper():
        return "<name>"
    return "<word>" if word else "<none>"


class Place:
    """A place that may end a sentence: where the next one would start, the class before, its back-off, the next word."""

    __slots__ = ("start", "before", "shape", "after", "words")

    def __init__(self, start: int, before: str, shape: str, after: str, words: int):
        self.start, self.before, self.shape, self.after, self.words = start, before, shape, after, words


def gaps(text: str, low: int, high: int) -> list[Place]:
    """The spaces between the words of text[low:high], in which there is no end mark."""
    found = []
    for m in _GAP.finditer(text, low, high):
        word, after = m.group(1) or m.group(3), m.group(2) or m.group(4)
        found.append(Place(m.end(), "<gap> " + word.strip(OPENERS + CLOSERS + ",;:").lower(), "<gap>", next_class(after), 1))
    return found


def script_gaps(text: str, low: int, high: int) -> list[Place]:
    """The places between two characters of text[low:high], which has neither spaces nor end marks; classes are pairs of characters."""
    return [Place(k, "<gap> " + text[k - 2 : k], "<script gap>", "<script> " + text[k : k + 2], 1) for k in range(low + 2, high - 1)]


def _quote_kind(text: str, closer_at: int, closer: str, low: int) -> str:
    """Whether a quotation or bracket that closes here began where a sentence can begin ('s') or inside one ('m')."""
    opener = {"»": "«", "”": "“„", "“": "„", "’": "‘", "」": "「", "』": "『", "）": "（", ")": "(", "]": "["}.get(closer, closer)
    at = max(text.rfind(o, low, closer_at) for o in opener)
    if at < 0:
        return "m"
    k = at - 1
    while k >= low and text[k].isspace():
        k -= 1
    return "s" if k < low or text[k] in END_MARKS or (text[k] in CLOSERS and k > low) else "m"


def places(text: str, low: int, high: int) -> list[Place]:
    """The places inside text[low:high] (one paragraph or list item), in order."""
    found: list[Place] = []
    last = low
    for m in _PLACE.finditer(text, low, high):
        if m.group(5) is not None:
            found.append(Place(m.end(5), "<thai>", "<thai>", m.group(6)[:2], 9))
            last = m.end()
            continue
        word, marks, space, after = m.group(1), m.group(2), m.group(3), m.group(4)
        end = m.end()
        opening = marks.find("“", 1)
        if opening > 0 and text.rfind("„", low, m.start()) < 0:
            # without a low quotation mark before it, this one opens the next sentence
            marks, space, end = marks[:opening], "", m.start(2) + opening
            after = text[end : end + 20]
        if end >= high:
            continue
        wide = marks[0] in _WIDE or marks[0] in "।॥؟۔" or (marks[0] == "…" and ord(after[0]) >= 0x2E80)
        if not space and not wide:
            # without a space only 'word.Next' and 'word?!Next' can be an end, not names of hosts, files or versions
            if not (after[0].isupper() and after[1:2].islower() and len(word) > 1 and word.islower() and word.isalpha() and "." not in after and "@" not in after and "/" not in after):
                continue
            k = m.start() - 1
            if k >= low and not text[k].isspace() and text[k] not in OPENERS:
                continue
        marks = marks.replace(" ", "")
        head = marks[0]
        if marks[-1] in CLOSERS and len(marks) > 1:
            before = "q" + head + marks[-1] + _quote_kind(text, m.end(2) - 1, marks[-1], low)
            shape = before
        elif len(marks) > 1 and head == "." or head == "…":
            before = shape = "<ellipsis>"
        elif head == ".":
            bare = word.lstrip(OPENERS)
            before, shape = bare.lower() + ".", _shape(bare) + "."
            if shape == "<short number>.":
                earlier = text[max(low, m.start() - 24) : m.start()].split()
                before = (earlier[-1].lower() if earlier else "") + " " + shape
        else:
            before = shape = "<" + head + ">"
        gap = text.count(" ", last, m.start()) + 1
        found.append(Place(end, before, shape, next_class(after), gap if not wide else 9))
        last = end
    return found


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs and list items of a text: a sentence never reaches over their ends."""
    out, at = [], 0
    bounds = [(m.start(), m.end()) for m in _BLANK.finditer(text)] + [(len(text), len(text))]
    for stop, resume in bounds:
        start, item = at, False
        lines = [at, *(m.end() for m in _LINE.finditer(text, at, stop))]
        marked = [bool(_MARKER.match(text, a, stop)) for a in lines]
        several = sum(marked) > 1
        for k, line in enumerate(lines):
            if not marked[k]:
                continue
            if line > start:
                # a line of wrapped text can begin like an item: one is believed after an end, or among others
                before = text[start:line].rstrip()
                if not (item or several or before[-1:] in END_MARKS + ":;"):
                    continue
                out.append((start, line))
                start = line
            item = True
            line_end = lines[k + 1] if k + 1 < len(lines) else stop
            if text[line:line_end].lstrip().startswith("#"):
                out.append((line, line_end))
                start = line_end
        out.append((start, stop))
        at = resume
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def _first(text: str, a: int, b: int) -> tuple[int, str]:
    """Where the words of a unit begin, after a list marker, and the class of the first word."""
    m = _MARKER.match(text, a, b)
    at = m.end() if m else a
    return at, next_class(text[at : at + 20])


class HiddenEventModel:
    """Probabilities of the event after a class, of words at the start and inside of sentences, and of short sentences."""

    def __init__(self, event: dict, event_shape: dict, start: dict, inside: dict, short: float):
        self.event, self.event_shape, self.start, self.inside, self.short = event, event_shape, start, inside, short
        self.start_floor, self.inside_floor = start[None], inside[None]
        self.short_odds = short / max(1e-6, 1 - short)

    def class_odds(self, before: str, shape: str, after: str) -> float:
        p = self.event.get(before)
        if p is None:
            p = self.event_shape.get(shape, 0.5)
        return p / (1 - p) * self.start.get(after, self.start_floor) / self.inside.get(after, self.inside_floor)

    def odds(self, place: Place) -> float:
        return self.class_odds(place.before, place.shape, place.after)

    def posteriors(self, found: list[Place]) -> list[float]:
        """Posterior of each event of the chain of places of one unit."""
        return self.chain([self.odds(p) for p in found], [k > 0 and p.words <= NEAR_WORDS for k, p in enumerate(found)])

    def chain(self, odds: list[float], linked: list[bool]) -> list[float]:
        """Posteriors by forward and backward passes; ``linked``: whether a place is near the one before it."""
        n = len(odds)
        if n == 1:
            return [odds[0] / (1 + odds[0])]
        both = [self.short_odds if near else 1.0 for near in linked]
        forward, off, on = [], 1.0, 0.0
        for k in range(n):
            off, on = (off + on), (off + on * both[k]) * odds[k]
            total = off + on
            off, on = off / total, on / total
            forward.append((off, on))
        out = [0.0] * n
        b_off, b_on = 1.0, 1.0
        for k in range(n - 1, -1, -1):
            x, y = forward[k][0] * b_off, forward[k][1] * b_on
            out[k] = y / (x + y)
            b_off, b_on = b_off + odds[k] * b_on, b_off + odds[k] * both[k] * b_on
            total = b_off + b_on
            b_off, b_on = b_off / total, b_on / total
        return out


def _clip(p: float) -> float:
    return min(0.9995, max(0.0005, p))


_BETWEEN, _WITHIN, _RARE = "\x1e", "\x1f", "\x00"


class _Counts:
    """What is counted of texts: (kind, class, shape) -> number, words inside sentences, and segments of linked places."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.inside: Counter = Counter()
        self.pairs: Counter = Counter()

    def add(self, text: str) -> list[tuple[int, list[Place]]]:
        """Count a text; its units as (start, places)."""
        counts, out = self.counts, []
        for a, b in units(text):
            at, first = _first(text, a, b)
            counts["start", first, ""] += 1
            chain, tail = chain_of(text, a, at, b)
            out.append((a, chain))
            self.inside.update(_INSIDE.findall(text, at, b))
            if "。" in text[a:b]:
                self._script(text[a:b])
            if tail is not None:
                counts["end", tail.before, tail.shape] += 1
            if not chain:
                counts["lengths", "", ""] += 1
                counts["short", "", ""] += text.count(" ", a, b) < NEAR_WORDS
            elif chain[0].shape not in ("<gap>", "<script gap>"):  # what has no mark tells nothing of marks
                if tail is None and "\u0e00" <= text[b - 1] <= "\u0e7f":
                    counts["end", "<thai>", "<thai>"] += 1
                for p in chain:
                    counts["seen", p.before, p.shape] += 1
                    counts["after", p.after, ""] += 1
                for segment in segments(chain):
                    counts["segment", _BETWEEN.join([_WITHIN.join((p.before, p.shape, p.after)) for p in segment]), ""] += 1
        return out

    def _script(self, unit: str) -> None:
        """Pairs of characters in a script without spaces: wherever they stand, and before and after end marks."""
        for m in _SCRIPT.finditer(unit):
            run = m.group()
            self.pairs.update(zip(run, run[1:]))
            if unit[m.end() : m.end() + 1] in ("。", "！", "？"):
                self.counts["closing", run[-2:], ""] += 1
            if unit[m.start() - 1 : m.start()] in ("", "。", "！", "？"):
                self.counts["opening", run[:2], ""] += 1

    def taken(self) -> Counter:
        """The counts so far, which are then forgotten."""
        out = self.counts
        for (x, y), n in self.pairs.items():
            out["pair", x + y, ""] += n
        self.pairs = Counter()
        for word, n in self.inside.items():
            out["inside", next_class(word), ""] += n
        self.counts, self.inside = Counter(), Counter()
        return out


def chain_of(text: str, a: int, at: int, b: int) -> tuple[list[Place], Place | None]:
    """The places inside the unit text[a:b], whose words begin at ``at``, and the place at its end."""
    # two characters more show what a mark at the end would be if a sentence followed
    found = places(text[at:b] + " A", 0, b - at + 2)
    tail = found.pop() if found and found[-1].start >= b - at else None
    for p in found:
        p.start += at
    if not found and tail is None and b - at >= LONG_SCRIPT and not _MARK.search(text, at, b):
        if text.count(" ", at, b) >= LONG_UNIT - 1:
            found = gaps(text, at, b)
        elif _SCRIPT.fullmatch(text, at, b):
            found = script_gaps(text, at, b)
    return found, tail


def segments(chain: list[Place]) -> Iterator[list[Place]]:
    """The chain cut wherever a place is not near the one before it: beyond a cut nothing bears on a posterior."""
    start = 0
    for k in range(1, len(chain)):
        if chain[k].words > NEAR_WORDS:
            yield chain[start:k]
            start = k
    yield chain[start:]


def _expected(rows: Iterable[tuple[str, float]], model: HiddenEventModel) -> Counter:
    """Expected counts by (kind, class, shape) of one round, of distinct segments and their counts. Classes the model
    has none of its own for are counted together."""
    counts = Counter()
    for segment, n in rows:
        found = [p.split(_WITHIN) for p in segment.split(_BETWEEN)]
        values = model.chain([model.class_odds(*p) for p in found], [k > 0 for k in range(len(found))])
        for (before, shape, after), value in zip(found, values):
            counts["on", before if before in model.event else _RARE, shape] += n * value
            after = after if after in model.start else _RARE
            counts["begin", after, ""] += n * value
            counts["inner", after, ""] += n * (1 - value)
    return counts


_PAIR_KINDS = ("pair", "closing", "opening")


class Evidence:
    """The counts the model is made of: words (start, inside, after), the rest of the words, classes (ends, seen, shape),
    shapes (ends, seen), units without places (all, short ones), and pairs of characters (seen, closing, opening)."""

    def __init__(self, words: dict, rest: tuple, classes: dict, shapes: dict, lengths: float, short: float, pairs: dict):
        self.words, self.rest, self.classes, self.shapes, self.lengths, self.short, self.pairs = words, rest, classes, shapes, lengths, short, pairs

    @classmethod
    def of(cls, counts: dict) -> Evidence:
        words, shapes = defaultdict(lambda: [0.0, 0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
        totals, by_shape, pairs = defaultdict(lambda: [0.0, 0.0]), defaultdict(Counter), defaultdict(lambda: [0.0, 0.0, 0.0])
        for (kind, word, shape), n in counts.items():
            if kind in _PAIR_KINDS:
                pairs[word][_PAIR_KINDS.index(kind)] += n
            elif kind in ("start", "inside", "after"):
                words[word][("start", "inside", "after").index(kind)] += n
            elif kind in ("end", "seen"):
                totals[word][kind == "seen"] += n
                shapes[shape][kind == "seen"] += n
                by_shape[word][shape] += n
        rare = [v for v in words.values() if sum(v) < LEAST_COUNT]
        kept = {w: tuple(v) for w, v in words.items() if sum(v) >= LEAST_COUNT}
        # a class met in several shapes has its most frequent one
        classes = {w: (*v, max(by_shape[w], key=lambda s: (by_shape[w][s], s))) for w, v in totals.items() if sum(v) >= LEAST_COUNT}
        return cls(kept, tuple(sum(v[k] for v in rare) for k in range(3)), classes, {s: tuple(v) for s, v in shapes.items()}, counts.get(("lengths", "", ""), 0), counts.get(("short", "", ""), 0), {w: tuple(v) for w, v in pairs.items() if sum(v) >= LEAST_COUNT})


def train(texts: list[str], rounds: int = ROUNDS) -> HiddenEventModel:
    held = _Counts()
    for text in texts:
        held.add(text)
    counts = held.taken()
    rows = [(key[1], n) for key, n in counts.items() if key[0] == "segment"]
    return _maximized(Evidence.of(counts), lambda model: _expected(rows, model), rounds)


def _by(counts: dict, kind: str, at: int = 1) -> Counter:
    out = Counter()
    for key, n in counts.items():
        if key[0] == kind:
            out[key[at]] += n
    return out


def _maximized(evidence: Evidence, expected: Callable[[HiddenEventModel], dict], rounds: int = ROUNDS) -> HiddenEventModel:
    """The model of counts, and of the expected counts that ``expected`` gives for a model."""
    classes, shapes = evidence.classes, evidence.shapes
    # The rate at which sure ends close a paragraph, by which the end rate of any class is judged at first.
    sure = [shapes[s] for s in ("<word>.", "<।>", "<。>") if s in shapes]
    usual = min(0.9, max(0.01, sum(e for e, _ in sure) / max(1, sum(e + n for e, n in sure))))

    def rate(end: float, inner: float) -> float:
        return _clip(min(1.0, end / max(1e-9, usual) / max(1.0, end + inner)))

    shape = {s: rate(*v) for s, v in shapes.items()}
    # A word's own rate is how often it closes paragraphs; if it is rare, the mean of a posterior over GRID with its
    # shape's rate as prior.
    event = {}
    for b, (ends, seen, own_shape) in classes.items():
        n = ends + seen
        if n >= COMMON_COUNT or own_shape == b:
            event[b] = rate(ends, seen)
            continue
        p = shape.get(own_shape, 0.5)
        prior = ((1 - p) * 0.8, (1 - p) * 0.1, 0.1 * (1 - p) + 0.02, 0.03, 0.1 * p, 0.85 * p)
        logs = [math.log(w) + ends * math.log(g * usual) + (n - ends) * math.log(1 - g * usual) for g, w in zip(GRID, prior)]
        weights = [math.exp(x - max(logs)) for x in logs]
        event[b] = _clip(sum(g * w for g, w in zip(GRID, weights)) / sum(weights))

    def distribution(first: int, more: Counter) -> dict:
        """Smoothed rates of the words counted at place ``first`` of the evidence, and of expected ones."""
        held = {w: v[first] + more.get(w, 0.0) for w, v in evidence.words.items()}
        others = evidence.rest[first] + sum(n for w, n in more.items() if w not in evidence.words)
        total, size = sum(held.values()) + others, len(held) + 1
        out = {w: (n + 0.05) / (total + 0.05 * size) for w, n in held.items()}
        # unseen words: what the words left out weigh, shared by as many
        out[None] = (others + 1.0) / (total + 0.05 * size)
        return out

    # The first expectation knows the classes before only: a word is no start because it follows a mark.
    flat = dict.fromkeys(evidence.words, 1.0) | {None: 1.0}
    model = HiddenEventModel(event, shape, flat, flat, 0.5)
    short = _clip(evidence.short / max(1, evidence.lengths))
    for _ in range(rounds):
        told = expected(model)
        on, on_shape, begin, inner = _by(told, "on"), _by(told, "on", 2), _by(told, "begin"), _by(told, "inner")
        # a rate leans on its first estimate, which is the paragraphs' evidence, as on as many observations as it has
        new_shape = {s: _clip((_clip((on_shape[s] + 0.5 * shape[s]) / (seen + 0.5)) + shape[s]) / 2) if seen else shape[s] for s, (_, seen) in shapes.items()}
        new_event = {b: _clip((on[b] / classes[b][1] + p) / 2) if classes[b][1] else p for b, p in event.items()}
        model = HiddenEventModel(new_event, new_shape, distribution(0, begin), distribution(1, inner), short)
    _add_gaps(model, evidence)
    return model


def _add_gaps(model: HiddenEventModel, evidence: Evidence) -> None:
    """The rate at which a word closes a sentence, from its ends with a full stop: the event after it where there are no marks."""
    closing: Counter = Counter()
    for before, (ends, seen, _) in evidence.classes.items():
        if before.endswith(".") and " " not in before:
            closing[before[:-1]] += ends + seen * model.event[before]
    # a class of the words inside, with case; ends are without
    inside: Counter = Counter()
    for word, (_, n, _) in evidence.words.items():
        inside[word.lower()] += n
    usual = (sum(closing.values()) + 1.0) / (sum(closing.values()) + sum(inside.values()) + 20.0)
    model.event_shape["<gap>"] = _clip(usual)
    for word, n in inside.items():
        model.event["<gap> " + word] = _clip((closing[word] + GAP_LEAN * usual) / (closing[word] + n + GAP_LEAN))
    pairs = evidence.pairs
    seen, closes, opens = (sum(v[k] for v in pairs.values()) + 1.0 for k in range(3))
    model.event_shape["<script gap>"] = usual = _clip(closes / seen)
    for pair, (n, closing_, opening) in pairs.items():
        model.event["<gap> " + pair] = _clip((closing_ + GAP_LEAN * usual) / (n + GAP_LEAN))
        model.start["<script> " + pair] = (opening + GAP_LEAN * n / seen) / (opens + GAP_LEAN)
        model.inside["<script> " + pair] = n / seen if n else 1 / seen


def sentence_starts(text: str, model: HiddenEventModel) -> list[int]:
    out = []
    for a, b in units(text):
        out.append(a)
        at, _ = _first(text, a, b)
        found, _ = chain_of(text, a, at, b)
        if found:
            out.extend(p.start for p, value in zip(found, model.posteriors(found)) if value >= 0.5)
    return out


class _Packed:
    """The units and places of some texts as arrays: what the finished model needs to find their sentences."""

    def __init__(self):
        self.classes: dict[tuple[str, str, str], int] = {}
        self.ids, self.unit_text, self.unit_start = [], [], []
        self.text, self.start, self.code, self.linked = [], [], [], []

    def add(self, id_: int, found: list[tuple[int, list[Place]]]) -> None:
        k, classes = len(self.ids), self.classes
        self.ids.append(id_)
        for start, chain in found:
            self.unit_text.append(k)
            self.unit_start.append(start)
            for j, p in enumerate(chain):
                self.text.append(k)
                self.start.append(p.start)
                self.code.append(classes.setdefault((p.before, p.shape, p.after), len(classes)))
                self.linked.append(j > 0 and p.words <= NEAR_WORDS)

    def dump(self) -> bytes:
        numbers = [np.array(x, np.int32).tobytes() for x in (self.unit_text, self.unit_start, self.text, self.start, self.code)]
        return pickle.dumps((list(self.classes), np.array(self.ids, np.int64).tobytes(), *numbers, np.array(self.linked, bool).tobytes()))


def _starts_of(packed: bytes, model: HiddenEventModel) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of the sentences of packed texts."""
    classes, ids, *numbers, linked = pickle.loads(packed)
    unit_text, unit_start, text, start, code = (np.frombuffer(x, np.int32) for x in numbers)
    linked = np.frombuffer(linked, bool)
    odds = np.array([model.class_odds(*c) for c in classes])[code] if len(code) else np.empty(0)
    value = odds / (1 + odds)
    near = np.flatnonzero(linked)
    if len(near):
        first = near[np.r_[True, np.diff(near) > 1]] - 1
        stop = near[np.r_[np.diff(near) > 1, True]] + 1
        for a, b in zip(first.tolist(), stop.tolist()):
            value[a:b] = model.chain(odds[a:b].tolist(), linked[a:b].tolist())
    kept = value >= 0.5
    owner, begins = np.concatenate([unit_text, text[kept]]), np.concatenate([unit_start, start[kept]])
    order = np.lexsort((begins, owner))
    return np.frombuffer(ids, np.int64)[owner[order]], begins[order]


_COUNTS = "kind string, word string, shape string, n double, places binary"


def _rows_of(counts: dict, places_: bytes | None = None) -> pa.RecordBatch:
    rows = [(*key, float(n), None) for key, n in counts.items()] + ([("places", "", "", 0.0, places_)] if places_ else [])
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "word", "shape", "n", "places"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counts()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a in range(0, len(texts), TEXTS_A_ROW):
            packed = _Packed()
            for id_, text in zip(ids[a : a + TEXTS_A_ROW], texts[a : a + TEXTS_A_ROW]):
                packed.add(id_, held.add(text))
            full = len(held.counts) + len(held.inside) + len(held.pairs) > _MOST_COUNTS
            yield _rows_of(held.taken() if full else {}, packed.dump())
    yield _rows_of(held.taken())


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            total.update(_expected(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), model.value))
        yield _rows_of(total)

    return run


def read(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table of what is counted, and of the places, of all texts."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return materialize(spread(rows).mapInArrow(_count, _COUNTS), "sentence-counts")


def fit(rows: DataFrame) -> HiddenEventModel:
    """A model of all texts in a table ``read`` has made."""
    spark = rows.sparkSession
    summed = materialize(rows.where("kind <> 'places'").groupBy("kind", "word", "shape").agg(F.sum("n").alias("n")), "sentence-sums")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0.0)).alias(kind)
    words = materialize(summed.where("kind in ('start', 'inside', 'after')").groupBy("word").agg(of("start"), of("inside"), of("after")), "sentence-words")
    enough = F.expr(f"start + inside + after >= {LEAST_COUNT}")
    kept = {r["word"]: (r["start"], r["inside"], r["after"]) for r in words.where(enough).collect()}
    rest = words.where(~enough).agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("start", "inside", "after")]).first()
    ends = summed.where("kind in ('end', 'seen')")
    shaped = ends.groupBy("word", "shape").agg(F.sum("n").alias("n"), of("end"), of("seen"))
    by_word = shaped.groupBy("word").agg(F.sum("end").alias("end"), F.sum("seen").alias("seen"), F.max_by("shape", F.struct("n", "shape")).alias("shape"))
    classes = {r["word"]: (r["end"], r["seen"], r["shape"]) for r in by_word.where(f"end + seen >= {LEAST_COUNT}").collect()}
    shapes = {r["shape"]: (r["end"], r["seen"]) for r in ends.groupBy("shape").agg(of("end"), of("seen")).collect()}
    single = {r["kind"]: r["n"] for r in summed.where("kind in ('lengths', 'short')").collect()}
    held = summed.where("kind = 'segment'").select("word", "n")
    by_pair = summed.where("kind in ('pair', 'closing', 'opening')").groupBy("word").agg(*[of(kind) for kind in _PAIR_KINDS])
    pairs = {r["word"]: (r["pair"], r["closing"], r["opening"]) for r in by_pair.where(f"pair + closing + opening >= {LEAST_COUNT}").collect()}

    def expected(model: HiddenEventModel) -> dict:
        told = held.mapInArrow(_expect(spark.sparkContext.broadcast(model)), _COUNTS)
        return {(r[0], r[1], r[2]): r[3] for r in told.groupBy("kind", "word", "shape").agg(F.sum("n")).collect()}

    return _maximized(Evidence(kept, tuple(rest), classes, shapes, single.get("lengths", 0.0), single.get("short", 0.0), pairs), expected)


def _find(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _starts_of(packed, model.value)], ["id", "start_char"])

    return run


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [sentence_starts(t, model.value) if t else [] for t in batch.column(1).to_pylist()]
            sizes = [len(x) for x in starts]
            ids = batch.column(0).take(pa.array([k for k, n in enumerate(sizes) for _ in range(n)], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([s for x in starts for s in x], pa.int32())], ["id", "start_char"])

    return run


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: HiddenEventModel | None = None) -> DataFrame:
    """(id, start_char) of each sentence: the offset, in code points, of its first character that is no white space.

    Null, empty and blank texts have no row; a repeated row gives its rows again; other columns are ignored; an empty
    table gives none.
    """
    schema, context = "id long, start_char int", documents.sparkSession.sparkContext
    if model is not None:
        rows = documents.select(F.col(id_col).cast("long"), text_col)
        return spread(rows).mapInArrow(_apply(context.broadcast(model)), schema)
    rows = read(documents, id_col, text_col)
    return rows.where("kind = 'places'").select("places").mapInArrow(_find(context.broadcast(fit(rows))), schema)
