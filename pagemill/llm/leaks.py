"""Evaluation passages in documents (problem 9): q-gram counts in diagonal bands, then banded alignment.

The items are few and held by every task, in blocks of at most ``BLOCK_CHARS`` characters; any number of blocks is
worked through. Texts and passages are brought to NFC and lower case, and only their words are compared.

A part of a passage leaks if ``least_words`` consecutive words of it (a window) stand in a document with at most
``edit_share`` edits a character. By the q-gram lemma a window of ``length`` characters with ``edits`` edits keeps at least
``length + 1 - q * (edits + 1)`` of its q-grams within a band of diagonals; ``q`` is the longest for which every window
keeps one. Windows with as many in a band are aligned in it, and those within their edits are leaks. Of each document and
item it is told whether some window stands there exactly, word by word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shingles import WORD
from pagemill.shared import spread

#: Longest q-grams; shorter ones are taken as more edits are allowed.
Q = 26
BAND = 8
LEAST_WORDS = 13
#: Edits allowed for each character of a window.
EDIT_SHARE = 1 / 40
BLOCK_CHARS = 8_000_000
_TABLE_BITS = 22
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Texts searched together, and windows aligned together.
_TEXTS, _WINDOWS = 512, 4096


def plain_words(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []


class _Powers:
    """Powers of the base and of its inverse, modulo 2 ** 64, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(x), np.uint64)], dtype=np.uint64) for x in (_BASE, _BACK))
        return self.up, self.down


_POWERS = _Powers()


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position, by differences of one running sum; empty if there are fewer."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _POWERS.to(len(codes))
    total = np.cumsum(codes.astype(np.uint64) * up[: len(codes)], dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), total[: n - 1]])
    mixed = (total[q - 1 :] - before) * down[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(31))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def banded_distances(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edits that make each pattern (row, ``lengths`` of it) a stretch of its text, whose first character is k further
    on for some diagonal k of the band; ``texts`` is as many columns longer than ``patterns`` as the band has diagonals less one.
    """
    n, width = len(patterns), texts.shape[1] - patterns.shape[1] + 1
    ramp = np.arange(width, dtype=np.int32)
    row, out = np.zeros((n, width), np.int32), np.zeros(n, np.int32)
    far = np.full((n, 1), 1 << 20, np.int32)
    for i in range(patterns.shape[1]):
        match = row + (texts[:, i : i + width] != patterns[:, i : i + 1])
        skipped = np.concatenate([row[:, 1:], far], 1) + 1  # a character of the pattern that the text lacks
        best = np.minimum(match, skipped) - ramp
        row = np.minimum.accumulate(best, axis=1) + ramp  # and characters of the text that the pattern lacks
        ends = lengths == i + 1
        if ends.any():
            out[ends] = row[ends].min(1)
    return out


class ItemIndex:
    """q-grams and windows of a block of items: (ids, passages)."""

    def __init__(self, ids: list[int], passages: list[str | None], edit_share: float = EDIT_SHARE, least_words: int = LEAST_WORDS):
        self.ids, self.least_words = ids, least_words
        self.words = [plain_words(p) for p in passages]
        self.codes = [codes_of(" ".join(w)) for w in self.words]
        self.runs = [{" ".join(w[i : i + least_words]) for i in range(len(w) - least_words + 1)} for w in self.words]
        first, last, owner = [], [], []
        for k, w in enumerate(self.words):
            ends = np.cumsum([len(x) + 1 for x in w]) if w else np.empty(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if w else ends
            count = max(0, len(w) - least_words + 1)
            first.append(starts[:count])
            last.append(ends[least_words - 1 :][:count] - 1)
            owner.append(np.full(count, k))
        self.first, self.last, self.owner = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (first, last, owner))
        length = self.last - self.first
        self.edits = np.floor(length * edit_share).astype(np.int64)
        self.q = int(max(1, min(Q, (length // (self.edits + 1)).min(initial=Q))))
        self.least = np.maximum(1, length + 1 - self.q * (self.edits + 1))
        #: of each item, the fewest q-grams that any of its windows keeps, and where its windows are
        self.item_least = np.full(len(ids), 1 << 30)
        np.minimum.at(self.item_least, self.owner, self.least)
        self.window_at = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        grams = [gram_hashes(c, self.q) for c in self.codes]
        sizes = [len(g) for g in grams]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), sizes)[order]
        self.position = np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in sizes)])[order].astype(np.int64)
        self.grams, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the codes, item, place in the item) of every q-gram that both have."""
        none = (np.empty(0, np.int64),) * 3
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return none
        where = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        keep = self.grams[where] == hashes[at]
        at, where = at[keep], where[keep]
        counts = self.counts[where]
        posting = np.repeat(self.starts[where] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(at) else np.empty(0, np.int64)
        return np.repeat(at, counts), self.item[posting], self.position[posting]

    def leaks(self, texts: list[str]) -> dict[tuple[int, int], int]:
        """(text, item) -> least edits of a window of the item that stands in the text within its edits."""
        gap = "\x00" * self.q
        starts = np.cumsum([0, *(len(t) + self.q for t in texts)])
        codes = codes_of(gap.join([*texts, ""]))
        at, item, place = self.hits(codes)
        if not len(at):
            return {}
        text = np.searchsorted(starts, at, "right") - 1
        diagonal = at - starts[text] - place
        rows = []
        for shift in (0, BAND // 2):  # bands overlap by half, so any ``BAND // 2`` neighbouring diagonals share one
            band = (diagonal + shift) // BAND
            order = np.lexsort((place, band, item, text))
            t, i, b, p = text[order], item[order], band[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]))
            sizes = np.diff(np.concatenate([new, [len(t)]]))
            enough = sizes >= self.item_least[i[new]]
            for s, n in zip(new[enough].tolist(), sizes[enough].tolist()):
                own = np.unique(p[s : s + n])
                a, z = self.window_at[i[s]], self.window_at[i[s] + 1]
                kept = np.searchsorted(own, self.last[a:z] - self.q, "right") - np.searchsorted(own, self.first[a:z]) >= self.least[a:z]
                if kept.any():
                    windows = a + np.flatnonzero(kept)
                    rows.append((np.full(len(windows), t[s]), windows, np.full(len(windows), b[s] * BAND - shift)))
        found: dict[tuple[int, int], int] = {}
        if not rows:
            return found
        text, window, low = (np.concatenate(x) for x in zip(*rows))
        for k in range(0, len(text), _WINDOWS):
            self._align(codes, starts, text[k : k + _WINDOWS], window[k : k + _WINDOWS], low[k : k + _WINDOWS], found)
        return found

    def _align(self, codes, starts, text, window, low, found) -> None:
        edits, first = self.edits[window], self.first[window]
        length, most = self.last[window] - first, int(edits.max())
        longest, width = int(length.max()), BAND + 2 * most
        patterns = np.zeros((len(text), longest), np.uint32)
        for k, (w, a, n) in enumerate(zip(window.tolist(), first.tolist(), length.tolist())):
            patterns[k, :n] = self.codes[self.owner[w]][a : a + n]
        place = starts[text][:, None] + (first + low - most)[:, None] + np.arange(longest + width - 1)
        inside = (place >= starts[text][:, None]) & (place < starts[text + 1][:, None] - self.q)
        stretch = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], 0xFFFFFFFF)
        distance = banded_distances(patterns, length, stretch)
        for k in np.flatnonzero(distance <= edits):
            key = (int(text[k]), int(self.owner[window[k]]))
            found[key] = min(found.get(key, 1 << 30), int(distance[k]))

    def stands_exactly(self, words: list[str], item: int) -> bool:
        runs, n = self.runs[item], self.least_words
        return any(" ".join(words[i : i + n]) in runs for i in range(len(words) - n + 1))


_FOUND = "doc_id long, item_id long, edits int, exact boolean"


def _find(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*block.value)
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), [plain_words(t) for t in batch.column(1).to_pylist()]
            long = [k for k, w in enumerate(lists) if len(w) > index.least_words // 2]
            docs, items, edits, exact = [], [], [], []
            for k in range(0, len(long), _TEXTS):
                own = long[k : k + _TEXTS]
                for (t, item), n in index.leaks([" ".join(lists[i]) for i in own]).items():
                    docs.append(ids[own[t]])
                    items.append(index.ids[item])
                    edits.append(n)
                    exact.append(n == 0 and index.stands_exactly(lists[own[t]], item))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((docs, items, edits, exact), kinds)], ["doc_id", "item_id", "edits", "exact"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", edit_share: float = EDIT_SHARE, least_words: int = LEAST_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, exact): documents in which ``least_words`` consecutive words of a passage stand with at most
    ``edit_share`` edits a character.

    ``edits``: the fewest of any such window; ``exact``: whether one stands there word by word. Null or short texts and
    passages have no row, repeated rows give one row, other columns are ignored, and empty tables give no rows.
    """
    spark = documents.sparkSession
    source = spread(documents.select(doc_id, text))
    result, block, size = None, ([], []), 0

    def search(block):
        found = source.mapInArrow(_find(spark.sparkContext.broadcast((*block, edit_share, least_words))), _FOUND)
        return found if result is None else result.union(found)

    for row in items.select(item_id, passage).where(f"{passage} is not null").toLocalIterator():
        block[0].append(row[0])
        block[1].append(row[1])
        size += len(row[1])
        if size >= block_chars:
            result, block, size = search(block), ([], []), 0
    if block[0] or result is None:
        result = search(block)
    return result.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("exact").alias("exact"))
