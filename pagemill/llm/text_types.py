"""Statistics of texts and their types (problem 3), by labelling functions whose accuracies are learned.

Each statistic of a page's body, title apart, is turned into a vote (high, middling, low) by two thresholds. The votes
are noisy: how often each is given by prose, lists, tables and junk is learned by expectation-maximization on how the
votes agree (no labels; a rule of thumb gives the first guess). All texts are counted: the votes of all pages are
grouped into patterns, of which there are at most 3**len(VOTES), before the model sees them. The posterior of each
pattern is the posterior of the pages that have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.code_spans import code_lines
from pagemill.llm.main_content import LineModel, body_range, fit_lines
from pagemill.llm.shingles import WORD, words
from pagemill.shared import materialize, spread

TYPES = ("prose", "list", "table", "junk")
ROUNDS = 30
LEAST_WORDS = 40

# Common words of the languages of the pages.
COMMON = frozenset(
    (
        "the of and to a in is that it for on with as are was were be by at this have has from or an they we you not but which when what all each had will can more than there their our "
        "der die das und in zu den ist nicht von mit für auf im dem des ein eine sich auch wir sind werden als wenn seit nach mehr am alle nur sie aus bei "
        "le la les de des et en un une du que qui dans pour pas sur est nous au aux plus avec il depuis quand mais aussi ne sont ont nos vers sans "
        "el los las y que en un una del se por con para no al son más como desde cuando pero sino también sus hay nuestras nuestros sabemos durante sin casi"
    ).split()
)
_MARKER = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)])\s|^\s*<li[ >]")
_MARK = re.compile(r"</?(?!li\b)[a-zA-Z][^<>]*>")
_CELL = re.compile(r"<t[dh][ >]")
_END = re.compile(r"[.!?…:;][\"'”»“)*_\]]*\s*(?:</[a-z]+>)?\s*$")
_DELIMITERS = (re.compile(r"\|"), re.compile(r";"), re.compile(r"\t"), re.compile(r","), re.compile(r"\S {2,}(?=\S)"), re.compile(r"<t[dh]"))
_VOWEL = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûåæøœ]")

#: Statistics that vote: below the first cut low, from the second on high.
VOTES = {
    "common_share": (0.13, 0.22),
    "ending_share": (0.15, 0.60),
    "symbol_ratio": (0.06, 0.14),
    "marker_share": (0.30, 0.80),
    "column_share": (0.30, 0.80),
    "mean_word_chars": (3.4, 8.5),
    "digit_ratio": (0.05, 0.12),
    "line_words": (7.0, 14.0),
    "distinct_share": (0.25, 0.92),
    "pronounceable_share": (0.70, 0.90),
}
STATISTICS = ["words", "lines", *VOTES]


def statistics(lines: list[str]) -> list[float]:
    """The statistics of a body's lines, blank ones and its main heading apart, in the order of STATISTICS."""
    if lines and re.match(r"^\s*#\s?[^#]", next((line for line in lines if line.strip()), "")):
        lines = lines[next(k for k, line in enumerate(lines) if line.strip()) + 1 :]
    code = code_lines(lines)
    # code is neither prose nor not, unless there is nothing else
    own = [line for line, c in zip(lines, code) if line.strip() and not c] or [line for line in lines if line.strip()]
    own = [line for line in (_MARK.sub(" ", x) if "<" in x and not _CELL.search(x) else x for x in own) if line.strip()]
    text = "\n".join(own)
    found = words(text)
    n = len(found)
    if not n:
        return [0.0, float(len(own)), *([0.0] * len(VOTES))]
    chars = sum(not c.isspace() for c in text) or 1
    per_line = [len(WORD.findall(line)) for line in own]
    ending = sum(k for k, line in zip(per_line, own) if k >= 4 and _END.search(line) and not _MARKER.match(line))
    marked = sum(k for k, line in zip(per_line, own) if _MARKER.match(line))
    columns = 0
    for pattern in _DELIMITERS:
        counts = [len(pattern.findall(line)) for line in own]
        most = max(set(counts), key=lambda c: (c >= 1) * counts.count(c))
        if most >= (2 if pattern.pattern == "," else 1) and len(own) >= 2:
            columns = max(columns, sum(k for k, c in zip(per_line, counts) if c == most))
    letters = "".join(found)
    digits = sum(c.isdigit() for c in letters)
    spoken = sum(1 for w in found if w.isalpha() and _VOWEL.search(w) and len(w) <= 14 or w in COMMON)
    return [
        float(n),
        float(len(own)),
        sum(w in COMMON for w in found) / n,
        ending / n,
        (chars - len(letters)) / chars,
        marked / n,
        columns / n,
        len(letters) / n,
        digits / chars,
        n / len(own),
        len(set(found)) / n,
        spoken / n,
    ]


def votes(row: list[float]) -> str:
    """One sign for each voting statistic: l, m or h."""
    return "".join("l" if v < low else "h" if v >= high else "m" for v, (low, high) in zip(row[2:], VOTES.values()))


def first_guess(pattern: str) -> int:
    v = dict(zip(VOTES, pattern))
    if v["common_share"] == "h" or v["common_share"] == "m" and v["ending_share"] != "l":
        return 0
    if v["column_share"] == "h" and v["pronounceable_share"] != "l":
        return 2
    return 1 if v["marker_share"] == "h" or v["pronounceable_share"] == "h" and v["symbol_ratio"] != "h" else 3


def learn(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Posterior of each type for each pattern of votes, by expectation-maximization over the counted patterns."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    signs = np.array([["lmh".index(c) for c in p] for p in patterns])
    posterior = np.full((len(patterns), len(TYPES)), 0.02)
    posterior[np.arange(len(patterns)), [first_guess(p) for p in patterns]] = 1.0
    posterior /= posterior.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = posterior * n[:, None]
        prior = (weight.sum(0) + 1) / (n.sum() + len(TYPES))
        total = np.log(prior)[None, :].repeat(len(patterns), 0)
        for j in range(signs.shape[1]):
            rate = np.stack([weight[signs[:, j] == s].sum(0) for s in range(3)]) + 0.5
            total += np.log(rate / rate.sum(0))[signs[:, j]]
        total -= total.max(1, keepdims=True)
        posterior = np.exp(total) / np.exp(total).sum(1, keepdims=True)
    return dict(zip(patterns, posterior))


def _measure(least_words: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for page, text, chars in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text or len(WORD.findall(text)) < least_words:
                    continue
                lines = text.split("\n")
                first, stop = body_range(lines, chars, held.value)
                row = statistics(lines[first:stop])
                ids.append(page)
                rows.append(row)
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, pa.array([votes(r) for r in rows], pa.string())], ["id", *STATISTICS, "votes"])

    return run


_SCHEMA = "id long, " + ", ".join(f"{s} double" for s in STATISTICS) + ", votes string"


def measured(pages: DataFrame, id_col: str, text_col: str, chars_col: str, least_words: int = 1, model: LineModel | None = None) -> DataFrame:
    """(id, statistics..., votes) of each page with at least ``least_words`` words, its chrome and title left out.

    Null and empty texts have no row; a null count of the body's characters is no constraint; a repeated row gives its
    row again; other columns are ignored; an empty table gives no rows.
    """
    rows = spread(pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(chars_col).cast("int").alias("chars")))
    held = pages.sparkSession.sparkContext.broadcast(model or fit_lines(pages, id_col, text_col, chars_col))
    return rows.mapInArrow(_measure(least_words, held), _SCHEMA)


def typed(pages: DataFrame, id_col: str, text_col: str, chars_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, statistics..., text_type, prose_posterior) of each page as in ``measured``."""
    rows = materialize(measured(pages, id_col, text_col, chars_col, least_words), "statistics")
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    answers = [(p, TYPES[int(np.argmax(q))], float(q[0])) for p, q in learn(counts).items()]
    schema = T.StructType([T.StructField("votes", T.StringType()), T.StructField("text_type", T.StringType()), T.StructField("prose_posterior", T.DoubleType())])
    # at most 3 ** len(VOTES) rows, whatever the number of pages
    return rows.join(F.broadcast(pages.sparkSession.createDataFrame(answers, schema)), "votes").drop("votes")
