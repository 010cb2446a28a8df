"""Template residue, filler and error-page text (problem 1): positive-unlabelled naive Bayes by expectation-maximization.

Trusted records are the positives: titles of pages the crawler turned away for a bad title or phrase, and the short
list ``SEEDS``. All other passages are unlabelled. Naive Bayes is first trained with the unlabelled as negative; then
expectation (posterior of each unlabelled passage) and maximization (counts weighted by it, and the share of positives)
alternate, the positives staying what they are. So wordings that stand beside trusted ones are learned. The model is fitted
to bounded samples, taken by hash, and applied to every passage of every record: a sentence, a title, or a placeholder
with the words beside it, outside code. A record's decision joins its passages' by their greatest log odds, with further
suspicious passages of the record adding to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.code_spans import code_lines, without_spans
from pagemill.shared import spread

#: Bounds of the samples the model is fitted to: trusted titles, unlabelled titles, unlabelled texts.
TRUSTED = 6_000
TITLES = 6_000
TEXTS = 4_000
ROUNDS = 8
#: Share of passages that are positive, before any is looked at, and the passages this guess counts for afterwards.
PRIOR = 0.02
PRIOR_WEIGHT = 20_000
#: Occurrences, at the feature's rate over all passages, that each class is credited with.
SMOOTHING = 12.0
#: Weight of an unlabelled passage that is thought positive against a trusted one.
UNLABELLED_WEIGHT = 0.2
#: Most that one feature speaks for a passage, so that a stray word alone, beside others, is not enough.
MOST_WEIGHT = 5.0
#: Weight of a word the samples do not have.
UNKNOWN_WORD = -0.7
#: Occurrences of a feature in the samples from which it is kept.
LEAST_COUNT = 2

# Passages of trusted error and placeholder records, by kind, and the usual filler text.
SEEDS = """
Error 404: there is nothing at this address. Not found. The document that was asked for could not be located on this server. It may have been deleted, or its name was changed. This offer ended and was taken off the site. 410: the item is gone for good.
Error 403: forbidden. You are not allowed to open this. Sign in with rights to see it. Error 500: the server failed. An unexpected error occurred while the page was put together. Error 502: bad answer of another server. Error 503: the service is down for maintenance. Error 504: no answer in time. No connection to the database.
The service cannot be reached at present, try again in some minutes. Tell the webmaster if this goes on. Return to the homepage or use the search field.
Fehler 404: unter dieser Adresse gibt es nichts. Die gewünschte Seite wurde nicht gefunden. Der Zugriff auf dieses Dokument ist verboten. Der Server meldet einen internen Fehler. Der Dienst ist zurzeit nicht erreichbar, bitte versuchen Sie es später noch einmal. Zur Startseite zurückkehren.
Erreur 404 : il n'y a rien à cette adresse. La page demandée est introuvable. Accès interdit à ce document. Erreur interne du serveur web. Le service est indisponible pour le moment, veuillez réessayer plus tard. Revenir à la page d'accueil.
Error 404: no hay nada en esta dirección. La página solicitada no se ha encontrado. Acceso prohibido a este documento. Error interno del servidor web. El servicio no está disponible por ahora, vuelva a intentarlo más tarde. Volver a la página de inicio.
Fatal error: uncaught exception thrown in main.php on line 7. Traceback (most recent call last): File "main.py", line 7, in start. TypeError: argument is missing. ValueError: bad value. KeyError: no such key. Warning: undefined variable on line 7. Stack trace: at main.java line 7.
JavaScript is turned off in your browser. This site needs JavaScript to work: enable it, then reload. Your browser has scripts disabled; allow scripting to see the content. This app will not run without JavaScript. Turn on cookies and JavaScript to continue.
We are checking that your browser is safe, wait a few seconds. Prove that you are human to continue. Security check of your connection. Too many requests from your network, slow down. Please wait a moment. Your request is being verified before access is given.
JavaScript ist im Browser ausgeschaltet. Bitte aktivieren Sie JavaScript in den Einstellungen und laden Sie die Seite neu. Wir prüfen Ihren Browser, bitte einen Moment warten. Zu viele Anfragen aus Ihrem Netz.
JavaScript est désactivé dans votre navigateur. Veuillez activer JavaScript dans les réglages puis recharger la page. Nous vérifions votre navigateur, veuillez patienter un instant. Trop de requêtes depuis votre réseau.
JavaScript está desactivado en su navegador. Active JavaScript en los ajustes y recargue la página. Estamos comprobando su navegador, espere un momento. Demasiadas solicitudes desde su red.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sample text, to be replaced. Placeholder text: write your own here. Dummy content for testing. foo bar baz. test test test. asdf qwerty. xxx. The content of this page is coming soon. This site is under construction, check back soon. Put the headline here. Insert your text here. Replace this with your own words. Untitled. Untitled document. No title.
Platzhalter: hier kommt Ihr eigener Text hin. Inhalt folgt bald. Diese Seite ist noch im Aufbau. Texte d'exemple à remplacer : écrivez ici votre propre texte. Contenu bientôt disponible. Ce site est en construction. Texto de ejemplo para sustituir: escriba aquí su propio texto. Contenido disponible pronto. Este sitio está en construcción.
{{ page.name }} ${name} <%= name %> %PAGE_NAME% @@NAME@@ __NAME__ [INSERT HEADLINE] {name} #{name} null undefined NaN
""".strip()  # fmt: skip

_WORD = re.compile(r"[^\W\d_]+|\d+|<[a-z]+>")
_DIGIT = re.compile(r"\d")
_CODES = frozenset("404 403 410 500 502 503".split())
_LETTERS = re.compile(r"[^\W\d_]+")
#: After an end mark and before no small letter, or at a dash or bar by itself; every place begins with white space, which is quick to find.
_SENTENCE = re.compile(r"\s(?:(?<=[.!?:]\s)\s*(?=[^\sa-z])|\s*[-|]\s+)")
#: Paths, urls and ids say nothing of what a passage is.
_OPAQUE = re.compile(r"\S*/\S+|\b(?=\w*\d)(?=\w*[a-z])\w{5,}\b")
_MIXED = re.compile(r"[^\W\d]\d|\d[^\W\d]")
#: Placeholders by their signs. Braces of formulas and commands, templates with parameters, links and bare marks do not match.
_HOLDERS = [
    ("mustache", re.compile(r"\{\{\{?\s*[#/^&>]?\s*[\w.\- ]+?\s*\}?\}\}")),
    ("dollar", re.compile(r"\$\{[^{}\n]{1,60}\}")),
    ("erb", re.compile(r"<%[^%\n]{1,80}%>")),
    ("hash", re.compile(r"#\{[^{}\n]{1,60}\}")),
    ("percent", re.compile(r"%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%|%%?[A-Z]{3,}%%?")),
    ("at", re.compile(r"@@[A-Z][A-Z0-9_]*@@")),
    ("under", re.compile(r"(?<![^\W_])__[A-Z][A-Z0-9_]*__(?![^\W_])")),
    ("slot", re.compile(r"(?<!\[)\[(?:(?:INSERT|Insert|insert)\b[^\[\]\n]{0,60}|[^\[\]\n]{0,60}\b(?:goes|name|text|title) here)\](?!\()")),
    ("brace", re.compile(r"(?<![\\\w}\]^_{$#])\{[A-Za-z][\w.]*\}(?![}{\]])")),
]
_HOLDER_KINDS = frozenset("<" + kind + ">" for kind, _ in _HOLDERS)
_SLOTS = [(kind, pattern) for kind, pattern in _HOLDERS if kind == "slot"]
_BRACKET = re.compile(r"(?<!\[)\[([^\[\]|\n]{3,60})\](?![\](\[:])")


def _lines(text: str | None, title: bool) -> list[str]:
    """The lines outside fenced code; a title is one."""
    if not text:
        return []
    if title:
        return [text]
    lines = text.split("\n")
    return lines if "```" not in text and "~~~" not in text else [line for line, code in zip(lines, code_lines(lines)) if not code]


def _line_parts(line: str, title: bool) -> Iterator[list[str]]:
    """The words of each passage in order, in lower case (numbers by length); a placeholder found by its signs is one of its own."""
    line = without_spans(line)
    # what every placeholder but a slot in brackets has
    hint = "{" in line or "<%" in line or "@@" in line or "__" in line or "%" in line
    if hint or "[" in line:
        patterns = _HOLDERS if hint else _SLOTS
        for kind, pattern in patterns:
            for _ in pattern.finditer(line):
                yield ["<" + kind + ">", "<holder>"]
        for m in _BRACKET.finditer(line):
            yield _words("<bracket> " + m.group(1))
        for _, pattern in patterns:
            line = pattern.sub(" <holder> ", line)
    digits = _DIGIT.search(line)
    if "/" in line or digits and _MIXED.search(line):
        line = _OPAQUE.sub(" ", line)
    if not digits:
        pattern = _WORD if "<" in line else _LETTERS
        for sentence in _SENTENCE.split(line):
            own = pattern.findall(sentence.lower())
            if own:
                yield own
        return
    for sentence in _SENTENCE.split(line):
        own = _words(sentence)
        # numbers alone say nothing in a text
        if own and (title or any(not w[0].isdigit() for w in own)):
            yield own


def passages(text: str | None, title: bool = False) -> list[list[str]]:
    """Features of each passage: its words, and its pairs of words."""
    return [_features(own) for line in _lines(text, title) for own in _line_parts(line, title) if own]


def _words(sentence: str) -> list[str]:
    words = _WORD.findall(sentence.lower())
    if _DIGIT.search(sentence):
        return [("0" * min(len(w), 4) if w[0].isdigit() and w not in _CODES else w) for w in words]
    return words


def _features(words: list[str]) -> list[str]:
    if words[-1] == "<holder>" and len(words) == 2 and words[0] in _HOLDER_KINDS:
        return words
    return [*dict.fromkeys(words), *{f"{a} {b}" for a, b in zip(words, words[1:])}]


class _Weights(dict):
    def __missing__(self, word: str) -> float:
        return UNKNOWN_WORD


class Model:
    """Log odds of a passage: ``bias`` plus the weights of its features. Unknown words speak a little against it."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias, self.seen = bias, {}
        self.words = _Weights((f, w) for f, w in weights.items() if " " not in f)
        self.pairs = {tuple(f.split(" ")): w for f, w in weights.items() if " " in f}

    def odds(self, words: list[str]) -> float:
        """Of the words of a passage, in order."""
        total = self.bias + sum(map(self.words.__getitem__, set(words)))
        if len(words) == 2 and words[0] in _HOLDER_KINDS and words[1] == "<holder>":
            return total
        return total + sum(filter(None, map(self.pairs.get, set(zip(words, words[1:])))))

    def record(self, text: str | None, title: bool = False) -> float:
        """Log odds of a record's text: its strongest passage, and a tenth of each further one that speaks for it."""
        odds = []
        for line in _lines(text, title):
            # short lines are shared by the pages of a site
            if len(line) >= 80:
                odds.extend(self.odds(words) for words in _line_parts(line, title) if words)
                continue
            known = self.seen.get((line, title))
            if known is None:
                if len(self.seen) >= 100_000:
                    self.seen.clear()
                known = self.seen[line, title] = [self.odds(words) for words in _line_parts(line, title) if words]
            odds.extend(known)
        odds.sort(reverse=True)
        if not odds:
            return -math.inf
        return odds[0] + 0.1 * sum(min(5.0, o) for o in odds[1:] if o > 0)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def train(positive: list[list[str]], unlabelled: list[list[str]], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    rows = positive + unlabelled
    counts: dict[str, int] = {}
    for r in rows:
        for f in r:
            counts[f] = counts.get(f, 0) + 1
    names = [f for f, n in counts.items() if n >= LEAST_COUNT]
    number = {f: k for k, f in enumerate(names)}
    pairs = [(i, number[f]) for i, r in enumerate(rows) for f in r if f in number]
    row, column = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    known = np.arange(len(rows)) < len(positive)
    trust = np.where(known, 1.0, UNLABELLED_WEIGHT)
    posterior = known.astype(float)
    weights, bias = np.zeros(len(names)), _logit(prior)
    rate = np.bincount(column, minlength=len(names)) / max(1, len(rows))
    halved = np.array([0.5 if " " in f else 1.0 for f in names])  # a pair of words repeats what the words say
    for turn in range(rounds):
        # Rates of each feature in the two classes; what a passage lacks is left out, as most features are absent.
        on = np.bincount(column, (trust * posterior)[row], len(names))
        off = np.bincount(column, 1 - posterior[row], len(names))
        n_on, n_off = (trust * posterior).sum(), (1 - posterior).sum()
        weights = np.log((on + SMOOTHING * rate) / (n_on + SMOOTHING)) - np.log((off + SMOOTHING * rate) / (n_off + SMOOTHING))
        weights = np.minimum(weights * halved, MOST_WEIGHT)
        if turn:
            bias = _logit((posterior[~known].sum() + PRIOR * PRIOR_WEIGHT) / ((~known).sum() + PRIOR_WEIGHT))
        odds = bias + np.bincount(row, weights[column], len(rows))
        posterior = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
    return Model(dict(zip(names, weights.tolist())), bias)


def _sample(df: DataFrame, id_col: str, column: Column, most: int) -> list:
    """At most ``most`` values of a text column, by the hash of ids and values, so that a frequent value is taken in proportion."""
    share = max(1, df.count() // most)
    rows = df.select(F.xxhash64(id_col, column).alias("h"), column.alias("x")).where(F.pmod(F.col("h"), F.lit(share)) == 0).where("x is not null")
    return [r[0] for r in rows.orderBy("h", "x").limit(most).select("x").collect()]


def fit(titles: DataFrame, trusted: Column, texts: DataFrame, id_col: str = "page_id", title_col: str = "title", text_col: str = "markdown") -> Model:
    positive = [f for line in SEEDS.split("\n") for f in passages(line, True)] * 3
    for t in _sample(titles.where(trusted), id_col, F.col(title_col), TRUSTED):
        positive.extend(passages(t, True))
    unlabelled = []
    for t in _sample(titles.where(~F.coalesce(trusted, F.lit(False))), id_col, F.col(title_col), TITLES):
        unlabelled.extend(passages(t, True))
    for t in _sample(texts, id_col, F.col(text_col), TEXTS):
        unlabelled.extend(passages(t))
    return train(positive, unlabelled)


def _judge(model, title: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            odds = [m.record(t, title) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds, pa.float64())], ["id", "odds"])

    return run


def scores(records: DataFrame, id_col: str, text_col: str, model: Model, title: bool = False) -> DataFrame:
    """(id, odds): log odds that a record's text is, or holds, template residue, filler or an error text.

    Null, empty and code-only texts have odds of minus infinity; a repeated row gives its row again; other columns are
    ignored; an empty table gives no rows.
    """
    held = records.sparkSession.sparkContext.broadcast(model)
    rows = spread(records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_judge(held, title), "id long, odds double")


def page_model(info: DataFrame, sent: DataFrame) -> Model:
    return fit(info, F.col("reason").isin("bad_title", "bad_phrase"), sent)


def flagged_pages(info: DataFrame, sent: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id) of the pages whose title or text is judged so, once each."""
    model = model or page_model(info, sent)
    titles = scores(info, "page_id", "title", model, title=True)
    texts = scores(sent, "page_id", "markdown", model)
    return titles.union(texts).where("odds > 0").select(F.col("id").alias("page_id")).distinct()
