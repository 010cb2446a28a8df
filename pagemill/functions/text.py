"""Signatures, hashes and line rules of markdown, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import fixed
from pagemill.functions.urls import strip


def content_signature(text: Column) -> Column:
    """Hash of the basic Latin letters of a text without its urls; '' for null and ''."""
    letters = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)https?://\S+", ""), "[^a-zA-Z]", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.sha2(letters, 256))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def compared(text: Column) -> Column:
    """Lower case without markdown's signs, one space between words."""
    plain = F.regexp_replace(strip(F.lower(text)), fixed.MARKDOWN_SIGNS, " ")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def spacing(text: Column) -> Column:
    """Line feeds only, single spaces, no spaces at line ends, at most one blank line."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    single = F.regexp_replace(F.regexp_replace(unix, r"[\t\x0b\x0c]+", " "), "[  ]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(single, r"\n{3,}", "\n\n"), r" +\n", "\n"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_table_rule(line: Column) -> Column:
    return strip(line).rlike(r"(?U)^[|:\-\s]+$")


def spaced_heading(line: Column) -> Column:
    return F.regexp_replace(line, r"^(#{1,6})([^#\s])", "$1 $2")


def heading_text(line: Column) -> Column:
    """The compared text of a heading line, '' for other lines."""
    return F.when(line.rlike(r"^#{1,6}\s+\S"), compared(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1))).otherwise(F.lit(""))


def is_noise_line(line: Column, own: Column | None = None) -> Column:
    """Whether a line says nothing: interface phrases, bare urls, signs only, asset paths, names of social networks.

    ``own`` is the compared line, where it is known already.
    """
    own, low = compared(line) if own is None else own, F.lower(line)
    letters = F.length(F.regexp_replace(own, r"[^\p{L}]", ""))
    return (
        (own == "")
        | own.isin(fixed.UI_PHRASES)
        | line.rlike(r"(?U)^https?://\S+$")
        | line.rlike(r"(?U)^[\W_]+$")
        | (low.rlike(rf"(?U)\b({fixed.ASSET_LINE_FOLDERS})/") & low.rlike(rf"(?U)\.({fixed.ASSET_LINE_ENDINGS})\b"))
        | own.isin(fixed.SOCIAL_NAMES)
        | ((F.length(own) <= 2) & (letters <= 1))
    )


def is_kept_line(line: Column, own: Column | None = None) -> Column:
    """Headings with some text stay even if they look like noise."""
    own = compared(line) if own is None else own
    return ~is_noise_line(line, own) | (F.startswith(line, F.lit("#")) & (F.length(own) >= 2))


def kept_lines(own: Column) -> Column:
    """Those of an array of lines that say something; each line is compared once."""
    both = F.transform(own, lambda x: F.struct(x.alias("line"), compared(x).alias("own")))
    return F.transform(F.filter(both, lambda x: is_kept_line(x["line"], x["own"])), lambda x: x["line"])


def without_noise_lines(text: Column) -> Column:
    own = F.transform(lines(text), lambda x: spaced_heading(strip(x)))
    return F.array_join(kept_lines(F.filter(own, lambda x: ~x.rlike(r"^#{1,6}\s*$"))), "\n")


def without_repeated_lines(text: Column) -> Column:
    """First occurrence of each line by its compared text; lines of fewer than four compared characters all stay."""
    own = lines(text)
    ranked = F.array_sort(F.transform(own, lambda x, i: F.struct(compared(x).alias("own"), i.alias("place"))))
    # a lambda's variable holds both arrays, so that they are made once; after the sort equal lines stand side by side

    def firsts(held):
        new = F.filter(held["ranked"], lambda x, i: (F.length(x["own"]) < 4) | (i == 0) | (F.get(held["ranked"], i - 1)["own"] != x["own"]))
        return F.transform(F.array_sort(F.transform(new, lambda x: x["place"])), lambda place: F.get(held["lines"], place))

    return F.array_join(F.get(F.transform(F.array(F.struct(own.alias("lines"), ranked.alias("ranked"))), firsts), F.lit(0)), "\n")


def without_repeated_headings(text: Column) -> Column:
    """Headings equal to the heading before them go; lines between do not matter."""
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("kept"))

    def step(state, line):
        own = heading_text(line)
        repeated = (own != "") & (own == state["last"])
        is_heading = line.rlike(r"^#{1,6}\s+\S")
        return F.struct(F.when(is_heading, own).otherwise(state["last"]).alias("last"), F.when(repeated, state["kept"]).otherwise(F.concat(state["kept"], F.array(line))).alias("kept"))

    return F.array_join(F.aggregate(lines(text), start, step, lambda s: s["kept"]), "\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def has_job_content(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in fixed.JOB_WORDS), F.lit(0)) >= fixed.LEAST_JOB_WORDS


def quality_reason(text: Column, title: Column, content_chars: Column, route: Column, least_chars: int = fixed.LEAST_CHARS, least_detail_chars: int = fixed.LEAST_DETAIL_CHARS) -> Column:
    """Why a page is poor, the first rule that holds; 'ok' if none does. Null texts, titles and counts count as empty."""
    body, own_title = strip(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    head, chars = F.substring(F.lower(body), 1, fixed.BAD_PHRASE_CHARS), F.coalesce(content_chars, F.lit(0))
    detail = F.coalesce(F.endswith(route, F.lit("_detail")), F.lit(False))
    least = F.when((route == "job_detail") & has_job_content(body), min(least_detail_chars, fixed.JOB_DETAIL_CHARS)).otherwise(least_detail_chars)

    def judged(found: Column) -> Column:
        return (
            F.when(own_title.rlike("|".join(fixed.BAD_TITLES)), "bad_title")
            .when(head.rlike("|".join(fixed.BAD_PHRASES)), "bad_phrase")
            .when(detail & (chars < least), F.concat(F.lit("detail_body_too_short:"), chars.cast("string")))
            .when(~detail & (F.length(body) < least_chars), "too_short")
            .when(F.size(found) < fixed.LEAST_PAGE_WORDS, "too_few_words")
            .when((F.size(found) > fixed.MANY_WORDS) & (F.size(F.array_distinct(found)) / F.size(found) < fixed.LEAST_DISTINCT_SHARE), "low_unique_word_ratio")
            .otherwise("ok")
        )

    # a lambda's variable holds the words, so that they are looked for once
    return F.get(F.transform(F.array(words(body)), judged), F.lit(0))
