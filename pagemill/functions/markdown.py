"""Cleaning of markdown: Unicode form, images and links in one Arrow function, the line rules after it natively."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import fixed
from pagemill.functions import text as rules
from pagemill.shared import once

_SIGNS = re.compile(fixed.MARKDOWN_SIGNS)
_IMAGE = re.compile(fixed.IMAGE_PATTERN)
_LINK = re.compile(fixed.LINK_PATTERN)


def _told(alt: str) -> bool:
    plain = " ".join(_SIGNS.sub(" ", alt.strip().lower()).split())
    return len(plain) >= 4 and plain not in fixed.IMAGE_NOISE


def _unwrap_batch(text: pd.Series) -> pd.DataFrame:
    """NFKC, table rules dropped, images by their telling descriptions, links by their labels, with their numbers."""
    out = []
    for t in text:
        own = "\n".join(x for x in unicodedata.normalize("NFKC", t or "").splitlines() if not re.fullmatch(r"[|:\-\s]+", x.strip()))
        own, images = _IMAGE.subn(lambda m: m.group(1).strip() if _told(m.group(1)) else "", own)
        own, links = _LINK.subn(lambda m: " ".join(m.group(1).split()), own)
        out.append((own, images, links))
    return pd.DataFrame(out, columns=["text", "images", "links"])


def unwrapped(text: Column) -> Column:
    return F.pandas_udf(_unwrap_batch, "struct<text: string, images: int, links: int>")(text)


def with_cleaned(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with ``name``: struct(text, report) of a column of markdown; null counts as ''.

    Lines pass, in this order: empty headings, repeated headings, noise, repeated lines. The report has the numbers of
    characters before and after, images, links, noise lines (repeated headings among them) and repeated lines.
    """
    df = once(df, "__opened", unwrapped(F.coalesce(text_col, F.lit(""))))
    own = F.filter(F.transform(rules.lines(rules.spacing(F.col("__opened.text"))), lambda x: rules.spaced_heading(rules.strip(x))), lambda x: ~x.rlike(r"^#{1,6}\s*$"))
    df = once(df, "__own", own)
    df = once(df, "__headed", rules.lines(rules.without_repeated_headings(F.array_join("__own", "\n"))))
    df = once(df, "__quiet", rules.kept_lines(F.col("__headed")))
    df = once(df, "__once", rules.lines(rules.without_repeated_lines(F.array_join("__quiet", "\n"))))
    df = once(df, "__result", rules.spacing(F.array_join("__once", "\n")))
    # joining and splitting makes one empty line of no line
    noise = F.when(F.size("__own") == 0, 0).otherwise(F.size("__own") - F.size("__quiet"))
    repeated = F.when(F.size("__quiet") == 0, 0).otherwise(F.size("__quiet") - F.size("__once"))
    report = F.struct(
        F.lit(True).alias("enabled"), F.length(F.coalesce(text_col, F.lit(""))).alias("original_chars"), F.length("__result").alias("cleaned_chars"),
        F.col("__opened.images").alias("removed_images"), F.col("__opened.links").alias("replaced_links"), noise.alias("removed_noise_lines"), repeated.alias("removed_duplicate_lines"),
    )
    df = df.withColumn(name, F.struct(F.col("__result").alias("text"), report.alias("report")))
    return df.drop("__opened", "__own", "__headed", "__quiet", "__once", "__result")
