"""Addresses in sitemaps, nested ones included, from a table of their bodies."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import fixed, urls
from pagemill.operators.dedup import last_by
from pagemill.shared import materialize


def _decode_batch(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else bytes(b)).decode("utf-8", "ignore"))


def decoded(body: Column) -> Column:
    """Text of a binary body, unpacked if it is gzip; bytes that are no UTF-8 are left out."""
    return F.pandas_udf(_decode_batch, "string")(body)


def locations(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit("(?i)" + fixed.SITEMAP_LOCATION), F.lit(1))


def first_sitemaps(start_urls: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """(root, url, place) of where sitemaps of each start url may be, with and without ``www.``: for each base the addresses its
    robots file names, ``robots``: (host, body), and then the well-known places. ``place`` is an array that orders them.
    """
    at = urls.split_parts(F.col("url"))
    bases = F.when(at[1].startswith("www."), F.array(at[1])).otherwise(F.array(at[1], F.concat(F.lit("www."), at[1])))
    rows = start_urls.select(urls.host_of(F.col("url")).alias("root"), at[0].alias("scheme"), F.posexplode(bases).alias("base", "host"))
    known = rows.select("root", "base", F.concat("scheme", F.lit("://"), "host").alias("origin"), F.posexplode(F.array(*[F.lit(p) for p in fixed.SITEMAP_PATHS])).alias("row", "path"))
    found = known.select("root", F.concat("origin", "path").alias("url"), F.array(F.col("base").cast("long"), F.lit(1).cast("long"), F.col("row").cast("long")).alias("place"))
    if robots is None:
        return found
    named = rows.join(robots, "host").select("root", "base", F.posexplode(named_sitemaps(F.col("body"))).alias("row", "url"))
    return named.select("root", "url", F.array(F.col("base").cast("long"), F.lit(0).cast("long"), F.col("row").cast("long")).alias("place")).unionByName(found)


def named_sitemaps(body: Column) -> Column:
    """The addresses in the ``Sitemap:`` lines of a robots file, in order; null bodies have none."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: F.startswith(F.lower(x), F.lit("sitemap:")))
    return F.filter(F.transform(lines, lambda x: urls.strip(F.regexp_replace(x, r"^[^:]*:", ""))), lambda x: x != "")


def sitemap_urls(seeds: DataFrame, bodies: DataFrame, most: int = fixed.MOST_SITEMAPS) -> DataFrame:
    """(root, url, parent) of the pages in the sitemaps of each root; ``seeds``: (root, url, place), ``bodies``: (url, body).

    Sitemaps are read level by level, at most ``most`` for a root. A sitemap's place is its parent's with its row behind it,
    so that places order all of a level however deep it is. Of an address found twice the last one's parent stays.
    Bodies that are missing or null have no address.
    """
    level, queue, read, found = 0, seeds.groupBy("root", "url").agg(F.min("place").alias("place")), None, None
    while True:
        ranked = queue if read is None else queue.join(read.select("root", "url"), ["root", "url"], "left_anti")
        used = None if read is None else read.groupBy("root").agg(F.count("*").alias("used"))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("place", "url")))
        ranked = ranked.withColumn("used", F.lit(0)) if used is None else ranked.join(used, "root", "left").na.fill(0, ["used"])
        now = materialize(ranked.where(F.col("rank") + F.col("used") <= most).select("root", "url", "place"), "sitemaps")
        if now.isEmpty():
            break
        read = now if read is None else materialize(read.union(now), "sitemaps-read")
        locs = now.join(bodies, "url").select("root", F.col("url").alias("parent"), "place", F.posexplode(locations(F.col("body"))).alias("row", "loc"))
        locs = locs.withColumn("url", urls.normalize_url(F.col("loc"))).where("url is not null and url <> ''")
        locs = locs.withColumn("place", F.concat("place", F.array(F.col("row").cast("long"))))
        order = F.struct(F.lit(level).alias("level"), "place")
        locs = materialize(locs.withColumn("order", order).withColumn("nested", F.col("url").rlike(r"\.(xml|gz)$")), "locations")
        pages = locs.where(~F.col("nested") & urls.same_site(F.col("url"), F.col("root"))).select("root", "url", "parent", "order")
        found = pages if found is None else found.union(pages)
        queue = locs.where("nested").groupBy("root", "url").agg(F.min("place").alias("place"))
        level += 1
    return seeds.sparkSession.createDataFrame([], "root string, url string, parent string") if found is None else last_by(found, ["root", "url"], ["order"]).drop("order")
