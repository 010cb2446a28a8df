"""The engine's functions under names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagemill.functions import html


class ExplodeLinks:
    """Rows (url, source, text) of the links of a page; SQL: SELECT * FROM explode_links(html, url)."""

    def eval(self, page: str, url: str):
        if page:
            yield from html.links(html.parse(page), url or "")


def register(spark: SparkSession) -> None:
    """Adds read_page(html, url), explode_links(html, url), headings(html) and spa_routes(state, url) to the session's SQL."""
    from pyspark.sql import functions as F

    spark.udf.register("read_page", F.pandas_udf(html._read_batch, html.SCHEMA))
    spark.udf.register("headings", F.pandas_udf(html._heading_batch, html.HEADINGS))
    spark.udf.register("spa_routes", F.pandas_udf(html._route_batch, "array<string>"))
    spark.udtf.register("explode_links", udtf(ExplodeLinks, returnType="url: string, source: string, text: string"))
