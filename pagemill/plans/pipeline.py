"""A job's pages from HTML to decisions, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import fixed, routes, text, urls
from pagemill.functions.html import read_page
from pagemill.functions.markdown import with_cleaned
from pagemill.operators.dedup import duplicate_gate, first_by
from pagemill.shared import materialize, once, spread


def decide(pages: DataFrame, clean: bool = True, least_chars: int = fixed.LEAST_CHARS, least_detail_chars: int = fixed.LEAST_DETAIL_CHARS) -> DataFrame:
    """Decision on each page: (job_id, seq, url, route_type, title, h1, main_content_chars, markdown, markdown_chars, report, status, decision, reason).

    ``pages``: job_id, seq, url, html, and, null where there is none, http_status and revealed_text (what clicks showed).
    Of several rows of one normalised url in a job the first in ``seq`` counts. The HTML is read once; the table of
    what was read is written out, as the gates look at it several times.
    """
    rows = once(pages, "norm", urls.normalize_url(F.col("url"))).where("norm <> ''")
    rows = first_by(rows.select("job_id", "seq", "norm", "url", "html", "http_status", "revealed_text"), ["job_id", "norm"], ["seq"])
    rows = once(spread(rows), "page", read_page("html", "url")).drop("html")
    title = F.coalesce(F.nullif("page.best_heading", F.lit("")), F.nullif("page.h1", F.lit("")), "page.title")
    raw = F.concat("page.markdown", F.when(F.coalesce("revealed_text", F.lit("")) != "", F.concat(F.lit(fixed.REVEALED_HEADING), "revealed_text")).otherwise(""))
    rows = rows.select("job_id", "seq", "url", "norm", "http_status", routes.classify_route(F.col("norm")).alias("route_type"), title.alias("title"), F.col("page.h1").alias("h1"), F.col("page.canonical_url").alias("canonical_url"), F.col("page.main_content_chars").alias("main_content_chars"), raw.alias("raw"))
    if clean:
        rows = with_cleaned(rows, "raw", "done").select("*", F.col("done.text").alias("markdown"), F.col("done.report").alias("report")).drop("done", "raw")
    else:
        rows = rows.withColumnRenamed("raw", "markdown").withColumn("report", F.lit(None).cast("struct<enabled: boolean>"))
    quality = text.quality_reason(F.col("markdown"), F.col("title"), F.col("main_content_chars"), F.col("route_type"), least_chars, least_detail_chars)
    failed = F.col("http_status") >= 400
    rows = materialize(rows.withColumn("quality", F.when(F.coalesce(failed, F.lit(False)), F.concat(F.lit("http_"), "http_status")).otherwise(quality)), "pages-read")

    other = urls.normalize_url(F.col("canonical_url"))
    canonical = F.when((other != "") & (other != F.col("norm")) & ~routes.is_generic_parent(F.col("url"), F.col("canonical_url")), other)
    meta = F.concat(urls.strip(F.lower(F.coalesce("title", F.lit("")))), F.lit("|"), urls.strip(F.lower(F.coalesce("h1", F.lit("")))))
    good = rows.where("quality = 'ok'").select("job_id", "seq", F.col("norm").alias("url"), canonical.alias("canonical"), text.content_signature(F.col("markdown")).alias("sig"), meta.alias("meta"), routes.is_detail(F.col("route_type")).alias("is_detail"))
    gate = duplicate_gate(good).withColumnRenamed("reason", "gate")

    rows = rows.join(gate, ["job_id", "seq"], "left")
    error, poor, double = F.col("quality").startswith("http_"), F.col("quality") != "ok", F.col("gate") != "ok"
    decision = F.when(error, "PAGE_ERROR").when(poor, "SKIP_LOW_QUALITY").when(double, "SKIP_DUPLICATE").otherwise("SEND")
    status = F.when(error, F.concat(F.lit("failed_"), F.col("http_status"))).when(poor, F.concat(F.lit("skipped_"), "quality")).when(double, "skipped_duplicate").otherwise("completed")
    reason = F.when(poor, F.col("quality")).otherwise(F.coalesce("gate", F.lit("ok")))
    kept = ["job_id", "seq", "url", "route_type", "title", "h1", "main_content_chars", "markdown"]
    return rows.select(*kept, F.length("markdown").alias("markdown_chars"), "report", status.alias("status"), decision.alias("decision"), reason.alias("reason"))
