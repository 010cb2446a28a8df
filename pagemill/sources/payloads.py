"""The payload a page is sent with, its answer, and writing pages out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_FIELDS = ["depth", "score", "source", "route_type", "main_content_chars", "preprocessing_report"]


def payload(pages: DataFrame) -> DataFrame:
    """(page_id, payload): JSON of each page as it is sent."""
    report = F.struct(*[F.col(f"crawler_report.{f}") for f in REPORT_FIELDS]).alias("crawler_report")
    body = F.struct("tenant_id", "agent_id", "url", "title", "markdown", "content_hash", report)
    return pages.select("page_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def _first_told(answer: Column, *keys: str) -> Column:
    values = [F.get_json_object(answer, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(~v.isin("", "0", "null"), v) for v in values])


def document_id(answer: Column) -> Column:
    return _first_told(answer, "document_id", "id")


def ingestion_job_id(answer: Column) -> Column:
    return _first_told(answer, "ingestion_job_id", "job_id")


def write_pages(pages: DataFrame, folder: str, mode: str = "append") -> None:
    """Pages as Parquet, a folder for each day they were sent, so that a day is read without the others.

    Rows are brought together by day and hash, so that a day becomes some large files and no task writes all of a day.
    """
    day = pages.withColumn("sent_day", F.to_date("sent_at"))
    day.repartition("sent_day", F.pmod(F.xxhash64("page_id"), F.lit(16))).write.mode(mode).partitionBy("sent_day").parquet(folder)
