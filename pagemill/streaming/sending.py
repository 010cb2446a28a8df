"""Sending pages to a receiver, page by page with the retry rule, from tables and from streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions import fixed
from pagemill.sources.payloads import payload

SCHEMA = "page_id long, ok boolean, status int, answer string, attempts int"


def sent(body: str, post: Callable[[str], tuple[int, str]], wait: Callable[[float], None]) -> tuple[bool, int, str, int]:
    """(ok, status, answer, attempts) of one payload: a call that fails, or an answer that says so, is tried again after one
    second, then twice as long each time; a call that never got an answer has status 0."""
    for attempt in range(1, fixed.MOST_ATTEMPTS + 1):
        try:
            status, answer = post(body)
        except Exception as error:  # whatever the transport raises is no answer
            status, answer = 0, str(error)
        if status not in fixed.RETRIED_STATUSES or attempt == fixed.MOST_ATTEMPTS:
            return 200 <= status < 300, status, answer[: fixed.ERROR_CHARS], attempt
        wait(2.0 ** (attempt - 1))
    raise AssertionError


def send_pages(pages: DataFrame, post: Callable[[str], tuple[int, str]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """What became of each page: (page_id, ok, status, answer, attempts). ``post`` takes a payload and gives (status, answer); it is
    called in the tasks. The result must be written once: reading it twice would send twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(page, *sent(body, post, wait)) for page, body in zip(rows["page_id"], rows["payload"])]
            yield pd.DataFrame(out, columns=["page_id", "ok", "status", "answer", "attempts"])

    return payload(pages).mapInPandas(run, SCHEMA)


def send_stream(pages: DataFrame, post: Callable[[str], tuple[int, str]], folder: str, checkpoint: str, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Send a stream of pages as it comes; the outcomes of each batch are written to a folder of its own, so that a batch that is
    run again after a failure takes the place of its first try."""

    def batch(rows: DataFrame, number: int) -> None:
        send_pages(rows, post, wait).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
