"""Structured Streaming forms of the stateful operators.

State is keyed, and bounded: a client's accepted times of one window, a job's counters, a job's fingerprints until its
time is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions import fixed


def _seconds(values: pd.Series) -> list[float]:
    return (values.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def rate_limited(requests: DataFrame, key: str, ts: str, max_requests: int = fixed.RATE_REQUESTS, seconds: int = fixed.RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(request_id, key, accepted) of a stream of requests (request_id, key, ts); refused requests do not count.

    The times of accepted requests are the client's state. It goes when the watermark, ``late`` behind the newest
    request, has left them behind; requests older than the watermark are dropped.
    """
    kind = dict(requests.dtypes)[key]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, "request_id"])
        out = []
        for now in _seconds(rows[ts]):
            accepted = [t for t in accepted if now - t < seconds]
            out.append(len(accepted) < max_requests)
            if out[-1]:
                accepted.append(now)
        state.update((accepted,))
        state.setTimeoutTimestamp(max(int((now + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"request_id": rows["request_id"], key: group[0], "accepted": out})

    return requests.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"request_id long, {key} {kind}, accepted boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def circuit_breaker(sends: DataFrame, key: str, ts: str, failed: str) -> DataFrame:
    """(key, ts, aborted) of a stream of sends: whether sending is given up at or before each."""
    kind = dict(sends.dtypes)[key]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, bad, aborted = state.get if state.exists else (0, 0, False)
        rows, out = pd.concat(list(batches)).sort_values(ts), []
        for one in rows[failed]:
            total, bad = total + 1, bad + bool(one)
            aborted = bool(aborted or (total >= fixed.ABORT_AFTER and bad / total > fixed.ABORT_RATE))
            out.append(aborted)
        state.update((total, bad, aborted))
        yield pd.DataFrame({key: group[0], ts: rows[ts].tolist(), "aborted": out})

    return sends.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, aborted boolean", "total long, bad long, aborted boolean", "append", GroupStateTimeout.NoTimeout)


def throughput(events: DataFrame, ts: str, keys: list[str], late: str = "2 minutes", seconds: int = 60, slide: int = 10) -> DataFrame:
    """Events of each key in sliding windows, late ones within the watermark."""
    window = F.window(ts, f"{seconds} seconds", f"{slide} seconds")
    counts = events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def first_fingerprints(pages: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first page of each key's fingerprint; fingerprints are forgotten when the watermark has passed them."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def live_jobs(events: DataFrame, ts: str, key: str, status: str, seconds: int = fixed.JOB_SECONDS) -> DataFrame:
    """(key, status, expired): each change of a job's status, and, once a finished job's time is over, its expiry."""
    kind = dict(events.dtypes)[key]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "status": [last], "expired": [True]})
            return
        rows = pd.concat(list(batches)).sort_values(ts)
        last = rows[status].iloc[-1]
        state.update((last,))
        if last in fixed.FINAL_STATUSES:
            due = int(rows[ts].iloc[0].timestamp() * 1000) + seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], "status": rows[status].tolist(), "expired": False})

    return events.withWatermark(ts, "1 minute").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, status string, expired boolean", "status string", "append", GroupStateTimeout.EventTimeTimeout)
