"""Job statistics, listings, remaining time, sending, limits."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import fixed


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def page_counters(pages: DataFrame) -> DataFrame:
    """Counters of each job's pages, of distinct rows: (job_id, crawled, sent, failed_sends, skipped_duplicates, skipped_quality, page_errors,
    finished: those that came to an end of any kind)."""
    count = lambda c: F.count_if(c)
    return pages.distinct().groupBy("job_id").agg(
        F.count("*").alias("crawled"),
        count((F.col("decision") == "SEND") & (F.col("status") == "completed")).alias("sent"),
        count(F.col("status") == "failed_send").alias("failed_sends"),
        count(F.col("decision") == "SKIP_DUPLICATE").alias("skipped_duplicates"),
        count(F.col("decision") == "SKIP_LOW_QUALITY").alias("skipped_quality"),
        count(F.col("decision") == "PAGE_ERROR").alias("page_errors"),
        count(F.col("decision").isNotNull() | F.col("status").isNotNull()).alias("finished"),
    )


def discovered(pages: DataFrame, norm: str) -> DataFrame:
    """(job_id, discovered): how many different addresses each job came upon."""
    return pages.where(F.col(norm) != "").select("job_id", norm).distinct().groupBy("job_id").agg(F.count("*").alias("discovered"))


def final_status(failed_sends: Column, sent: Column) -> Column:
    """FAILED if sending was given up, COMPLETED_WITH_ERRORS if some sends failed; errors of pages do not matter."""
    total = failed_sends + sent
    given_up = (total >= fixed.ABORT_AFTER) & (failed_sends / total > fixed.ABORT_RATE)
    return F.when(given_up, "FAILED").when(failed_sends > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")


def route_counts(pages: DataFrame) -> DataFrame:
    """(job_id, route_type_counts) as a map from route type to number of pages."""
    counts = pages.distinct().where("route_type is not null").groupBy("job_id", "route_type").agg(F.count("*").alias("n"))
    return counts.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("route_type", "n")))).alias("route_type_counts"))


def listing(pages: DataFrame, job_id: str | None = None, decision: str | None = None, route_type: str | None = None, page: int = 1, page_size: int = 100) -> DataFrame:
    """One page of the list of pages: sent ones first, then by score (null as 0), then in order of discovery."""
    if page < 1 or not 1 <= page_size <= 500:
        raise ValueError("page must be 1 or more, page_size 1 to 500")
    rows = _of(pages, job_id, decision, route_type)
    order = [F.when(F.col("decision") == "SEND", 0).otherwise(1), F.desc(F.coalesce("score", F.lit(0))), "seq", "page_id"]
    return rows.distinct().orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def _of(pages: DataFrame, job_id: str | None, decision: str | None, route_type: str | None) -> DataFrame:
    for column, value in (("job_id", job_id), ("decision", decision), ("route_type", route_type)):
        if value is not None:
            pages = pages.where(F.col(column) == value)
    return pages


def listing_total(pages: DataFrame, job_id: str | None = None, decision: str | None = None, route_type: str | None = None, page_size: int = 100) -> DataFrame:
    """(total, pages): how many rows the list has, and pages of that size."""
    rows = _of(pages, job_id, decision, route_type).distinct()
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / page_size).alias("pages"))


def status_eta(status: Column, crawled: Column, discovered: Column, max_pages: Column, elapsed: Column) -> Column:
    """Seconds a job is expected to take yet: null before its first page and where nothing is left, 0 for final states.

    The rate is 0.6 of the rate of the last 30 % of the pages, taken to fill half of the time, and 0.4 of the overall one.
    """
    total = F.when(discovered > crawled, F.least(max_pages, discovered)).otherwise(max_pages)
    left = total - crawled
    recent = F.greatest(F.lit(1), F.floor(crawled * 3 / F.lit(10))) / F.greatest(elapsed * F.lit(0.5), F.lit(1.0))
    overall = crawled / F.greatest(elapsed * F.lit(1.0), F.lit(1.0))
    rate = F.greatest(recent * F.lit(0.6) + overall * F.lit(0.4), F.lit(0.02))
    return F.when((crawled < 1) | (status == "QUEUED"), F.lit(None).cast("long")).when(status.isin(fixed.FINAL_STATUSES), F.lit(0).cast("long")).when(left <= 0, F.lit(None).cast("long")).otherwise(F.floor(left / rate).cast("long"))


def engine_eta(queue: Column, crawled: Column, max_pages: Column, recent: Column, span: Column, elapsed: Column) -> Column:
    """Seconds the engine expects to need yet, from the pages of the last minute or, early on, of the whole run."""
    pages = F.greatest(crawled, F.lit(1))
    left = queue + F.greatest(F.lit(0), max_pages - pages)
    rate = F.when((recent >= 3) & (elapsed > 10), recent / F.greatest(span * F.lit(1.0), F.lit(1.0))).otherwise(pages / F.greatest(elapsed * F.lit(1.0), F.lit(1.0)))
    eta = left / F.greatest(rate, F.lit(0.01))
    eta = F.when((pages > 10) & (queue < 20), eta * F.lit(0.7)).when(pages < 5, eta * F.lit(1.5)).otherwise(eta)
    return F.when(left == 0, F.lit(0).cast("long")).otherwise(F.floor(eta).cast("long"))


#: Seconds of one key's rows that one task looks at: a key that holds a third of all rows is many tasks' work.
BLOCK_SECONDS = 3600


def _block(ts: str, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def rolling_rate(events: DataFrame, key: str, ts: str, seconds: int = 60, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``events`` with the number of events of their key in the ``seconds`` up to them, and the span of these in seconds.

    A key's events are dealt to blocks of time; those less than ``seconds`` before the end of one are lent to the next.
    Rows without a time have no count.
    """
    block_seconds = max(block_seconds, seconds)
    own, after = _block(ts, block_seconds), F.floor((micros(ts) + seconds * 1_000_000) / F.lit(block_seconds * 1_000_000))
    rows = events.withColumn("__block", F.explode(F.when(own < after, F.array(own, after)).otherwise(F.array(own))))
    window = Window.partitionBy(key, "__block").orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    counted = rows.withColumn("recent", F.count(ts).over(window)).withColumn("span", (micros(ts) - F.min(micros(ts)).over(window)) / F.lit(1_000_000.0))
    return counted.where(F.col("__block").eqNullSafe(own)).drop("__block")


def circuit_breaker(sends: DataFrame, key: str, order: list[str], failed: str, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``sends`` with ``aborted``: whether sending is given up at or before the row; once given up, it stays so.

    ``order`` begins with a time. Counts run within blocks of time; what the blocks before have is added from the blocks'
    sums, of which there are few, so that no task has all rows of a key.
    """
    rows = sends.withColumn("__block", _block(order[0], block_seconds))
    blocks = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(blocks), F.lit(0))
    sums = rows.groupBy(key, "__block").agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("int")).alias("bad"))
    sums = sums.select(F.col(key).alias("__key"), F.col("__block").alias("__at"), before("n").alias("__n"), before("bad").alias("__bad"))
    rows = rows.join(sums, F.col(key).eqNullSafe(F.col("__key")) & F.col("__block").eqNullSafe(F.col("__at"))).drop("__key", "__at")
    window = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("__n") + F.count("*").over(window)
    bad = F.col("__bad") + F.coalesce(F.sum(F.col(failed).cast("int")).over(window), F.lit(0))
    rows = rows.withColumn("__tripped", (total >= fixed.ABORT_AFTER) & (bad / total > fixed.ABORT_RATE)).withColumn("__aborted", F.max("__tripped").over(window))
    # the first block that trips decides for all later ones
    first = rows.where("__tripped").groupBy(F.col(key).alias("__key")).agg(F.min("__block").alias("__first"))
    rows = rows.join(first, F.col(key).eqNullSafe(F.col("__key")), "left")
    aborted = F.col("__aborted") | F.coalesce(F.col("__first") < F.col("__block"), F.lit(False))
    return rows.withColumn("aborted", aborted).drop("__block", "__n", "__bad", "__tripped", "__aborted", "__key", "__first")


def _limited(max_requests: int, seconds: float, key: str, ts: str):
    def run(batches):
        client, accepted = None, deque()
        for rows in batches:
            out = []
            for own, now in zip(rows[key], rows["__micros"]):
                if own != client:
                    client, accepted = own, deque()
                while accepted and now - accepted[0] >= seconds * 1_000_000:
                    accepted.popleft()
                out.append(len(accepted) < max_requests)
                if out[-1]:
                    accepted.append(now)
            yield rows[["request_id", key]].assign(accepted=out)

    return run


def rate_limit(requests: DataFrame, key: str, ts: str, max_requests: int = fixed.RATE_REQUESTS, seconds: int = fixed.RATE_SECONDS) -> DataFrame:
    """(request_id, key, accepted): a request is refused if ``max_requests`` were accepted in the last ``seconds``.

    Refused requests do not count, so the fold is sequential within a client. Rows are sorted by client and time, which
    spills, and the fold goes over them batch by batch: what a task holds is the accepted times of one window, however
    many requests a client has. Rows without a client are left out.
    """
    kind = dict(requests.dtypes)[key]
    rows = requests.where(F.col(key).isNotNull()).select("request_id", key, micros(ts).alias("__micros"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "__micros", "request_id")
    return ordered.mapInPandas(_limited(max_requests, seconds, key, ts), f"request_id long, {key} {kind}, accepted boolean")


def send_outcomes(attempts: DataFrame) -> DataFrame:
    """(req_id, attempts, status, ok) of each request: the attempts that were due, the last one's status, whether it was taken.

    Attempts after one that is not retried, or beyond the fourth, are not due; repeated rows count once.
    """
    rows = attempts.distinct()
    final = ~F.col("status").isin(fixed.RETRIED_STATUSES)
    last = rows.groupBy("req_id").agg(F.coalesce(F.min(F.when(final, F.col("attempt"))), F.lit(fixed.MOST_ATTEMPTS)).alias("stop"))
    due = rows.join(last, "req_id").where((F.col("attempt") <= F.col("stop")) & (F.col("attempt") <= fixed.MOST_ATTEMPTS))
    out = due.groupBy("req_id").agg(F.countDistinct("attempt").alias("attempts"), F.max_by("status", "attempt").alias("status"))
    return out.withColumn("ok", F.col("status").between(200, 299))


def expired(jobs: DataFrame, now: Column, seconds: int = fixed.JOB_SECONDS) -> DataFrame:
    """Finished jobs that were made more than ``seconds`` ago."""
    return jobs.where(F.col("status").isin(fixed.FINAL_STATUSES) & (micros("created_at") < micros(now) - seconds * 1_000_000))


def health(jobs: DataFrame) -> DataFrame:
    active = F.count_if(F.col("status").isin(fixed.ACTIVE_STATUSES))
    return jobs.agg(active.alias("active_jobs"), F.count("*").alias("total_jobs"), (active < fixed.MOST_ACTIVE).alias("admits"))


def load_outcomes(attempts: DataFrame) -> DataFrame:
    """(page_id, loaded, http_status, error) of page loads from their attempts (page_id, attempt, problem, http_status, error).

    A load is tried a second time after an error; a timeout counts as loaded, with what had come. Of a page that never
    loaded the last error stays, cut short; one that answered with 400 or more is loaded and has that status.
    """
    rows = attempts.distinct().where(F.col("attempt") <= fixed.MOST_LOADS)
    good = F.coalesce(F.col("problem") != "error", F.lit(True))
    out = rows.groupBy("page_id").agg(
        F.min_by(F.when(good, F.struct("http_status")), F.when(good, F.col("attempt"))).alias("first"),
        F.max(good).alias("loaded"),
        F.max_by("error", F.when(~good, F.col("attempt"))).alias("error"),
    )
    return out.select("page_id", "loaded", "first.http_status", F.when(~F.col("loaded"), F.substring("error", 1, fixed.ERROR_CHARS)).alias("error"))


def log_lines(events: DataFrame) -> DataFrame:
    """(line): a JSON object for each event (ts, level, logger, msg, fields: a map of texts or null), its fields beside the others."""
    head = F.create_map(F.lit("ts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("level"), F.col("level"), F.lit("logger"), F.col("logger"), F.lit("msg"), F.col("msg"))
    more = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("ts", "level", "logger", "msg"))
    return events.select(F.to_json(F.map_concat(head, more)).alias("line"))
