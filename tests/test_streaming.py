import pytest
"""Streams, fed file by file, against the batch operators."""

import random

from pyspark.sql import functions as F

from pagemill.operators import jobs
from pagemill.streaming import limits


def fed(spark, df, order, folder, pieces=3):
    """A stream of the rows of ``df`` in ``pieces`` files, in order."""
    rows = [r.asDict() for r in df.orderBy(order).collect()]
    for k in range(pieces):
        part = rows[k * len(rows) // pieces : (k + 1) * len(rows) // pieces]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(spark, out, name, folder, mode="append"):
    query = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def requests(spark):
    rng, t, rows = random.Random(5), 0, []
    for n in range(120):
        t += rng.choice([0, 1, 2, 9])
        rows.append((n, rng.randint(0, 3), t))
    return spark.createDataFrame(rows, "request_id long, client int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_rate_limit(spark, tmp_path):
    df = requests(spark)
    want = {tuple(r) for r in jobs.rate_limit(df, "client", "ts", 2, 10).collect()}
    got = drained(spark, limits.rate_limited(fed(spark, df, "request_id", tmp_path), "client", "ts", 2, 10), "limited", tmp_path)
    assert {tuple(r) for r in got.collect()} == want


def test_circuit_breaker(spark, tmp_path):
    df = requests(spark).select(F.col("client").alias("job"), (F.col("ts") + F.make_interval(secs=F.col("request_id") / 1000)).alias("ts"), (F.col("request_id") % 7 < 6).alias("failed"))
    want = {tuple(r) for r in jobs.circuit_breaker(df, "job", ["ts"], "failed").select("job", "ts", "aborted").collect()}
    got = drained(spark, limits.circuit_breaker(fed(spark, df, "ts", tmp_path), "job", "ts", "failed"), "breaker", tmp_path)
    assert {tuple(r) for r in got.collect()} == want


def test_throughput_and_fingerprints(spark, tmp_path):
    df = requests(spark)
    got = drained(spark, limits.throughput(fed(spark, df, "request_id", tmp_path), "ts", ["client"]), "rate", tmp_path, "complete")
    last = got.groupBy("client").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in last) == 6 * df.count()
    firsts = drained(spark, limits.first_fingerprints(fed(spark, df, "request_id", tmp_path / "b"), "ts", ["client"]), "firsts", tmp_path / "b")
    assert firsts.count() == 4


def test_live_jobs(spark, tmp_path):
    rows = [("a", "PROCESSING", 0), ("a", "COMPLETED", 10), ("b", "PROCESSING", 20), ("b", "PROCESSING", 90_000), ("c", "QUEUED", 99_000)]
    df = spark.createDataFrame(rows, "job string, status string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = drained(spark, limits.live_jobs(fed(spark, df, "ts", tmp_path, 5), "ts", "job", "status"), "live", tmp_path)
    seen = {tuple(r) for r in got.collect()}
    assert ("a", "COMPLETED", True) in seen and not any(j == "b" and x for j, _, x in seen)


def test_sending_with_retries(spark, tmp_path):
    import json

    from pyspark.sql import types as T

    from pagemill.sources.settings import Settings
    from pagemill.streaming import sending

    asked = []

    def post(body):
        kind = json.loads(body)["url"]
        asked.append(kind)
        if kind == "raises":
            raise OSError("no route")
        return {"fine": 201, "busy": 503, "wrong": 422, "late": 200 if asked.count("late") > 2 else 429}[kind], "said"

    waits = []
    outcome = {kind: sending.sent(json.dumps({"url": kind}), post, waits.append) for kind in ("fine", "busy", "wrong", "late", "raises")}
    assert outcome == {"fine": (True, 201, "said", 1), "busy": (False, 503, "said", 4), "wrong": (False, 422, "said", 1), "late": (True, 200, "said", 3), "raises": (False, 0, "no route", 4)}
    assert waits == [1.0, 2.0, 4.0, 1.0, 2.0, 1.0, 2.0, 4.0]

    pages = spark.read.parquet("/root/testdata/sf0.001/sent_pages.parquet").limit(5)
    pages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(T.StructType.fromJson(pages.schema.jsonValue())).parquet(f"{tmp_path}/in")
    sending.send_stream(stream, lambda body: (200, str(len(body))), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").where("ok and attempts = 1").count() == 5

    with pytest.raises(ValueError, match="receiver"):
        Settings.of(spark).ready_to_send()
    spark.conf.set("spark.pagemill.most_active_jobs", " 3 ")
    assert Settings.of(spark).most_active_jobs == 3
    spark.conf.set("spark.pagemill.most_active_jobs", "many")
    with pytest.raises(ValueError, match="most_active_jobs"):
        Settings.of(spark)
    spark.conf.unset("spark.pagemill.most_active_jobs")


def test_log_lines(spark):
    import json

    from pagemill.operators import jobs

    rows = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS ts, 'INFO' AS level, 'crawl' AS logger, 'a \"b\"' AS msg, map('url', 'u', 'level', 'x') AS fields UNION ALL SELECT NULL, 'WARN', 'api', NULL, NULL")
    lines = [json.loads(r["line"]) for r in jobs.log_lines(rows).collect()]
    assert lines[0] == {"ts": "2024-01-02 03:04:05,678", "level": "INFO", "logger": "crawl", "msg": 'a "b"', "url": "u"} and lines[1]["level"] == "WARN"
