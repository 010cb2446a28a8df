"""Rules of robots files, from a table of their bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import fixed
from pagemill.functions.urls import strip


def disallowed_prefixes(bodies: DataFrame, honour_root: bool = False) -> DataFrame:
    """(host, prefix) the followed agents may not read, lower case, without a trailing slash; ``bodies``: (host, body).

    A line counts if the agent line last seen above it names a followed agent. ``Disallow: /`` and empty rules are
    ignored unless ``honour_root``; Allow, wildcards and delays are not supported. Null bodies have no rule.
    """
    lines = bodies.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("row", "raw")).withColumn("line", strip(F.col("raw")))
    value = strip(F.regexp_replace("line", r"^[^:]*:", ""))
    agent = F.when(F.lower("line").startswith("user-agent:"), value)
    window = Window.partitionBy("host").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(window)).where(F.lower("line").startswith("disallow:") & F.col("agent").isin(fixed.ROBOTS_AGENTS))
    trimmed = F.regexp_replace(F.lower(value), "/+$", "")
    prefix = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    kept = rows.select("host", prefix.alias("prefix"))
    return (kept if honour_root else kept.where("prefix <> '/'")).distinct()
