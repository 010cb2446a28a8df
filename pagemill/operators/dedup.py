"""First-wins removal of repeated urls and the duplicate gate, by aggregates and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.shared import materialize


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, which is total. Combined before the shuffle, so a hot key is one row."""
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("row"))
    return packed.select(*keys, "row.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("row"))
    return packed.select(*keys, "row.*").select(*df.columns)


def canonical_rejects(pages: DataFrame) -> DataFrame:
    """(job_id, seq, reason): pages whose canonical link an earlier page has, or is, unless that page was itself turned away.

    ``pages``: job_id, seq, url (normalised, unique in its job), canonical (effective: null if it is the url itself or a
    generic parent). A page with an earlier owner of its canonical link has the opposite fate of that owner. Chains of
    owners are followed by pointer jumping: each round doubles what is covered, so a chain of n pages takes log2 n rounds,
    however long it is; every round is written out.
    """
    same = pages.where("canonical is not null")
    first = same.groupBy("job_id", "canonical").agg(F.min("seq").alias("first_seq"))
    seen = same.join(first, ["job_id", "canonical"]).withColumn("repeated", F.col("seq") > F.col("first_seq"))
    owner = pages.select("job_id", F.col("url").alias("canonical"), F.col("seq").alias("owner_seq"))
    state = seen.join(owner, ["job_id", "canonical"], "left")
    earlier = F.when(~F.col("repeated") & (F.col("owner_seq") < F.col("seq")), F.col("owner_seq"))
    # ``fate``: of a page without an owner to ask, whether it is turned away; of others, whether theirs is the owner's opposite
    state = materialize(state.select("job_id", "seq", "canonical", earlier.alias("ask"), (F.col("repeated") | earlier.isNotNull()).alias("fate")), "canonical")
    while not state.where("ask is not null").isEmpty():
        asked = state.select("job_id", F.col("seq").alias("ask"), F.col("ask").alias("next"), F.col("fate").alias("other"))
        step = state.join(asked, ["job_id", "ask"], "left")
        # an owner without a canonical link of its own is not turned away
        fate = F.when(F.col("ask").isNull(), F.col("fate")).otherwise(F.col("fate") != F.coalesce("other", F.lit(False)))
        state = materialize(step.select("job_id", "seq", "canonical", F.col("next").alias("ask"), fate.alias("fate")), "canonical")
    return state.where("fate").select("job_id", "seq", F.concat(F.lit("duplicate_canonical:"), "canonical").alias("reason"))


def content_reasons(pages: DataFrame) -> DataFrame:
    """``pages`` (job_id, seq, url, sig, meta, is_detail) with ``reason``: 'ok', or why its content is a repetition.

    The first page of a content is found by an aggregate that is combined before the shuffle and joined back, so that a
    content of a third of all pages is no single task's group.
    """
    first = pages.groupBy("job_id", "sig").agg(F.min_by(F.struct("seq", "url", "meta"), "seq").alias("first"))
    joined = pages.join(first, ["job_id", "sig"])
    later = F.col("seq") > F.col("first.seq")
    reason = (
        F.when(later & ~F.col("is_detail"), F.concat(F.lit("duplicate_content:"), "first.url"))
        .when(later & F.col("is_detail") & (F.col("meta") == F.col("first.meta")), F.concat(F.lit("duplicate_content_and_title:"), "first.url"))
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).drop("first")


def duplicate_gate(pages: DataFrame) -> DataFrame:
    """(job_id, seq, reason) of each page: canonical links first, then content among the pages they leave."""
    rejects = canonical_rejects(pages)
    left = pages.join(rejects, ["job_id", "seq"], "left_anti")
    return rejects.unionByName(content_reasons(left).select("job_id", "seq", "reason"))


def first_fingerprints(pages: DataFrame, keys: list[str], fingerprint: str, order: str) -> DataFrame:
    """``pages`` with ``is_first``: whether a page is the first of its keys with this fingerprint; '' is never a repetition."""
    first = pages.where(F.col(fingerprint) != "").groupBy(*keys, fingerprint).agg(F.min(order).alias("__first"))
    joined = pages.join(first, [*keys, fingerprint], "left")
    return joined.withColumn("is_first", (F.col(fingerprint) == "") | (F.col(order) == F.col("__first"))).drop("__first")
