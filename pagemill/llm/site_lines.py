"""Lines repeated across the documents of one site (problem 5).

``LineCounts`` keeps, from run to run, how many documents of a site have each line (appended deltas) and which documents
these are (a line-to-document index), both bucketed by line. A new partition (batch) is merged as a delta: its own lines
are counted and brought to the stored counts, which tells the lines that cross the threshold with it. What comes out is
the partition's own repeated lines and, by the index, the earlier documents' lines that have just crossed; only these
documents are rebuilt, and no earlier text is read again.

Lines are compared by their words, each run of digits read as one 0; keys are two 64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.stored import StoredTable, bucket_count, note, noted, together
from pagemill.shared import discard, materialize, scratch, shared_folder, spread

LEAST_CHARS = 20
LEAST_DOCUMENTS = 6


def site_of(url: Column) -> Column:
    """Host of a url in lower case, without user, port and one leading ``www.``; '' if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def line_words(line: Column) -> Column:
    """The words of a line, lower case, one space between them, each run of digits as one 0."""
    spaced = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\p{Nd}+", "0"))


def occurrences(pages: DataFrame, id_col: str, url_col: str, text_col: str, partition_col: str | None = None) -> DataFrame:
    """(id, line_no, part, h1, h2): each line of at least LEAST_CHARS normalised characters; null texts have none."""
    part = F.lit(0) if partition_col is None else F.coalesce(F.col(partition_col).cast("int"), F.lit(-(2**31) + 1))
    rows = spread(pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(url_col).alias("url"), part.alias("part")))
    lines = rows.select("id", "part", site_of(F.col("url")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    keyed = lines.where(F.length("line") >= LEAST_CHARS).withColumn("words", line_words(F.col("line"))).where(F.length("words") >= LEAST_CHARS)
    return keyed.select("id", "line_no", "part", F.xxhash64("site", "words").alias("h1"), F.xxhash64("words", "site", F.lit("second")).alias("h2"))


class LineCounts:
    """The counts and the index of all partitions merged so far, in ``folder``; opened again if there are some."""

    def __init__(self, spark: SparkSession, id_type: str = "long", folder: str | None = None, least: int = LEAST_DOCUMENTS):
        self.spark, self.folder, self.least = spark, folder or f"{shared_folder(spark)}/line-counts-{uuid.uuid4().hex}", least
        self.about = noted(spark, self.folder, {"buckets": bucket_count(spark), "merged": 0, "version": 0})
        self.index = StoredTable(spark, f"{self.folder}/index", f"h1 long, h2 long, id {id_type}, line_no int", "h1, h2", self.about["buckets"])
        self.counts = self._count_table()

    def _count_table(self) -> StoredTable:
        return StoredTable(self.spark, f"{self.folder}/counts-{self.about['version']}", "h1 long, h2 long, n long", "h1, h2", self.about["buckets"])

    def state(self) -> DataFrame:
        """(h1, h2, documents)"""
        return self.counts.read().groupBy("h1", "h2").agg(F.sum("n").alias("documents"))

    def merge(self, found: DataFrame) -> DataFrame:
        """Merge one partition's occurrences (id, line_no, h1, h2); returns (id, line_no) of the lines that are repeated now
        and were not known to be: the partition's own, and those of earlier documents that crossed the threshold with it.

        A document belongs to one partition. Counts are combined before the shuffle, so a line of a third of all
        documents is a few rows by then.
        """
        with scratch(self.spark):
            return self._merged(found)

    def _merged(self, found: DataFrame) -> DataFrame:
        delta = found.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
        if self.about["merged"]:
            delta = delta.join(self.state(), ["h1", "h2"], "left").fillna(0, ["documents"])
        else:
            delta = delta.withColumn("documents", F.lit(0).cast("long"))
        delta = materialize(delta, "line-delta")
        repeated = delta.where(F.col("n") + F.col("documents") >= self.least)
        out = found.join(repeated.select("h1", "h2"), ["h1", "h2"], "left_semi").select("id", "line_no")
        if self.about["merged"]:
            crossed = repeated.where((F.col("documents") < self.least) & (F.col("documents") > 0)).select("h1", "h2")
            out = out.union(self.index.read().join(crossed, ["h1", "h2"], "left_semi").select("id", "line_no"))
        out = materialize(out.distinct(), "line-removals", keep=True)
        together(self.spark, lambda: self.index.append(found.select("h1", "h2", "id", "line_no")), lambda: self.counts.append(delta.select("h1", "h2", "n")))
        self.about["merged"] += 1
        note(self.spark, self.folder, self.about)
        return out

    def compact(self) -> None:
        """Sum the deltas of each line."""
        before, summed = self.counts, self.state().withColumnRenamed("documents", "n")
        self.about["version"] += 1
        self.counts = self._count_table()
        self.counts.append(summed)
        note(self.spark, self.folder, self.about)
        before.drop()

    def drop(self) -> None:
        self.counts.drop()
        self.index.drop()
        discard(self.spark, self.folder)


def repeated_lines(pages: DataFrame, id_col: str, url_col: str, text_col: str, partition_col: str | None = None, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, line_no) of each line that stands in at least ``least`` documents of its site; partitions are merged in turn.

    Null urls form one site of their own; null and empty texts have no line; a repeated row counts as one document and
    gives its lines once; a null partition is the first; other columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    found, folder = occurrences(pages, id_col, url_col, text_col, partition_col), f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    found.write.partitionBy("part").parquet(folder)
    staged = spark.read.schema(found.schema).parquet(folder)
    id_type, out = dict(found.dtypes)["id"], None
    counts = LineCounts(spark, id_type, least=least)
    for (part,) in staged.select("part").distinct().orderBy("part").collect():
        own = spark.read.schema(f"id {id_type}, line_no int, h1 long, h2 long").parquet(f"{folder}/part={part}")
        new = counts.merge(own)
        out = new if out is None else out.union(new)
    counts.drop()
    discard(spark, folder)
    return out if out is not None else spark.createDataFrame([], f"id {id_type}, line_no int")


def rebuild(pages: DataFrame, id_col: str, text_col: str, removed: DataFrame) -> DataFrame:
    """(id, text, removed): the documents that contain removed lines, without these lines. ``removed``: (id, line_no)."""
    drop = removed.groupBy("id").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drop, "id").dropDuplicates(["id"])
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("drop", i))
    return rows.select("id", F.array_join(kept, "\n").alias("text"), F.size("drop").alias("removed"))
