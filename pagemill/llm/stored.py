"""State kept from batch to batch in a folder of the shared storage: bucketed tables that grow by appending, and a note.

A table bucketed by its key is joined, or grouped, by that key without being moved: only a batch's own rows are shuffled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from pagemill.shared import discard


class StoredTable:
    """A bucketed table in ``folder``; the files stay there, the name is of this session."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, by: str, buckets: int):
        self.spark, self.folder, self.name = spark, folder, f"stored_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def append(self, rows: DataFrame) -> None:
        rows.write.insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            discard(self.spark, self.folder)


def bucket_count(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _file(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/about.json")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def noted(spark: SparkSession, folder: str, fresh: dict) -> dict:
    """What ``note`` wrote in the folder, over what a fresh one has."""
    files, path = _file(spark, folder)
    if not files.exists(path):
        return fresh
    return fresh | json.loads(spark.read.text(f"{folder}/about.json", wholetext=True).first()[0])


def note(spark: SparkSession, folder: str, about: dict) -> None:
    files, path = _file(spark, folder)
    out = files.create(path, True)
    out.write(bytearray(json.dumps(about).encode()))
    out.close()


def together(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run writes that do not depend on each other at the same time; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]:
            done.result()
