"""Where intermediate tables live, and how a lineage is cut.

Executors may be lost at any time, so nothing is kept in one executor's cache: a table that is read more than
once is written to the folder all executors share (``spark.checkpoint.dir``) and read from there.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is made only where the setting is absent (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folders:
        _local_folders.append(tempfile.mkdtemp(prefix="pagemill-"))
        atexit.register(shutil.rmtree, _local_folders[0], ignore_errors=True)
    return "file://" + _local_folders[0]


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but those that say ``keep``, are deleted at the end: nothing that is read later may depend on them."""
    token = _scratch.set([])
    try:
        yield
    finally:
        discard(spark, *_scratch.get())
        _scratch.reset(token)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back; the result has no lineage to recompute."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch.get() is not None and not keep:
        _scratch.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Write ``df`` once into the shared folder, bucketed and sorted by some columns: joins by these do not move it again."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread_out = df.repartition(buckets, *by)
    spread_out.write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared storage that nothing will read any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Nodes of a plan whose output has the partitions of their own shuffles, or work of its own.
_NOT_A_SCAN = {"Join", "Aggregate", "Repartition", "RepartitionByExpression", "Window", "Sort", "Distinct", "MapInArrow", "Generate", "Union", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow"}


def _nodes(plan) -> Iterator[str]:
    yield plan.nodeName()
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan enough tasks for Python work: small files arrive as one row group, hence as one task.

    A row count is not needed: the scan's own number of splits decides, and a scan that already has a task
    for each core is left alone, so that large inputs are never shuffled for this. What is no plain scan has the
    partitions of its own shuffles and stays as it is; asking it for them would run it.
    """
    execution = df._jdf.queryExecution()
    if not _NOT_A_SCAN.isdisjoint(_nodes(execution.optimizedPlan())):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column whose expression is computed once for each row, however often later steps name it.

    The optimizer copies a projected expression into every filter and projection above it; long ones then multiply. It
    does not copy through a generator, and one that makes a row of a row costs next to nothing.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
