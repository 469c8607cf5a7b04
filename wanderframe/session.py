"""Session helpers: table access, shared checkpoints, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        where = tempfile.mkdtemp(prefix="wanderframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from the copy, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def kept(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in the shared folder: later passes read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark itself reads it, so that what opens files without Spark finds the same."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


@contextmanager
def short_plan_texts(spark: SparkSession, length: int = 2_000) -> Iterator[None]:
    """For loops of many jobs: Spark's driver keeps the text of every executed plan and of its adaptive changes, so keep them short."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, str(length))
    try:
        yield
    finally:
        spark.conf.set(name, before)
