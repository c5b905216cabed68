"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (tests), a folder below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows of df, written to path (by default a new one in the shared folder) and read from there: computed once, and lost
    with no executor."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of saved() that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it comes in fewer (a small table in few row groups): for work on rows that
    outweighs a shuffle of them. A large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_evenly(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """df in tasks_per_core partitions of equal numbers of rows for each core, for rows that cost far more to work on than to shuffle. What a scan
    cuts its files into doesn't tell: a file of one row group is read by one task, however many there are, and the adaptive
    planner joins partitions of few bytes."""
    return df.repartition(tasks(df.sparkSession, tasks_per_core))


def tasks(spark: SparkSession, per_core: int = 4) -> int:
    return spark.sparkContext.defaultParallelism * per_core
