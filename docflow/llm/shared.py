"""What the training-data operators share: tables in the shared folder, batches of documents."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, remove, saved, shared_folder

__all__ = ["free_heap", "free_shuffles", "fresh_path", "remove", "saved", "shared_folder", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole documents go to Python in Arrow batches of so many rows, if the session has Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def free_shuffles(spark: SparkSession) -> None:
    """Let the executors delete the shuffle files of finished steps: Spark does so when the driver collects garbage, which a driver
    with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()


def free_heap(spark: SparkSession) -> None:
    """Let the executors give back the heap that finished steps have grown, which Java does in full collections only. One short task
    for each core; an executor that has no free core is left out."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("_")).write.format("noop").mode("overwrite").save()
