"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, remove, saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node of its component) of every node in edges (columns a, b; any ordered type, not null).

    A star hangs a node's neighbours on the least of them; the number of rounds grows as the logarithm of the longest
    path. Each round is written to the shared folder, so plans stay short and survive lost executors; the round before it is
    deleted. A node with many
    neighbours is one row per neighbour, and its minimum is partly aggregated before it is shuffled."""
    spark = edges.sparkSession
    path = fresh_path(spark, name)
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, path)
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("x")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), F.col("u") == F.col("x")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        before, path = path, fresh_path(spark, name)
        now = saved(small, name, path)
        remove(spark, before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
