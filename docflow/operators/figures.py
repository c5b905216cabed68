"""Figures found above their captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _region(captions: DataFrame, items: DataFrame, prefix: str) -> DataFrame:
    """Union of the boxes of items (x1, y1, x2, y2) at or above each caption on its page."""
    c = captions.select("doc_id", "page_index", "line_no", (F.col("y") + F.col("height")).alias("_top"))
    met = c.join(items, ["doc_id", "page_index"]).where(F.least("y1", "y2") >= F.col("_top"))
    return met.groupBy("doc_id", "page_index", "line_no").agg(
        F.min(F.least("x1", "x2")).alias(f"{prefix}x1"), F.min(F.least("y1", "y2")).alias(f"{prefix}y1"), F.max(F.greatest("x1", "x2")).alias(f"{prefix}x2"), F.max(F.greatest("y1", "y2")).alias(f"{prefix}y2"), F.count(F.lit(1)).alias(f"{prefix}n")
    )


def detect_figures(lines: DataFrame, rulings: DataFrame, images: DataFrame) -> DataFrame:
    """A figure for each figure caption with rulings (else images) above it: doc_id, page_index, line_no, figure_no (per page),
    number (in the caption), kind (vector or image), x, y, width, height, n_items."""
    captions = lines.where((T.caption_target("text") == "figure") & T.is_finite("y"))
    vector = _region(captions, rulings, "v_")
    image = _region(captions, images.select("doc_id", "page_index", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2")), "i_")
    key = ["doc_id", "page_index", "line_no"]
    both = captions.select(*key, "text").join(vector, key, "left").join(image, key, "left").where("v_n is not null or i_n is not null")
    pick = lambda c: F.when(F.col("v_n").isNotNull(), F.col(f"v_{c}")).otherwise(F.col(f"i_{c}"))
    n = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("line_no"))
    return both.select(
        *key, n.alias("figure_no"), F.regexp_extract("text", r"(\d+)", 1).cast("int").alias("number"), F.when(F.col("v_n").isNotNull(), "vector").otherwise("image").alias("kind"),
        pick("x1").alias("x"), pick("y1").alias("y"), (pick("x2") - pick("x1")).alias("width"), (pick("y2") - pick("y1")).alias("height"), pick("n").alias("n_items"),
    )


def insert_figures(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """blocks with a placeholder before the block that begins with each figure's caption line, renumbered."""
    refs = figures.select("doc_id", F.col("line_no").alias("first_line"), F.concat(F.lit("*[Figure "), F.coalesce(F.col("number"), F.col("figure_no")).cast("string"), F.lit(" preview unavailable; metadata retained.]*")).alias("text"))
    extra = refs.join(blocks.select("doc_id", "first_line", "block_no"), ["doc_id", "first_line"]).select("doc_id", "block_no", F.lit("figure").alias("kind"), "text", "first_line", F.lit(0).cast("long").alias("n_lines"))
    both = blocks.select("doc_id", "block_no", "kind", "text", "first_line", "n_lines").unionByName(extra)
    order = Window.partitionBy("doc_id").orderBy("block_no", (F.col("kind") != "figure").cast("int"))
    return both.withColumn("block_no", F.row_number().over(order) - 1)
