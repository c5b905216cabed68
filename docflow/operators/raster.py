"""Raster and batch plans of pages, and the image kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pixels(points, dpi: float):
    return F.greatest(F.lit(1), F.ceil(points * dpi / 72 - 1e-9)).cast("long")


def raster_plan(pages: DataFrame, *, dpi: float = 300, thumbnail_dpi: float = 36, max_pixels: int = 100_000_000) -> DataFrame:
    """Target sizes of pages (width_pt, height_pt, rotation): width_px, height_px, pixels, thumb_width, thumb_height, status
    (planned, or skipped above max_pixels). A quarter turn swaps width and height."""
    turned = F.pmod(F.col("rotation"), F.lit(180)) == 90
    w, h = F.when(turned, F.col("height_pt")).otherwise(F.col("width_pt")), F.when(turned, F.col("width_pt")).otherwise(F.col("height_pt"))
    out = pages.select("doc_id", "page_index", _pixels(w, dpi).alias("width_px"), _pixels(h, dpi).alias("height_px"), _pixels(w, thumbnail_dpi).alias("thumb_width"), _pixels(h, thumbnail_dpi).alias("thumb_height"))
    out = out.withColumn("pixels", F.col("width_px") * F.col("height_px"))
    return out.withColumn("status", F.when(F.col("pixels") > max_pixels, "skipped").otherwise("planned"))


def batch_plan(plan: DataFrame, *, max_pixels: int = 8_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Pages of each document in order, packed into batches of at most max_pixels and max_bytes (4 a pixel): doc_id, page_index,
    batch_no; null for a page above a limit by itself. A fold over a document's pages, in the JVM."""
    limit = min(max_pixels, max_bytes // 4)
    pages = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "pixels"))).alias("p"))
    start = F.expr("named_struct('b', 0, 'sum', cast(0 as bigint), 'out', cast(array() as array<struct<page_index:int,batch_no:int>>))")

    def step(acc, page):
        big = page["pixels"] > limit
        new = ~big & (acc["sum"] > 0) & (acc["sum"] + page["pixels"] > limit)
        b = F.when(new, acc["b"] + 1).otherwise(acc["b"])
        total = F.when(big, acc["sum"]).when(new, page["pixels"]).otherwise(acc["sum"] + page["pixels"])
        entry = F.struct(page["page_index"].cast("int").alias("page_index"), F.when(~big, b).alias("batch_no"))
        return F.struct(b.alias("b"), total.alias("sum"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return pages.select("doc_id", F.explode(F.aggregate("p", start, step)["out"]).alias("e")).select("doc_id", "e.page_index", "e.batch_no")


def gpu_plan(routed: DataFrame, plan: DataFrame, *, available: bool = True, max_pixels: int = 8_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Pages that go to OCR with their batch or the reason why they have none: doc_id, page_index, status (planned, missing-raster,
    exceeds-batch-pixel-limit, exceeds-memory-limit, cpu-fallback) and batch_no. routed: doc_id, page_index, source_type; plan: as
    raster_plan gives it."""
    pages = routed.where(F.col("source_type").isin("scanned", "hybrid")).select("doc_id", "page_index").join(plan.select("doc_id", "page_index", "pixels"), ["doc_id", "page_index"], "left")
    status = F.when(F.lit(not available), "cpu-fallback").when(F.col("pixels").isNull(), "missing-raster").when(F.col("pixels") > max_pixels, "exceeds-batch-pixel-limit").when(F.col("pixels") * 4 > max_bytes, "exceeds-memory-limit").otherwise("planned")
    pages = pages.withColumn("status", status)
    batches = batch_plan(pages.where("status = 'planned'"), max_pixels=max_pixels, max_bytes=max_bytes)
    return pages.join(batches, ["doc_id", "page_index"], "left").select("doc_id", "page_index", "status", "batch_no")


def binarize(rgba: np.ndarray, threshold: int = 128) -> np.ndarray:
    """RGBA of the same shape, black or white by luma >= threshold."""
    on = (luma(rgba) >= threshold).astype(np.uint8) * 255
    return np.stack([on, on, on, rgba[..., 3]], axis=-1)


def luma(rgba: np.ndarray) -> np.ndarray:
    c = rgba.astype(np.int64)
    return (77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8


def adaptive_threshold(rgba: np.ndarray, radius: int = 8, bias: int = 7) -> np.ndarray:
    """Black where luma is below the mean of its square of 2 radius + 1 less bias; a pixel whose square leaves the image is held
    against itself."""
    y = luma(rgba)
    h, w = y.shape
    table = np.zeros((h + 1, w + 1), np.int64)
    table[1:, 1:] = y.cumsum(0).cumsum(1)
    total, count = y.copy(), np.ones_like(y)
    r = radius
    if h > 2 * r and w > 2 * r:
        k = 2 * r + 1
        total[r : h - r, r : w - r] = table[k:, k:] - table[:-k, k:] - table[k:, :-k] + table[:-k, :-k]
        count[r : h - r, r : w - r] = k * k
    on = (y * count >= total - bias * count).astype(np.uint8) * 255
    return np.stack([on, on, on, rgba[..., 3]], axis=-1)


def preprocess_images(images: DataFrame, *, mode: str = "adaptive", threshold: int = 128, radius: int = 8, bias: int = 7) -> DataFrame:
    """images (image_id, width, height, rgba) with rgba binarized, by Arrow batches. Pixels that don't fit the size give null."""

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 64):
                batch, out = whole.slice(at, 64), []
                for w, h, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    if raw is None or w is None or h is None or len(raw) != w * h * 4:
                        out.append(None)
                        continue
                    px = np.frombuffer(raw, np.uint8).reshape(h, w, 4)
                    out.append((adaptive_threshold(px, radius, bias) if mode == "adaptive" else binarize(px, threshold)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["image_id", "width", "height", "rgba"])

    rows = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "rgba")
    return rows.mapInArrow(run, f"image_id {images.schema['image_id'].dataType.simpleString()}, width int, height int, rgba binary")
