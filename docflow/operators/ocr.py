"""Scan detection, page routing, OCR boxes, and the choice between PDF and OCR lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def scan_signals(pages: DataFrame, lines: DataFrame, images: DataFrame) -> DataFrame:
    """Signals of each page (doc_id, page_index, width_pt, height_pt): n_lines, n_hidden, n_images, text_ratio,
    coverage (area of images, 1 at most), dominant (coverage .5 or more), little_text (fewer than 3 visible lines, under 1 % of
    the area), hidden_overlay (hidden lines on a dominant image), mismatch (a hidden line meets no image by half of it)."""
    key = ["doc_id", "page_index"]
    area = F.col("width_pt") * F.col("height_pt")
    text = lines.groupBy(*key).agg(
        F.count(F.when(~F.col("hidden"), 1)).alias("n_lines"), F.count(F.when(F.col("hidden"), 1)).alias("n_hidden"), F.sum(F.when(~F.col("hidden"), F.col("width") * F.col("height"))).alias("text_area")
    )
    drawn = images.groupBy(*key).agg(F.count(F.lit(1)).alias("n_images"), F.sum("area").alias("image_area"))
    hidden = lines.where("hidden").select(*key, "line_no", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("width").alias("lw"), F.col("height").alias("lh"))
    share = T.overlap_area("lx", "ly", "lw", "lh", "x", "y", "width", "height") / (F.col("lw") * F.col("lh"))
    met = hidden.join(images.select(*key, "x", "y", "width", "height"), key, "left").groupBy(*key, "line_no").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("overlap"))
    worst = met.groupBy(*key).agg(F.min("overlap").alias("least_overlap"))
    out = pages.join(text, key, "left").join(drawn, key, "left").join(worst, key, "left").fillna(0, ["n_lines", "n_hidden", "n_images", "text_area", "image_area"])
    coverage = F.when(area > 0, F.least(F.col("image_area") / area, F.lit(1.0))).otherwise(0.0)
    out = out.withColumn("coverage", T.round_half_up(coverage, 3)).withColumn("text_ratio", F.when(area > 0, F.col("text_area") / area).otherwise(0.0))
    dominant = F.col("coverage") >= 0.5
    return out.select(
        *key, "n_lines", "n_hidden", "n_images", "coverage", dominant.alias("dominant"), ((F.col("n_lines") < 3) & (F.col("text_ratio") < 0.01)).alias("little_text"),
        (dominant & (F.col("n_hidden") > 0)).alias("hidden_overlay"), (dominant & (F.col("n_hidden") > 0) & (F.coalesce("least_overlap", F.lit(0.0)) < 0.5)).alias("mismatch"),
    )


def route_pages(signals: DataFrame) -> DataFrame:
    """signals with source_type and routing_confidence of each page."""
    kind = (
        F.when(F.col("mismatch"), "hybrid").when(F.col("hidden_overlay"), "hybrid").when(F.col("dominant") & F.col("little_text"), "scanned").when(F.col("dominant") & (F.col("n_lines") > 0), "hybrid")
        .when(F.col("n_lines") > 0, "digital").when(F.col("n_images") > 0, "scanned").otherwise("unknown")
    )
    level = (
        F.when(F.col("mismatch"), 0.6).when(F.col("hidden_overlay"), 0.9).when(F.col("dominant") & F.col("little_text"), F.when(F.col("n_lines") == 0, 0.95).otherwise(0.85)).when(F.col("dominant") & (F.col("n_lines") > 0), 0.75)
        .when(F.col("n_lines") > 0, F.when(F.col("n_images") == 0, 0.9).otherwise(0.65)).when(F.col("n_images") > 0, 0.85).otherwise(0.2)
    )
    return signals.withColumn("source_type", kind).withColumn("routing_confidence", level)


def document_source_type(routed: DataFrame) -> DataFrame:
    """doc_id, source_type, mean routing confidence (3 decimals) and the counts of pages by type."""
    n = {k: F.count(F.when(F.col("source_type") == k, 1)) for k in ("digital", "scanned", "hybrid", "unknown")}
    sums = routed.groupBy("doc_id").agg(*[v.alias(f"n_{k}") for k, v in n.items()], T.round_half_up(F.avg("routing_confidence"), 3).alias("confidence"))
    kind = F.when((F.col("n_hybrid") > 0) | ((F.col("n_digital") > 0) & (F.col("n_scanned") > 0)), "hybrid").when(F.col("n_scanned") > 0, "scanned").when(F.col("n_digital") > 0, "digital").otherwise("unknown")
    return sums.withColumn("source_type", kind)


def image_dominance_confidence(coverage, threshold: float = 0.5):
    """Confidence by the distance of the coverage from the threshold."""
    d = F.abs(coverage - threshold)
    return F.when(d >= 0.35, 0.95).when(d >= 0.2, 0.85).when(d >= 0.1, 0.7).otherwise(0.55)


def normalize_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """OCR boxes in page coordinates: text normalised, confidence in 0..1, raster boxes (y down, pixels) scaled and flipped;
    boxes without text or size go. boxes: doc_id, page_index, box_no, text, confidence, x, y, width, height, coordinate_space,
    width_px, height_px."""
    b = boxes.join(pages.select("doc_id", "page_index", "width_pt", "height_pt"), ["doc_id", "page_index"])
    raster = (F.col("coordinate_space") == "raster") & (F.col("width_px") > 0) & (F.col("height_px") > 0)
    sx, sy = F.col("width_pt") / F.col("width_px"), F.col("height_pt") / F.col("height_px")
    out = b.select(
        "doc_id", "page_index", "box_no", T.normalize_text("text").alias("text"), T.confidence_unit("confidence").alias("confidence"),
        T.round_half_up(F.when(raster, F.col("x") * sx).otherwise(F.col("x")), 6).alias("x"), T.round_half_up(F.when(raster, F.col("height_pt") - (F.col("y") + F.col("height")) * sy).otherwise(F.col("y")), 6).alias("y"),
        T.round_half_up(F.when(raster, F.col("width") * sx).otherwise(F.col("width")), 6).alias("width"), T.round_half_up(F.when(raster, F.col("height") * sy).otherwise(F.col("height")), 6).alias("height"),
    )
    return out.where((F.col("text") != "") & (F.col("width") > 0) & (F.col("height") > 0) & T.is_finite("x") & T.is_finite("y"))


def reconcile(routed: DataFrame, pdf_lines: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """Which source a page's text comes from: doc_id, page_index, n_pdf, n_ocr, selected (pdf-text, ocr, both, none), reason."""
    key = ["doc_id", "page_index"]
    p, o = pdf_lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pdf")), ocr_lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n_ocr"))
    all_pages = routed.select(*key, "source_type", "mismatch").join(p, key, "full_outer").join(o, key, "full_outer").fillna(0, ["n_pdf", "n_ocr"])
    kind = F.coalesce("source_type", F.lit("unknown"))
    pick = (
        F.when((F.col("n_pdf") == 0) & (F.col("n_ocr") == 0), "none").when(F.col("n_ocr") == 0, "pdf-text").when(F.col("n_pdf") == 0, "ocr").when(kind == "scanned", "ocr").when(kind == "digital", "pdf-text")
        .when(kind == "hybrid", F.when(F.coalesce("mismatch", F.lit(False)), "ocr").otherwise("pdf-text")).otherwise("both")
    )
    reason = (
        F.when((F.col("n_pdf") == 0) & (F.col("n_ocr") == 0), "no-text").when(F.col("n_ocr") == 0, "no-ocr-text").when(F.col("n_pdf") == 0, "no-pdf-text").when(kind == "scanned", "scanned-page").when(kind == "digital", "digital-page")
        .when(kind == "hybrid", F.when(F.coalesce("mismatch", F.lit(False)), "geometry-mismatch").otherwise("aligned-hidden-text")).otherwise("unknown-page")
    )
    return all_pages.select(*key, "n_pdf", "n_ocr", pick.alias("selected"), reason.alias("reason"))


def ocr_outside_pdf(ocr_lines: DataFrame, pdf_lines: DataFrame, share: float = 0.5) -> DataFrame:
    """The OCR lines that no reliable PDF line (visible, with text) covers by that share of the smaller of the two."""
    key = ["doc_id", "page_index"]
    reliable = pdf_lines.where((~F.col("hidden")) & (F.trim("text") != "")).select(*key, *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "width", "height")])
    common = T.overlap_area("x", "y", "width", "height", "p_x", "p_y", "p_width", "p_height") / F.least(F.col("width") * F.col("height"), F.col("p_width") * F.col("p_height"))
    o, r = ocr_lines.alias("o"), reliable.alias("r")
    return o.join(r, (F.col("o.doc_id") == F.col("r.doc_id")) & (F.col("o.page_index") == F.col("r.page_index")) & (common >= share), "left_anti")


def page_languages(pages: DataFrame, defaults: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """pages with the OCR languages of each: the last override of a page, else the defaults (trimmed, first of equals kept)."""
    base = F.array_distinct(F.array(*[F.lit(x.strip()) for x in defaults if x.strip()] or [F.lit("eng")]))
    if overrides is None:
        return pages.withColumn("languages", base)
    last = overrides.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy(F.desc("ord")))).where("_n = 1").select("doc_id", "page_index", F.array_distinct(F.filter(F.transform("languages", lambda x: F.trim(x)), lambda x: x != "")).alias("_l"))
    return pages.join(last, ["doc_id", "page_index"], "left").withColumn("languages", F.when(F.size("_l") > 0, F.col("_l")).otherwise(base)).drop("_l")


#: script -> OCR languages
SCRIPTS = {
    "latin": ["eng"], "rtl": ["ara", "heb"], "arabic": ["ara"], "hebrew": ["heb"], "cjk": ["chi_sim", "chi_tra", "jpn", "kor"], "chinese": ["chi_sim", "chi_tra"], "japanese": ["jpn"], "korean": ["kor"], "vertical": ["jpn_vert"],
}


def language_selection(languages, scripts, fallback: tuple[str, ...] = ("eng",)):
    """Languages given (trimmed; the fallback where none is), then those of the scripts hinted at, each once."""
    strip = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    own = strip(languages)
    table = F.create_map(*[y for k, v in SCRIPTS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    hinted = F.flatten(F.filter(F.transform(strip(scripts), lambda x: table[F.lower(x)]), lambda x: x.isNotNull()))
    return F.array_distinct(F.concat(F.when(F.size(own) > 0, own).otherwise(F.array(*map(F.lit, fallback))), hinted))


def preprocessing_plan(routed: DataFrame, raster: DataFrame | None = None, *, deskew: bool = True, binarize: bool = True, denoise: bool = True) -> DataFrame:
    """Operations for each page that goes to OCR (scanned or hybrid): doc_id, page_index, rotation_correction, operations, deferred, status.

    routed may have the page's rotation; raster: what raster_plan gives. Where it has the page, operations on pixels are planned; where it
    skipped the page, there are none; without it they are deferred, and the page has metadata alone."""
    named = (("estimate-deskew", deskew), ("binarize", binarize), ("denoise", denoise))
    empty = F.array().cast("array<string>")
    pixels = F.array(*[F.lit(n) for n, on in named if on]) if any(on for _, on in named) else empty
    pages = routed.where(F.col("source_type").isin("scanned", "hybrid"))
    pages = pages if "rotation" in pages.columns else pages.withColumn("rotation", F.lit(0))
    turn = F.pmod(360 - F.pmod(F.coalesce(F.col("rotation"), F.lit(0)).cast("int"), F.lit(360)), F.lit(360))
    pages = pages.join(raster.select("doc_id", "page_index", F.col("status").alias("_r")), ["doc_id", "page_index"], "left") if raster is not None else pages.withColumn("_r", F.lit(None).cast("string"))
    status = F.when(F.col("_r") == "skipped", "skipped-pixel-limit").when(F.col("_r").isNotNull(), "planned").otherwise("metadata-only")
    first = F.when(turn != 0, F.array(F.lit("normalize-page-rotation"))).otherwise(empty)
    return pages.select(
        "doc_id", "page_index", turn.alias("rotation_correction"), F.concat(first, F.when(status == "planned", pixels).otherwise(empty)).alias("operations"), F.when(status == "metadata-only", pixels).otherwise(empty).alias("deferred"), status.alias("status")
    )
