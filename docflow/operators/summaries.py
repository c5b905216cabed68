"""Counts for reports: rulings, grids, tables, forms, structure roles; plans that only describe; sidebars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import multiset_match


def ruling_summary(rulings: DataFrame) -> DataFrame:
    """Per page, pages without number last: horizontal, vertical and merged rulings."""
    return rulings.groupBy("doc_id", "page_index").agg(F.count(F.when(F.col("orientation") == "h", 1)).alias("n_horizontal"), F.count(F.when(F.col("orientation") == "v", 1)).alias("n_vertical"), F.count(F.when(F.col("segment_count") > 1, 1)).alias("n_merged")).orderBy("doc_id", F.col("page_index").asc_nulls_last())


def table_summary(converted: DataFrame) -> DataFrame:
    """Per document: ruled and borderless tables, mean confidence (3 decimals), pages with tables."""
    t = converted.select("doc_id", F.explode("tables").alias("t"))
    return t.groupBy("doc_id").agg(F.count(F.when(F.col("t.kind") == "ruled", 1)).alias("n_ruled"), F.count(F.when(F.col("t.kind") == "borderless", 1)).alias("n_borderless"), T.round_half_up(F.avg("t.confidence"), 3).alias("confidence"), F.count_distinct("t.page_index").alias("n_pages"))


def block_summary(converted: DataFrame) -> DataFrame:
    """Per document: how many blocks of each kind, as a map."""
    kinds = converted.select("doc_id", F.explode("blocks.kind").alias("kind")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def role_summary(lines: DataFrame) -> DataFrame:
    """Per document: how many lines have each structure role, as a map."""
    roles = lines.where("structure_role is not null").groupBy("doc_id", "structure_role").agg(F.count(F.lit(1)).alias("n"))
    return roles.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("structure_role", "n")))).alias("roles"))


def form_summary(fields: DataFrame) -> DataFrame:
    """Per document: fields, filled ones, checked boxes, signatures (never validated here)."""
    return fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count(F.when(F.coalesce("value", F.lit("")) != "", 1)).alias("n_filled"), F.count(F.when(F.col("checked"), 1)).alias("n_checked"), F.count(F.when(F.col("type") == "signature", 1)).alias("n_signatures"))


def annotation_summary(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("doc_id", "page_index").agg(F.count(F.when(F.col("subtype") == "Link", 1)).alias("n_links"), F.count(F.when(F.col("subtype") == "Text", 1)).alias("n_notes"))


def marked_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """lines with role and path of their marked content (doc_id, page_index, mcid, ord, role, path); a later mark counts."""
    last = marks.groupBy("doc_id", "page_index", "mcid").agg(F.max_by(F.struct("role", "path"), "ord").alias("m"))
    return lines.drop("structure_role", "structure_path").join(last, ["doc_id", "page_index", "mcid"], "left").withColumn("structure_role", F.col("m.role")).withColumn("structure_path", F.col("m.path")).drop("m")


def sidebar_regions(lines: DataFrame, share: float = 0.45) -> DataFrame:
    """Columns of a page that hold at most that share of its widest column's lines: doc_id, page_index, column_no, n_lines and box.
    lines: as layout.reading_order gives them."""
    cols = lines.groupBy("doc_id", "page_index", "column_no").agg(F.count(F.lit(1)).alias("n_lines"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
    most = F.max("n_lines").over(Window.partitionBy("doc_id", "page_index"))
    return cols.withColumn("most", most).where(F.col("n_lines") <= share * F.col("most")).drop("most")


def coalesced_spans(spans: DataFrame) -> DataFrame:
    """Neighbouring spans of a line (doc_id, line_no, span_no, text, font_name, direction, source, x, width, font_size) of the same
    font, direction and source whose gap is at most max(.5, a tenth of the size), as one."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("span_no")
    lag = lambda c: F.lag(c).over(w)
    same = (lag("font_name").eqNullSafe(F.col("font_name"))) & (lag("direction") == F.col("direction")) & (lag("source") == F.col("source")) & (F.abs(F.col("x") - lag("x") - lag("width")) <= F.greatest(F.lit(0.5), 0.1 * F.col("font_size")))
    runs = spans.withColumn("run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "line_no", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("text"), F.min_by("font_name", "span_no").alias("font_name"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width")
    )


def alt_text(x):
    """Alternative text: white space collapsed, at most 240 characters; null if empty."""
    t = T.collapse(x)
    return F.when(t != "", F.substring(t, 1, 240))


def ocr_plan(pages_with_languages: DataFrame, *, adapter: str = "tesseract.js", base_url: str | None = None) -> DataFrame:
    """Per language: the model file an adapter would load, and for how many pages. Nothing is loaded."""
    each = pages_with_languages.select(F.explode("languages").alias("language"))
    return each.groupBy("language").agg(F.count(F.lit(1)).alias("n_pages")).select("language", "n_pages", F.lit(adapter).alias("adapter"), F.concat(F.lit(base_url or "adapter-default"), F.lit("/"), F.col("language"), F.lit(".traineddata")).alias("model"))


def span_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Precision, recall and f1 of cells (table_id, row_index, column_index, text, row_span, column_span) as a multiset, per table."""
    keys = ["row_index", "column_index", "text", "row_span", "column_span"]
    count = lambda d: d.withColumn("text", F.lower(T.collapse("text"))).groupBy("table_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    return multiset_match(count(expected), count(actual), ["table_id"], keys)


def tagged_gate(lines: DataFrame, *, min_marked: int = 1, max_conflicts: int = 0) -> DataFrame:
    """Per document: marked lines, conflicts of tagged headings, and whether both are within bounds."""
    from .blocks import dominant_font_size, tagged_heading_conflict

    why = tagged_heading_conflict(F.col("text"), F.col("font_size"), F.col("body_size"))
    sums = lines.join(dominant_font_size(lines), "doc_id").groupBy("doc_id").agg(F.count(F.when(F.col("mcid").isNotNull(), 1)).alias("n_marked"), F.count(F.when(F.col("structure_role").rlike("^H[1-6]$") & why.isNotNull(), 1)).alias("n_conflicts"))
    return sums.withColumn("passed", (F.col("n_marked") >= min_marked) & (F.col("n_conflicts") <= max_conflicts))
