"""Warnings and confidence of converted documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: code -> place in the result
ORDER = {
    c: k
    for k, c in enumerate(
        ["security.input_too_large", "pdf.invalid_header", "pdf.parse_failed", "security.password_required", "security.password_incorrect", "security.unsupported_encryption", "security.page_count_exceeded", "ocr.disabled", "webgpu.unavailable",
         "text.unicode_mapping_suspect", "text.ordering_uncertain", "structure.tagged_layout_conflict", "table.low_confidence", "equation.low_ocr_confidence", "figure.low_semantic_content", "security.image_pixels_exceeded",
         "text.heuristic_content_stream", "conversion.not_implemented"]
    )
}


def ordering_warnings(lines: DataFrame) -> DataFrame:
    """The first jump of each page: a line above the line just before it by more than max(6, half its size) and more than 96 aside."""
    lag = lambda c: F.lag(c).over(Window.partitionBy("doc_id").orderBy("line_no"))
    jump = (lag("page_index") == F.col("page_index")) & (F.col("y") - lag("y") > F.greatest(F.lit(6.0), 0.5 * F.col("font_size"))) & (F.abs(F.col("x") - lag("x")) > 96)
    found = lines.withColumn("_j", jump).where("_j")
    n = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("line_no"))
    return found.withColumn("_n", n).where("_n = 1").select("doc_id", F.lit("text.ordering_uncertain").alias("code"), "page_index", "line_no")


def unicode_warnings(lines: DataFrame) -> DataFrame:
    """Once per page and font that has no Unicode map and isn't trusted."""
    return lines.where("not has_to_unicode and not font_trusted").select("doc_id", F.lit("text.unicode_mapping_suspect").alias("code"), "page_index", "font_name").distinct()


def tag_conflicts(lines: DataFrame, body: DataFrame, samples: int = 5) -> DataFrame:
    """One row a document with headings' tags at odds with their lines: n_conflicts and the first lines."""
    from .blocks import tagged_heading_conflict

    why = tagged_heading_conflict(F.col("text"), F.col("font_size"), F.col("body_size"))
    hit = lines.join(body, "doc_id").where(F.col("structure_role").rlike("^H[1-6]$")).withColumn("why", why).where("why is not null")
    return hit.groupBy("doc_id").agg(F.lit("structure.tagged_layout_conflict").alias("code"), F.count(F.lit(1)).alias("n_conflicts"), F.slice(F.array_sort(F.collect_list("line_no")), 1, samples).alias("samples"))


def all_warnings(parts: list[DataFrame]) -> DataFrame:
    """doc_id, ord, code of every warning in the order of the result."""
    place = F.create_map(*[x for c, k in ORDER.items() for x in (F.lit(c), F.lit(k))])
    rows = reduce(DataFrame.unionByName, [p.select("doc_id", "code", *[F.col(c) if c in p.columns else F.lit(None).cast("int").alias(c) for c in ("page_index", "line_no")]) for p in parts])
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(place[F.col("code")], F.lit(len(ORDER))), F.col("page_index").asc_nulls_first(), F.col("line_no").asc_nulls_first())
    return rows.withColumn("ord", F.row_number().over(order) - 1).select("doc_id", "ord", "code", "page_index", "line_no")


def confidence_columns() -> list[Column]:
    """overall, text, layout and tables of a document (n_pdf_lines, ocr_confidence, n_layout_pages, table_confidence)."""
    pdf = F.col("n_pdf_lines") > 0
    return [
        F.when(pdf | F.col("ocr_confidence").isNotNull(), 0.25).otherwise(0.0).alias("overall"), F.when(pdf, 0.4).otherwise(F.coalesce(T.confidence_unit("ocr_confidence"), F.lit(0.0))).alias("text"),
        F.when(F.col("n_layout_pages") > 0, 0.35).otherwise(0.0).alias("layout"), F.coalesce(T.round_half_up("table_confidence", 3), F.lit(0.0)).alias("tables"),
    ]


def confidence(documents: DataFrame) -> DataFrame:
    """doc_id and confidence_columns of documents."""
    return documents.select("doc_id", *confidence_columns())


def extraction_mode(documents: DataFrame) -> DataFrame:
    """documents (doc_id, n_pdf_lines, n_ocr_lines) with mode: pdf-text, ocr, hybrid or none."""
    p, o = F.col("n_pdf_lines") > 0, F.col("n_ocr_lines") > 0
    return documents.withColumn("mode", F.when(p & o, "hybrid").when(p, "pdf-text").when(o, "ocr").otherwise("none"))
