"""The line relation: one row per text line, with geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_PER_PAGE, LEFT, TOP, LEADING, SIZE = 46, 72.0, 720.0, 14.0, 12.0


def lines_from_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of plain texts, laid out on pages of 46 lines: doc_id, line_no, page_index, text, x, y, width, height,
    font_size. A null text has no lines; an empty one has one, empty.

    Whole texts are shuffled by id before they are cut, so that windows and groups by document need no shuffle of lines."""
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    cut = whole.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    row = F.pmod(F.col("line_no"), F.lit(LINES_PER_PAGE))
    return cut.select(
        "doc_id", "line_no", F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_index"), "text",
        F.lit(LEFT).alias("x"), (F.lit(TOP) - F.lit(LEADING) * row).alias("y"), (6.0 * F.length("text")).alias("width"), F.lit(SIZE).alias("height"), F.lit(SIZE).alias("font_size"),
    )


def lines_from_html(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The same relation of web pages, one line per closed block element, without their tags."""
    flat = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b[^>]*>.*?</\1>|\n", " ")
    blocks = F.regexp_replace(flat, r"(?i)</(?:p|h[1-6]|li|div|tr|nav|footer|article|title)>|<br\s*/?>", "\n")
    text = F.array_join(F.filter(F.transform(F.split(blocks, "\n"), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))), lambda t: t != ""), "\n")
    return lines_from_documents(pages.select(F.col(id_col).alias("doc_id"), text.alias("text")))
