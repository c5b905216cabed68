"""Ruled tables as relations: grids of a page's rulings, and their cells with the lines in them.

A page's rulings and lines are one row that Python reads, as cells grow greedily; a page is all that is ever in it. Many pages go there
together: a call for each costs more than the work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import tasks
from . import ruled

_KEY = ["doc_id", "page_index"]


def _kinds(rulings: DataFrame) -> str:
    return ", ".join(f"{c} {rulings.schema[c].dataType.simpleString()}" for c in _KEY)


def ruled_grids(rulings: DataFrame) -> DataFrame:
    """Grids from the top of each page down: doc_id, page_index, grid_no, n_rows, n_columns, complete (every crossing is drawn), x and y
    (edges)."""

    def rows(h: list[dict], _) -> list[tuple]:
        return [(n, len(g["y"]) - 1, len(g["x"]) - 1, g["complete"], g["x"], g["y"]) for n, g in enumerate(ruled.grids(h))]

    kinds = {"grid_no": pa.int32(), "n_rows": pa.int32(), "n_columns": pa.int32(), "complete": pa.bool_(), "x": pa.list_(pa.float64()), "y": pa.list_(pa.float64())}
    return _by_page(rulings, None).mapInArrow(_run(rows, kinds), f"{_kinds(rulings)}, grid_no int, n_rows int, n_columns int, complete boolean, x array<double>, y array<double>")


_RULING, _TEXT = ("orientation", "x1", "y1", "x2", "y2"), ("line_no", "text", "x", "y", "width", "height")


def _by_page(rulings: DataFrame, lines: DataFrame | None) -> DataFrame:
    """doc_id, page_index and the rulings and lines of each page with rulings, in one exchange."""
    both = rulings.select(*_KEY, F.struct(*_RULING).alias("h"), F.lit(None).alias("l")) if lines is None else rulings.select(*_KEY, F.struct(*_RULING).alias("h"), F.lit(None).cast(lines.select(F.struct(*_TEXT)).schema[0].dataType).alias("l"))
    if lines is not None:
        both = both.unionByName(lines.select(*_KEY, F.lit(None).cast(rulings.select(F.struct(*_RULING)).schema[0].dataType).alias("h"), F.struct(*_TEXT).alias("l")))
    return both.repartition(tasks(rulings.sparkSession), *_KEY).groupBy(*_KEY).agg(F.collect_list("h").alias("h"), F.collect_list("l").alias("l")).where(F.size("h") > 0)


def _run(rows, kinds: dict):
    """A function over batches of _by_page that gives rows(rulings, lines) of each page, with its key."""

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [rows(h, l) for h, l in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                page = pa.array([k for k, r in enumerate(found) for _ in r], pa.int64())
                cols = list(zip(*(x for r in found for x in r))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(page), batch.column(1).take(page), *(pa.array(v, t) for v, t in zip(cols, kinds.values()))], names=[*_KEY, *kinds])

    return run


def ruled_cells(rulings: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of every grid: doc_id, page_index, grid_no, row_index, column_index, row_span, column_span, covered (by a cell that grew over it),
    text and line_nos. Lines without text, or not in a grid, are in no cell."""
    schema = f"{_kinds(rulings)}, grid_no int, row_index int, column_index int, row_span int, column_span int, covered boolean, text string, line_nos array<int>"

    def rows(h: list[dict], l: list[dict]) -> list[tuple]:
        texts = [x for x in l if (x["text"] or "").strip() and None not in (x["x"], x["y"], x["width"], x["height"])]
        return [
            (n, c["row"], c["column"], c["row_span"], c["column_span"], c["covered"] is not None, c["text"], [x["line_no"] for x in c["lines"]])
            for n, g in enumerate(ruled.grids(h))
            for row in ruled.fill(g, texts)
            for c in row
        ]

    kinds = dict(zip(("grid_no", "row_index", "column_index", "row_span", "column_span"), [pa.int32()] * 5)) | {"covered": pa.bool_(), "text": pa.string(), "line_nos": pa.list_(pa.int32())}
    return _by_page(rulings, lines.withColumn("line_no", F.col("line_no").cast("int"))).mapInArrow(_run(rows, kinds), schema)


def grid_summary(grids: DataFrame) -> DataFrame:
    """Per page, pages without number last: grids, complete ones, and cells."""
    return grids.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_grids"), F.count(F.when(F.col("complete"), 1)).alias("n_complete"), F.sum(F.col("n_rows") * F.col("n_columns")).alias("n_cells")).orderBy("doc_id", F.col("page_index").asc_nulls_last())


def table_of_lines(cells: DataFrame) -> DataFrame:
    """The lines that a grid's cells hold: doc_id, page_index, line_no, grid_no."""
    return cells.select(*_KEY, F.explode("line_nos").alias("line_no"), "grid_no")


def export_choice(cells: DataFrame, *, html_fallback: bool = True) -> DataFrame:
    """Per grid: whether it is worth a table (a row and two columns at least, some text), its form (html with spans or a single row, else
    gfm) and confidence."""
    each = cells.groupBy(*_KEY, "grid_no").agg(
        (F.max("row_index") + 1).alias("n_rows"), (F.max("column_index") + 1).alias("n_columns"), F.max((F.col("row_span") > 1) | (F.col("column_span") > 1)).alias("spans"), F.max(F.col("text") != "").alias("filled")
    )
    form = F.when(F.lit(html_fallback) & (F.col("spans") | (F.col("n_rows") == 1)), "html").otherwise("gfm")
    return each.select(*_KEY, "grid_no", ((F.col("n_rows") >= 1) & (F.col("n_columns") >= 2) & F.col("filled")).alias("exported"), form.alias("form"), F.when(F.col("spans"), 0.9).otherwise(0.95).alias("confidence"))
