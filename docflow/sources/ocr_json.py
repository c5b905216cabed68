"""OCR results supplied as JSON, and CSV sidecars read back."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "text string, confidence double, direction string, x double, y double, left double, top double, right double, bottom double, x0 double, y0 double, x1 double, y1 double, width double, height double, bbox struct<x:double,y:double,left:double,top:double,right:double,bottom:double,x0:double,y0:double,x1:double,y1:double,width:double,height:double>"

def _schema() -> str:
    item = "struct<" + ",".join(":".join(x.split(" ", 1)) for x in _split(_ITEM)) + ">"
    page = f"pageIndex:int,language:string,coordinateSpace:string,widthPx:double,heightPx:double,boxes:array<{item}>,lines:array<{item}>,words:array<{item}>"
    return f"doc_id string, schemaVersion int, source string, results array<struct<{page}>>"


def _split(spec: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(spec):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(spec[at:i].strip())
            at = i + 1
    return [*out, spec[at:].strip()]


def read_ocr_results(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Boxes of JSON files of OCR results (one object a file, or a line without multi_line, with the doc_id it belongs to): the box relation that
    operators.ocr.normalize_boxes takes. A page's boxes count, else its lines, else its words; of several results for a
    page the last one counts; corners may be given under several names."""
    raw = spark.read.schema(_schema()).option("multiLine", str(multi_line).lower()).json(path)
    pages = raw.select("doc_id", F.posexplode("results").alias("ord", "r"))
    last = pages.groupBy("doc_id", F.col("r.pageIndex").alias("page_index")).agg(F.max_by("r", "ord").alias("r"))
    filled = lambda c: F.when(F.size(F.col(f"r.{c}")) > 0, F.col(f"r.{c}"))
    each = last.select("doc_id", "page_index", "r.language", F.coalesce("r.coordinateSpace", F.lit("page")).alias("coordinate_space"), F.col("r.widthPx").alias("width_px"), F.col("r.heightPx").alias("height_px"), F.posexplode(F.coalesce(filled("boxes"), filled("lines"), filled("words"))).alias("box_no", "b"))
    either = lambda *names: F.coalesce(*[F.col(f"b.{n}") for n in names], *[F.col(f"b.bbox.{n}") for n in names])
    x, y = either("x", "left", "x0"), either("y", "top", "y0")
    return each.select(
        "doc_id", "page_index", "box_no", "language", "coordinate_space", F.col("b.text").alias("text"), F.col("b.confidence").alias("confidence"), F.col("b.direction").alias("direction"), x.alias("x"), y.alias("y"),
        F.coalesce(either("width"), either("right", "x1") - x).alias("width"), F.coalesce(either("height"), F.abs(either("bottom", "y1") - y)).alias("height"), "width_px", "height_px",
    )


def parse_csv(text: str) -> list[list[str]]:
    """Rows of a CSV sidecar; a quoted cell may hold line feeds."""
    return list(csv.reader(io.StringIO(text, newline="")))


def csv_cells(tables: DataFrame) -> DataFrame:
    """table_id, row_index, column_index, text of CSV texts (table_id, csv), formula guards taken off."""
    import pandas as pd

    def run(it):
        for pdf in it:
            rows = [(t, r, c, v[1:] if v[:1] == "'" and v[1:2] in tuple("=+-@") else v) for t, x in zip(pdf["table_id"], pdf["csv"]) for r, row in enumerate(parse_csv(x or "")) for c, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=["table_id", "row_index", "column_index", "text"])

    return tables.select("table_id", "csv").mapInPandas(run, f"table_id {tables.schema['table_id'].dataType.simpleString()}, row_index int, column_index int, text string")
