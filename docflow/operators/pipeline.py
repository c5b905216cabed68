"""Whole conversion: parsed files, with OCR results where there are any, to Markdown and what goes with it."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as T
from ..shared import saved, spread_evenly
from ..sources.pdf.document import Limits
from ..sources.pdf.reader import RELATIONS, SCHEMA, parse_file, relation
from . import ocr as O
from . import warnings as W
from .convert import convert

_LINE = S.StructType([*RELATIONS["lines"].fields])
RESULT = (
    "doc_id string, markdown string, blocks array<struct<block_no:int,kind:string,text:string,page_index:int,md_start:int,md_end:int>>, "
    "regions array<struct<md_start:int,md_end:int,kind:string,page_index:int,x:double,y:double,width:double,height:double>>, "
    "tables array<struct<page_index:int,kind:string,confidence:double,rows:int,columns:int>>, figures array<struct<page_index:int,figure_no:int,number:int,kind:string,x:double,y:double,width:double,height:double>>, "
    "assets array<struct<asset_id:string,path:string,page_index:int,content:string>>, warnings array<struct<code:string,page_index:int,line_no:int>>"
)


def ocr_lines(parsed: DataFrame, boxes: DataFrame) -> DataFrame:
    """OCR boxes as lines of the line relation, numbered after the file's own."""
    pages = relation(parsed, "pages").select("doc_id", "page_index", "width_pt", "height_pt")
    n = O.normalize_boxes(boxes, pages)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "box_no"))
    given = {"line_no": (F.lit(1_000_000) + number).cast("int"), "font_size": F.col("height"), "font_trusted": F.lit(True), "has_to_unicode": F.lit(False), "source": F.lit("ocr"), "direction": T.direction("text"), "hidden": F.lit(False)}
    cols = [given[f.name].cast(f.dataType).alias(f.name) if f.name in given else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in n.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _LINE]
    return n.select("doc_id", *cols)


def select_lines(parsed: DataFrame, boxes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines that each page's text is taken from, and the pages' routing. Hybrid pages keep their visible PDF lines and take
    the OCR lines that those don't cover."""
    pages, lines, images = (relation(parsed, n) for n in ("pages", "lines", "images"))
    routed = O.route_pages(O.scan_signals(pages, lines, images))
    if boxes is None:
        return lines, routed
    ocr = ocr_lines(parsed, boxes)
    choice = O.reconcile(routed, lines, ocr).join(routed.select("doc_id", "page_index", "source_type", "mismatch"), ["doc_id", "page_index"], "left")
    pick = F.when((F.col("source_type") == "hybrid") & (F.col("n_pdf") > 0) & (F.col("n_ocr") > 0), "mixed").otherwise(F.col("selected"))
    choice = choice.select("doc_id", "page_index", pick.alias("pick"), F.coalesce("mismatch", F.lit(False)).alias("mismatch"))
    key = ["doc_id", "page_index"]
    boxes_of = relation(parsed, "images").select(*key, F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("width").alias("iw"), F.col("height").alias("ih"))
    share = T.overlap_area("x", "y", "width", "height", "ix", "iy", "iw", "ih") / (F.col("width") * F.col("height"))
    met = lines.where("hidden").join(boxes_of, key, "left").groupBy("doc_id", "line_no").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("met"))
    # a hidden line that lies on an image is trusted; one that doesn't isn't
    own = lines.join(met, ["doc_id", "line_no"], "left").join(choice, key, "left")
    reliable = ~F.col("hidden") | (F.coalesce("met", F.lit(0.0)) >= 0.5)
    pdf = own.where(F.coalesce("pick", F.lit("pdf-text")).isin("pdf-text", "both") | ((F.col("pick") == "mixed") & reliable)).select("doc_id", *_LINE.names)
    trusted = own.where((F.col("pick") == "mixed") & reliable).withColumn("hidden", F.lit(False)).select("doc_id", *_LINE.names)
    mixed = ocr.join(choice.where("pick = 'mixed'").select(*key), key, "left_semi")
    extra = O.ocr_outside_pdf(mixed, trusted)
    plain = ocr.join(choice.where("pick in ('ocr', 'both')").select(*key), key, "left_semi")
    return pdf.unionByName(plain).unionByName(extra.select("doc_id", *_LINE.names)), routed


_FACTS = "n_pdf_lines long, n_ocr_lines long, ocr_confidence double, n_layout_pages long, table_confidence double"


def _source_type(pages: list[dict], lines: list[dict], images: list[dict]) -> str:
    """document_source_type(route_pages(scan_signals(..))) of one document, for rows that are in Python anyway."""
    found = set()
    for page in pages:
        n, area = page["page_index"], (page["width_pt"] or 0) * (page["height_pt"] or 0)
        drawn = [i for i in images if i["page_index"] == n]
        shown = [x for x in lines if x["page_index"] == n and not x["hidden"]]
        if not drawn:
            found.add("digital" if shown else "unknown")
            continue
        hidden = [x for x in lines if x["page_index"] == n and x["hidden"]]
        coverage = math.floor(min(sum(i["area"] for i in drawn) / area, 1.0) * 1000.0 + 0.5) / 1000.0 if area > 0 else 0.0
        ratio = sum(x["width"] * x["height"] for x in shown) / area if area > 0 else 0.0
        if coverage < 0.5:
            found.add("digital" if shown else "scanned")
        elif hidden:
            found.add("hybrid")  # aligned with the image or not
        elif len(shown) < 3 and ratio < 0.01:
            found.add("scanned")
        else:
            found.add("hybrid" if shown else "scanned")
    return "hybrid" if "hybrid" in found or {"digital", "scanned"} <= found else "scanned" if "scanned" in found else "digital" if "digital" in found else "unknown"


def _read(row: dict, options: dict) -> dict:
    """RESULT and _FACTS of a document's relations (parse_warnings: those of the parser)."""
    lines = row["lines"] or []
    c = convert(lines, row["rulings"] or [], row["images"] or [], row["outlines"] or [], **options)
    ws = [{"code": w["code"], "page_index": w["page_index"], "line_no": None} for w in row["parse_warnings"] or []]
    fonts = {(x["page_index"], x["font_name"]) for x in lines if x["source"] != "ocr" and not x["has_to_unicode"] and not x["font_trusted"]}
    ws += [{"code": "text.unicode_mapping_suspect", "page_index": p, "line_no": None} for p, _ in sorted(fonts, key=str)] + c["warnings"]
    ws.append({"code": "text.heuristic_content_stream" if lines else "conversion.not_implemented", "page_index": None, "line_no": None})
    ws.sort(key=lambda w: W.ORDER.get(w["code"], len(W.ORDER)))
    ocr = [x for x in lines if x["source"] == "ocr"]
    scores = [x["confidence"] for x in ocr if x["confidence"] is not None]
    return {
        "doc_id": row["doc_id"], "markdown": c["markdown"], "blocks": [{k: b.get(k) for k in ("block_no", "kind", "text", "page_index", "md_start", "md_end")} for b in c["blocks"]],
        "regions": [{"md_start": m["md_start"], "md_end": m["md_end"], "kind": m["kind"], **r} for m in c["source_map"] for r in m["regions"]],
        "tables": [{"page_index": t["page_index"], "kind": t["kind"], "confidence": t["confidence"], "rows": len(t["cells"]), "columns": len(t["cells"][0])} for t in c["tables"]],
        "figures": [{k: f[k] for k in ("page_index", "figure_no", "number", "kind", "x", "y", "width", "height")} for f in c["figures"]], "assets": c["csv"], "warnings": ws,
        "n_pdf_lines": len(lines) - len(ocr), "n_ocr_lines": len(ocr), "ocr_confidence": sum(scores) / len(scores) if scores else None, "n_layout_pages": len({x["page_index"] for x in lines if x["page_index"] is not None}),
        "table_confidence": sum(t["confidence"] for t in c["tables"]) / len(c["tables"]) if c["tables"] else None,
    }


def _with_confidence(done: DataFrame) -> DataFrame:
    return W.extraction_mode(done).withColumn("confidence", F.struct(*W.confidence_columns())).drop("n_pdf_lines", "n_ocr_lines", "ocr_confidence", "n_layout_pages", "table_confidence")


def convert_built(rows: DataFrame, build, *, keep: tuple[str, ...] = (), tolerant: bool = False, limits: Limits | None = None, **options) -> DataFrame:
    """What parse_files and convert_documents give, for the files that build(*values) makes of rows, each built, read and converted once, where it is; no
    file or relation is sent on, written or shuffled. One row for every file, of equal files too: path (the first column), what is kept of the
    reader's SCHEMA, RESULT, mode, confidence and source_type."""
    result = S.StructType([S.StructField("path", S.StringType()), *[SCHEMA[k] for k in keep], *S.StructType.fromDDL(RESULT + ", " + _FACTS + ", source_type string")])
    arrow = to_arrow_schema(result)

    def run(it):
        out, size = [], 0
        for batch in it:
            for path, *rest in zip(*batch.columns):
                path = path.as_py()
                raw = build(path, *(x.as_py() for x in rest))
                parsed = parse_file(raw, tolerant=tolerant, limits=limits) | {"doc_id": hashlib.sha256(raw).hexdigest()}
                out.append({k: parsed[k] for k in keep} | _read(parsed | {"parse_warnings": parsed["warnings"]}, options) | {"path": str(path), "source_type": _source_type(parsed["pages"], parsed["lines"], parsed["images"])})
                size += len(raw) + len(out[-1]["markdown"])
                if size > 4 << 20 or len(out) == 64:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _with_confidence(spread_evenly(rows).mapInArrow(run, result))


def convert_documents(parsed: DataFrame, boxes: DataFrame | None = None, *, parsed_to: str | None = None, **options) -> DataFrame:
    """One row for each distinct file content: RESULT, and source_type, mode and confidence; by_path gives one for each file.

    The parsed files are written to parsed_to (by default a new table in the shared folder), so that each file is parsed once; it
    may be removed when the result has been read. With OCR boxes pages are routed and lines chosen by joins; the blocks of a document are
    read from its lines by one Python function, once, which routes the pages, too, where there are no boxes."""
    parsed = saved(parsed.dropDuplicates(["doc_id"]), "parsed_files", parsed_to)
    rest = parsed.select("doc_id", "pages", "lines", "rulings", "images", "outlines", F.col("warnings").alias("parse_warnings"))
    kinds = None
    if boxes is not None:
        lines, routed = select_lines(parsed, boxes)
        kinds = O.document_source_type(routed).select("doc_id", F.col("source_type").alias("routed_type"))
        per_doc = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*_LINE.names))).alias("lines"))
        rest = rest.drop("lines").join(per_doc, "doc_id", "left").select(*rest.columns)
    result = S.StructType.fromDDL(RESULT + ", " + _FACTS + ", source_type string")
    arrow = to_arrow_schema(result)

    def run(it):
        for batch in it:
            rows, size = [], 0
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows.append(_read(row, options) | {"source_type": _source_type(row["pages"] or [], row["lines"] or [], row["images"] or [])})
                size += len(rows[-1]["markdown"])
                if size > 4 << 20 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0

    done = _with_confidence(rest.mapInArrow(run, result))
    names = [f.name for f in S.StructType.fromDDL(RESULT)]
    if kinds is not None:  # of the file's own lines, not of those that were chosen
        done = done.drop("source_type").join(kinds, "doc_id", "left").withColumn("source_type", F.coalesce("routed_type", F.lit("unknown")))
    return done.select(*names, "confidence", "mode", "source_type")


def by_path(converted: DataFrame, parsed: DataFrame) -> DataFrame:
    """path and the result of every file: files of equal content share one."""
    return parsed.select("doc_id", "path").join(converted, "doc_id")


def document_ir(converted: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """doc_id and the nested representation as JSON: pages, each with its elements: text and tables in order, equations, figures,
    and, of the parsed files where they are given, form fields and annotations. A block without a page is left out."""
    b, f = F.col("b"), F.col("f")
    none = lambda kind: F.lit(None).cast(kind)
    box = lambda c: F.struct(*[c[k].alias(k) for k in ("x", "y", "width", "height")])
    kind = "struct<x:double,y:double,width:double,height:double>"
    each = converted.select("doc_id", F.explode("blocks").alias("b")).where("b.page_index is not null and b.kind != 'figure'").select(
        "doc_id", b["page_index"].alias("pageIndex"), F.when(b["kind"] == "equation", 1).otherwise(0).alias("part"), b["block_no"].alias("order"),
        F.when(b["kind"].isin("table", "equation"), b["kind"]).otherwise("text").alias("type"), b["kind"].alias("kind"), b["text"].alias("text"), none(kind).alias("region"),
    )
    figures = converted.select("doc_id", F.explode("figures").alias("f")).select("doc_id", f["page_index"], F.lit(2), f["figure_no"], F.lit("figure"), f["kind"], F.concat(F.lit("Figure "), f["number"].cast("string")), box(f))
    each = each.union(figures)
    if parsed is not None:
        fields = relation(parsed.dropDuplicates(["doc_id"]), "form_fields").where("page_index is not null")
        notes = relation(parsed.dropDuplicates(["doc_id"]), "annotations")
        each = each.union(fields.select("doc_id", "page_index", F.lit(3), "field_no", F.lit("form"), "type", F.concat_ws("=", "name", F.coalesce("value", "state")), none(kind)))
        r = F.col("rect")
        region = F.when(r.isNotNull(), F.struct(F.least(r[0], r[2]).alias("x"), F.least(r[1], r[3]).alias("y"), F.abs(r[2] - r[0]).alias("width"), F.abs(r[3] - r[1]).alias("height")))
        each = each.union(notes.select("doc_id", "page_index", F.lit(4), "annotation_no", F.lit("annotation"), "subtype", F.coalesce("uri", "contents"), region))
    pages = each.groupBy("doc_id", "pageIndex").agg(F.array_sort(F.collect_list(F.struct("part", "order", "type", "kind", "text", "region"))).alias("elements"))
    pages = pages.withColumn("elements", F.transform("elements", lambda e: F.struct(e["type"].alias("type"), e["kind"].alias("kind"), e["text"].alias("text"), e["region"].alias("region"))))
    whole = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pageIndex", "elements"))).alias("pages")).join(converted.select("doc_id", "source_type"), "doc_id")
    return whole.select("doc_id", F.to_json(F.struct(F.lit("0.1.0").alias("schemaVersion"), F.col("source_type").alias("sourceType"), "pages")).alias("ir"))


def output_hash(converted: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of what a conversion gave, in a fixed order of keys."""
    return converted.select("doc_id", F.sha2(F.to_json(F.struct("assets", "blocks", "figures", "markdown", "tables", "warnings")), 256).alias("output_sha256"))
