"""Convert PDF files: python -m docflow INPUT [--output FOLDER] [--json] [--tolerant] [--password P] [--page-anchors] [--debug-trace FOLDER]"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docflow", description="Convert PDF files to Markdown.", allow_abbrev=False)
    p.add_argument("input", help="a file or folder")
    p.add_argument("--output", help="folder for <doc_id>.md; else Markdown goes to standard output")
    p.add_argument("--json", action="store_true", help="whole results, a line of JSON each, instead of Markdown")
    p.add_argument("--tolerant", action="store_true", help="repair damaged files")
    p.add_argument("--password", help="of encrypted files")
    p.add_argument("--page-anchors", action="store_true")
    p.add_argument("--debug-trace", help="folder for a trace: a line of JSON a document, without texts or secrets")
    p.add_argument("--ocr-results", help="JSON file or folder of OCR results")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.pipeline import convert_documents
    from .sources import ocr_json, sinks
    from .sources.pdf.reader import files, parse_files

    spark = SparkSession.builder.appName("docflow").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    binary = files(spark, a.input)
    parsed = parse_files(binary, password=a.password, tolerant=a.tolerant)
    boxes = ocr_json.read_ocr_results(spark, a.ocr_results) if a.ocr_results else None
    out = convert_documents(parsed, boxes, page_anchors=a.page_anchors)
    if a.debug_trace:
        from .operators.checks import sanitized_trace

        options = F.struct(F.lit(a.tolerant).alias("tolerant"), F.lit(a.page_anchors).alias("pageAnchors"), F.lit(a.password is not None).alias("passwordProvided"), F.lit(a.password).alias("password"))
        event = F.struct(F.lit("document").alias("event"), F.col("doc_id").alias("docId"), "mode", F.col("source_type").alias("sourceType"), "confidence", F.size("blocks").alias("blocks"), F.size("tables").alias("tables"), F.col("warnings.code").alias("warnings"), options.alias("options"))
        sanitized_trace(out.select(F.to_json(event).alias("json"))).write.mode("overwrite").text(a.debug_trace)
    if a.output and not a.json:
        sinks.write_markdown(out, a.output)
    elif a.output:
        out.select(F.to_json(F.struct(*out.columns)).alias("value")).write.mode("overwrite").text(a.output)
    else:
        rows = out.select(F.to_json(F.struct(*out.columns)).alias("v")) if a.json else out.select(F.col("markdown").alias("v"))
        for r in rows.toLocalIterator():
            sys.stdout.write(r.v if not a.json else r.v + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
