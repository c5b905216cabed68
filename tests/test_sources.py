"""OCR files, sinks, summaries, acceptance, streaming and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docflow.operators import acceptance, pipeline, summaries
from docflow.sources import ocr_json, sinks
from docflow.sources.pdf import reader
from docflow.sources.pdf.writer import text_pdf

PDF = text_pdf([[(72, 720, 22, "Title"), (72, 690, 12, "Some text."), (72, 660, 12, "- item"), (72, 630, 12, "More of it.")]])


@pytest.fixture(scope="module")
def parsed(spark):
    return reader.parse_files(spark.createDataFrame([("a.pdf", bytearray(PDF))], "path string, content binary"))


@pytest.fixture(scope="module")
def converted(parsed):
    return pipeline.convert_documents(parsed).persist()


def test_ocr_results(spark, tmp_path):
    page = {"pageIndex": 0, "coordinateSpace": "raster", "widthPx": 1224, "heightPx": 1584}
    body = {"doc_id": "d", "results": [{**page, "lines": [{"text": "old"}]}, {**page, "words": [{"text": "w", "bbox": {"x0": 10, "y0": 20, "x1": 30, "y1": 60}, "confidence": 0.9}], "boxes": []}, {"pageIndex": 1, "boxes": [{"text": "b", "left": 1, "top": 2, "width": 3, "height": 4, "confidence": 88}]}]}
    (tmp_path / "r.json").write_text(json.dumps(body))
    got = sorted((r.page_index, r.text, r.x, r.y, r.width, r.height, r.coordinate_space) for r in ocr_json.read_ocr_results(spark, str(tmp_path)).collect())
    assert got == [(0, "w", 10, 20, 20, 40, "raster"), (1, "b", 1, 2, 3, 4, "page")]


def test_csv_cells(spark):
    t = spark.createDataFrame([(1, 'a,"b\nc",\'=1\n"""",x,-2\n'), (2, None)], "table_id long, csv string")
    assert [(r.row_index, r.column_index, r.text) for r in ocr_json.csv_cells(t).orderBy("row_index", "column_index").collect()] == [(0, 0, "a"), (0, 1, "b\nc"), (0, 2, "=1"), (1, 0, '"'), (1, 1, "x"), (1, 2, "-2")]


def test_sinks(spark, converted, tmp_path):
    sinks.write_markdown(converted, str(tmp_path / "md"))
    (file,) = (tmp_path / "md").glob("*.md")
    assert file.read_text() == "# Title\n\nSome text.\n\n- item\n\nMore of it.\n"
    assert sinks.html_documents(converted).first().html == "<h1>Title</h1>\n<p>Some text.</p>\n<ul><li>item</li></ul>\n<p>More of it.</p>"
    assert sinks.render_html("| a \\| b | c |\n| --- | ---: |\n| 1 | 2 |\n\n```\nx < y\n```\n\n\\# no") == "<table><tr><th>a | b</th><th>c</th></tr><tr><td>1</td><td>2</td></tr></table>\n<pre><code>x &lt; y</code></pre>\n<p># no</p>"
    a = spark.createDataFrame([("d", 0, "../x y.txt", None, bytearray(b"1")), ("d", 1, "x-y.txt", None, bytearray(b"2")), ("d", 2, "...", None, None)], "doc_id string, attachment_no int, name string, media_type string, content binary")
    got = {r.asset_id: (r.path, r.content) for r in sinks.attachment_assets(a).collect()}
    assert got == {"attachment-1-x-y-txt": ("assets/attachments/x-y.txt", "MQ=="), "attachment-2-x-y-txt": ("assets/attachments/x-y-2.txt", "Mg=="), "attachment-3-attachment": ("assets/attachments/attachment", None)}
    boxes = spark.createDataFrame([("d", 0, 0, "t", 0.5, 1.0, 2.0, 3.0, 4.0)], "doc_id string, page_index int, box_no int, text string, confidence double, x double, y double, width double, height double")
    assert json.loads(sinks.ocr_debug_assets(boxes).first().content) == {"pageIndex": 0, "boxes": [{"text": "t", "confidence": 0.5, "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}]}


def test_output_hash_and_ir(converted):
    assert len(pipeline.output_hash(converted).first().output_sha256) == 64
    ir = json.loads(pipeline.document_ir(converted).first().ir)
    assert ir["sourceType"] == "digital" and [e["kind"] for e in ir["pages"][0]["elements"]] == ["heading", "paragraph", "list", "paragraph"]


def test_summaries(spark, parsed, converted):
    assert dict(summaries.block_summary(converted).first().kinds) == {"heading": 1, "list": 1, "paragraph": 2}
    lines = reader.relation(parsed, "lines")
    assert not summaries.tagged_gate(lines).first().passed and summaries.table_summary(converted).count() == 0
    marks = spark.createDataFrame([("d", 0, 0, 0, "P", ["P"]), ("d", 0, 0, 1, "H1", ["H1"])], "doc_id string, page_index int, mcid int, ord int, role string, path array<string>")
    assert summaries.marked_lines(spark.createDataFrame([("d", 0, 0, None, None)], "doc_id string, page_index int, mcid int, structure_role string, structure_path array<string>"), marks).first().structure_role == "H1"
    spans = spark.createDataFrame([("d", 0, i, t, f, "ltr", "pdf-text", x, 10.0, 12.0) for i, t, f, x in ((0, "a", "F", 0.0), (1, "b", "F", 10.4), (2, "c", "G", 20.0), (3, "d", "G", 40.0))], "doc_id string, line_no int, span_no int, text string, font_name string, direction string, source string, x double, width double, font_size double")
    assert [r.text for r in summaries.coalesced_spans(spans).orderBy("run").collect()] == ["ab", "c", "d"]
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, page_index int")
    from docflow.operators import ocr

    over = spark.createDataFrame([("d", 1, 0, ["fra"]), ("d", 1, 1, [" deu ", "eng", "deu"])], "doc_id string, page_index int, ord int, languages array<string>")
    langs = ocr.page_languages(pages, ["eng"], over)
    assert {r.page_index: r.languages for r in langs.collect()} == {0: ["eng"], 1: ["deu", "eng"]}
    assert {r.language: r.n_pages for r in summaries.ocr_plan(langs).collect()} == {"eng": 2, "deu": 1}
    cells = spark.createDataFrame([(1, 0, 0, "A", 1, 2), (1, 1, 0, "b", 1, 1)], "table_id int, row_index int, column_index int, text string, row_span int, column_span int")
    assert summaries.span_accuracy(cells, cells.withColumn("column_span", F.lit(1))).first().f1 == 0.5


def test_acceptance(spark, parsed, converted):
    text = 'id: a\ngate: text-mvp\nexpectedMode: pdf-text\nmust:\n  - extract_title\n  - extract_bullet_list # yes\n  - no_such_label\nmustNot:\n  - emit_empty_markdown\nmetrics:\n  minTextCoverage: 0.98\nsnippets:\n  - page: 1\n    contains: "Some: text"\nstructure:\n  expected:\n    - heading_level_1\n'
    case = acceptance.parse_acceptance(text)
    assert case["must"] == ["extract_title", "extract_bullet_list", "no_such_label"] and case["metrics"] == {"minTextCoverage": 0.98} and case["snippets"] == [{"page": 1, "contains": "Some: text"}] and case["structure"] == {"expected": ["heading_level_1"]}
    seen = acceptance.observed_features(parsed, converted)
    results = converted.join(parsed.select("doc_id", "parse_mode", "form_fields"), "doc_id").join(seen, "doc_id")
    doc = results.first().doc_id
    cases = spark.createDataFrame([(doc, case["must"], case["mustNot"], case["structure"]["expected"], case["expectedMode"])], "doc_id string, must array<string>, must_not array<string>, structure array<string>, expected_mode string")
    got = {(r.rule, r.label): (r.passed, r.unknown) for r in acceptance.evaluate(results, cases).collect()}
    assert got == {("must", "extract_title"): (True, False), ("must", "extract_bullet_list"): (True, False), ("must", "no_such_label"): (False, True), ("mustNot", "emit_empty_markdown"): (True, False), ("structure", "heading_level_1"): (True, False), ("mode", "pdf-text"): (True, False)}
    every = spark.createDataFrame([(doc, list(acceptance.MUST), list(acceptance.MUST_NOT), list(acceptance.STRUCTURE), "unsupported")], cases.schema)
    assert acceptance.evaluate(results, every).where("unknown").count() == 0


def test_streaming(spark, tmp_path):
    from docflow.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(PDF)
    ingest.convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().markdown.startswith("# Title")
    assert ingest.arrival_counts(spark, str(tmp_path / "in")).isStreaming


def test_command_line(spark, tmp_path, capsys):
    from docflow import __main__ as cli

    (tmp_path / "a.pdf").write_bytes(PDF)
    assert cli.main([str(tmp_path), "--debug-trace", str(tmp_path / "trace"), "--password", "hush"]) == 0
    trace = spark.read.text(str(tmp_path / "trace")).first().value
    assert '"event":"document"' in trace and '"password":"[redacted]"' in trace and '"passwordProvided":true' in trace and "hush" not in trace
    assert capsys.readouterr().out.endswith("More of it.\n")
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path), "--jso"])
