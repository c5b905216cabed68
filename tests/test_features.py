"""Shared tables, progress, paths of equal files, the nested representation, and kernels of checks."""

from __future__ import annotations

import json
import os
import time
import zlib

import pytest
from pyspark.sql import functions as F

from docflow import shared
from docflow.operators import checks, grids, pipeline
from docflow.operators.progress import Aborted, run_with_progress
from docflow.sources.pdf import reader, samples
from docflow.sources.pdf.document import Limits
from docflow.sources.pdf.writer import text_pdf


def test_saved_tables(spark):
    path = shared.fresh_path(spark, "t")
    df = shared.saved(spark.range(10), "t", path)
    assert df.count() == 10 and path.startswith(shared.shared_folder(spark)) and os.path.isdir(path.removeprefix("file:"))
    shared.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
    few = spark.range(100).coalesce(1)
    assert shared.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and shared.spread(few.repartition(9)).rdd.getNumPartitions() == 9


def test_progress_and_abort(spark):
    told = []
    assert run_with_progress(spark, lambda: spark.range(1000).repartition(8).count(), on_progress=told.append) == 1000
    assert told[0] == 0 and told[-1] == 1 and told == sorted(told)
    with pytest.raises(ZeroDivisionError):
        run_with_progress(spark, lambda: 1 // 0)

    def slow():
        def run(it):
            for b in it:
                time.sleep(20)
                yield b

        return spark.range(4).mapInArrow(run, "id long").count()

    began = time.time()
    with pytest.raises(Aborted):
        run_with_progress(spark, slow, should_abort=lambda: time.time() - began > 1)
    with pytest.raises(Aborted):
        run_with_progress(spark, slow, timeout=0.5)
    with pytest.raises(Aborted):
        run_with_progress(spark, slow, should_abort=lambda: True)
    assert time.time() - began < 18


def test_files_of_equal_content_and_their_paths(spark):
    one, two = text_pdf([[(72, 720, 22, "Same"), (72, 690, 12, "Text.")]]), samples.interactive(3, "Bob")
    rows = [("a.pdf", bytearray(one)), ("b.pdf", bytearray(one)), ("c.pdf", bytearray(two)), ("d.pdf", None)]
    parsed = reader.parse_files(spark.createDataFrame(rows, "path string, content binary"))
    out = pipeline.convert_documents(parsed)
    assert out.count() == 3
    got = {r.path: r for r in pipeline.by_path(out, parsed).collect()}
    assert set(got) == {"a.pdf", "b.pdf", "c.pdf", "d.pdf"} and got["a.pdf"].markdown == got["b.pdf"].markdown == "# Same\n\nText.\n" and got["d.pdf"].markdown == ""
    ir = {json.loads(r.ir)["pages"][0]["elements"][0]["text"]: json.loads(r.ir) for r in pipeline.document_ir(out, parsed).collect()}
    kinds = [e["type"] for e in ir["## Tagged 3 0"]["pages"][0]["elements"]]
    assert kinds.count("form") == 2 and kinds.count("annotation") == 2 and kinds == sorted(kinds, key=["text", "form", "annotation"].index)
    note = ir["## Tagged 3 0"]["pages"][0]["elements"][-1]
    assert note["text"] == "note Bob" and note["region"] == {"x": 5, "y": 5, "width": 4, "height": 4}


def test_relations_that_are_not_wanted_are_not_read():
    full, part = reader.parse_file(samples.interactive(4, "A")), reader.parse_file(samples.interactive(4, "A"), only=("lines",))
    assert part["outlines"] == part["form_fields"] == [] and [x["text"] for x in part["lines"]] == [x["text"] for x in full["lines"]] and full["outlines"]


def test_sample_files_under_damage():
    for kind in samples.STRUCTURES:
        data = samples.structured(kind, "one\ntwo\n" + "x" * 300)
        for cut in (10, len(data) // 2, len(data) - 30):
            r = reader.parse_file(data[:cut], tolerant=True, limits=Limits(max_operations=5000))
            assert r["parse_mode"] or r["warnings"]
    for kind in samples.FILTERS:
        assert [x["text"] for x in reader.parse_file(samples.filtered(kind, "a\n\nb" * 40))["lines"]][:2] == ["a", "ba"]


def test_lzw_against_the_decoder():
    import random

    from docflow.sources.pdf import filters
    from docflow.sources.pdf.values import Name

    r = random.Random(1)
    for n in (0, 1, 2, 300, 9000, 40_000):
        raw = bytes(r.choice(b"abcd") if r.random() < 0.9 else r.randrange(256) for _ in range(n))
        assert filters.decode(samples.lzw(raw), {"Filter": Name("LZWDecode")}) == raw
        assert filters.decode(samples.run_length(raw), {"Filter": Name("RunLengthDecode")}) == raw


def test_empty_grids_and_tables(spark):
    none = spark.createDataFrame([], "doc_id long, page_index int, orientation string, x1 double, y1 double, x2 double, y2 double")
    lines = spark.createDataFrame([(1, 0, 0, None, 1.0, 1.0, None, 1.0)], "doc_id long, page_index int, line_no int, text string, x double, y double, width double, height double")
    assert grids.ruled_grids(none).count() == 0 and grids.ruled_cells(none, lines).count() == 0
    loose = spark.createDataFrame([(1, 0, "h", 0.0, 5.0, 9.0, 5.0), (1, None, "v", 0.0, 0.0, 0.0, 9.0)], none.schema)
    assert grids.ruled_grids(loose).count() == 0 and grids.ruled_cells(loose, lines).count() == 0
    odd = spark.createDataFrame([(1, "<table><tr><td rowspan=2>a<td>b<tr><td>c</table><table>"), (2, None), (3, "no table <td>x")], "doc_id long, html string")
    cells = [(r.doc_id, r.row_index, r.column_index, r.row_span, r.text) for r in checks.html_table_cells(odd).orderBy("row_index", "column_index").collect()]
    assert cells == [(1, 0, 0, 2, "a"), (1, 0, 1, 1, "b"), (1, 1, 1, 1, "c")]


def test_traces(spark):
    rows = [(1, json.dumps({"a": [1] * 250, "Passphrase": 1, "deep": [[[[[[[[[1]]]]]]]]]})), (2, None), (3, "x"), (4, json.dumps({f"k{i:03}": i for i in range(230)}))]
    got = {r.n: r.json and json.loads(r.json) for r in checks.sanitized_trace(spark.createDataFrame(rows, "n int, json string")).collect()}
    assert len(got[1]["a"]) == 201 and got[1]["a"][-1] == "...50 more items" and got[1]["Passphrase"] == "[redacted]" and "[MaxDepth]" in json.dumps(got[1]["deep"])
    assert got[2] is None and got[3] is None and got[4]["__omittedKeys"] == 30
    found = checks.snippets_on_pages(spark.createDataFrame([(1, "a.b a*b", [(0, 3, 0)])], "id int, markdown string, regions array<struct<md_start:int,md_end:int,page_index:int>>"), spark.createDataFrame([(1, "a*b", 0), (1, ".b", 0), (2, "a", 0)], "id int, snippet string, page_index int"))
    assert {(r.id, r.snippet): r.found for r in found.collect()} == {(1, "a*b"): False, (1, ".b"): True, (2, "a"): False}
    assert checks.rendered_gate(spark.createDataFrame([(1, 1)], "page_id int, text_chars int")).select(F.size("failures")).first()[0] == 0


def test_scan_of_streams_beside_any_bytes():
    """A file that is only streams: two less-than signs in a stream's bytes begin no dictionary, a stream may end in line ends, and hold the word endstream."""
    line = lambda t: b"BT /F1 12 Tf 72 700 Td (" + t + b") Tj ET"
    stream = lambda body, info=b"": b"<< /Length %d %s >>\nstream\n" % (len(body), info) + body + b"\nendstream\n"
    packed = next(z for k in range(20_000) if (z := zlib.compress(line(b"line %d" % k)))[-1:] in (b"\n", b"\r"))
    data = b"%PDF-1.7\n" + stream(line(b"one")) + stream(b"%<< " + b"x" * 40) + stream(line(b"two")) + stream(line(b"endstream")) + stream(packed, b"/Filter /FlateDecode /DecodeParms << /Predictor 1 >>") + stream(line(b"last"))
    r = reader.parse_file(data, tolerant=True)
    assert r["parse_mode"] == "stream-scan"
    assert [x["text"] for x in r["lines"]] == ["one", "two", "endstream", zlib.decompress(packed).split(b"(")[1].split(b")")[0].decode(), "last"]


def test_grids_of_many_pages_in_one_call(spark):
    """No call of Python for each page; pages without rulings have no cells, and the page without number has its own."""
    rule = "doc_id long, page_index int, orientation string, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, p, "h", 0.0, y, 100.0, y) for p in (0, None) for y in (0.0, 20.0)] + [(1, p, "v", x, 0.0, x, 20.0) for p in (0, None) for x in (0.0, 50.0, 100.0)]
    lines = [(1, p, 7, t, 60.0, 6.0, 10.0, 8.0) for p, t in ((0, "a"), (None, "b"), (5, "c"))] + [(1, 0, 8, " ", 10.0, 6.0, 10.0, 8.0), (1, 0, 9, "x", None, 6.0, 10.0, 8.0)]
    cells = grids.ruled_cells(spark.createDataFrame(rows, rule), spark.createDataFrame(lines, "doc_id long, page_index int, line_no long, text string, x double, y double, width double, height double"))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and plan.count("MapInArrow") == 1
    got = {(r.page_index, r.column_index): (r.text, r.line_nos) for r in cells.collect()}
    assert got == {(0, 0): ("", []), (0, 1): ("a", [7]), (None, 0): ("", []), (None, 1): ("b", [7])}


def test_images_of_small_tables_are_spread(spark):
    from docflow.plans import feature_queries

    for name in ("adaptive", "binarized"):
        assert feature_queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_observed_features_shuffle_no_wide_rows(spark):
    from docflow.plans import feature_queries

    out = feature_queries.pdf_observed(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "MapInArrow" not in plan
