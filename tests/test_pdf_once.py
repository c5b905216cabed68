"""Files of queries are built and read once, in even tasks and small batches."""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docflow.operators import ocr as O
from docflow.operators import pipeline
from docflow.operators.convert import convert
from docflow.plans import pdf_queries as Q
from docflow.shared import spread_evenly
from docflow.sources.pdf import reader, samples
from docflow.sources.pdf.content import merge_rulings
from docflow.sources.pdf.document import Document
from docflow.sources.pdf.writer import assemble

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pdf_form_fields", "pdf_attachments", "pdf_filters", "pdf_page_geometry", "pdf_fonts", "pdf_outlines", "pdf_roundtrip"])
def test_one_python_step(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize(("name", "sample", "table"), [("tagged_roles", "interactive", "customer"), ("form_summary", "interactive", "customer"), ("unicode_warnings", "fonts", "part")])
def test_each_file_is_built_once(spark, monkeypatch, tmp_path, name, sample, table):
    build, log = getattr(samples, sample), str(tmp_path / "built")

    def counted(*row):
        with open(log, "a") as f:
            f.write("x\n")
        return build(*row)

    monkeypatch.setattr(samples, sample, counted)
    Q.QUERIES[name](spark, SF).count()
    with open(log) as f:
        assert len(f.readlines()) == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_spread_of_one_row_group(spark, tmp_path):
    """A file of one row group comes in as many partitions as cores and more, but all its rows are in one."""
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": pa.array(range(2000), pa.int64())}), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = spread_evenly(spark.read.parquet(path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4 * spark.sparkContext.defaultParallelism and max(r[1] for r in rows) <= 2 * 2000 / len(rows)


def test_small_batches():
    sizes = [b.num_rows for b in reader._batches((str(k), b"%d" % k, reader.parse_file(b"%d" % k)) for k in range(1000))]
    assert sum(sizes) == 1000 and max(sizes) <= 64


def test_only_what_is_wanted():
    data = samples.interactive(3, "A")
    full = reader.parse_file(data)
    for name in reader.RELATIONS:
        part = reader.parse_file(data, only=(name,))
        assert part[name] == full[name] and part["has_xfa"] == full["has_xfa"]


def test_equal_objects_are_two_where_two_are_named():
    """Two leaves of a tree of names that are equal byte by byte are two leaves; and files that share objects keep their own."""
    leaf, spec = b"<< /Names [(b) 9 0 R] >>", b"<< /F (n.txt) /EF << /F 10 0 R >> >>"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Names << /EmbeddedFiles 6 0 R >> >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>", 6: b"<< /Kids [7 0 R 8 0 R] >>",
        7: leaf, 8: leaf, 9: spec, 10: b"<< /Length 2 >>\nstream\nhi\nendstream",
    }
    assert [len(Document(assemble(objects)).attachments()) for _ in range(2)] == [2, 2]
    one, two = (reader.parse_file(samples.fonts(k)) for k in (11, 12))
    assert [x["text"] for x in one["lines"]] != [x["text"] for x in two["lines"]] and two["lines"][3]["text"] == "BCfiΩ"


def test_fonts_of_equal_dictionaries_and_other_maps():
    """A font's dictionary may be the same in two files and its Unicode map another."""
    a, b = samples.fonts(7), samples.fonts(7).replace(b"<03A9>", b"<03B1>")
    assert [reader.parse_file(x)["lines"][3]["text"] for x in (a, b, a)] == ["HfiΩ", "Hfiα", "HfiΩ"]


def test_report_of_many_orders():
    """More rows than a page of common size holds, and rows as high and low as running heads, are one table."""
    for n in (10, 27, 60, 600):
        for merged in (False, True):
            table = [["Order and state", "", "Price"] if merged else ["Order", "State", "Price"], *([str(k), "O", str(7 * k)] for k in range(n))]
            p = reader.parse_file(samples.report("Customer 1", ["one num-", "ber of it"], ["a", "b"], table, merged=merged))
            c = convert(p["lines"], p["rulings"], p["images"], p["outlines"])
            assert [b["kind"] for b in c["blocks"]] == ["heading", "paragraph", "list", "table"] and [(t["kind"], len(t["cells"])) for t in c["tables"]] == [("ruled", n + 1)]
            assert c["blocks"][3]["text"].count("<tr>" if merged else "\n| ") == n + 1


def test_grids_of_many_rows_take_no_squares():
    """Twelve times the rows take about twelve times the work, not a hundred and more: counted in lines of Python that are run."""

    def work(n: int) -> int:
        p = reader.parse_file(samples.report("Customer 1", ["x"], ["a"], [["A", "B", "C"]] + [["1", "2", "3"]] * n))
        count = 0

        def trace(frame, event, arg):
            nonlocal count
            count += event == "line"
            return trace

        sys.settrace(trace)
        try:
            convert(p["lines"], p["rulings"], p["images"], p["outlines"])
            merge_rulings(p["rulings"])
        finally:
            sys.settrace(None)
        return count

    assert work(240) < 20 * work(20)


def test_converted_where_they_are_read(spark):
    """convert_built gives what parse_files and convert_documents give, by the file."""
    rows = [(k,) for k in range(24)]

    def build(k: int) -> bytes:
        return [samples.interactive(3, "A"), samples.fonts(k // 6), samples.drawings(k), samples.report(f"T {k}", ["a b"], ["x"], [["A", "B"], ["1", "2"]]), samples.faulty("locked", k), b"no file"][k % 6]

    table = spark.createDataFrame(rows, "k long")
    files = spark.createDataFrame([(str(k), build(k)) for (k,) in rows], "path string, content binary")
    parsed = reader.parse_files(files)
    a, b = pipeline.convert_built(table, build), pipeline.by_path(pipeline.convert_documents(parsed), parsed)
    assert set(a.columns) == set(b.columns)
    assert [r.asDict(True) for r in a.select(*sorted(a.columns)).orderBy("path").collect()] == [r.asDict(True) for r in b.select(*sorted(a.columns)).orderBy("path").collect()]


def test_source_type_as_by_joins(spark):
    page = lambda n, w=600.0: {"page_index": n, "width_pt": w, "height_pt": 800.0}
    line = lambda n, no, hidden=False, x=50.0: {"page_index": n, "line_no": no, "x": x, "y": 100.0, "width": 200.0, "height": 12.0, "hidden": hidden}
    image = lambda n, w, h: {"page_index": n, "x": 0.0, "y": 0.0, "width": w, "height": h, "area": w * h}
    docs = {
        "digital": ([page(0)], [line(0, 1)], []), "none": ([page(0)], [], []), "no pages": ([], [line(None, 1)], []), "scan": ([page(0)], [], [image(0, 600.0, 800.0)]), "small": ([page(0)], [], [image(0, 60.0, 80.0)]),
        "figure": ([page(0)], [line(0, 1)], [image(0, 60.0, 80.0)]), "few": ([page(0)], [line(0, 1)], [image(0, 600.0, 790.0)]), "many": ([page(0)], [line(0, k) for k in range(4)], [image(0, 600.0, 790.0)]),
        "hidden": ([page(0)], [line(0, 1, True)], [image(0, 600.0, 790.0)]), "aside": ([page(0)], [line(0, 1, True, 590.0)], [image(0, 580.0, 790.0)]), "both": ([page(0), page(1)], [line(0, 1)], [image(1, 600.0, 800.0)]), "empty": ([page(0, 0.0)], [], [image(0, 600.0, 800.0)]), "half": ([page(0)], [line(0, 1)], [image(0, 300.0, 800.0)]),
    }
    flat = lambda k: [{"doc_id": d, **x} for d, v in docs.items() for x in v[k]]
    pages = spark.createDataFrame(flat(0), "doc_id string, page_index int, width_pt double, height_pt double")
    lines = spark.createDataFrame(flat(1), "doc_id string, page_index int, line_no int, x double, y double, width double, height double, hidden boolean")
    images = spark.createDataFrame(flat(2), "doc_id string, page_index int, x double, y double, width double, height double, area double")
    routed = {r[0]: r[1] for r in O.document_source_type(O.route_pages(O.scan_signals(pages, lines, images))).select("doc_id", "source_type").collect()}
    assert {d: pipeline._source_type(*v) for d, v in docs.items()} == {d: routed.get(d, "unknown") for d in docs}


@pytest.mark.parametrize(("name", "times"), [("report_warnings", 1), ("report_tables", 1), ("report_ir", 1), ("report_hash", 2)])
def test_reports_are_built_as_often_as_they_are_converted(spark, monkeypatch, tmp_path, name, times):
    log, build = str(tmp_path / "built"), Q._report

    def counted(*row):
        with open(log, "a") as f:
            f.write("x\n")
        return build(*row)

    monkeypatch.setattr(Q, "_report", counted)
    out = Q.QUERIES[name](spark, SF)
    if name == "report_warnings":  # customers and their orders, and nothing after that
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    out.collect()
    with open(log) as f:
        assert len(f.readlines()) == times * spark.read.parquet(f"{SF}/customer.parquet").count()
