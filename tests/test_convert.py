"""Markdown of whole documents, and the operators that need no table of the driver's."""

from __future__ import annotations

import numpy as np
import pytest

from docflow.operators import raster
from docflow.operators.convert import convert, csv_text, fence, gfm, join_parts, normalize
from docflow.sources.pdf.reader import parse_file
from docflow.sources.pdf.writer import text_pdf


def md(pages, drawings=None, **options) -> dict:
    r = parse_file(text_pdf(pages, drawings=drawings))
    return convert(r["lines"], r["rulings"], r["images"], r["outlines"], **options)


def test_headings_lists_paragraphs():
    page = [(72, 720, 22, "Title"), (72, 690, 16, "Part"), (72, 660, 12, "A line that is hyphen-"), (72, 646, 12, "ated and goes on."), (72, 620, 12, "- one"), (72, 606, 12, "- two & <b>"), (90, 592, 12, "3) three"), (72, 560, 12, "# not a heading")]
    out = md([page])
    assert out["markdown"] == "# Title\n\n## Part\n\nA line that is hyphenated and goes on.\n\n- one\n- two &amp; &lt;b&gt;\n  3. three\n\n\\# not a heading\n"
    for b in out["blocks"]:
        assert out["markdown"][b["md_start"] : b["md_end"]] == b["text"]
    assert md([[]])["markdown"] == ""


def test_running_content_and_anchors():
    pages = [[(72, 760, 9, "Header"), (72, 700, 12, f"Body {n}."), (300, 40, 9, f"Page {n}")] for n in range(3)]
    assert md(pages, page_anchors=True)["markdown"] == "".join(f'<a id="page-{n + 1}"></a>\n\nBody {n}.\n\n' for n in range(3))[:-1]
    assert "Header" in md(pages, keep_titles=True)["markdown"]


def test_columns():
    page = [(72, 720, 22, "Two columns and a title over both of them"), *[(72, 680 - 14 * k, 12, f"left column line {k} with words") for k in range(4)], *[(330, 680 - 14 * k, 12, f"right column line {k} with words") for k in range(4)]]
    assert md([page])["markdown"].endswith(" ".join(f"left column line {k} with words" for k in range(4)) + "\n\n" + " ".join(f"right column line {k} with words" for k in range(4)) + "\n")


GRID = b"72 610 360 90 re S 192 610 m 192 700 l S 312 610 m 312 700 l S 72 670 m 432 670 l S 72 640 m 432 640 l S"


def test_ruled_table():
    cells = [("Season", "Earned", "Spent"), ("dry", "10", "=2"), ("wet", "20", "4|5")]
    page = [(72, 740, 22, "Report"), *[(82 + 120 * c, 682 - 30 * r, 11, t) for r, row in enumerate(cells) for c, t in enumerate(row)], (72, 560, 12, "After it.")]
    out = md([page], {0: GRID})
    assert "| Season | Earned | Spent |\n| --- | ---: | --- |\n| dry | 10 | =2 |\n| wet | 20 | 4\\|5 |" in out["markdown"] and out["markdown"].endswith("After it.\n")
    assert out["csv"][0] == {"asset_id": "table-page-1-1-csv", "path": "assets/table-page-1-1-csv.csv", "page_index": 0, "content": "Season,Earned,Spent\ndry,10,'=2\nwet,20,4|5\n"}
    assert out["tables"][0]["confidence"] == 0.95 and out["tables"][0]["complete"]


def test_spans_give_html():
    draw = b"72 610 240 60 re S 72 640 m 312 640 l S 192 610 m 192 640 l S"
    out = md([[(82, 650, 11, "Over both"), (82, 620, 11, "a"), (202, 620, 11, "b")]], {0: draw})
    assert '<th colspan="2">Over both</th>' in out["markdown"] and out["tables"][0]["confidence"] == 0.9
    assert "| Over both |" in md([[(82, 650, 11, "Over both"), (82, 620, 11, "a"), (202, 620, 11, "b")]], {0: draw}, html_fallback=False)["markdown"]


def test_borderless_table():
    rows = [("Item", "Count"), ("Bolt", "10"), ("Nut", "12")]
    out = md([[(72 + 120 * c, 700 - 20 * r, 12, t) for r, row in enumerate(rows) for c, t in enumerate(row)]])
    assert out["markdown"] == "| Item | Count |\n| --- | ---: |\n| Bolt | 10 |\n| Nut | 12 |\n" and out["tables"][0]["confidence"] == 0.775
    words = [("One", "Two"), ("red", "blue"), ("big", "small")]
    out = md([[(72 + 120 * c, 700 - 20 * r, 12, t) for r, row in enumerate(words) for c, t in enumerate(row)]])
    assert "|" not in out["markdown"] and [w["code"] for w in out["warnings"]].count("table.low_confidence") >= 1


def test_code_equation_figure():
    page = [(72, 700, 12, "A paragraph of plain prose text to set the width of the page's body here."), (110, 660, 12, "return x;"), (122, 646, 12, "if (a) {"), (120, 600, 12, "a = b + 1"), (72, 400, 12, "Figure 2. A box.")]
    out = md([page], {0: b"100 450 200 100 re S"}, formulas=[{"equation_index": 0, "latex": "a=b+1"}])
    assert "```\nreturn x;\n if (a) {\n```" in out["markdown"] and "$$\na=b+1\n$$" in out["markdown"]
    assert "*[Figure 2 preview unavailable; metadata retained.]*\n\nFigure 2. A box." in out["markdown"] and out["figures"][0]["height"] == 100


def test_small_functions():
    assert normalize("ﬁne　Ａ  b") == "fine A b" and join_parts(["一二", "三 a", "b"]) == "一二三 a b"
    assert fence("a ``` b") == "~~~" and fence("~~~ ````") == "~~~~"
    assert csv_text([["a,b", '"', "-5", "@x"]]) == '"a,b","""",\'-5,\'@x\n' and gfm([["h"], ["*"]]) == "| h |\n| --- |\n| \\* |"


def test_ordering_and_tag_warnings():
    lines = parse_file(text_pdf([[(72, 500, 12, "low"), (300, 700, 12, "high")]]))["lines"]
    lines[0]["structure_role"] = "H1"
    lines[0]["text"] = "x" * 200
    assert [w["code"] for w in convert(lines)["warnings"]] == ["structure.tagged_layout_conflict", "text.ordering_uncertain"]


def test_image_kernels(spark):
    g = np.random.default_rng(1)
    px = g.integers(0, 256, (40, 30, 4), dtype=np.uint8)
    y = (px[..., :3].astype(int) @ [77, 150, 29]) >> 8
    assert (raster.binarize(px)[..., 0] == np.where(y >= 128, 255, 0)).all() and (raster.binarize(px)[..., 3] == px[..., 3]).all()
    out = raster.adaptive_threshold(px, 3, 5)[..., 0]
    for i in range(40):
        for j in range(30):
            inside = 3 <= i < 37 and 3 <= j < 27
            mean = y[i - 3 : i + 4, j - 3 : j + 4].mean() if inside else y[i, j]
            assert out[i, j] == (255 if y[i, j] >= mean - 5 - 1e-9 else 0)
    rows = spark.createDataFrame([(1, 30, 40, bytearray(px.tobytes())), (2, 3, 3, bytearray(b"x")), (3, None, 1, None)], "image_id long, width int, height int, rgba binary")
    got = {r.image_id: r.rgba for r in raster.preprocess_images(rows, mode="binarize").collect()}
    assert bytes(got[1]) == raster.binarize(px).tobytes() and got[2] is None and got[3] is None


def test_conversion_with_ocr(spark):
    from docflow.operators import pipeline
    from docflow.sources.pdf import reader

    scan = text_pdf([[]], drawings={0: b"q 612 0 0 792 0 0 cm BI /W 1 /H 1 /BPC 8 /CS /G ID a EI Q"})
    digital = text_pdf([[(72, 720, 22, "Digital"), (72, 690, 12, "Text."), (72, 676, 12, "More."), (72, 662, 12, "Most.")]])
    parsed = reader.parse_files(spark.createDataFrame([("s.pdf", bytearray(scan)), ("d.pdf", bytearray(digital)), ("d2.pdf", bytearray(digital)), ("bad.pdf", bytearray(b"nothing"))], "path string, content binary"))
    ids = {r.path: r.doc_id for r in parsed.collect()}
    boxes = spark.createDataFrame([(ids["s.pdf"], 0, 0, "Scanned title", 99.0, 72.0, 720.0, 200.0, 22.0, "page", 0.0, 0.0), (ids["s.pdf"], 0, 1, "body", 80.0, 144.0, 264.0, 100.0, 24.0, "raster", 1224.0, 1584.0)],
                                  "doc_id string, page_index int, box_no int, text string, confidence double, x double, y double, width double, height double, coordinate_space string, width_px double, height_px double")
    out = {r.doc_id: r for r in pipeline.convert_documents(parsed, boxes).collect()}
    assert len(out) == 3
    assert out[ids["s.pdf"]].markdown == "# Scanned title\n\nbody\n" and out[ids["s.pdf"]].mode == "ocr" and out[ids["s.pdf"]].source_type == "scanned" and out[ids["s.pdf"]].confidence.text == pytest.approx(0.895)
    assert out[ids["d.pdf"]].markdown.startswith("# Digital") and out[ids["d.pdf"]].source_type == "digital"
    bad = out[ids["bad.pdf"]]
    assert bad.markdown == "" and [w.code for w in bad.warnings] == ["pdf.invalid_header", "conversion.not_implemented"]
    assert pipeline.document_ir(pipeline.convert_documents(parsed)).count() == 1
