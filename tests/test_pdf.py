"""The PDF reader: filters, fonts, cross references, repair, encryption, structure, interactions, hostile files."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import pytest

from docflow.sources.pdf import filters
from docflow.sources.pdf.content import merge_rulings
from docflow.sources.pdf.document import _PAD, Document, Limits, rc4
from docflow.sources.pdf.fonts import CMap, glyph_text, plain, simple_table
from docflow.sources.pdf.reader import parse_file
from docflow.sources.pdf.values import Name, Parser, PdfError, Ref, text_string
from docflow.sources.pdf.writer import assemble, text_pdf


def texts(data: bytes, **kw) -> list[str]:
    return [x["text"] for x in parse_file(data, **kw)["lines"]]


def codes(data: bytes, **kw) -> list[str]:
    return [w["code"] for w in parse_file(data, **kw)["warnings"]]


SIMPLE = text_pdf([[(72, 720, 22, "Title (one)"), (72, 690, 12, "Body é ß \\ text")], [(72, 720, 12, "Second page")]])


def test_values():
    v = Parser(b"<< /A#20b [1 -2.5 (a\\(b\\)\\101\\\n) <48 6> true null 3 0 R] /C << /D /E >> >> % x").value()
    assert v == {"A b": [1, -2.5, b"a(b)A", b"H`", True, None, Ref(3, 0)], "C": {"D": Name("E")}}
    assert text_string(b"\xfe\xff\x00A\x26\x3a") == "A☺" and text_string(b"\x80\x93") == "•ﬁ"
    with pytest.raises(PdfError):
        Parser(b"[" * 200).value()


def test_filters():
    g = random.Random(1)
    raw = bytes(g.randrange(256) for _ in range(400)) + b"\0" * 40
    assert filters.decode(zlib.compress(raw), {"Filter": Name("FlateDecode")}) == raw
    assert filters.decode(base64.a85encode(raw) + b"~>", {"Filter": Name("A85")}) == raw
    assert filters.decode(raw.hex().encode() + b"4>", {"Filter": [Name("ASCIIHexDecode")]}) == raw + b"\x40"
    assert filters.decode(b"\x02abc\xfed\x80", {"Filter": Name("RunLengthDecode")}) == b"abcddd"
    assert filters.decode(bytes.fromhex("800B6050220C0C8501"), {"Filter": Name("LZWDecode")}) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.decode(b"jpeg", {"Filter": Name("DCTDecode")}) == b"jpeg"
    for bad in (b"\x02abc", b"\xfed"):
        with pytest.raises(PdfError):
            filters.decode(bad, {"Filter": Name("RunLengthDecode")})
    with pytest.raises(PdfError, match="too large"):
        filters.decode(zlib.compress(b"0" * 10_000), {"Filter": Name("FlateDecode")}, 100)


@pytest.mark.parametrize("tag", range(5))
def test_png_predictors(tag):
    rows = [bytes((i * 7 + r * 13) % 256 for i in range(12)) for r in range(5)]
    out, above = b"", bytes(12)
    for row in rows:
        left = lambda i, x: x[i - 3] if i >= 3 else 0
        guess = [0, *[None] * 4][tag]
        line = bytes(
            (row[i] - (guess if guess is not None else [0, left(i, row), above[i], (left(i, row) + above[i]) // 2, filters._paeth(left(i, row), above[i], left(i, above))][tag])) & 255 for i in range(12)
        )
        out, above = out + bytes([tag]) + line, row
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    assert filters.decode(zlib.compress(out), {"Filter": Name("FlateDecode"), "DecodeParms": parms}) == b"".join(rows)


def test_tiff_predictor():
    assert filters.decode(zlib.compress(bytes([1, 1, 1, 5, 1, 1])), {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 2, "Columns": 3}}) == bytes([1, 2, 3, 5, 6, 7])


def test_fonts():
    m = CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange")
    assert [t for _, t in m.codes(bytes.fromhex("000100020011002100FF"))] == ["A", "fi", "b", "y", None]
    with pytest.raises(PdfError):
        CMap(b"1 beginbfrange <0000> <FFFF> <0000> endbfrange", limit=10)
    assert glyph_text("eacute") == "é" and glyph_text("uni00410042") == "AB" and glyph_text("u1F600") == "\U0001f600" and glyph_text("f_i") == "fi" and glyph_text("nope") is None
    assert plain(1) == "␁" and simple_table("WinAnsiEncoding")[0x80] == "€" and simple_table("MacRomanEncoding")[0x8E] == "é" and simple_table("StandardEncoding")[0x27] == "’"


def test_simple_file():
    r = parse_file(SIMPLE)
    assert [x["text"] for x in r["lines"]] == ["Title (one)", "Body é ß \\ text", "Second page"] and r["parse_mode"] == "classic-xref" and not r["warnings"]
    assert (r["lines"][0]["x"], r["lines"][0]["y"], r["lines"][0]["font_size"], r["lines"][2]["page_index"]) == (72, 720, 22, 1)
    assert r["pages"][0]["width_pt"] == 612


def test_xref_stream_and_object_stream():
    body = b"BT /F1 12 Tf 72 700 Td (From an object stream) Tj ET"
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 300 400] >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>"), (4, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")]
    head, parts = b"", b""
    for n, b in inner:
        head += b"%d %d " % (n, len(parts))
        parts += b + b" "
    packed = zlib.compress(head + parts)
    out = bytearray(b"%PDF-1.5\n")
    at = {}
    for n, b in ((5, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)), (6, b"<< /Type /ObjStm /N 4 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(head), len(packed), packed))):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    start = len(out)
    rows = [(0, 0, 0), *[(2, 6, k) for k in range(4)], (1, at[5], 0), (1, at[6], 0), (1, start, 0)]
    table = zlib.compress(b"".join(bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows))
    out += b"7 0 obj\n<< /Type /XRef /Size 8 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, start)
    r = parse_file(bytes(out))
    assert [x["text"] for x in r["lines"]] == ["From an object stream"] and r["parse_mode"] == "xref-stream" and r["pages"][0]["height_pt"] == 400


def test_incremental_update_takes_the_newest():
    old = text_pdf([[(72, 700, 12, "Old text")]], compress=False)
    new = b"BT /F1 12 Tf 72 700 Td (New text) Tj ET"
    at = len(old)
    prev = int(old.rsplit(b"startxref\n", 1)[1].split()[0])
    more = b"10001 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(new), new)
    data = old + more + b"xref\n10001 1\n%010d 00000 n \ntrailer\n<< /Size 10002 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, prev, at + len(more))
    assert texts(data) == ["New text"]


def test_repair_and_scan():
    broken = SIMPLE.replace(b"startxref\n", b"startxref\n9")
    assert parse_file(broken, tolerant=True)["parse_mode"] == "object-scan-repair" and texts(broken, tolerant=True)[0] == "Title (one)"
    r = parse_file(broken)
    assert r["parse_mode"] == "stream-scan" and [w["code"] for w in r["warnings"]] == ["pdf.parse_failed"] and r["lines"][0]["page_index"] is None
    short = text_pdf([[(72, 700, 12, "Wrong length")]], compress=False).replace(b"/Length 5", b"/Length 1")
    assert texts(short, tolerant=True) == ["Wrong length"]


def encrypted(password: bytes) -> bytes:
    o = rc4(hashlib.md5((b"owner" + _PAD)[:32]).digest()[:5], (password + _PAD)[:32])
    fid, p = b"0123456789abcdef", -44
    key = hashlib.md5((password + _PAD)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + fid).digest()[:5]
    body = b"BT /F1 12 Tf 72 700 Td (Secret words) Tj ET"
    k = hashlib.md5(key + (5).to_bytes(3, "little") + b"\0\0").digest()[:10]
    enc = rc4(k, body)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        4: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>", 5: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(enc), enc),
        6: b"<< /Filter /Standard /V 1 /R 2 /P %d /O <%s> /U <%s> >>" % (p, o.hex().encode(), rc4(key, _PAD).hex().encode()),
    }
    return assemble(objects, b"/Encrypt 6 0 R /ID [<%s> <%s>]" % (fid.hex().encode(), fid.hex().encode()))


def test_encryption():
    assert texts(encrypted(b"")) == ["Secret words"]
    data = encrypted(b"open")
    assert texts(data, password="open") == ["Secret words"]
    assert codes(data) == ["security.password_required"] and codes(data, password="no") == ["security.password_incorrect"] and not texts(data)
    assert codes(data.replace(b"/V 1", b"/V 4")) == ["security.unsupported_encryption"]


def test_rotation_crop_and_unit():
    line = [[(100, 200, 12, "Turned")]]
    r = parse_file(text_pdf(line, page_extra=b"/Rotate 90 /CropBox [50 100 562 700]"))
    x = r["lines"][0]
    assert x["direction"] == "ltr" and (r["pages"][0]["width_pt"], r["pages"][0]["height_pt"]) == (600, 512) and x["x"] == pytest.approx(100, abs=13) and x["y"] > 400
    r = parse_file(text_pdf(line, page_extra=b"/UserUnit 2"))
    assert (r["lines"][0]["x"], r["lines"][0]["y"], r["pages"][0]["width_pt"]) == (200, 400, 1224)


def test_text_operators():
    content = b"BT /F1 10 Tf 14 TL 72 500 Td [(Two) -400 (words)] TJ T* (next) Tj (line) ' 1 0 0 1 72 300 Tm 3 Tr (hidden) Tj ET q 2 0 0 2 0 0 cm BT /F1 10 Tf 50 50 Td (scaled) Tj ET Q BT /F1 10 Tf 72 100 Td (gap) Tj 40 0 Td (far) Tj ET"
    r = parse_file(text_pdf([[]], drawings={0: content}))
    by = {x["text"]: x for x in r["lines"]}
    assert {"Two words", "next", "line", "hidden", "scaled"} <= set(by) and by["hidden"]["hidden"] and not by["next"]["hidden"]
    assert by["scaled"]["font_size"] == 20 and by["scaled"]["x"] == 100 and by["next"]["y"] == 486


def test_rulings_images_and_forms():
    draw = b"72 610 360 90 re S 192 610 m 192 700 l S 72 670 m 200 670 l S 200.5 670 m 432 670 l S 10 10 m 60 60 l S 0 0 50 50 re f q 200 0 0 100 72 300 cm BI /W 2 /H 1 /BPC 8 /CS /G ID ab EI Q /X1 Do"
    r = parse_file(text_pdf([[]], drawings={0: draw}, extra={100: b"<< /Type /XObject /Subtype /Form /BBox [0 0 9 9] /Length 20 >>\nstream\n5 5 m 5 50 l S      \nendstream"}))
    assert len(r["images"]) == 1 and r["images"][0]["area"] == 20_000 and r["images"][0]["image_width"] == 2
    h = [x for x in r["rulings"] if x["orientation"] == "h"]
    assert sorted(x["y1"] for x in h) == [610, 670, 700] and next(x for x in h if x["y1"] == 670)["segment_count"] == 2 and len(r["rulings"]) == 6
    a = {"orientation": "h", "x1": 0, "x2": 10, "y1": 5, "y2": 5, "page_index": 0, "width": 1, "segment_count": 1}
    assert len(merge_rulings([a, {**a, "x1": 12, "x2": 20}])) == 2 and len(merge_rulings([a, {**a, "x1": 10.5, "x2": 20}, {**a, "x1": 20.9, "x2": 30}])) == 1


def interactive() -> bytes:
    extra = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 110 0 R /StructTreeRoot 120 0 R /AcroForm << /Fields [130 0 R 131 0 R] /XFA () >> /Names << /EmbeddedFiles << /Names [(a) 140 0 R] >> >> >>",
        110: b"<< /First 111 0 R >>", 111: b"<< /Title (One) /Next 112 0 R /First 113 0 R >>", 112: b"<< /Title <FEFF0054> >>", 113: b"<< /Title (Below) /Next 111 0 R >>",
        120: b"<< /RoleMap << /Head /H2 >> /K << /S /Document /K << /S /Head /Pg 10000 0 R /Alt (alt) /K 0 >> >> >>",
        130: b"<< /T (person) /Kids [132 0 R 133 0 R] >>", 131: b"<< /T (ok) /FT /Btn /AS /Yes /V /Yes /Subtype /Widget /Rect [0 0 9 9] >>",
        132: b"<< /T (name) /FT /Tx /V (Ann) /Ff 2 /Subtype /Widget /Rect [0 0 9 9] >>", 133: b"<< /T (sig) /FT /Sig /V << /Name (Ann) /M (D:2024) >> >>",
        140: b"<< /F (n.txt) /EF << /F 141 0 R >> >>", 141: b"<< /Length 5 /Subtype /text#2Fplain >>\nstream\nhello\nendstream", 150: b"<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (https://example.org) >> >>",
    }
    return text_pdf([[]], drawings={0: b"/Head << /MCID 0 >> BDC BT /F1 12 Tf 72 700 Td (Tagged) Tj ET EMC"}, extra=extra, page_extra=b"/Annots [150 0 R 132 0 R]")


def test_interactions_and_structure():
    r = parse_file(interactive(), attachments=True)
    assert [(o["title"], o["depth"]) for o in r["outlines"]] == [("One", 1), ("Below", 2), ("T", 1)]
    assert r["lines"][0]["structure_role"] == "H2" and r["lines"][0]["structure_path"] == ["Document", "H2"] and r["lines"][0]["source"] == "tagged-pdf"
    f = {x["name"]: x for x in r["form_fields"]}
    assert f["person.name"]["value"] == "Ann" and f["person.name"]["required"] and f["person.name"]["page_index"] == 0 and f["ok"]["checked"] and f["person.sig"]["signature_status"] == "not-validated" and f["person.sig"]["signer"] == "Ann"
    assert r["annotations"][0]["uri"] == "https://example.org" and r["attachments"][0]["content"] == b"hello" and r["attachments"][0]["media_type"] == "text/plain" and r["has_xfa"]


def hostile() -> dict[str, bytes]:
    cyclic = assemble({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R] >>"})
    deep = assemble({1: b"<< /Type /Catalog /Pages 2 0 R >>"} | {n: b"<< /Type /Pages /Kids [%d 0 R] >>" % (n + 1) for n in range(2, 200)})
    bomb = text_pdf([[]], drawings={0: b" " * 3_000_000})
    widths = b"%PDF-1.5\n1 0 obj\n<< /Type /XRef /W [9 9 -1] /Size 3 /Length 0 >>\nstream\n\nendstream\nendobj\nstartxref\n9\n%%EOF"
    loop = text_pdf([[]], drawings={0: b"/X Do"}).replace(b"/Font << /F1 3 0 R >>", b"/XObject << /X 99 0 R >>")
    return {"cyclic": cyclic, "deep": deep, "bomb": bomb, "widths": widths, "loop": loop, "empty": b"", "short": b"%PDF-1.4", "text": b"just text that is no PDF", "nest": text_pdf([[]], drawings={0: b"[" * 500})}


@pytest.mark.parametrize("name", sorted(hostile()))
def test_hostile_files_give_warnings(name):
    for tolerant in (False, True):
        r = parse_file(hostile()[name], tolerant=tolerant, limits=Limits(max_stream_bytes=1_000_000))
        assert r["warnings"] or name == "loop"


def test_limits():
    assert codes(SIMPLE, limits=Limits(max_bytes=100)) == ["security.input_too_large"]
    assert codes(SIMPLE, limits=Limits(max_pages=1)) == ["security.page_count_exceeded"]
    assert "pdf.parse_failed" in codes(SIMPLE, limits=Limits(max_operations=2))
    with pytest.raises(ValueError):
        Limits(max_pages=0)


def test_mutations_never_raise():
    g = random.Random(7)
    for data in (SIMPLE, interactive()):
        for _ in range(120):
            b = bytearray(data)
            for _ in range(g.randint(1, 12)):
                b[g.randrange(len(b))] = g.randrange(256)
            if g.random() < 0.3:
                b = b[: g.randrange(len(b))]
            parse_file(bytes(b), tolerant=g.random() < 0.5, limits=Limits(max_stream_bytes=1 << 20, max_operations=20_000))


def test_document_needs_a_header():
    with pytest.raises(PdfError):
        Document(b"no")


def test_relations_in_spark(spark, tmp_path):
    from docflow.sources.pdf import reader, source

    (tmp_path / "a.pdf").write_bytes(SIMPLE)
    (tmp_path / "b.pdf").write_bytes(interactive())
    (tmp_path / "c.pdf").write_bytes(encrypted(b"open"))
    (tmp_path / "d.txt").write_bytes(b"no")
    files = reader.files(spark, str(tmp_path))
    parsed = reader.parse_files(files, passwords={"c.pdf": "open"}, attachments=True)
    assert parsed.count() == 3 and reader.relation(parsed, "lines").count() == 5
    assert {r.pdf_version for r in reader.read_headers(files).collect()} == {"1.7"}
    source.register(spark)
    own = spark.read.format("pdf").option("path", str(tmp_path)).load()
    assert own.count() == 3 and own.selectExpr("sum(size(lines))").first()[0] == 4
