"""A small PDF writer: text, rulings and images on pages, for round trips and tests."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ...shared import spread_evenly


#: Files are sent on together up to so many files and bytes.
_BATCH_FILES, _BATCH_BYTES = 64, 4 << 20


def literal(text: str) -> bytes:
    """A string of the content in WinAnsi."""
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def text_objects(pages: list[list[tuple[float, float, float, str]]], *, drawings: dict[int, bytes] | None = None, compress: bool = True, size: tuple[float, float] = (612, 792), extra: dict[int, bytes] | None = None, page_extra: bytes = b"") -> dict[int, bytes]:
    """The objects of a file of pages of (x, y, font size, text) in Helvetica. drawings: more content by page; extra: more objects by number
    (from 100 on); page_extra: more entries of each page's dictionary."""
    objects: dict[int, bytes] = {3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    kids = []
    for n, lines in enumerate(pages):
        body = b"".join(b"BT /F1 %g Tf %g %g Td " % (s, x, y) + literal(t) + b" Tj ET\n" for x, y, s, t in lines) + (drawings or {}).get(n, b"")
        raw = zlib.compress(body) if compress else body
        page, content = 10_000 + 2 * n, 10_001 + 2 * n
        objects[content] = b"<< /Length %d%s >>\nstream\n" % (len(raw), b" /Filter /FlateDecode" if compress else b"") + raw + b"\nendstream"
        objects[page] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R %s >>" % (*size, content, page_extra)
        kids.append(b"%d 0 R" % page)
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    return objects | (extra or {})


def text_pdf(pages: list[list[tuple[float, float, float, str]]], **options) -> bytes:
    """The file of text_objects."""
    return assemble(text_objects(pages, **options))


def assemble(objects: dict[int, bytes], trailer: bytes = b"") -> bytes:
    """A file of these objects with a cross reference table; object 1 is the catalog."""
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, a) for n, a in sorted(at.items()))
    out += b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (max(objects) + 1, trailer, start)
    return bytes(out)


def write_pdfs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines_per_page: int = 46) -> DataFrame:
    """path (the id) and content of a PDF for each text, a line of the text a line of a page. A null text gives one empty page."""

    def run(it):
        for batch in it:
            paths, out, size = [], [], 0
            for k, (path, text) in enumerate(zip(batch.column(0).cast(pa.string()), batch.column(1))):
                paths.append(path)
                out.append(text_file(text.as_py(), lines_per_page))
                size += len(out[-1])
                if len(out) == _BATCH_FILES or size > _BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([p.as_py() for p in paths], pa.string()), pa.array(out, pa.binary())], names=["path", "content"])
                    paths, out, size = [], [], 0

    return spread_evenly(docs.select(id_col, text_col)).mapInArrow(run, "path string, content binary")


def text_file(text: str | None, lines_per_page: int = 46) -> bytes:
    """The file that write_pdfs makes of a text."""
    lines = (text or "").split("\n")
    return text_pdf([[(72, 720 - 14 * k, 12, x) for k, x in enumerate(lines[a : a + lines_per_page]) if x] for a in range(0, len(lines), lines_per_page)])
