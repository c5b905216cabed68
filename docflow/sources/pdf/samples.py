"""PDF files that each show some features of the format, built from rows: for round trips through the reader."""

from __future__ import annotations

import base64
import hashlib
import zlib

from .document import _PAD, rc4
from .writer import assemble, literal, text_objects, text_pdf


def pages_of(text: str, lines_per_page: int = 46) -> list[list[tuple[float, float, float, str]]]:
    """A text's lines on pages, as write_pdfs sets them."""
    lines = text.split("\n")
    return [[(72, 720 - 14 * k, 12, x) for k, x in enumerate(lines[a : a + lines_per_page]) if x] for a in range(0, len(lines), lines_per_page)]


# file structures


def with_xref_stream(objects: dict[int, bytes], *, hybrid: bool = False) -> bytes:
    """Objects that aren't streams in an object stream, found by a cross-reference stream; hybrid: with a table for the rest."""
    packed = {n: b for n, b in objects.items() if b"stream\n" not in b}
    head, parts = b"", b""
    for n, b in sorted(packed.items()):
        head += b"%d %d " % (n, len(parts))
        parts += b + b" "
    body, top = zlib.compress(head + parts), max(objects) + 1
    rest = {n: b for n, b in objects.items() if n not in packed} | {top: b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), len(head), len(body), body)}
    out, rows = bytearray(b"%PDF-1.7\n"), [(0, 0, 0, 65535)]
    for n, b in sorted(rest.items()):
        rows.append((n, 1, len(out), 0))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    rows += [(n, 2, top, k) for k, n in enumerate(sorted(packed))]
    start = len(out)
    rows = sorted([*rows, (top + 1, 1, start, 0)])
    runs: list[list[int]] = []
    for n, *_ in rows:
        if runs and runs[-1][0] + runs[-1][1] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    table = zlib.compress(b"".join(bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for _, k, a, b in rows))
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Index [%s] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (
        top + 1, top + 2, b" ".join(b"%d %d" % (a, b) for a, b in runs), len(table), table)
    if hybrid:
        at = len(out)
        plain = [(n, a) for n, k, a, _ in rows if k == 1]
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in plain)
        out += b"trailer\n<< /Size %d /Root 1 0 R /XRefStm %d >>\n" % (top + 2, start)
        start = at
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def updated(old: bytes, objects: dict[int, bytes]) -> bytes:
    """A file with a newer revision of some objects after it."""
    prev = int(old.rsplit(b"startxref\n", 1)[1].split()[0])
    out, at = bytearray(old), {}
    for n, b in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in at.items())
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (max(at) + 1, prev, start))


def encrypted(objects: dict[int, bytes], password: bytes = b"") -> bytes:
    """The file under the standard handler, revision 2 (RC4 of 40 bits); its streams are encrypted, and it has no strings."""
    o = rc4(hashlib.md5((b"owner" + _PAD)[:32]).digest()[:5], (password + _PAD)[:32])
    fid, p = b"0123456789abcdef", -44
    key = hashlib.md5((password + _PAD)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + fid).digest()[:5]
    out = {}
    for n, b in objects.items():
        if b"stream\n" in b:
            head, _, body = b.partition(b"stream\n")
            b = head + b"stream\n" + rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], body.removesuffix(b"\nendstream")) + b"\nendstream"
        out[n] = b
    out[99] = b"<< /Filter /Standard /V 1 /R 2 /P %d /O <%s> /U <%s> >>" % (p, o.hex().encode(), rc4(key, _PAD).hex().encode())
    return assemble(out, b"/Encrypt 99 0 R /ID [<%s> <%s>]" % (fid.hex().encode(), fid.hex().encode()))


STRUCTURES = ("classic", "xref-stream", "hybrid", "updated", "repaired", "encrypted", "indirect-length", "scanned")


def structured(kind: str, text: str) -> bytes:
    """A text's lines in a file of that structure (one of STRUCTURES)."""
    objects = text_objects(pages_of(text))
    if kind == "xref-stream":
        return with_xref_stream(objects)
    if kind == "hybrid":
        return with_xref_stream(objects, hybrid=True)
    if kind == "updated":
        return updated(assemble(text_objects([[(72, 720, 12, "superseded")] for _ in pages_of(text)])), {n: b for n, b in objects.items() if b"stream\n" in b})
    if kind == "repaired":
        return assemble(objects).replace(b"startxref\n", b"startxref\n9")
    if kind == "encrypted":
        return encrypted(objects)
    if kind == "indirect-length":
        out = {}
        for n, b in objects.items():
            if b"stream\n" in b:
                length = b.split(b"/Length ")[1].split()[0]
                out[n + 50_000] = length
                b = b.replace(b"/Length " + length, b"/Length %d 0 R" % (n + 50_000), 1)
            out[n] = b
        return assemble(out)
    if kind == "scanned":  # nothing but streams
        return b"%PDF-1.7\n" + b"\n".join(b for n, b in sorted(objects.items()) if b"stream\n" in b)
    return assemble(objects)


# stream filters


def lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits that change early."""
    table, bits, out, n = {bytes([k]): k for k in range(256)}, 9, 256, 9
    nxt, w = 258, b""
    for c in data:
        x = w + bytes([c])
        if x in table:
            w = x
            continue
        out, n = out << bits | table[w], n + bits
        table[x] = nxt
        nxt += 1
        if nxt + 1 > 1 << bits:
            bits += 1
        if nxt >= 4094:
            out, n = out << bits | 256, n + bits
            table, bits, nxt = {bytes([k]): k for k in range(256)}, 9, 258
        w = bytes([c])
    if w:
        out, n = out << bits | table[w], n + bits
        nxt += 1
        if nxt + 1 > 1 << bits and bits < 12:
            bits += 1
    out, n = out << bits | 257, n + bits
    return (out << -n % 8).to_bytes((n + 7) // 8, "big")


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out) + b"\x80"


def png_rows(data: bytes, columns: int, tag: int) -> bytes:
    """Rows of bytes under PNG filter `tag` (0 none, 1 left, 2 above)."""
    data = data.ljust(-(-len(data) // columns) * columns)
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data), columns):
        row = data[at : at + columns]
        left = bytes([0]) + row[:-1]
        out += bytes([tag]) + bytes((a - b) & 255 for a, b in zip(row, (bytes(columns), left, above)[tag]))
        above = row
    return bytes(out)


def tiff_rows(data: bytes, columns: int) -> bytes:
    data = data.ljust(-(-len(data) // columns) * columns)
    return b"".join(bytes((a - b) & 255 for a, b in zip(r, b"\0" + r[:-1])) for r in (data[k : k + columns] for k in range(0, len(data), columns)))


FILTERS = ("none", "flate", "hex", "base85", "lzw", "run", "png-left", "png-up", "tiff", "chain")


def filtered(kind: str, text: str) -> bytes:
    """A text's lines in content streams under one of FILTERS."""
    objects = text_objects(pages_of(text), compress=False)
    for n, b in objects.items():
        if b"stream\n" not in b:
            continue
        raw = b.partition(b"stream\n")[2].removesuffix(b"\nendstream")
        parms = b""
        if kind == "flate":
            raw, name = zlib.compress(raw), b"/FlateDecode"
        elif kind == "hex":
            raw, name = raw.hex().encode() + b">", b"/AHx"
        elif kind == "base85":
            raw, name = base64.a85encode(raw) + b"~>", b"/ASCII85Decode"
        elif kind == "lzw":
            raw, name = lzw(raw), b"/LZWDecode"
        elif kind == "run":
            raw, name = run_length(raw), b"/RunLengthDecode"
        elif kind.startswith("png"):
            raw, name, parms = zlib.compress(png_rows(raw, 16, 1 if kind == "png-left" else 2)), b"/FlateDecode", b"/DecodeParms << /Predictor 15 /Columns 16 >>"
        elif kind == "tiff":
            raw, name, parms = zlib.compress(tiff_rows(raw, 12)), b"[/Fl]", b"/DecodeParms [<< /Predictor 2 /Columns 12 >>]"
        elif kind == "chain":
            raw, name, parms = base64.a85encode(zlib.compress(raw)) + b"~>", b"[/A85 /FlateDecode]", b"/DecodeParms [null << /Predictor 1 >>]"
        else:
            name = b""
        objects[n] = b"<< /Length %d %s %s >>\nstream\n" % (len(raw), b"/Filter " + name if name else b"", parms) + raw + b"\nendstream"
    return assemble(objects)


# fonts, text state, geometry


def _stream(body: bytes, info: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(body), info) + body + b"\nendstream"


def one_page(content: bytes, fonts: bytes, page: bytes, extra: dict[int, bytes], *, catalog: bytes = b"", xobjects: bytes = b"") -> bytes:
    """A file of one page with this content. Font F1 is Helvetica; fonts, xobjects, page and catalog: more entries of those
    dictionaries; extra objects are numbered from 20 on."""
    return assemble({
        1: b"<< /Type /Catalog /Pages 2 0 R " + catalog + b" >>", 2: b"<< /Type /Pages /Kids [4 0 R] /Count 1 /MediaBox [0 0 612 792] >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 3 0 R " + fonts + b" >> /XObject << " + xobjects + b" >> >> " + page + b" >>", 5: _stream(content), **extra,
    })


def fonts(key: int) -> bytes:
    """Lines in fonts of six kinds: WinAnsi, MacRoman, standard with differences, a Unicode map, two-byte codes, and one without
    any encoding."""
    n = b"%d" % key
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <30> <39> <0041> <61> <62> [<00660069> <03A9>] endbfrange"
    wide = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0030> <0039> <0030> endbfrange 1 beginbfchar <0001> <4E2D> endbfchar"
    extra = {
        20: b"<< /Type /Font /Subtype /TrueType /BaseFont /Mac /Encoding /MacRomanEncoding /FirstChar 32 /LastChar 255 /Widths [%s] >>" % b" ".join([b"600"] * 224),
        21: b"<< /Type /Font /Subtype /Type1 /BaseFont /Diff /Encoding << /BaseEncoding /StandardEncoding /Differences [65 /eacute /uni00DF /f_f] >> >>",
        22: b"<< /Type /Font /Subtype /Type3 /BaseFont /Mapped /ToUnicode 23 0 R >>", 23: _stream(cmap),
        24: b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [26 0 R] /ToUnicode 25 0 R >>", 25: _stream(wide), 26: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide /DW 500 /W [48 57 750] >>",
        27: b"<< /Type /Font /Subtype /Type3 /BaseFont /Bare /FirstChar 48 /LastChar 57 /Widths [%s] >>" % b" ".join([b"500"] * 10),
    }
    show = [(b"F1", literal("win é€ " + str(key))), (b"F2", b"(mac \\216 " + n + b")"), (b"F3", b"(ABC " + n + b")"), (b"F4", b"(" + n + b"ab)"), (b"F5", b"<" + b"".join(b"%04X" % c for c in n) + b"0001>"), (b"F6", b"(\\001" + n + b")")]
    content = b"".join(b"BT /%s 10 Tf 72 %d Td %s Tj ET\n" % (f, 700 - 40 * k, t) for k, (f, t) in enumerate(show))
    return one_page(content, b"/F2 20 0 R /F3 21 0 R /F4 22 0 R /F5 24 0 R /F6 27 0 R", b"", extra)


def text_operators(key: int) -> bytes:
    """Every way to show and place text: spacing, scaling, leading, rise, arrays, quotes, matrices, hidden text."""
    n = b"%d" % key
    content = (
        b"BT /F1 10 Tf 14 TL 72 700 Td [(Two) -400 (words) -20 (joined)] TJ T* (next " + n + b") Tj (line) ' 1 2 (quoted) \" ET "
        b"BT /F1 10 Tf 2 Tc 5 Tw 50 Tz 1 0 0 1 72 600 Tm (a b) Tj ET BT /F1 10 Tf 0 Tc 0 Tw 100 Tz 72 560 TD 3 Tr (hidden " + n + b") Tj ET "
        b"BT 0 Tr /F1 10 Tf 4 Ts 72 520 Td (raised) Tj ET q 2 0 0 2 10 20 cm BT 0 Ts /F1 10 Tf 50 200 Td (scaled) Tj ET Q "
        b"BT /F1 10 Tf 0 1 -1 0 300 400 Tm (upright) Tj ET BT /F1 10 Tf 72 360 Td (near) Tj 30 0 Td (by) Tj 200 0 Td (far) Tj ET"
    )
    return one_page(content, b"", b"", {})


def page_geometry(key: int) -> bytes:
    """A page of some rotation, crop box and unit with a line at (100, 200); the media box is inherited."""
    turn, unit = key % 4 * 90, 1 + key % 3
    page = b"/Rotate %d /UserUnit %d" % (turn, unit) + b" /CropBox [50 100 562 700]" * (key % 2)
    return one_page(b"BT /F1 12 Tf 100 200 Td (At %d) Tj ET" % key, b"", page, {})


def drawings(key: int) -> bytes:
    """Stroked paths in pieces, a rectangle, paths that leave no ruling, images, an inline image and a form that draws."""
    w = 100 + key % 200
    content = (
        b"72 670 m %d 670 l S %d.5 670.2 m %d 670.2 l S 72 610 %d 40 re S " % (100, 100, 72 + w, w)
        + b"10 10 m 60 60 l S 0 0 50 50 re f 5 5 50 0 re n 300 100 m 300 101 l S 320 100 m 320 180 l 321 180 m s "
        + b"q %d 0 0 50 72 300 cm /X1 Do Q q 0 40 -30 0 400 300 cm /X1 Do Q q 20 0 0 20 500 500 cm BI /W 2 /H 1 /BPC 8 /CS /G ID ab EI Q /X2 Do /X2 Do" % w
    )
    extra = {20: _stream(b"\0" * 6, b"/Type /XObject /Subtype /Image /Width 3 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray"), 21: _stream(b"0 0 m 0 30 l S", b"/Type /XObject /Subtype /Form /BBox [0 0 9 99] /Matrix [1 0 0 1 450 50]")}
    return one_page(content, b"", b"", extra, xobjects=b"/X1 20 0 R /X2 21 0 R")


# structure and interaction


def _text(value: str) -> bytes:
    """A text string in UTF-16 with its mark."""
    return b"<" + (b"\xfe\xff" + value.encode("utf-16-be")).hex().encode() + b">"


def interactive(key: int, name: str) -> bytes:
    """Outlines of two levels, tagged lines, a form with all kinds of fields, annotations and two attachments."""
    n, on = b"%d" % key, key % 2
    extra = {
        20: b"<< /First 21 0 R >>", 21: b"<< /Title " + _text(name + " Ω") + b" /Next 23 0 R /First 22 0 R >>", 22: b"<< /Title (Below " + n + b") /Next 21 0 R >>", 23: b"<< /Title (Last \\(" + n + b"\\)) >>",
        30: b"<< /RoleMap << /Head /Mid /Mid /H2 >> /K << /S /Document /K [<< /S /Head /Pg 4 0 R /Alt (alt) /K 0 >> << /S /P /Pg 4 0 R /K [1 << /Type /MCR /MCID 2 >>] >>] >> >>",
        40: b"<< /T (person) /Kids [41 0 R 42 0 R] >>", 41: b"<< /T (name) /FT /Tx /V (" + n + b") /Ff %d /Subtype /Widget /Rect [0 0 9 9] >>" % (2 + on), 42: b"<< /T (sig) /FT /Sig /V << /Name " + _text(name) + b" /M (D:2024) >> >>",
        43: b"<< /T (ok) /FT /Btn /AS /%s /Subtype /Widget /Rect [0 0 9 9] >>" % (b"Yes" if on else b"Off"), 44: b"<< /T (pick) /FT /Ch /V [(a) (" + n + b")] >>", 45: b"<< /T (one) /FT /Btn /Ff 32768 /V /B%d >>" % (key % 3),
        50: b"<< /Subtype /Link /Rect [1 2 3 %d] /A << /S /URI /URI (https://example.org/" % (key % 50 + 3) + n + b") >> >>", 51: b"<< /Subtype /Text /Rect [5 5 9 9] /Contents " + _text("note " + name) + b" >>", 52: b"<< /Subtype /Highlight >>",
        60: b"<< /Kids [61 0 R] /Names [(a) 62 0 R] >>", 61: b"<< /Names [(b) 63 0 R] >>", 62: b"<< /F (n.txt) /EF << /F 64 0 R >> >>", 63: b"<< /UF " + _text("../dir/N" + str(key) + ".TXT") + b" /EF << /F 65 0 R >> >>",
        64: _stream(b"hello " + n, b"/Subtype /text#2Fplain"), 65: _stream(zlib.compress(name.encode()), b"/Filter /FlateDecode"),
    }
    content = b"".join(b"/%s << /MCID %d >> BDC BT /F1 %d Tf 72 %d Td (%s) Tj ET EMC\n" % (t, k, z, 700 - 40 * k, b"Tagged " + n + b" %d" % k) for k, (t, z) in enumerate(((b"Head", 18), (b"P", 12), (b"P", 12)))) + b"BT /F1 12 Tf 72 500 Td (Untagged) Tj ET"
    catalog = b"/Outlines 20 0 R /StructTreeRoot 30 0 R /AcroForm << /Fields [40 0 R 43 0 R 44 0 R 45 0 R] %s >> /Names << /EmbeddedFiles 60 0 R >>" % (b"/XFA ()" if on else b"")
    return one_page(content, b"", b"/Annots [50 0 R 51 0 R 52 0 R 41 0 R 43 0 R]", extra, catalog=catalog)


FAULTS = ("none", "empty", "no-header", "too-large", "too-many-pages", "locked", "other-handler", "cyclic", "bomb", "form-cycle")


def faulty(kind: str, key: int) -> bytes:
    """A file that one of FAULTS keeps from being read, or from being read whole."""
    line = [[(72, 720, 12, f"Fine {key}")]]
    if kind == "empty":
        return b""
    if kind == "no-header":
        return b"just text " + b"%d" % key
    if kind == "too-large":
        return text_pdf(line) + b"%" * 60_000
    if kind == "too-many-pages":
        return text_pdf(line * 9)
    if kind == "locked":
        return encrypted(text_objects(line), b"open")
    if kind == "other-handler":
        return encrypted(text_objects(line)).replace(b"/V 1", b"/V 4")
    if kind == "cyclic":
        return assemble({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R] >>"})
    if kind == "bomb":
        return text_pdf(line, drawings={0: b" " * 300_000})
    if kind == "form-cycle":
        return one_page(b"BT /F1 12 Tf 72 720 Td (Fine %d) Tj ET /X Do" % key, b"", b"", {20: _stream(b"/X Do", b"/Subtype /Form")}, xobjects=b"/X 20 0 R")
    return text_pdf(line)


def report(title: str, paragraph: list[str], items: list[str], table: list[list[str]], *, merged: bool = False) -> bytes:
    """A page with a heading, a paragraph, a list and a ruled table (merged: the header's first two cells are one). The page is as high as the
    table needs. Cells are set in 11 points: text of 10 and less that repeats above 740 or below 60 is taken for running heads."""
    lines: list[tuple[float, float, float, str]] = [(72, 740, 20, title)] + [(72, 700 - 14 * k, 10, t) for k, t in enumerate(paragraph)]
    y = 700 - 14 * len(paragraph) - 26
    for t in items:
        lines.append((72, y, 10, "- " + t))
        y -= 14
    top, step, xs = y - 20, 20, [72, 192, 312, 432]
    up = max(0, step * len(table) + 40 - top)
    lines, top = [(x, y + up, size, t) for x, y, size, t in lines], top + up
    draw = []
    if table:
        low = top - step * len(table)
        draw += [b"%d %d m %d %d l S" % (xs[0], top - step * r, xs[-1], top - step * r) for r in range(len(table) + 1)]
        draw += [b"%d %d m %d %d l S" % (x, low, x, top - step * (merged and k == 1)) for k, x in enumerate(xs)]
        for r, row in enumerate(table):
            lines += [(xs[c] + 4, top - step * (r + 1) + 6, 11, t) for c, t in enumerate(row) if t]
    return text_pdf([lines], drawings={0: b"\n".join(draw)}, size=(612, 792 + up))
