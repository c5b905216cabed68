"""Stream filters: Flate, LZW, ASCIIHex, ASCII85, RunLength, with predictors."""

from __future__ import annotations

import zlib

import numpy as np

from .values import Name, PdfError

_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
#: Their bytes stay as they are: the image is described, not decoded.
IMAGES = {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"}


def filter_names(info: dict) -> list[str]:
    f = info.get("Filter", info.get("F"))
    f = [f] if isinstance(f, Name) else f if isinstance(f, list) else []
    return [_SHORT.get(x, str(x)) for x in f if isinstance(x, Name)]


def decode(data: bytes, info: dict, max_bytes: int = 50 << 20) -> bytes:
    """The bytes of a stream. Each filter's output is at most max_bytes."""
    parms = info.get("DecodeParms", info.get("DP"))
    parms = parms if isinstance(parms, list) else [parms]
    for i, name in enumerate(filter_names(info)):
        p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
        if name in IMAGES:
            return data
        if name == "FlateDecode":
            data = _predict(_inflate(data, max_bytes), p)
        elif name == "LZWDecode":
            data = _predict(_lzw(data, p.get("EarlyChange", 1), max_bytes), p)
        elif name == "ASCIIHexDecode":
            digits = bytes(c for c in data.partition(b">")[0] if c in b"0123456789abcdefABCDEF")
            data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif name == "ASCII85Decode":
            data = _ascii85(data)
        elif name == "RunLengthDecode":
            data = _run_length(data, max_bytes)
        elif name != "Crypt":
            raise PdfError("pdf.stream.unsupported_filter", f"filter {name}")
        if len(data) > max_bytes:
            raise PdfError("pdf.stream.decoded_too_large", "a stream is too large when decoded")
    return data


def _inflate(data: bytes, max_bytes: int) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, max_bytes + 1)
    except zlib.error as e:
        raise PdfError("pdf.stream.flate", str(e)) from e
    if len(out) > max_bytes:
        raise PdfError("pdf.stream.decoded_too_large", "a stream is too large when decoded")
    return out


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.partition(b"~>")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _five(group)
                group = []
        elif c not in b"\0\t\n\x0c\r ":
            raise PdfError("pdf.stream.ascii85", "a character that ASCII85 doesn't have")
    if len(group) == 1:
        raise PdfError("pdf.stream.ascii85", "a last group of one character")
    if group:
        out += _five(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _five(group: list[int]) -> bytes:
    n = 0
    for g in group:
        n = n * 85 + g
    if n >> 32:
        raise PdfError("pdf.stream.ascii85", "a group above 32 bits")
    return n.to_bytes(4, "big")


def _run_length(data: bytes, max_bytes: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n == 128:
            return bytes(out)
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) > max_bytes:
            raise PdfError("pdf.stream.decoded_too_large", "a stream is too large when decoded")
    raise PdfError("pdf.stream.run_length", "no end of data")


def _lzw(data: bytes, early: int, max_bytes: int) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, before, bits, have = bytearray(), 9, b"", 0, 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code == 257:
            return bytes(out)
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise PdfError("pdf.stream.lzw", "a code that isn't in the table")
        out += entry
        if len(out) > max_bytes:
            raise PdfError("pdf.stream.decoded_too_large", "a stream is too large when decoded")
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        n = len(table) + early
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    raise PdfError("pdf.stream.lzw", "no end of data")


def _predict(data: bytes, p: dict) -> bytes:
    kind = p.get("Predictor", 1)
    if kind in (None, 1):
        return data
    colors, bits, columns = p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1)
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise PdfError("pdf.stream.predictor", "a TIFF predictor of other than 8 bits")
        if len(data) % row:
            raise PdfError("pdf.stream.predictor", "a last row that isn't whole")
        return np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, columns, colors), axis=1, dtype=np.uint8).tobytes()
    if not 10 <= kind <= 15:
        raise PdfError("pdf.stream.predictor", f"predictor {kind}")
    if len(data) % (row + 1):
        raise PdfError("pdf.stream.predictor", "a last row that isn't whole")
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        tag = data[at] if kind == 15 else kind - 10  # another predictor than 15 rules, whatever the row's tag
        line = bytearray(data[at + 1 : at + 1 + row])
        if tag == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(bytes(above), np.uint8)).astype(np.uint8).tobytes())
        elif tag in (1, 3, 4):
            for i in range(row):
                left = line[i - step] if i >= step else 0
                if tag == 1:
                    line[i] = line[i] + left & 255
                elif tag == 3:
                    line[i] = line[i] + (left + above[i]) // 2 & 255
                else:
                    corner = above[i - step] if i >= step else 0
                    line[i] = line[i] + _paeth(left, above[i], corner) & 255
        elif tag:
            raise PdfError("pdf.stream.predictor", f"row filter {tag}")
        out += line
        above = line
    return bytes(out)


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c
