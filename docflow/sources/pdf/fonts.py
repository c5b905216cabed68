"""Fonts: simple encodings, glyph names, ToUnicode maps and widths."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .values import END, Name, Parser, PdfError, Word

_STANDARD = dict(zip(range(32, 127), map(chr, range(32, 127)))) | {0x27: "’", 0x60: "‘"} | dict(
    zip([0xA1, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xAB, 0xAC, 0xAD, 0xAE, 0xAF, 0xB1, 0xB2, 0xB3, 0xB4, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xBB, 0xBC, 0xBD, 0xBF, 0xC1, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, 0xE8, 0xE9, 0xEA, 0xEB, 0xF1, 0xF5, 0xF8, 0xF9, 0xFA, 0xFB],
        "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß")
)


@lru_cache
def simple_table(name: str | None) -> dict[int, str] | None:
    if name == "WinAnsiEncoding":
        return {b: bytes([b]).decode("cp1252", "ignore") or "•" for b in range(32, 256)} | {0x7F: "•", 0xA0: " ", 0xAD: "-"}
    if name == "MacRomanEncoding":
        return {b: bytes([b]).decode("mac_roman") for b in range(32, 256) if b != 127} | {0xCA: " "}
    if name == "StandardEncoding":
        return dict(_STANDARD)
    return None


@lru_cache
def _glyphs() -> dict[str, str]:
    out = {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    names = "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at"
    out |= {n: chr(32 + i) for i, n in enumerate(names.split())}
    out |= dict(zip("bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), "[\\]^_`{|}~"))
    for accent, mark in (("grave", "̀"), ("acute", "́"), ("circumflex", "̂"), ("tilde", "̃"), ("dieresis", "̈"), ("ring", "̊"), ("caron", "̌"), ("cedilla", "̧"), ("macron", "̄"), ("breve", "̆"), ("ogonek", "̨"), ("dotaccent", "̇"), ("hungarumlaut", "̋")):
        for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            if len(x := unicodedata.normalize("NFC", c + mark)) == 1:
                out[c + accent] = x
    out |= dict(zip("quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase endash emdash bullet ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright fraction florin trademark registered copyright degree section paragraph germandbls AE ae OE oe Oslash oslash Lslash lslash dotlessi minus plusminus multiply divide Euro sterling yen cent currency exclamdown questiondown periodcentered ordfeminine ordmasculine mu logicalnot onehalf onequarter threequarters onesuperior twosuperior threesuperior Eth eth Thorn thorn nbspace softhyphen".split(),
                    "‘’“”‚„–—•…†‡‰‹›«»⁄ƒ™®©°§¶ßÆæŒœØøŁłı−±×÷€£¥¢¤¡¿·ªºµ¬½¼¾¹²³ÐðÞþ ­"))
    out |= dict(zip("ff fi fl ffi ffl".split(), ("ff", "fi", "fl", "ffi", "ffl")))
    greek = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho . Sigma Tau Upsilon Phi Chi Psi Omega".split()
    for i, n in enumerate(greek):
        if n != ".":
            out[n], out[n.lower()] = chr(0x391 + i), chr(0x3B1 + i)
    out |= dict(zip("infinity partialdiff integral summation product radical approxequal notequal lessequal greaterequal element arrowright arrowleft".split(), "∞∂∫∑∏√≈≠≤≥∈→←"))
    return out


def glyph_text(name: str) -> str | None:
    """Text of a glyph's name: known, uniXXXX.., uXXXX to uXXXXXX, or parts joined by _."""
    base = name.split(".")[0] or name
    if base in _glyphs():
        return _glyphs()[base]
    if (m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base)) or (m := re.fullmatch(r"u([0-9A-F]{4,6})", base)):
        parts = re.findall("....", m[1]) if base.startswith("uni") else [m[1]]
        points = [int(p, 16) for p in parts]
        return "".join(map(chr, points)) if all(p < 0x110000 and not 0xD800 <= p < 0xE000 for p in points) else None
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    return None


def _hex_text(raw: bytes) -> str:
    if len(raw) > 512:
        raise PdfError("pdf.cmap.destination_too_long", "a mapping's target is too long")
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


class CMap:
    """A ToUnicode map."""

    def __init__(self, data: bytes, limit: int = 65536):
        self.map: dict[bytes, str] = {}
        self.spaces: list[tuple[bytes, bytes]] = []
        p, left, stack = Parser(data, refs=False), limit, []

        def put(code: bytes, text: str) -> None:
            nonlocal left
            left -= 1
            if left < 0:
                raise PdfError("pdf.cmap.too_many_mappings", "a map has too many entries")
            self.map[code] = text

        while (v := p.value()) is not END:
            if not isinstance(v, Word):
                stack.append(v)
                continue
            if v == "endcodespacerange":
                self.spaces += [(a, b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif v == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        put(a, _hex_text(b))
            elif v == "endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3]):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    if high - low + 1 > left:
                        raise PdfError("pdf.cmap.too_many_mappings", "a map has too many entries")
                    for k in range(low, high + 1):
                        code = k.to_bytes(len(a), "big")
                        if isinstance(c, list):
                            if k - low < len(c) and isinstance(c[k - low], bytes):
                                put(code, _hex_text(c[k - low]))
                        elif isinstance(c, bytes):
                            text = _hex_text(c)
                            put(code, text[:-1] + chr(min(ord(text[-1]) + k - low, 0x10FFFF)) if text else "")
            stack = []
        self.lengths = sorted({len(a) for a, _ in self.spaces} or {len(c) for c in self.map} or {1}, reverse=True)

    def codes(self, raw: bytes):
        """(code, text or None) of each character of a string, longest code first."""
        i = 0
        while i < len(raw):
            for n in self.lengths:
                code = raw[i : i + n]
                if len(code) == n and (code in self.map or any(len(a) == n and a <= code <= b for a, b in self.spaces)):
                    yield code, self.map.get(code)
                    i += n
                    break
            else:
                yield raw[i : i + 1], self.map.get(raw[i : i + 1])
                i += 1


def plain(byte: int) -> str:
    """A byte without a map; control characters as their pictures."""
    return chr(0x2400 + byte) if byte < 32 else "␡" if byte == 127 else chr(byte)


class Font:
    """What text needs to know of a font's dictionary."""

    #: All that is read of it, and of the dictionaries in it.
    KEYS = ("Subtype", "BaseFont", "ToUnicode", "Encoding", "BaseEncoding", "Differences", "FirstChar", "Widths", "DescendantFonts", "DW", "W")

    def __init__(self, info: dict, load, limit: int = 65536):
        get = lambda k: load(info.get(k))
        self.subtype, self.base = str(get("Subtype") or ""), str(get("BaseFont") or "")
        self._bytes = None
        self.cmap = None
        stream = get("ToUnicode")
        if isinstance(stream, tuple):
            self.cmap = CMap(stream[1], limit)
        encoding, differences = get("Encoding"), {}
        name = encoding if isinstance(encoding, Name) else None
        if isinstance(encoding, dict):
            name = load(encoding.get("BaseEncoding"))
            at = 0
            for x in load(encoding.get("Differences")) or []:
                x = load(x)
                if isinstance(x, int):
                    at = x
                elif isinstance(x, Name):
                    differences[at] = str(x)
                    at += 1
        self.encoding = str(name) if name else None
        table = simple_table(self.encoding)
        if table is None and differences:
            table = simple_table("StandardEncoding")
        self.table = dict(table) if table is not None else None
        self.unknown = False
        for code, glyph in differences.items():
            text = glyph_text(glyph)
            if text is None:
                self.unknown = True
            else:
                self.table[code] = text
        self.composite = self.subtype == "Type0"
        self.trusted = bool(self.cmap and self.cmap.map) or (not self.composite and simple_table(self.encoding) is not None and not self.unknown)
        self.widths: dict[int, float] = {}
        self.default_width: float | None = None
        first = get("FirstChar")
        if isinstance(first, int):
            for k, w in enumerate(get("Widths") or []):
                w = load(w)
                if isinstance(w, (int, float)):
                    self.widths[first + k] = float(w)
        if self.composite:
            below = load((get("DescendantFonts") or [None])[0])
            if isinstance(below, dict):
                self.default_width = float(load(below.get("DW")) or 1000)
                self._cid_widths(load(below.get("W")) or [], load)

    def _cid_widths(self, w: list, load) -> None:
        i = 0
        w = [load(x) for x in w]
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                for k, x in enumerate(w[i + 1]):
                    self.widths[w[i] + k] = float(load(x))
                i += 2
            elif i + 2 < len(w):
                for k in range(w[i], min(w[i + 1], w[i] + 65535) + 1):
                    self.widths[k] = float(w[i + 2])
                i += 3
            else:
                break

    def measure(self, raw: bytes) -> tuple[str, float, int, int, bool]:
        """A string's text, its width in ems (half an em for a glyph of unknown width), glyphs, single-byte spaces, and
        whether all widths were known. Fonts of one byte a glyph are looked up by tables."""
        if self.cmap or self.composite:
            found = list(self.glyphs(raw))
            return "".join(t for _, t, _ in found), sum(0.5 if w is None else w for _, _, w in found), len(found), sum(c == b" " for c, _, _ in found), all(w is not None for _, _, w in found)
        if self._bytes is None:
            all_ = list(self.glyphs(bytes(range(256))))
            self._bytes = [t for _, t, _ in all_], [0.5 if w is None else w for _, _, w in all_], {c[0] for c, _, w in all_ if w is None}
        texts, widths, unknown = self._bytes
        return "".join(map(texts.__getitem__, raw)), sum(map(widths.__getitem__, raw)), len(raw), raw.count(b" "), not unknown or unknown.isdisjoint(raw)

    @property
    def confidence(self) -> float:
        return 0.95 if self.cmap and self.cmap.map else 0.75 if self.subtype in ("Type1", "TrueType") else 0.6

    def glyphs(self, raw: bytes):
        """(code, text, width of 1 em or None) of each character."""
        if self.cmap:
            found = self.cmap.codes(raw)
        elif self.composite:
            found = ((raw[i : i + 2], None) for i in range(0, len(raw), 2))
        else:
            found = ((raw[i : i + 1], (self.table or {}).get(raw[i])) for i in range(len(raw)))
        for code, text in found:
            if text is None:
                text = "".join((self.table or {}).get(b) or plain(b) for b in code)
            n = int.from_bytes(code, "big")
            w = self.widths.get(n, self.default_width)
            yield code, text, None if w is None else w / 1000
