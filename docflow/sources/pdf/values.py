"""PDF values: a lexer over bytes, and a parser of objects."""

from __future__ import annotations

import re
from typing import NamedTuple


class PdfError(Exception):
    """A file that can't be read on; `code` becomes the warning's."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Name(str):
    __slots__ = ()


class Word(str):
    """A bare word: an operator or keyword."""

    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


class InlineImage(NamedTuple):
    info: dict
    data: bytes


_BLANK = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
# after blanks: a number, a name, a string without escapes and brackets, a word, or the first byte of something else
_REST = rb"([+-]?(?:\d+\.?\d*|\.\d+)(?![^\0\t\n\x0c\r ()<>\[\]{}/%]))|/([^\0\t\n\x0c\r ()<>\[\]{}/%]*)|\(([^()\\]*)\)|([^\0\t\n\x0c\r ()<>\[\]{}/%]+)|([()<>\[\]{}]))?"
_TOKEN = re.compile(_BLANK.pattern + rb"(?:(?!)()()|" + _REST)
_TOKEN_OR_REF = re.compile(_BLANK.pattern + rb"(?:(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])|" + _REST)
_REF, _NUMBER, _NAME, _STRING, _WORD = 2, 3, 4, 5, 6
_HEX_BYTE, _NO_DIGIT = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"[^0-9A-Fa-f]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
END = Word("")
#: Names and words met before, as many as _KEPT, and what isn't a word but looks like one.
_NAMES: dict[bytes, Name] = {}
_WORDS: dict[bytes, object] = {b"true": True, b"false": False, b"null": None}
_KEPT = 4096


class Parser:
    """Values one after the other. refs: whether `1 0 R` is a reference (not so in content streams)."""

    def __init__(self, data: bytes, at: int = 0, *, refs: bool = True, max_depth: int = 100):
        self.data, self.at, self.max_depth = data, at, max_depth
        self.token = (_TOKEN_OR_REF if refs else _TOKEN).match

    def skip(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        """The next value; END at the end."""
        if depth > self.max_depth:
            raise PdfError("pdf.object.too_deep", "values are nested too deeply")
        data = self.data
        m = self.token(data, self.at)
        kind = m.lastindex
        self.at = m.end()
        if kind == _NUMBER:
            number = m[_NUMBER]
            return float(number) if b"." in number else int(number)
        if kind == _WORD:
            word = m[_WORD]
            return _WORDS[word] if word in _WORDS else self._word(word)
        if kind == _NAME:
            name = m[_NAME]
            return _NAMES[name] if name in _NAMES else self._name(name)
        if kind == _STRING:
            return m[_STRING]
        if kind == _REF:
            return Ref(int(m[1]), int(m[2]))
        if kind is None:
            return END
        c = data[self.at - 1 : self.at]
        if c == b"<":
            self.at -= 1
            return self._dict(depth) if data[self.at + 1 : self.at + 2] == b"<" else self._hex()
        if c == b"[":
            return self._array(depth)
        if c == b"(":
            self.at -= 1
            return self._literal()
        if c == b">" and data[self.at : self.at + 1] == b">":
            self.at += 1
        return Word(c.decode("latin-1"))

    @staticmethod
    def _word(word: bytes) -> Word:
        out = Word(word.decode("latin-1"))
        if len(_WORDS) < _KEPT:
            _WORDS[word] = out
        return out

    @staticmethod
    def _name(raw: bytes) -> Name:
        out = Name(_HEX_BYTE.sub(lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))
        if len(_NAMES) < _KEPT:
            _NAMES[raw] = out
        return out

    def _array(self, depth: int) -> list:
        out = []
        while True:
            if depth >= self.max_depth:  # an empty array is no deeper
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
            v = self.value(depth + 1)
            if v.__class__ is Word:
                if v is END:
                    raise PdfError("pdf.syntax", "an array has no end")
                if v == "]":
                    return out
            out.append(v)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("pdf.syntax", "a hex string has no end")
        digits = _NO_DIGIT.sub(b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _literal(self) -> bytes:
        data, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(data):
            c = data[i : i + 1]
            i += 1
            if c == b"\\":
                e = data[i : i + 1]
                i += 1
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif e.isdigit() and e < b"8":
                    m = re.compile(rb"[0-7]{1,3}").match(data, i - 1)
                    i = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == b"\r":
                    i += data[i : i + 1] == b"\n"
                elif e != b"\n":
                    out += e
                continue
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = i
                    return bytes(out)
            out += c
        raise PdfError("pdf.syntax", "a string has no end")

    def _dict(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        data, token = self.data, self.token
        while True:
            m = token(data, self.at)
            if m.lastindex != _NAME or depth >= self.max_depth:
                self.skip()
                if data[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    raise PdfError("pdf.syntax", "a dictionary's key isn't a name")
            else:
                self.at, name = m.end(), m[_NAME]
                key = _NAMES[name] if name in _NAMES else self._name(name)
            out[key] = self.value(depth + 1)

    def inline_image(self) -> InlineImage:
        """What follows BI, through EI."""
        info: dict = {}
        while True:
            key = self.value()
            if key == "ID" and isinstance(key, Word):
                break
            if not isinstance(key, Name):
                raise PdfError("pdf.content.inline_image", "an inline image's key isn't a name")
            info[key] = self.value()
        self.at += 1
        m = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ]|$)").search(self.data, self.at)
        if not m:
            raise PdfError("pdf.content.inline_image", "an inline image has no end")
        data, self.at = self.data[self.at : m.start()], m.end()
        return InlineImage(info, data)


def text_string(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else PDFDocEncoding."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1").translate(_PDF_DOC)


_PDF_DOC = {0x18 + i: c for i, c in enumerate("˘ˇˆ˙˝˛˚˜")} | {0x80 + i: c for i, c in enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")} | {0xA0: "€"}
