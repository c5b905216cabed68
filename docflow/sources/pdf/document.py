"""The object graph of a PDF file: cross references, repair, decryption, pages, outlines, structure, interactions."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from . import filters
from .fonts import Font
from .values import Name, Parser, PdfError, Ref, Word, text_string

_ENTRY = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+([nf])(?=[\0\t\n\x0c\r ])")
_SECTION = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)(?=[\0\t\n\x0c\r ])")
_HEAD = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
#: Objects by their bytes: files of one origin have many in common. Nothing changes a value once it is read.
_SEEN: dict[bytes, tuple] = {}
_SEEN_BYTES, _SEEN_OBJECTS = 4096, 2048
#: Fonts by all that they are read from; and by their dictionary in _SEEN: the dictionary, what its references stood for, the size of the streams in it, the font.
_FONTS: dict[str, Font] = {}
_FONTS_OF: dict[tuple, tuple] = {}
_SEEN_FONTS = 256

_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


@dataclass
class Limits:
    max_bytes: int = 100 << 20
    max_stream_bytes: int = 50 << 20
    max_total_bytes: int = 200 << 20
    max_pages: int = 5000
    max_objects: int = 100_000
    max_depth: int = 100
    max_mappings: int = 65_536
    max_operations: int = 1_000_000
    max_outputs: int = 1_000_000
    max_pixels: int = 100_000_000
    max_seconds: float = 120.0

    def __post_init__(self):
        for name, value in vars(self).items():
            if not value > 0:
                raise ValueError(f"{name} must be above 0")


@dataclass
class Stream:
    info: dict
    raw: bytes
    key: tuple[int, int] | None = None


@dataclass
class Page:
    index: int
    media: list[float]
    crop: list[float]
    rotation: float
    unit: float
    resources: dict
    contents: list
    ref: Ref | None = None
    annots: list = field(default_factory=list)
    struct_parents: int | None = None


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


class Document:
    """A parsed file. tolerant: damaged cross references are rebuilt from the objects found, and streams end at endstream."""

    def __init__(self, data: bytes, *, password: str | None = None, tolerant: bool = False, limits: Limits | None = None):
        self.data, self.tolerant, self.limits = data, tolerant, limits or Limits()
        if len(data) > self.limits.max_bytes:
            raise PdfError("security.input_too_large", "the file is too large")
        m = re.match(rb"%PDF-(\d\.\d)", data[:32]) if len(data) >= 8 else None
        if not m:
            raise PdfError("pdf.invalid_header", "the file doesn't begin as a PDF does")
        self.version = m[1].decode()
        self.where: dict[int, tuple] = {}  # number -> (offset, generation) or (container, index)
        self.cache: dict[int, object] = {}
        self.members: dict[int, dict[int, object]] = {}
        self.open: set[int] = set()
        self.fonts: dict[object, Font] = {}
        self.total = 0
        self.key: bytes | None = None
        self.trailer: dict = {}
        self.mode, self.revisions = "", 1
        try:
            self._read_chain()
            if not isinstance(self.load(self.trailer.get("Root")), dict):
                raise PdfError("pdf.catalog.missing", "no catalog")
        except PdfError as e:
            if not tolerant or e.code.startswith(("security.", "pdf.encryption")) or "too_" in e.code:
                raise
            self._repair()
        if "Encrypt" in self.trailer:
            self._unlock(password)
        self.catalog = self.load(self.trailer.get("Root"))
        if not isinstance(self.catalog, dict):
            raise PdfError("pdf.catalog.missing", "no catalog")
        self.pages = self._pages()

    # cross references

    def _read_chain(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("pdf.xref.missing", "no startxref")
        start = Parser(self.data, at + 9).value()
        seen, todo, modes = set(), [start], []
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or not 0 <= at < len(self.data):
                raise PdfError("pdf.xref.offset", "a cross reference lies outside the file")
            if at in seen:
                raise PdfError("pdf.xref.cycle", "cross references form a circle")
            seen.add(at)
            p = Parser(self.data, at, max_depth=self.limits.max_depth)
            p.skip()
            if self.data[p.at : p.at + 4] == b"xref":
                trailer, rows, mode = self._table(p)
                if isinstance(hybrid := trailer.get("XRefStm"), int):
                    _, extra, _ = self._xref_stream(hybrid)
                    rows, mode = extra + rows, mode + "+hybrid-xref-stream"
            else:
                trailer, rows, mode = self._xref_stream(at)
            modes.append(mode)
            for number, entry in rows:
                self.where.setdefault(number, entry)
            if len(self.where) > self.limits.max_objects:
                raise PdfError("pdf.object.too_many", "too many objects")
            self.trailer = trailer | self.trailer
            if isinstance(trailer.get("Prev"), (int, float)):
                todo.append(int(trailer["Prev"]))
        self.mode, self.revisions = modes[0], len(modes)

    def _table(self, p: Parser) -> tuple[dict, list, str]:
        p.at += 4
        rows = []
        while True:
            if m := _SECTION.match(self.data, p.at):
                p.at, v, n = m.end(), int(m[1]), int(m[2])
            else:
                v = p.value()
                if isinstance(v, Word):
                    if v != "trailer":
                        raise PdfError("pdf.xref.syntax", "a cross reference table has no trailer")
                    break
                n = p.value()
            if not isinstance(v, int) or not isinstance(n, int) or n < 0 or n > self.limits.max_objects:
                raise PdfError("pdf.xref.syntax", "a section of a cross reference table is damaged")
            for k in range(n):
                if m := _ENTRY.match(self.data, p.at):
                    p.at = m.end()
                    rows.append((v + k, ("at", int(m[1]), int(m[2])) if m[3] == b"n" else ("free",)))
                    continue
                offset, generation, kind = p.value(), p.value(), p.value()
                if kind == "n" and isinstance(offset, int):
                    rows.append((v + k, ("at", offset, generation)))
                elif kind == "f":
                    rows.append((v + k, ("free",)))
                else:
                    raise PdfError("pdf.xref.syntax", "an entry of a cross reference table is damaged")
        trailer = p.value()
        if not isinstance(trailer, dict):
            raise PdfError("pdf.xref.syntax", "a trailer isn't a dictionary")
        return trailer, rows, "classic-xref"

    def _xref_stream(self, at: int) -> tuple[dict, list, str]:
        _, s = self._object_at(at)
        if not isinstance(s, Stream) or s.info.get("Type") != "XRef":
            raise PdfError("pdf.xref.syntax", "no cross reference there")
        w = s.info.get("W")
        if not (isinstance(w, list) and len(w) == 3 and all(isinstance(x, int) and 0 <= x <= 8 for x in w)) or not sum(w):
            raise PdfError("pdf.xref.widths", "the widths of a cross reference stream are damaged")
        body = self.decoded(s)
        index = s.info.get("Index") or [0, s.info.get("Size", 0)]
        rows, i, step = [], 0, sum(w)
        for first, n in zip(index[::2], index[1::2]):
            for k in range(n):
                if i + step > len(body):
                    break
                kind = int.from_bytes(body[i : i + w[0]], "big") if w[0] else 1
                a = int.from_bytes(body[i + w[0] : i + w[0] + w[1]], "big")
                b = int.from_bytes(body[i + w[0] + w[1] : i + step], "big")
                i += step
                if kind == 0:
                    rows.append((first + k, ("free",)))
                elif kind == 1:
                    rows.append((first + k, ("at", a, b)))
                elif kind == 2:
                    rows.append((first + k, ("in", a, b)))
        return s.info, rows, "xref-stream"

    def _repair(self) -> None:
        self.where, self.cache, self.members = {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj\b", self.data):
            self.where[int(m[1])] = ("at", m.start(), int(m[2]))
            if len(self.where) > self.limits.max_objects:
                raise PdfError("pdf.object.too_many", "too many objects")
        for number in list(self.where):
            try:
                s = self.load(Ref(number, 0))
            except PdfError:
                continue
            if isinstance(s, Stream) and s.info.get("Type") == "ObjStm":
                for k in self._members(number):
                    self.where.setdefault(k, ("in", number, 0))
        self.trailer = {}
        for m in reversed(list(re.finditer(rb"\btrailer\b", self.data))):
            try:
                found = Parser(self.data, m.end()).value()
            except PdfError:
                continue
            if isinstance(found, dict) and "Root" in found:
                self.trailer = found
                break
        else:
            for number in self.where:
                try:
                    v = self.load(Ref(number, 0))
                except PdfError:
                    continue
                info = v.info if isinstance(v, Stream) else v
                if isinstance(info, dict) and info.get("Type") == "Catalog":
                    self.trailer = {"Root": Ref(number, 0)}
                elif isinstance(info, dict) and info.get("Type") == "XRef" and "Root" in info:
                    self.trailer = info
        self.mode = "object-scan-repair"

    # objects

    def _object_at(self, at: int):
        end = self.data.find(b"endobj", at, at + _SEEN_BYTES)
        raw = self.data[at:end] if end >= 0 else None
        if raw in _SEEN and self.limits.max_depth == Limits.max_depth:
            return _SEEN[raw]
        p = Parser(self.data, at, max_depth=self.limits.max_depth)
        if m := _HEAD.match(self.data, at):
            number, generation, p.at = int(m[1]), int(m[2]), m.end()
        else:
            number, generation, word = p.value(), p.value(), p.value()
            if not isinstance(number, int) or not isinstance(generation, int) or word != "obj":
                raise PdfError("pdf.object.syntax", "no object there")
        value = p.value()
        p.skip()
        if raw is not None and p.at == end and self.limits.max_depth == Limits.max_depth:
            if len(_SEEN) >= _SEEN_OBJECTS:
                _SEEN.clear()
            _SEEN[raw] = (number, generation), value
        if not isinstance(value, dict) or self.data[p.at : p.at + 6] != b"stream":
            return (number, generation), value
        begin = p.at + 6
        begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1 if self.data[begin : begin + 1] in (b"\n", b"\r") else 0
        length = value.get("Length")
        own = not isinstance(length, Ref)
        if not own:
            length = self.load(length)
        end = begin + length if isinstance(length, int) and length >= 0 else -1
        if end < 0 or end > len(self.data) or not re.match(rb"[\0\t\n\x0c\r ]*endstream", self.data[end : end + 20]):
            if not self.tolerant:
                raise PdfError("pdf.stream.length", "a stream's length is wrong")
            own = False
            end = self.data.find(b"endstream", begin)
            if end < 0:
                raise PdfError("pdf.stream.length", "a stream has no end")
            end -= 2 if self.data[end - 2 : end] == b"\r\n" else 1 if self.data[end - 1 : end] in (b"\n", b"\r") else 0
        found = (number, generation), Stream(value, self.data[begin:end], (number, generation))
        if own and raw is not None and end + 9 <= at + len(raw) and self.limits.max_depth == Limits.max_depth:
            if len(_SEEN) >= _SEEN_OBJECTS:
                _SEEN.clear()
            _SEEN[raw] = found
        return found

    def _members(self, number: int) -> dict[int, object]:
        if number not in self.members:
            s = self.load(Ref(number, 0))
            if not isinstance(s, Stream):
                raise PdfError("pdf.object_stream.missing", "an object stream is missing")
            body, first, n = self.decoded(s), s.info.get("First"), s.info.get("N")
            if not isinstance(first, int) or not isinstance(n, int) or n > self.limits.max_objects:
                raise PdfError("pdf.object_stream.syntax", "an object stream's head is damaged")
            p, pairs = Parser(body, max_depth=self.limits.max_depth), []
            for _ in range(n):
                a, b = p.value(), p.value()
                if not isinstance(a, int) or not isinstance(b, int):
                    raise PdfError("pdf.object_stream.syntax", "an object stream's head is damaged")
                pairs.append((a, b))
            self.members[number] = {a: Parser(body, first + b, max_depth=self.limits.max_depth).value() for a, b in pairs}
        return self.members[number]

    def load(self, value):
        """The value that a reference stands for; others as they are. A missing object is null."""
        hops = 0
        while isinstance(value, Ref):
            hops += 1
            number = value.number
            if hops > 32 or number in self.open:
                raise PdfError("pdf.object.cycle", "references form a circle")
            if number not in self.cache:
                place = self.where.get(number, ("free",))
                self.open.add(number)
                try:
                    if place[0] == "at":
                        key, found = self._object_at(place[1])
                        if key[0] != number:
                            raise PdfError("pdf.object.number", "an object isn't where it should be")
                        if self.key:
                            found = self._decrypt(found, key)
                    elif place[0] == "in":
                        found = self._members(place[1]).get(number)
                    else:
                        found = None
                finally:
                    self.open.discard(number)
                self.cache[number] = found
            value = self.cache[number]
        return value

    def decoded(self, s: Stream) -> bytes:
        info = {k: self.load(v) for k, v in s.info.items() if k in ("Filter", "DecodeParms", "F", "DP")}
        if isinstance(info.get("Filter"), list):
            info["Filter"] = [self.load(x) for x in info["Filter"]]
        if isinstance(info.get("DecodeParms"), list):
            info["DecodeParms"] = [self.load(x) for x in info["DecodeParms"]]
        out = filters.decode(s.raw, info, self.limits.max_stream_bytes)
        self._count(len(out))
        return out

    def _count(self, n: int) -> None:
        self.total += n
        if self.total > self.limits.max_total_bytes:
            raise PdfError("pdf.stream.total_too_large", "streams are too large in all")

    # standard security handler, revision 2

    def _unlock(self, password: str | None) -> None:
        e = self.load(self.trailer["Encrypt"])
        if not isinstance(e, dict) or e.get("Filter") != "Standard" or e.get("V") not in (1, 2) or e.get("R") != 2 or e.get("Length", 40) != 40:
            raise PdfError("pdf.encryption.unsupported", "only the standard handler of revision 2 with 40 bits is known")
        first = (self.load(self.trailer.get("ID")) or [b""])[0]
        word = ((password or "").encode("latin-1", "replace") + _PAD)[:32]
        key = hashlib.md5(word + e["O"][:32] + (int(e["P"]) & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()[:5]
        if rc4(key, _PAD) != e["U"][:32]:
            raise PdfError("pdf.encryption.password_incorrect" if password else "pdf.encryption.password_required", "the file needs a password" if not password else "the password is wrong")
        self.key = key
        keep = self.trailer["Encrypt"]
        self.cache, self.members = ({keep.number: e} if isinstance(keep, Ref) else {}), {}

    def _decrypt(self, value, key: tuple[int, int], depth: int = 0):
        k = hashlib.md5(self.key + key[0].to_bytes(4, "little")[:3] + key[1].to_bytes(4, "little")[:2]).digest()[:10]
        if isinstance(value, Stream):
            return value if value.info.get("Type") == "XRef" else Stream(self._decrypt(value.info, key), rc4(k, value.raw), key)
        if isinstance(value, bytes):
            return rc4(k, value)
        if depth > self.limits.max_depth:
            raise PdfError("pdf.object.too_deep", "values are nested too deeply")
        if isinstance(value, list):
            return [self._decrypt(v, key, depth + 1) for v in value]
        if isinstance(value, dict):
            return {a: self._decrypt(v, key, depth + 1) for a, v in value.items()}
        return value

    # pages

    def _pages(self) -> list[Page]:
        out: list[Page] = []
        seen: set = set()

        def box(v) -> list[float] | None:
            v = self.load(v)
            v = [self.load(x) for x in v] if isinstance(v, list) else None
            if not v or len(v) != 4 or not all(isinstance(x, (int, float)) for x in v):
                return None
            return [float(min(v[0], v[2])), float(min(v[1], v[3])), float(max(v[0], v[2])), float(max(v[1], v[3]))]

        stack = [(self.catalog.get("Pages"), {}, 0)]
        while stack:
            ref, above, depth = stack.pop()
            if depth > self.limits.max_depth:
                raise PdfError("pdf.pages.too_deep", "the page tree is too deep")
            if isinstance(ref, Ref):
                if ref in seen:
                    raise PdfError("pdf.pages.cycle", "the page tree has a circle")
                seen.add(ref)
            node = self.load(ref)
            if not isinstance(node, dict):
                continue
            have = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate", "UserUnit") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                for kid in reversed(self.load(node.get("Kids")) or []):
                    stack.append((kid, have, depth + 1))
                continue
            if len(out) >= self.limits.max_pages:
                raise PdfError("security.page_count_exceeded", "too many pages")
            media = box(have.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
            contents = self.load(node.get("Contents"))
            contents = contents if isinstance(contents, list) else [contents]
            turn = self.load(have.get("Rotate")) or 0
            unit = self.load(have.get("UserUnit")) or 1
            resources, annots = self.load(have.get("Resources")), self.load(node.get("Annots"))
            out.append(
                Page(len(out), media, box(have.get("CropBox")) or media, float(turn % 360 if isinstance(turn, (int, float)) else 0), float(unit) if isinstance(unit, (int, float)) and unit > 0 else 1.0,
                     resources if isinstance(resources, dict) else {}, [c for c in contents if c is not None], ref if isinstance(ref, Ref) else None, annots if isinstance(annots, list) else [], self.load(node.get("StructParents")))
            )
        return out

    def content(self, page: Page) -> bytes:
        """The page's content streams as one program."""
        parts = [self.load(c) for c in page.contents]
        return b"\n".join(self.decoded(s) for s in parts if isinstance(s, Stream))

    def font(self, ref) -> Font | None:
        key = ref if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            info = self.load(ref)
            if not isinstance(info, dict):
                return None

            known = id(info), self.limits.max_mappings
            if known in _FONTS_OF and self._same(_FONTS_OF[known], info):
                self.fonts[key] = _FONTS_OF[known][3]
                return self.fonts[key]
            streams: dict[int, tuple] = {}
            met: list[tuple] = []

            def load(v):
                ref, v = v, self.load(v)
                if isinstance(v, Stream):
                    if id(v) not in streams:
                        streams[id(v)] = v.info, self.decoded(v)
                if isinstance(ref, Ref):
                    met.append((ref, v))
                return streams[id(v)] if isinstance(v, Stream) else v

            try:
                whole = repr((self.limits.max_mappings, self._read_by_fonts(info, load)))
            except (PdfError, ValueError, TypeError, AttributeError, KeyError, IndexError):
                whole = None  # what is wrong shows when it is read
            deps, size = list(met), sum(len(x) for _, x in streams.values())
            font = _FONTS.get(whole)
            if font is None:
                font = Font(info, load, self.limits.max_mappings)
            if whole is not None:
                if len(_FONTS) >= _SEEN_FONTS or len(_FONTS_OF) >= _SEEN_FONTS:
                    _FONTS.clear()
                    _FONTS_OF.clear()
                _FONTS[whole] = font
                if not any(isinstance(v, Stream) and any(isinstance(x, (Ref, list, dict)) for x in v.info.values()) for _, v in deps):
                    _FONTS_OF[known] = info, deps, size, font
            self.fonts[key] = font
        return self.fonts[key]

    def _same(self, known: tuple, info: dict) -> bool:
        """Whether a font of _FONTS_OF is that of this dictionary here, too: the same one, whose references stand for the same."""
        if known[0] is not info:
            return False
        for ref, was in known[1]:
            now = self.load(ref)
            if now is not was and not (isinstance(now, Stream) and isinstance(was, Stream) and now.raw == was.raw and now.info == was.info):
                return False
        self._count(known[2])
        return True

    def _read_by_fonts(self, value, load, depth: int = 0):
        """What Font reads of a font's dictionary, without references; of a stream its bytes."""
        value = load(value)
        if isinstance(value, tuple):
            return value[1]
        if depth > 8:
            raise ValueError("nested too deeply")
        if isinstance(value, list):
            return [self._read_by_fonts(v, load, depth + 1) if isinstance(v, (Ref, list, dict)) else v for v in value]
        if isinstance(value, dict):
            return {k: (type(value[k]).__name__, self._read_by_fonts(value[k], load, depth + 1)) for k in Font.KEYS if k in value}
        return value

    # outlines and structure

    def text(self, value) -> str | None:
        value = self.load(value)
        return text_string(value) if isinstance(value, bytes) else str(value) if isinstance(value, Name) else None

    def outlines(self) -> list[dict]:
        out, seen = [], set()
        root = self.load(self.catalog.get("Outlines"))
        stack = [(root.get("First"), 1)] if isinstance(root, dict) else []
        while stack:
            ref, depth = stack.pop()
            item = self.load(ref)
            if not isinstance(item, dict) or (isinstance(ref, Ref) and ref in seen) or depth > self.limits.max_depth:
                continue
            seen.add(ref if isinstance(ref, Ref) else id(item))
            if title := self.text(item.get("Title")):
                out.append({"item_no": len(out), "title": title, "depth": depth})
            stack.append((item.get("Next"), depth))
            stack.append((item.get("First"), depth + 1))
        return out

    def structure(self) -> dict[tuple[int, int], dict]:
        """(page, MCID) -> role, path and alternative text; a later mark of the same number counts."""
        root = self.load(self.catalog.get("StructTreeRoot"))
        if not isinstance(root, dict):
            return {}
        roles = self.load(root.get("RoleMap")) or {}
        page_of = {p.ref: p.index for p in self.pages if p.ref}
        marks: dict[tuple[int, int], dict] = {}
        seen: set = set()

        def role(name) -> str:
            known: set = set()
            name = self.load(name)
            while name in roles and name not in known:
                known.add(name)
                name = self.load(roles[name])
            return str(name or "")

        stack = [(root.get("K"), [], None, None)]
        while stack:
            ref, path, page, alt = stack.pop()
            item = self.load(ref)
            if isinstance(item, list):
                stack += [(x, path, page, alt) for x in reversed(item)]
            elif isinstance(item, int):
                if page is not None:
                    marks[(page, item)] = {"role": path[-1] if path else None, "path": path, "alt": alt}
            elif isinstance(item, dict):
                if isinstance(ref, Ref):
                    if ref in seen:
                        continue
                    seen.add(ref)
                at = page_of.get(item.get("Pg"), page)
                if item.get("Type") == "MCR" or "MCID" in item:
                    mcid = self.load(item.get("MCID"))
                    if at is not None and isinstance(mcid, int):
                        marks[(at, mcid)] = {"role": path[-1] if path else None, "path": path, "alt": alt}
                elif "S" in item and len(path) < self.limits.max_depth:
                    stack.append((item.get("K"), [*path, role(item["S"])], at, self.text(item.get("Alt")) or self.text(item.get("ActualText")) or alt))
        return marks

    # forms, annotations, attachments, signatures

    def form_fields(self) -> list[dict]:
        form = self.load(self.catalog.get("AcroForm"))
        if not isinstance(form, dict):
            return []
        widget_page = {a: p.index for p in reversed(self.pages) for a in p.annots if isinstance(a, Ref)}
        out: list[dict] = []
        seen: set = set()
        stack = [(r, {}, "", 0) for r in reversed(self.load(form.get("Fields")) or [])]
        while stack:
            ref, above, prefix, depth = stack.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            f = self.load(ref)
            if not isinstance(f, dict):
                continue
            if depth > self.limits.max_depth:
                raise PdfError("pdf.forms.too_deep", "the field tree is too deep")
            have = above | {k: f[k] for k in ("FT", "Ff", "V") if k in f}
            part = self.text(f.get("T"))
            name = ".".join(x for x in (prefix, part) if x)
            kids = [k for k in self.load(f.get("Kids")) or []]
            inner = [k for k in kids if isinstance(x := self.load(k), dict) and ("T" in x or "FT" in x or "Kids" in x)]
            kind = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}.get(self.load(have.get("FT")))
            if kind and (not inner or "V" in f):
                out.append(self._field(f, ref, have, name, kind, kids, widget_page))
            stack += [(k, have, name, depth + 1) for k in reversed(inner)]
        return [x | {"field_no": n} for n, x in enumerate(out)]

    def _field(self, f: dict, ref, have: dict, name: str, kind: str, kids: list, widget_page: dict) -> dict:
        flags = self.load(have.get("Ff")) or 0
        widgets = [(ref, f)] + [(k, self.load(k)) for k in kids if isinstance(self.load(k), dict)]
        placed = [(r, w) for r, w in widgets if r in widget_page] or [(r, w) for r, w in widgets if "Rect" in w] or widgets[:1]
        w_ref, widget = placed[0]
        value, state, button = self.load(have.get("V")), None, None
        if kind == "button":
            button = "radio" if flags & 1 << 15 else "push" if flags & 1 << 16 else "checkbox"
            state = self.text(widget.get("AS")) or self.text(value)
        text = ", ".join(filter(None, (self.text(x) for x in value))) if isinstance(value, list) else self.text(value) if not isinstance(value, (int, float)) else str(value)
        signature = value if kind == "signature" and isinstance(value, dict) else {}
        return {
            "name": name, "type": kind, "value": None if kind == "signature" else text, "page_index": widget_page.get(w_ref), "read_only": bool(flags & 1), "required": bool(flags & 2), "button": button, "state": state,
            "checked": (state is not None and state != "Off") if button == "checkbox" else None, "signer": self.text(signature.get("Name")), "signed_at": self.text(signature.get("M")), "signature_status": "not-validated" if kind == "signature" else None,
        }

    def has_xfa(self) -> bool:
        form = self.load(self.catalog.get("AcroForm"))
        return isinstance(form, dict) and form.get("XFA") is not None

    def annotations(self) -> list[dict]:
        out = []
        for page in self.pages:
            for ref in page.annots:
                a = self.load(ref)
                if not isinstance(a, dict) or a.get("Subtype") not in ("Link", "Text"):
                    continue
                act = self.load(a.get("A"))
                uri = self.text(act.get("URI")) if isinstance(act, dict) and act.get("S") == "URI" else None
                rect = [self.load(x) for x in self.load(a.get("Rect")) or []]
                rect = [float(x) for x in rect] if len(rect) == 4 and all(isinstance(x, (int, float)) for x in rect) else None
                out.append({"annotation_no": len(out), "page_index": page.index, "subtype": str(a["Subtype"]), "contents": self.text(a.get("Contents")), "uri": uri, "rect": rect})
        return out

    def attachments(self) -> list[dict]:
        names = self.load(self.catalog.get("Names"))
        root = names.get("EmbeddedFiles") if isinstance(names, dict) else None
        out, seen, stack = [], set(), [(root, 0)]
        while stack:
            node, depth = stack.pop()
            at = node if isinstance(node, Ref) else id(node)
            node = self.load(node)
            if not isinstance(node, dict) or at in seen:
                continue
            if depth > self.limits.max_depth:
                raise PdfError("pdf.attachments.too_deep", "the tree of attachments is too deep")
            seen.add(at)
            pairs = self.load(node.get("Names")) or []
            for key, ref in zip(pairs[::2], pairs[1::2]):
                spec = self.load(ref)
                files = self.load(spec.get("EF")) if isinstance(spec, dict) else None
                s = next((x for x in (self.load((files or {}).get(k)) for k in ("UF", "F")) if isinstance(x, Stream)), None)
                out.append({"attachment_no": len(out), "name": (self.text(spec.get("UF")) or self.text(spec.get("F")) if isinstance(spec, dict) else None) or self.text(key) or "attachment",
                            "media_type": self.text(s.info.get("Subtype")) if s else None, "content": self.decoded(s) if s else None})
            stack += [(k, depth + 1) for k in reversed(self.load(node.get("Kids")) or [])]
        return out
