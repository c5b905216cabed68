"""Content streams: text lines, ruling lines and image draws of a page."""

from __future__ import annotations

import math
import re

from .document import Document, Page, Stream
from .fonts import Font
from .values import END, InlineImage, Name, Parser, PdfError, Word

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_RTL, _LATIN, _CJK = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]"), re.compile("[A-Za-zÀ-ɏ]"), re.compile("[぀-ヿ㐀-鿿가-힯]")


def times(a, b):
    """The matrix that first does a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def move(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def page_matrix(page: Page):
    """From the page's space to points from the lower left corner of what is seen, upright."""
    x0, y0, x1, y1 = page.crop
    w, h = x1 - x0, y1 - y0
    turn = {0.0: IDENTITY, 90.0: (0, -1, 1, 0, 0, w), 180.0: (-1, 0, 0, -1, w, h), 270.0: (0, 1, -1, 0, h, 0)}.get(page.rotation, IDENTITY)
    u = page.unit
    return times(times((1, 0, 0, 1, -x0, -y0), turn), (u, 0, 0, u, 0, 0))


def page_size(page: Page) -> tuple[float, float]:
    w, h = (page.crop[2] - page.crop[0]) * page.unit, (page.crop[3] - page.crop[1]) * page.unit
    return (h, w) if page.rotation in (90.0, 270.0) else (w, h)


class _Line:
    """A text line that grows."""

    def __init__(self, key, font: Font | None, font_name: str, size: float, mode: int, vertical: bool, mark: dict | None, mcid):
        self.key, self.font, self.font_name, self.size, self.vertical, self.mark, self.mcid = key, font, font_name, size, vertical, mark, mcid
        self.parts: list[str] = []
        self.hidden: list[bool] = []
        self.modes = [mode]
        self.x0 = self.y0 = math.inf
        self.x1 = self.y1 = -math.inf
        self.base = (0.0, 0.0)
        self.end = (0.0, 0.0)


class Interpreter:
    """Runs the content of one page. Text, rulings and images come from the same walk."""

    def __init__(self, doc: Document, page: Page, marks: dict):
        self.doc, self.page, self.marks = doc, page, marks
        self.lines: list[dict] = []
        self.rulings: list[dict] = []
        self.images: list[dict] = []
        self.line: _Line | None = None
        self.text_object = self.serial = 0
        self.operations = 0
        self.mark_stack: list[tuple[str, int | None]] = []
        self.forms: list = []

    def run(self) -> None:
        self._program(self.doc.content(self.page), self.page.resources, page_matrix(self.page), IDENTITY)
        self._finish()

    def _exceeded(self) -> None:
        if self.operations > self.doc.limits.max_operations:
            raise PdfError("pdf.content.too_many_operations", "a page has too many operations")
        raise PdfError("pdf.content.too_many_outputs", "a page has too many lines")

    def _program(self, data: bytes, resources: dict, ctm, upright) -> None:
        """upright: the matrix without the page's rotation, by which text is vertical or not."""
        p = Parser(data, refs=False, max_depth=self.doc.limits.max_depth)
        s = {"ctm": ctm, "up": upright, "font": None, "name": "", "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0, "tr": 0, "w": 1.0}
        stack: list[dict] = []
        tm = tlm = IDENTITY
        path: list[tuple] = []
        at = start = None
        args: list = []

        def numbers(n: int) -> list[float] | None:
            v = args[-n:]
            if len(v) != n:
                return None
            for x in v:
                if x.__class__ is not float and x.__class__ is not int:
                    return None
            return [float(x) for x in v]

        def advance_line(tx: float, ty: float):
            nonlocal tm, tlm
            tlm = times((1, 0, 0, 1, tx, ty), tlm)
            tm = tlm
            if abs(ty) > max(0.5, 0.25 * abs(s["size"])):
                self.serial += 1

        value, most, outputs, lines, rulings, images = p.value, self.doc.limits.max_operations, self.doc.limits.max_outputs, self.lines, self.rulings, self.images
        while (v := value()) is not END:
            if v.__class__ is not Word:
                args.append(v)
                if len(args) > 4096:
                    raise PdfError("pdf.content.too_many_operands", "an operator has too many operands")
                continue
            self.operations += 1
            if self.operations > most or len(lines) + len(rulings) + len(images) > outputs:
                self._exceeded()
            op = str(v)
            if op == "ET":
                pass
            elif op == "Tj" and args and isinstance(args[-1], bytes):
                tm = self._show(args[-1], s, tm)
            elif op == "q":
                stack.append(dict(s))
                if len(stack) > 10 * self.doc.limits.max_depth:
                    raise PdfError("pdf.content.too_deep", "graphics states are nested too deeply")
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op == "cm" and (n := numbers(6)):
                s["ctm"], s["up"] = times(tuple(n), s["ctm"]), times(tuple(n), s["up"])
            elif op == "BT":
                tm = tlm = IDENTITY
                self.text_object += 1
                self.serial += 1
            elif op == "Tf" and len(args) >= 2 and isinstance(args[-2], Name):
                fonts = self.doc.load(resources.get("Font")) or {}
                s["font"], s["name"] = self.doc.font(fonts[args[-2]]) if args[-2] in fonts else None, str(args[-2])
                s["size"] = float(args[-1]) if isinstance(args[-1], (int, float)) else s["size"]
            elif op in ("Tr", "Tc", "Tw", "TL", "Ts") and (n := numbers(1)):
                s[op.lower()] = int(n[0]) if op == "Tr" else n[0]
            elif op == "Tz" and (n := numbers(1)):
                s["tz"] = n[0] / 100
            elif op in ("Td", "TD") and (n := numbers(2)):
                if op == "TD":
                    s["tl"] = -n[1]
                advance_line(*n)
            elif op == "Tm" and (n := numbers(6)):
                tm = tlm = tuple(n)
                self.serial += 1
            elif op == "T*":
                advance_line(0, -s["tl"])
            elif op == "TJ" and args and isinstance(args[-1], list):
                tm = self._show_array(args[-1], s, tm)
            elif op == "'" and args and isinstance(args[-1], bytes):
                advance_line(0, -s["tl"])
                tm = self._show(args[-1], s, tm)
            elif op == '"' and len(args) >= 3 and isinstance(args[-1], bytes):
                s["tw"], s["tc"] = float(args[-3]), float(args[-2])
                advance_line(0, -s["tl"])
                tm = self._show(args[-1], s, tm)
            elif op in ("BMC", "BDC"):
                mcid = None
                if op == "BDC" and args:
                    props = args[-1]
                    if isinstance(props, Name):
                        props = self.doc.load((self.doc.load(resources.get("Properties")) or {}).get(props))
                    mcid = props.get("MCID") if isinstance(props, dict) else None
                self.mark_stack.append((str(args[0]) if args else "", mcid if isinstance(mcid, int) else None))
            elif op == "EMC":
                if self.mark_stack:
                    self.mark_stack.pop()
            elif op == "Do" and args and isinstance(args[-1], Name):
                self._draw(args[-1], resources, s["ctm"], s["up"])
            elif op == "BI":
                self._inline(p.inline_image(), s["ctm"])
            elif op == "w" and (n := numbers(1)):
                s["w"] = n[0]
            elif op == "m" and (n := numbers(2)):
                at = start = move(s["ctm"], *n)
            elif op == "l" and (n := numbers(2)):
                to = move(s["ctm"], *n)
                if at:
                    path.append((*at, *to))
                at = to
                start = start or to
            elif op == "h":
                if at and start and at != start:
                    path.append((*at, *start))
                at = start
            elif op == "re" and (n := numbers(4)):
                x, y, w, h = n
                c = [move(s["ctm"], a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                path += [(*c[i], *c[(i + 1) % 4]) for i in range(4)]
                at = start = c[0]
            elif op in ("S", "s", "B", "B*", "b", "b*"):
                if op in ("s", "b", "b*") and at and start and at != start:
                    path.append((*at, *start))
                self._rule(path, s["w"] * math.sqrt(abs(s["ctm"][0] * s["ctm"][3] - s["ctm"][1] * s["ctm"][2])))
                path, at, start = [], None, None
            elif op in ("n", "f", "F", "f*"):
                path, at, start = [], None, None
            args = []

    # paths and images

    def _rule(self, path: list[tuple], width: float) -> None:
        for x1, y1, x2, y2 in path:
            dx, dy = abs(x1 - x2), abs(y1 - y2)
            if dy <= 0.5 and dx >= 2:
                y = (y1 + y2) / 2
                row = ("h", min(x1, x2), y, max(x1, x2), y)
            elif dx <= 0.5 and dy >= 2:
                x = (x1 + x2) / 2
                row = ("v", x, min(y1, y2), x, max(y1, y2))
            else:
                continue
            self.rulings.append(dict(zip(("orientation", "x1", "y1", "x2", "y2"), (row[0], *(round(v, 6) for v in row[1:])))) | {"page_index": self.page.index, "width": round(width, 6), "segment_count": 1})

    def _image(self, name: str, ctm, w, h) -> None:
        c = [move(ctm, a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
        xs, ys = [x for x, _ in c], [y for _, y in c]
        area = abs(sum(c[i][0] * c[(i + 1) % 4][1] - c[(i + 1) % 4][0] * c[i][1] for i in range(4))) / 2
        self.images.append({
            "page_index": self.page.index, "draw_no": len(self.images), "name": name, "x": round(min(xs), 6), "y": round(min(ys), 6), "width": round(max(xs) - min(xs), 6), "height": round(max(ys) - min(ys), 6), "area": round(area, 6),
            "image_width": w if isinstance(w, int) else None, "image_height": h if isinstance(h, int) else None,
        })

    def _inline(self, image: InlineImage, ctm) -> None:
        self._image("inline", ctm, image.info.get("W", image.info.get("Width")), image.info.get("H", image.info.get("Height")))

    def _draw(self, name: str, resources: dict, ctm, upright) -> None:
        ref = (self.doc.load(resources.get("XObject")) or {}).get(name)
        x = self.doc.load(ref)
        if not isinstance(x, Stream):
            return
        kind = self.doc.load(x.info.get("Subtype"))
        if kind == "Image":
            self._image(name, ctm, self.doc.load(x.info.get("Width")), self.doc.load(x.info.get("Height")))
        elif kind == "Form":
            if x.key in self.forms or len(self.forms) > self.doc.limits.max_depth:
                raise PdfError("pdf.content.form_cycle", "a form draws itself")
            self.forms.append(x.key)
            m = [self.doc.load(v) for v in self.doc.load(x.info.get("Matrix")) or IDENTITY]
            inner = self.doc.load(x.info.get("Resources"))
            m = tuple(float(v) for v in m)
            self._program(self.doc.decoded(x), inner if isinstance(inner, dict) else resources, times(m, ctm), times(m, upright))
            self.forms.pop()

    # text

    def _show_array(self, items: list, s: dict, tm):
        before = ""
        for k, x in enumerate(items):
            if isinstance(x, bytes):
                tm = self._show(x, s, tm)
                before = self.line.parts[-1] if self.line and self.line.parts else ""
            elif isinstance(x, (int, float)):
                shift = -x / 1000 * s["size"] * s["tz"]
                scale = math.hypot(*times(tm, s["ctm"])[:2])
                follow = next((y for y in items[k + 1 :] if isinstance(y, bytes) and y), None)
                if self.line and follow is not None and before and shift * scale >= max(abs(s["size"]) * scale * 0.25, 0.5) and not before[-1:].isspace():
                    first = next((t for _, t, _ in s["font"].glyphs(follow[:4])), "") if s["font"] else follow[:1].decode("latin-1")
                    if not first[:1].isspace():
                        self.line.parts.append(" ")
                tm = times((1, 0, 0, 1, shift, 0), tm)
                if self.line:
                    self.line.end = move(times(tm, s["ctm"]), 0, s["ts"])
        return tm

    def _show(self, raw: bytes, s: dict, tm):
        font: Font | None = s["font"]
        size, tz = s["size"], s["tz"]
        shown, ems, n, spaces, measured = font.measure(raw) if font else (raw.decode("latin-1"), 0.5 * len(raw), len(raw), raw.count(b" "), False)
        if not shown:
            return tm
        width = (ems * size + n * s["tc"] + spaces * s["tw"]) * tz
        trm = times(tm, s["ctm"])
        here, end = move(trm, 0, s["ts"]), move(trm, width, s["ts"])
        scale_y = math.hypot(trm[2], trm[3])
        high = abs(size) * scale_y
        way = times(tm, s["up"])
        vertical = abs(way[1]) > 1.25 * abs(way[0])
        tag, mcid = next(((a, b) for a, b in reversed(self.mark_stack) if b is not None), ("", None))
        key = (self.text_object, self.serial, mcid)
        line = self.line
        gap = None
        if line is not None and not line.vertical and not vertical:
            gap = here[0] - line.end[0]
            level = abs(here[1] - line.base[1]) <= max(0.5, 0.05 * high)
            same = line.key == key or (line.font_name == s["name"] and line.mcid == mcid and abs(line.size - high) < 1e-6 and abs(gap) <= 0.1 * high)
            near = -0.8 * high <= gap <= 2.5 * high
            if not (level and near and (same or line.key[0] == self.text_object)):
                line = None
        elif line is not None and not (line.key == key and line.vertical == vertical):
            line = None
        if line is None:
            self._finish()
            line = self.line = _Line(key, font, s["name"], high, s["tr"], vertical, self.marks.get((self.page.index, mcid)) if mcid is not None else None, mcid)
            line.base = here
        elif gap is not None and self._wants_space(line, shown, gap, high, measured):
            line.parts.append(" ")
        line.parts.append(shown)
        line.hidden.append(s["tr"] == 3)
        line.modes.append(s["tr"])
        line.end = end
        (xa, ya), (xb, yb) = move(trm, width, s["ts"] + size), move(trm, 0, s["ts"] + size)
        line.x0, line.x1 = min(line.x0, here[0], end[0], xa, xb), max(line.x1, here[0], end[0], xa, xb)
        line.y0, line.y1 = min(line.y0, here[1], end[1], ya, yb), max(line.y1, here[1], end[1], ya, yb)
        return times((1, 0, 0, 1, width, 0), tm)

    @staticmethod
    def _wants_space(line: _Line, text: str, gap: float, size: float, measured: bool) -> bool:
        """Whether a gap between two spans of a line is a space."""
        left = "".join(line.parts)[-1:]
        if not left or left.isspace() or text[:1].isspace() or text[0] in ",.;:!?)]}%" or left in "([{-/" or _CJK.match(left) or _CJK.match(text[0]):
            return False
        return gap >= (0.08 * size if measured else 0.12 * size)

    def _finish(self) -> None:
        line, self.line = self.line, None
        if line is None:
            return
        text = "".join(line.parts)
        if not text.strip():
            return
        r, n = len(_RTL.findall(text)), len(_LATIN.findall(text))
        direction = "vertical" if line.vertical else "rtl" if r > n else "ltr" if n or _CJK.search(text) else "unknown"
        f = line.font
        self.lines.append({
            "page_index": self.page.index, "text": text, "x": round(line.x0, 6), "y": round(line.y0, 6), "width": round(line.x1 - line.x0, 6), "height": round(line.y1 - line.y0, 6), "font_size": round(line.size, 6), "font_name": line.font_name,
            "base_font": f.base if f else None, "font_trusted": bool(f and f.trusted), "has_to_unicode": bool(f and f.cmap and f.cmap.map), "confidence": f.confidence if f else 0.6, "direction": direction, "text_render_mode": line.modes[-1],
            "hidden": all(line.hidden), "mcid": line.mcid, "structure_role": line.mark["role"] if line.mark else None, "structure_path": line.mark["path"] if line.mark else None, "source": "tagged-pdf" if line.mark and line.mark["role"] else "pdf-text",
        })


def merge_rulings(rulings: list[dict], axis_gap: float = 0.5, gap: float = 1.0) -> list[dict]:
    """Rulings of a page and orientation whose axes are within axis_gap and whose extents meet or nearly so are one: axis by
    length, extent from end to end. Repeated until nothing merges; the first keeps its place."""
    out: list[dict] = []
    for kind in ("h", "v"):
        a, low, high = ("y1", "x1", "x2") if kind == "h" else ("x1", "y1", "y2")
        other = "y2" if kind == "h" else "x2"
        rows = [dict(r) for r in rulings if r["orientation"] == kind]
        changed = True
        while changed:
            changed, done = False, []
            near: dict[int, list[int]] = {}  # places in done by axis, in pieces of axis_gap
            for r in rows:
                at = int(r[a] // axis_gap)
                for k in sorted(k for piece in range(at - 2, at + 3) for k in near.get(piece, ())):
                    d = done[k]
                    if d["page_index"] == r["page_index"] and abs(d[a] - r[a]) <= axis_gap and r[low] <= d[high] + gap and d[low] <= r[high] + gap:
                        x, y = max(d[high] - d[low], 1e-9), max(r[high] - r[low], 1e-9)
                        near[int(d[a] // axis_gap)].remove(k)
                        d[a] = d[other] = round((d[a] * x + r[a] * y) / (x + y), 6)
                        near.setdefault(int(d[a] // axis_gap), []).append(k)
                        d[low], d[high] = min(d[low], r[low]), max(d[high], r[high])
                        d["width"], d["segment_count"] = max(d["width"], r["width"]), d["segment_count"] + r["segment_count"]
                        changed = True
                        break
                else:
                    near.setdefault(at, []).append(len(done))
                    done.append(r)
            rows = done
        out += rows
    return out


def scan_streams(data: bytes, limits) -> list[dict]:
    """Lines of a file whose structure can't be read: every stream that decodes is taken for content, without a page."""
    from .filters import decode

    out: list[dict] = []
    at = 0
    while m := _STREAM.search(data, at):
        at = m.end()
        info = _dictionary_before(data, m.start() + 2)
        if info is None:
            continue
        length = info.get("Length")
        end = at + length if isinstance(length, int) and length >= 0 else -1
        if end < 0 or not _STREAM_END.match(data, end):
            end = data.find(b"endstream", at)
            if end < 0:
                continue
            end -= 2 if data[end - 2 : end] == b"\r\n" else 1 if data[end - 1 : end] in (b"\n", b"\r") else 0
        try:
            body = decode(data[at:end], info, limits.max_stream_bytes)
            page = Page(0, [0, 0, 612, 792], [0, 0, 612, 792], 0.0, 1.0, {}, [])
            shell = Document.__new__(Document)
            shell.limits, shell.cache, shell.where, shell.open, shell.fonts = limits, {}, {}, set(), {}
            it = Interpreter(shell, page, {})
            it._program(body, {}, IDENTITY, IDENTITY)
            it._finish()
            out += [x | {"page_index": None} for x in it.lines]
        except (PdfError, ValueError, IndexError, KeyError, TypeError):
            pass
        at = end
    return out


_STREAM, _STREAM_END = re.compile(rb">>[\0\t\n\x0c\r ]*stream\r?\n"), re.compile(rb"[\0\t\n\x0c\r ]*endstream")


def _dictionary_before(data: bytes, end: int, most: int = 4096) -> dict | None:
    """The outermost dictionary that ends at end. Two less-than signs before it may be of other objects, or of the bytes of a stream before it."""
    low = max(0, end - most)
    low = max(low, data.rfind(b"endobj", low, end), data.rfind(b"endstream", low, end))
    start = data.find(b"<<", low, end)
    while start >= 0:
        p = Parser(data, start)
        try:
            value = p.value()
            if p.at == end and isinstance(value, dict):
                return value
        except PdfError:
            pass
        start = data.find(b"<<", start + 1, end)
    return None
