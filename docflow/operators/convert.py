"""One document's lines to Markdown, in plain Python: a sequential reader in which each kind of block ends where one of higher
priority begins. The priority: ruled table, borderless table, page anchor, equation, code, heading, list, paragraph.

The islands of operators/blocks.py do the same for headings, lists and paragraphs without leaving the JVM."""

from __future__ import annotations

import re
import statistics
import unicodedata
from collections import Counter

from . import ruled

LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"})
_FORMS = re.compile("[　！-ﾟﭐ-﷿ﹰ-﻿]")
_LINK = re.compile(r"https?://[^\s<>()]+|www\.[^\s<>()]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_LIST = re.compile(r"^(?:[-*]|(\d+)[.)])\s+(.+)$")
_CJK = r"[⺀-〿぀-ヿ㄀-ㄯ㐀-䶿一-鿿가-힯豈-﫿！-｠]"
_CAPTION = re.compile(r"^fig(?:ure|\.)?\s+(\d+)\b", re.I)
_NUMERIC = re.compile(r"^[-+]?\d+(?:\.\d+)?%?$")
_CODE = re.compile(r"(?:[{};]\s*$|^\s*(?:def|class|return|import|from|const|let|var|function|if|for|while|public|private|#include)\b|=>|\w+\([^)]*\)\s*[;{:]?$|^\s*[$>]\s+\w)")
_ASCII_SPACE = re.compile(r"\s+")
_MONO = re.compile(r"courier|mono|consolas|menlo|typewriter", re.I)


def normalize(text: str) -> str:
    """Ligatures spelled out, full-width and presentation forms composed, white space collapsed."""
    if text.isascii():
        return " ".join(_ASCII_SPACE.split(text)).strip()
    text = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text.translate(LIGATURES))
    return re.sub(r"[\s﻿]+", " ", text).strip()


def escape(text: str) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"([\\`*_\[\]])", r"\\\1", text)


def escape_inline(text: str) -> str:
    out, at = [], 0
    for m in _LINK.finditer(text):
        bare = m[0].rstrip(".,;:!?")
        out += [escape(text[at : m.start()]), f"[{escape(bare)}](https://{bare})" if bare.startswith("www.") else f"<{bare}>", m[0][len(bare) :]]
        at = m.end()
    return "".join([*out, escape(text[at:])])


def escape_paragraph(text: str) -> str:
    text = re.sub(r"^([#+-])", r"\\\1", escape_inline(text))
    return re.sub(r"^(\d+)([.)]\s)", r"\1\\\2", text)


def escape_html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


_INF = float("inf")


def _finite(*values) -> bool:
    for v in values:
        if not isinstance(v, (int, float)) or not -_INF < v < _INF:
            return False
    return True


def _placed(line: dict) -> bool:
    x, y = line.get("x"), line.get("y")
    if x.__class__ is float and y.__class__ is float:
        return -_INF < x < _INF and -_INF < y < _INF
    return _finite(x, y)


def is_running(line: dict) -> bool:
    return _finite(line.get("font_size"), line.get("y")) and line["font_size"] <= 10 and (line["y"] >= 740 or line["y"] <= 60)


def is_page_number(line: dict) -> bool:
    return is_running(line) and re.match(r"^(?:page\s*)?\d+(?:\s*/\s*\d+)?$", line["text"].strip(), re.I) is not None


def remove_running(lines: list[dict], keep_titles: bool = False) -> list[dict]:
    times = Counter(normalize(x["text"]) for x in lines if is_running(x))
    title = lambda x: keep_titles and x["y"] >= 740 and re.search("[A-Za-z]", x["text"])
    return [x for x in lines if not is_page_number(x) and not (is_running(x) and times[normalize(x["text"])] >= 2 and not title(x))]


# reading order


def _rows(lines: list[dict]) -> list[list[dict]]:
    rows: list[dict] = []
    for line in sorted(lines, key=lambda x: (-x["y"], x["x"], x["line_no"])):
        tol = max(2.0, 0.25 * (line["font_size"] or 12))
        last = rows[-1] if rows else None
        if last and abs(last["y"] - line["y"]) <= max(last["tol"], tol):
            last["y"] = (last["y"] * len(last["items"]) + line["y"]) / (len(last["items"]) + 1)
            last["tol"] = max(last["tol"], tol)
            last["items"].append(line)
        else:
            rows.append({"y": line["y"], "tol": tol, "items": [line]})
    return [r["items"] for r in rows]


def _tabular(items: list[dict]) -> bool:
    texts = [x["text"].strip() for x in items]
    return len(items) >= 2 and (any(_NUMERIC.match(t) for t in texts) or all(len(t) <= 24 and not re.search(r"[.!?:;]$", t) for t in texts))


def page_columns(lines: list[dict]) -> list[float]:
    rows = [r for items in _rows(lines) for r in ([items] if _tabular(items) or any(x.get("direction") == "rtl" for x in items) else [[x] for x in items])]
    if len(rows) < 4:
        return []
    tol = max(36.0, 3 * statistics.median(x["font_size"] or 12 for x in lines))
    found: list[list[float]] = []
    for x in sorted(min(i["x"] for i in r) for r in rows):
        for c in found:
            if abs(c[0] - x) <= tol:
                c[0] = (c[0] * c[1] + x) / (c[1] + 1)
                c[1] += 1
                break
        else:
            found.append([x, 1])
    found = [c for c in found if c[1] >= 2]
    edges = [c[0] for i, c in enumerate(found) if not i or c[0] - found[i - 1][0] >= 96]
    return edges if len(edges) >= 2 else []


def order_page(lines: list[dict]) -> list[dict]:
    if not all(_placed(x) for x in lines):
        return lines
    votes = Counter(x.get("direction") for x in lines)
    if votes["vertical"] > max(votes["rtl"], votes["ltr"]):
        cols: list[dict] = []
        for x in sorted(lines, key=lambda x: (-(x["x"] + x["width"] / 2), -x["y"], x["line_no"])):
            axis, tol = x["x"] + x["width"] / 2, max(4.0, 0.75 * x["width"])
            last = cols[-1] if cols else None
            if last and abs(last["axis"] - axis) <= max(last["tol"], tol):
                last["axis"] = (last["axis"] * len(last["items"]) + axis) / (len(last["items"]) + 1)
                last["items"].append(x)
            else:
                cols.append({"axis": axis, "tol": tol, "items": [x]})
        return [x for c in cols for x in sorted(c["items"], key=lambda x: (-x["y"], x["line_no"]))]
    columns = page_columns(lines)
    rows = []
    for items in _rows(lines):
        rtl = any(x.get("direction") == "rtl" for x in items)
        together = _tabular(items) or rtl
        items = sorted(items, key=lambda x: (-(x["x"] + x["width"]), x["line_no"])) if rtl else items
        rows += [items] if together and not columns else [[x] for x in items]
    if not columns:
        return [x for r in rows for x in r]
    out, pending = [], [[] for _ in columns]
    for r in rows:
        left, right = min(x["x"] for x in r), max(x["x"] + x["width"] for x in r)
        if left <= columns[0] + 24 and right >= columns[-1] + 24:
            out += [x for c in pending for x in c]
            pending = [[] for _ in columns]
            out += r
        else:
            k = min(range(len(columns)), key=lambda k: (abs(columns[k] - left), k))
            pending[k] += r
    return out + [x for c in pending for x in c]


# blocks


class _Reader:
    def __init__(self, lines: list[dict], outlines: list[dict], options: dict):
        self.lines, self.options = lines, options
        halves = Counter(int(x["font_size"] * 2 + 0.5) / 2 for x in lines if x["text"].strip() and _finite(x.get("font_size")))
        self.body = min(halves, key=lambda s: (-halves[s], s)) if halves else 12.0
        big = sorted((s for s in halves if s >= max(15.0, self.body + 2)), reverse=True)[:6]
        if len(halves) == 1 and self.body >= 15:
            big = [self.body]
        self.levels = {s: i + 1 for i, s in enumerate(big)}
        self.titles: dict[str, int] = {}
        for o in outlines:
            self.titles.setdefault(normalize(o["title"]).lower(), min(max(o["depth"], 1), 6))
        xs = [x["x"] for x in lines if _placed(x)]
        self.left, self.width = (min(xs) if xs else 72.0), max((x["width"] for x in lines if _placed(x)), default=0.0)
        self.stops = ruled.clusters([x["x"] for x in lines if _placed(x) and _LIST.match(x["text"].strip())], 12)
        self.conflicts: list[int] = []

    def heading(self, x: dict) -> int | None:
        t = normalize(x["text"])
        if m := re.fullmatch("H([1-6])", x.get("structure_role") or ""):
            if t and len(t) <= 160 and not (_finite(x.get("font_size")) and x["font_size"] < 0.85 * self.body):
                return int(m[1])
            self.conflicts.append(x["line_no"])
        if t.lower() in self.titles:
            return self.titles[t.lower()]
        return self.levels.get(int(x["font_size"] * 2 + 0.5) / 2) if _finite(x.get("font_size")) and t else None

    def code(self, x: dict) -> bool:
        return bool(_MONO.search(x.get("base_font") or "")) or (_placed(x) and x["x"] >= self.left + 32 and bool(_CODE.search(x["text"])))

    def equation(self, x: dict) -> bool:
        t = x["text"].strip()
        if not 3 <= len(t) <= 180 or not re.search(r"\S\s*[=<>≈≠≤≥]\s*\S", t) or re.search(r"[{};]\s*$|=>", t) or _LINK.search(t) or re.match(r"^</?[A-Za-z][^>]*>", t) or len(re.findall(r"\b[A-Za-z]{3,}\b", t)) >= 6:
            return False
        return bool(re.search("[Ͱ-Ͽ∀-⋿]", t)) or (_placed(x) and (x["x"] - self.left >= 24 or x["width"] <= 0.72 * self.width) and bool(re.search(r"[A-Za-z0-9]\s*=", t)) and len(t.split()) >= 3)

    def near(self, a: dict, b: dict, factor: float = 2.0, least: float = 24.0) -> bool:
        return a["page_index"] == b["page_index"] and _placed(a) and _placed(b) and 0 < a["y"] - b["y"] <= max(least, factor * (b["font_size"] or 12))

    def goes_on(self, a: dict, b: dict) -> bool:
        if a["page_index"] != b["page_index"] or not (_placed(a) and _placed(b)) or abs((a["font_size"] or 12) - (b["font_size"] or 12)) > 0.5:
            return False
        if b.get("direction") == "vertical" == a.get("direction"):
            return abs(a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2) <= max(4.0, 0.75 * b["width"]) and b["y"] < a["y"]
        if b.get("direction") == "rtl" == a.get("direction"):
            same_row = abs(a["y"] - b["y"]) <= max(2.0, 0.25 * (b["font_size"] or 12))
            if same_row or (abs(a["x"] + a["width"] - b["x"] - b["width"]) <= 4 and 0 < a["y"] - b["y"] <= max(14.0, 1.35 * b["font_size"])):
                return True
            return False
        if abs(a["x"] - b["x"]) > 4 or re.search(r"[.!?:;)。！？．｡]$", a["text"].rstrip()):
            return False
        return 0 < a["y"] - b["y"] <= max(14.0, 1.35 * (b["font_size"] or 12))

    def table_rows(self, at: int) -> list[list[dict]]:
        """Rows of cells of one height from here on, each of two cells at least and as many as the first."""
        rows: list[list[dict]] = []
        i = at
        while i < len(self.lines):
            first = self.lines[i]
            row = []
            while i < len(self.lines) and self._cell(self.lines[i]) and self.lines[i]["page_index"] == first["page_index"] and abs(self.lines[i]["y"] - first["y"]) <= 2:
                row.append(self.lines[i])
                i += 1
            if len(row) < 2 or (rows and len(row) != len(rows[0])) or (rows and rows[0][0]["page_index"] != first["page_index"]):
                break
            rows.append(sorted(row, key=lambda x: x["x"]))
        return rows

    def _cell(self, x: dict) -> bool:
        return _placed(x) and _finite(x.get("font_size")) and x["font_size"] < 15 and not _LIST.match(x["text"].strip()) and bool(x["text"].strip())


def numeric_columns(rows: list[list[str]]) -> list[bool]:
    """Columns whose body isn't empty and is numeric throughout."""
    return [bool(rows[1:]) and all(_NUMERIC.match(r[c].strip()) for r in rows[1:]) for c in range(len(rows[0]))]


def gfm(rows: list[list[str]]) -> str:
    right = numeric_columns(rows)
    line = lambda r: "| " + " | ".join(escape_inline(normalize(t)).replace("|", "\\|") for t in r) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join("---:" if n else "---" for n in right) + " |", *map(line, rows[1:])])


def html(cells: list[list[dict]]) -> str:
    """The first row is the head, the others the body; covered cells are left out."""
    out = ["<table>"]
    for r, row in enumerate(cells):
        if r < 2:
            out.append("  <thead>" if r == 0 else "  <tbody>")
        tag = "th" if r == 0 else "td"
        out.append("    <tr>")
        for c in row:
            if not c["covered"]:
                span = (f' rowspan="{c["row_span"]}"' if c["row_span"] > 1 else "") + (f' colspan="{c["column_span"]}"' if c["column_span"] > 1 else "")
                out.append(f"      <{tag}{span}>{escape_html(normalize(c['text']))}</{tag}>")
        out.append("    </tr>")
        if r == 0:
            out.append("  </thead>")
    return "\n".join([*out, *["  </tbody>"] * (len(cells) > 1), "</table>"])


def csv_text(rows: list[list[str]]) -> str:
    def cell(t: str) -> str:
        t = normalize(t)
        t = "'" + t if re.match(r"^[=+\-@]", t) else t
        return '"' + t.replace('"', '""') + '"' if re.search('[",\r\n]', t) else t

    return "".join(",".join(map(cell, r)) + "\n" for r in rows)


def visual_rows(cells: list[list[dict]]) -> list[list[str]]:
    """Rows of text; a ruled row whose cells hold several lines at the same heights is several rows."""
    out = []
    for row in cells:
        heights = ruled.clusters([round(l["y"], 3) for c in row for l in c["lines"]], 2.0)[::-1]
        filled = [sum(any(abs(l["y"] - y) <= 2 for l in c["lines"]) for c in row) for y in heights]
        if len(heights) > 1 and all(f >= 2 for f in filled):
            out += [[" ".join(l["text"].strip() for l in c["lines"] if abs(l["y"] - y) <= 2) for c in row] for y in heights]
        else:
            out.append([c["text"] for c in row])
    return out


def join_parts(parts: list[str]) -> str:
    out = parts[0] if parts else ""
    for p in parts[1:]:
        if re.search("[A-Za-z]-$", out) and re.match("[a-z]", p):
            out = out[:-1] + p
        else:
            out += ("" if re.search(_CJK + "$", out) and re.match(_CJK, p) else " ") + p
    return out


def fence(text: str) -> str:
    run = lambda c: max((len(m) for m in re.findall(re.escape(c) + "+", text)), default=0)
    a, b = max(3, run("`") + 1), max(3, run("~") + 1)
    return "`" * a if a <= b else "~" * b


def convert(lines: list[dict], rulings: list[dict] = (), images: list[dict] = (), outlines: list[dict] = (), **options) -> dict:
    """Markdown of a document's lines, with its blocks, tables, figures, source map and warnings.

    Options: page_anchors (False), keep_titles (False), html_fallback (True), tables (True), figures (True), formulas
    ([{equation_index, page_index, latex}]). Offsets of the source map are in code points."""
    warnings: list[dict] = []
    kept = remove_running([x for x in lines if x["text"].strip()], options.get("keep_titles", False))
    pages: dict = {}
    for x in kept:
        pages.setdefault(x["page_index"], []).append(x)
    ordered = [x for p in pages.values() for x in order_page(p)]
    reader = _Reader(ordered, list(outlines), options)
    tables, at_line, used = [], {}, set()
    if options.get("tables", True):
        by_page: dict = {}
        for r in rulings:
            by_page.setdefault(r["page_index"], []).append(r)
        on_page: dict = {}
        for x in lines:
            if x["page_index"] in by_page and _placed(x) and x["text"].strip():
                on_page.setdefault(x["page_index"], []).append(x)
        place = {x["line_no"]: i for i, x in enumerate(ordered)}
        for page, rows in sorted(by_page.items()):
            for g in ruled.grids(rows):
                cells = ruled.fill(g, on_page.get(page, []))
                mine = [l["line_no"] for row in cells for c in row for l in c["lines"]]
                spans = any(c["row_span"] > 1 or c["column_span"] > 1 for row in cells for c in row)
                table = {"page_index": page, "kind": "ruled", "cells": cells, "confidence": 0.9 if spans else 0.95, "complete": g["complete"]}
                tables.append(table)
                if not mine or not all(n in place for n in mine):
                    continue
                first = min(place[n] for n in mine)
                if first not in at_line or len(mine) > len(at_line[first][1]):
                    body = html(cells) if options.get("html_fallback", True) and (spans or len(cells) == 1) else gfm(visual_rows(cells))
                    at_line[first] = (body, mine)
                used |= set(mine)
    blocks: list[dict] = []

    def add(kind: str, text: str, source: list[dict]) -> None:
        blocks.append({"block_no": len(blocks), "kind": kind, "text": text, "lines": source, "page_index": source[0]["page_index"] if source else None})

    formulas, equations, anchored = list(options.get("formulas") or []), 0, set()
    i = 0
    while i < len(ordered):
        x = ordered[i]
        if options.get("page_anchors") and x["page_index"] is not None and x["page_index"] not in anchored:
            anchored.add(x["page_index"])
            add("page_anchor", f'<a id="page-{x["page_index"] + 1}"></a>', [])
        if i in at_line:
            body, mine = at_line[i]
            add("table", body, [ordered[k] for k in sorted(place[n] for n in mine)])
            i += 1
            continue
        if x["line_no"] in used:
            i += 1
            continue
        rows = reader.table_rows(i) if options.get("tables", True) and reader._cell(x) else []
        if len(rows) >= 2:
            texts = [[c["text"].strip() for c in r] for r in rows]
            right = numeric_columns(texts)
            source = [c for r in rows for c in r]
            if any(right):
                confidence = min(0.85, 0.55 + 0.25 * sum(right) / len(right) + (0.1 if len(rows) >= 3 else 0))
                tables.append({"page_index": x["page_index"], "kind": "borderless", "confidence": round(confidence, 3), "cells": [[{"row": r, "column": c, "text": t, "row_span": 1, "column_span": 1, "covered": None, "lines": []} for c, t in enumerate(row)] for r, row in enumerate(texts)], "complete": False})
                add("table", gfm(texts), source)
                i += len(source)
                continue
            gaps = [b["x"] - a["x"] for a, b in zip(rows[0], rows[0][1:])]
            if len(rows) >= 3 and all(24 < g <= 180 for g in gaps):
                warnings.append({"code": "table.low_confidence", "page_index": x["page_index"], "line_no": x["line_no"]})
        level = reader.heading(x)
        if level is None and reader.equation(x):
            run = [x]
            while i + len(run) < len(ordered) and reader.equation(ordered[i + len(run)]) and reader.near(run[-1], ordered[i + len(run)]):
                run.append(ordered[i + len(run)])
            match = next((f for f in formulas if f.get("equation_index") == equations), None) or next((f for f in formulas if f.get("equation_index") is None and f.get("page_index") in (None, x["page_index"])), None)
            text = match["latex"] if match else "\n".join(y["text"].strip() for y in run)
            if match:
                formulas.remove(match)
            scores = [y["confidence"] for y in run if y.get("source") == "ocr" and _finite(y.get("confidence"))]
            if scores and not match and sum(scores) / len(scores) < 0.75:
                warnings.append({"code": "equation.low_ocr_confidence", "page_index": x["page_index"], "line_no": x["line_no"]})
            equations += 1
            add("equation", "$$\n" + text.replace("$$", "\\$\\$") + "\n$$", run)
            i += len(run)
            continue
        if level is None and reader.code(x):
            run = [x]
            while i + len(run) < len(ordered) and reader.code(ordered[i + len(run)]) and reader.near(run[-1], ordered[i + len(run)]):
                run.append(ordered[i + len(run)])
            if len(run) >= 2 or _MONO.search(x.get("base_font") or ""):
                base = min(y["x"] for y in run)
                body = "\n".join(" " * max(0, int((y["x"] - base) / 12 + 0.5)) + y["text"].rstrip() for y in run)
                f = fence(body)
                add("code", f"{f}\n{body}\n{f}", run)
                i += len(run)
                continue
        if level is not None:
            add("heading", "#" * level + " " + escape_inline(normalize(x["text"])), [x])
            i += 1
            continue
        if m := _LIST.match(x["text"].strip()):
            run, out = [], []
            while i < len(ordered) and (m := _LIST.match(ordered[i]["text"].strip())) and reader.heading(ordered[i]) is None and ordered[i]["line_no"] not in used:
                y = ordered[i]
                depth = min(range(len(reader.stops)), key=lambda k: abs(reader.stops[k] - y["x"])) if reader.stops and _placed(y) else 0
                out.append("  " * depth + (f"{int(m[1])}. " if m[1] else "- ") + escape_inline(normalize(m[2])))
                run.append(y)
                i += 1
            add("list", "\n".join(out), run)
            continue
        run = [x]
        i += 1
        while i < len(ordered):
            y = ordered[i]
            if i in at_line or y["line_no"] in used or not reader.goes_on(run[-1], y) or reader.heading(y) is not None or _LIST.match(y["text"].strip()) or reader.equation(y) or (reader.code(y) and _MONO.search(y.get("base_font") or "")):
                break
            if reader._cell(y) and len(t := reader.table_rows(i)) >= 2 and any(numeric_columns([[c["text"].strip() for c in r] for r in t])):
                break
            run.append(y)
            i += 1
        rtl = Counter(y.get("direction") for y in run)
        vertical = rtl["vertical"] > max(rtl["rtl"], rtl["ltr"])
        text = join_parts([normalize(y["text"]) for y in run]) if not vertical else "".join(normalize(y["text"]) for y in run)
        if vertical:
            text = f'<p style="writing-mode: vertical-rl">{escape_html(text)}</p>'
        elif rtl["rtl"] > rtl["ltr"]:
            text = f'<p dir="rtl">{escape_html(text)}</p>'
        else:
            text = escape_paragraph(text)
        add("paragraph", text, run)
    figures = _figures(ordered, rulings, images) if options.get("figures", True) else []
    for f in figures:
        k = next((k for k, b in enumerate(blocks) if any(y["line_no"] == f["line_no"] for y in b["lines"])), None)
        if k is not None:
            blocks.insert(k, {"kind": "figure", "text": f"*[Figure {f['number']} preview unavailable; metadata retained.]*", "lines": [], "page_index": f["page_index"]})
        warnings.append({"code": "figure.low_semantic_content", "page_index": f["page_index"], "line_no": f["line_no"]})
    at, source_map = 0, []
    for n, b in enumerate(blocks):
        b["block_no"], b["md_start"], b["md_end"] = n, at, at + len(b["text"])
        at = b["md_end"] + 2
        regions = {}
        for y in b["lines"]:
            if _placed(y):
                r = regions.setdefault(y["page_index"], [y["x"], y["y"], y["x"] + y["width"], y["y"] + y["height"]])
                r[:] = [min(r[0], y["x"]), min(r[1], y["y"]), max(r[2], y["x"] + y["width"]), max(r[3], y["y"] + y["height"])]
        source_map.append({"md_start": b["md_start"], "md_end": b["md_end"], "kind": b["kind"], "regions": [{"page_index": p, "x": r[0], "y": r[1], "width": r[2] - r[0], "height": r[3] - r[1]} for p, r in regions.items()]})
    if reader.conflicts:
        warnings.append({"code": "structure.tagged_layout_conflict", "page_index": None, "line_no": reader.conflicts[0]})
    for a, b in zip(lines, lines[1:]):
        if a["page_index"] == b["page_index"] and _placed(a) and _placed(b) and b["y"] - a["y"] > max(6.0, 0.5 * (b["font_size"] or 12)) and abs(b["x"] - a["x"]) > 96 and not any(w["code"] == "text.ordering_uncertain" and w["page_index"] == b["page_index"] for w in warnings):
            warnings.append({"code": "text.ordering_uncertain", "page_index": b["page_index"], "line_no": b["line_no"]})
    number: Counter = Counter()
    csvs = []
    for n, t in enumerate(tables):
        if t["kind"] == "ruled":
            number[t["page_index"]] += 1
            asset = f"table-page-{t['page_index'] + 1}-{number[t['page_index']]}-csv"
            csvs.append({"asset_id": asset, "path": f"assets/{asset}.csv", "page_index": t["page_index"], "content": csv_text([[("" if c["covered"] else c["text"]) for c in row] for row in t["cells"]] if any(c["covered"] for row in t["cells"] for c in row) else visual_rows(t["cells"]))})
    return {"markdown": "\n\n".join(b["text"] for b in blocks) + "\n" if blocks else "", "blocks": blocks, "tables": tables, "figures": figures, "source_map": source_map, "csv": csvs, "warnings": warnings}


def _figures(lines: list[dict], rulings, images) -> list[dict]:
    out, count = [], Counter()
    for x in lines:
        m = _CAPTION.match(x["text"].strip())
        if not m or not _placed(x):
            continue
        top = x["y"] + x["height"]
        vector = [(min(r["x1"], r["x2"]), min(r["y1"], r["y2"]), max(r["x1"], r["x2"]), max(r["y1"], r["y2"])) for r in rulings if r["page_index"] == x["page_index"] and min(r["y1"], r["y2"]) >= top]
        image = [(i["x"], i["y"], i["x"] + i["width"], i["y"] + i["height"]) for i in images if i["page_index"] == x["page_index"] and i["y"] >= top]
        boxes = vector or image
        if boxes:
            count[x["page_index"]] += 1
            x1, y1, x2, y2 = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)
            out.append({"page_index": x["page_index"], "line_no": x["line_no"], "figure_no": count[x["page_index"]], "number": int(m[1]), "kind": "vector" if vector else "image", "x": x1, "y": y1, "width": x2 - x1, "height": y2 - y1})
    return out
