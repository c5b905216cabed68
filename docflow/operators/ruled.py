"""Tables drawn with ruling lines: grids, the text in their cells, spans. Works on one page's rows in plain Python, as
cells grow greedily."""

from __future__ import annotations

from bisect import bisect_left

TOLERANCE = 1.0


def clusters(values: list[float], gap: float) -> list[float]:
    """Means of ascending values, a value within gap of the running mean of the first such cluster belonging to it."""
    out: list[list[float]] = []
    for v in sorted(values):
        c = out[-1] if out else None  # values ascend, so a cluster gets no more of them once there is a later one
        if c and abs(c[0] - v) <= gap:
            c[0] = (c[0] * c[1] + v) / (c[1] + 1)
            c[1] += 1
        else:
            out.append([v, 1])
    return [c[0] for c in out]


class _Near:
    """Rulings by one coordinate: those within the tolerance of a value."""

    def __init__(self, rulings: list[dict], axis: str):
        self.rulings, self.axis = sorted(rulings, key=lambda r: r[axis]), axis
        self.at = [r[axis] for r in self.rulings]

    def __call__(self, value: float) -> list[dict]:
        k, out = bisect_left(self.at, value - 2 * TOLERANCE), []
        while k < len(self.at) and self.at[k] <= value + 2 * TOLERANCE:
            if abs(self.at[k] - value) <= TOLERANCE:
                out.append(self.rulings[k])
            k += 1
        return out


def grids(rulings: list[dict]) -> list[dict]:
    """Grids of a page: components of crossing rulings with a row and two columns at least, from the top down.
    Each: x (edges ascending), y (edges descending), h and v (its rulings), complete (every crossing is drawn)."""
    h, v = [r for r in rulings if r["orientation"] == "h"], [r for r in rulings if r["orientation"] == "v"]
    root = list(range(len(h) + len(v)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    t = TOLERANCE
    for i, a in enumerate(h):
        for j, b in enumerate(v):
            if a["x1"] - t <= b["x1"] <= a["x2"] + t and b["y1"] - t <= a["y1"] <= b["y2"] + t:
                root[find(i)] = find(len(h) + j)
    parts: dict[int, list[int]] = {}
    for i in range(len(root)):
        parts.setdefault(find(i), []).append(i)
    out = []
    for members in parts.values():
        hs, vs = [h[i] for i in members if i < len(h)], [v[i - len(h)] for i in members if i >= len(h)]
        if len(hs) < 2 or len(vs) < 3:
            continue
        x, y = clusters([r["x1"] for r in vs], t), clusters([r["y1"] for r in hs], t)[::-1]
        if len(y) < 2 or len(x) < 3:
            continue
        near_h, near_v = _Near(hs, "y1"), _Near(vs, "x1")
        rows, columns = [(b, near_h(b)) for b in y], [(a, near_v(a)) for a in x]
        full = all(any(r["x1"] - t <= a <= r["x2"] + t for r in hb) and any(r["y1"] - t <= b <= r["y2"] + t for r in va) for a, va in columns for b, hb in rows)
        out.append({"x": x, "y": y, "h": hs, "v": vs, "complete": full})
    return sorted(out, key=lambda g: (-g["y"][0], g["x"][0]))


def _interval(edges: list[float], c: float, slack: float = 0.5) -> int | None:
    """Index of the first interval of ascending edges that holds c."""
    for i in range(max(0, bisect_left(edges, c - 2 * slack) - 2), len(edges) - 1):
        if edges[i] - slack > c:
            return None
        if c <= edges[i + 1] + slack:
            return i
    return None


def fill(grid: dict, lines: list[dict]) -> list[list[dict]]:
    """Cells [row][column] of a grid with the lines whose centre they hold (text: lines top down, left to right)."""
    rows, cols = len(grid["y"]) - 1, len(grid["x"]) - 1
    cells = [[{"row": r, "column": c, "lines": [], "row_span": 1, "column_span": 1, "covered": None, "text": ""} for c in range(cols)] for r in range(rows)]
    up = grid["y"][::-1]
    for line in lines:
        cy, cx = line["y"] + line["height"] / 2, line["x"] + line["width"] / 2
        r = _interval(up, cy)
        if r is None or not grid["x"][0] - 2 <= cx <= grid["x"][-1] + 2:
            continue
        c = _interval(grid["x"], cx)
        c = c if c is not None else (0 if cx < grid["x"][0] else cols - 1)
        cells[rows - 1 - r][c]["lines"].append(line)
    _spans(grid, cells)
    for row in cells:
        for cell in row:
            cell["lines"].sort(key=lambda l: (-(l["y"] + l["height"] / 2), l["x"], l["line_no"]))
            cell["text"] = " ".join(l["text"].strip() for l in cell["lines"])
    return cells


def _spans(grid: dict, cells: list[list[dict]]) -> None:
    """Row by row: a cell grows to the right until a vertical ruling covers its row, then down until a horizontal one covers it."""
    x, y, t = grid["x"], grid["y"], TOLERANCE
    near_h, near_v = _Near(grid["h"], "y1"), _Near(grid["v"], "x1")
    at_row, at_column = [near_h(v) for v in y], [near_v(v) for v in x]
    wall = lambda c, r: any(v["y1"] <= y[r + 1] + t and v["y2"] >= y[r] - t for v in at_column[c])
    floor = lambda r, a, b: any(h["x1"] <= x[a] + t and h["x2"] >= x[b] - t for h in at_row[r])
    for r, row in enumerate(cells):
        for c, cell in enumerate(row):
            if cell["covered"]:
                continue
            w = 1
            while c + w < len(row) and not row[c + w]["covered"] and not wall(c + w, r):
                w += 1
            n = 1
            while r + n < len(cells) and not any(cells[r + n][k]["covered"] for k in range(c, c + w)) and not floor(r + n, c, c + w):
                n += 1
            cell["row_span"], cell["column_span"] = n, w
            for a in range(r, r + n):
                for b in range(c, c + w):
                    if (a, b) != (r, c):
                        cells[a][b]["covered"] = (r, c)
                        cell["lines"] += cells[a][b]["lines"]
                        cells[a][b]["lines"] = []
