"""Exact edit distance of two sequences of codes (characters, tokens), of any length."""

from __future__ import annotations

import numpy as np

_OFTEN = 64


def characters(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _unlike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of a and b without the elements that are equal at the same place."""
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    return np.concatenate([a[:n][other], a[n:]]), np.concatenate([b[:n][other], b[n:]])


def _bits(at: np.ndarray, n: int) -> int:
    flags = np.zeros(n, np.uint8)
    flags[at] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _bit_parallel(a: np.ndarray, b: np.ndarray) -> int:
    """Myers' algorithm, a column of the table in one integer. Masks of rare codes are made when needed, so that memory
    doesn't grow with the number of distinct codes times the length."""
    m = len(a)
    codes, inverse, counts = np.unique(a, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    places = np.split(order, np.cumsum(counts)[:-1])
    known = dict(zip(codes.tolist(), range(len(codes))))
    kept: dict[int, int] = {}
    full, top = (1 << m) - 1, m - 1
    vp, vn, distance = full, 0, m
    for c in b.tolist():
        k = known.get(c)
        if k is None:
            eq = 0
        elif (eq := kept.get(k)) is None:
            eq = _bits(places[k], m)
            if counts[k] >= _OFTEN or m < 4096:
                kept[k] = eq
        x = eq | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        distance += (hp >> top & 1) - (hn >> top & 1)
        x = (hp << 1 | 1) & full
        vn = x & d0
        vp = (hn << 1 & full) | (full & ~(x | d0))
    return distance


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Insertions, deletions and replacements that turn a into b, at least.

    Two cases are proved in linear time. If what differs place by place has no code in common, the distance is the longer
    rest's length: no edit mends more than one of its elements. If one sequence is a subsequence of the other, it is the
    difference of their lengths. All others are computed by _bit_parallel."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    start = int(other[0]) if len(other) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    other = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(other[0]) if len(other) else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    x, y = _unlike(a, b)
    if not np.isin(x, y).any():
        return max(len(x), len(y))
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a.tolist())
    if all(c in rest for c in b.tolist()):
        return len(a) - len(b)
    return _bit_parallel(a, b)
