"""Vectorised text kernels shared by the operators: word and pre-token spans, span hashes, ragged gathers.

Every kernel works on a block: the UTF-8 bytes of some whole documents in one numpy array. Blocks are cut between
documents only, at about BLOCK_BYTES, so that memory stays level; a longer document is a block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents are processed in blocks of about this many bytes.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_P = (1 << 31) - 1
#: Spans are hashed in windows of so many bytes, which stay in the processor's cache.
WINDOW = 1 << 16
_seed = np.random.Generator(np.random.PCG64(71))
#: 16-bit values of the bytes, all different.
_tables = np.stack([_seed.permutation(np.arange(1, 1 << 16, dtype=np.uint64))[:256] for _ in range(4)]).reshape(2, 2, 256)
_bases = _seed.integers(1 << 20, _P - 1, (2, 2)).tolist()

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def batches(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about limit bytes of text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    i, n, total = 0, len(lengths), np.concatenate([[0], np.cumsum(lengths)])
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SAFE = re.compile(r"[0-9A-Za-z] (?=[0-9A-Za-z])")


def pieces_of(text: str, limit: int = BLOCK_BYTES) -> list[str]:
    """A text in pieces of about limit characters, cut before single spaces between ASCII letters or digits: neither
    tokeniser joins anything across such a place, and none looks back. Where there is no such place pieces are longer."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    out.append(text[at:] if at else text)
    return out


def texts_of(column: pa.Array, null: str = "") -> list[str]:
    """The strings of a column; null counts as empty, and bytes that aren't UTF-8 as U+FFFD."""
    return [null if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


class Block:
    """The bytes of some documents: data, and starts[d]..ends[d] of document d. A newline follows each document."""

    def __init__(self, texts: Iterable[bytes]):
        texts = list(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every maximal run of bytes other than space and \\x09-\\x0D."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~SPACE[self.data]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        return starts, ends, np.searchsorted(self.ends, starts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit changes every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@lru_cache(maxsize=4)
def _powers(which: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo _P, up to WINDOW."""
    out = []
    for base in (_bases[which][half], pow(_bases[which][half], -1, _P)):
        x = np.ones(WINDOW + 1, np.uint64)
        step, done = base, 1
        while done <= WINDOW:  # x[done:2*done] = x[:done] * base**done
            k = min(done, WINDOW + 1 - done)
            x[done : done + k] = x[:k] * _U(step) % _U(_P)
            step, done = step * step % _P, done + k
        out.append(x)
    return out[0], out[1]


def _residues(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int, half: int) -> np.ndarray:
    """Polynomial of every span, modulo _P; data has WINDOW bytes at most."""
    up, down = _powers(which, half)
    sums = np.zeros(len(data) + 1, np.uint64)
    term = _tables[which, half].take(data)
    term *= up[: len(data)]
    np.cumsum(term, out=sums[1:])  # terms of 47 bits, so the sums have 63
    x = sums[ends]
    x -= sums[starts]
    x = (x & _U(_P)) + (x >> _U(31))
    x *= down[starts]
    for _ in range(2):
        x = (x & _U(_P)) + (x >> _U(31))
    x[x >= _U(_P)] -= _U(_P)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every byte span; equal bytes have equal hashes. starts and ends ascend.

    Two polynomials modulo the prime 2**31 - 1, with random bases and random values of the bytes, by prefix sums: two different
    spans of n bytes meet in both with a probability of (n / 2**31)**2 at most, whatever the text. A window takes the spans
    that lie within WINDOW bytes; a longer span is hashed piece by piece, so memory doesn't depend on the text."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + WINDOW, "right"))
        if j > i:
            part = data[base : int(ends[j - 1])]
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = _residues(part, s, e, which, 0) << _U(31) | _residues(part, s, e, which, 1)
            i = j
            continue
        whole = [0, 0]
        zero = np.zeros(1, np.int64)
        for k, at in enumerate(range(base, int(ends[i]), WINDOW)):
            part = data[at : min(at + WINDOW, int(ends[i]))]
            for half in (0, 1):
                whole[half] = (whole[half] + int(_residues(part, zero, zero + len(part), which, half)[0]) * pow(_bases[which][half], k * WINDOW, _P)) % _P
        out[i] = whole[0] << 31 | whole[1]
        i += 1
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[s : s + c] for each s, c, one after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    out, i = np.empty(total, flat.dtype), 0
    while i < len(counts):  # some at a time, so that index arrays stay small
        begin = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, begin + WINDOW, "right")))
        if j == i + 1:
            out[begin : ends[i]] = flat[starts[i] : starts[i] + counts[i]]
        else:
            at = np.repeat(starts[i:j] - (ends[i:j] - counts[i:j] - begin), counts[i:j])
            at += np.arange(len(at))
            out[begin : ends[j - 1]] = flat[at]
        i = j
    return out


def ngram_hashes(word: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows, with the document of each and the index of its first word. A document of 1 to
    n - 1 words has one window of all of them."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    k = len(word) - n + 1
    if k > 0:
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + word[i : k + i]
        at = np.flatnonzero(doc[:k] == doc[n - 1 :])
        h = mix(h[at])
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short):
            x = int(count[d])
            for w in word[first[d] : first[d] + count[d]].tolist():
                x = (x * 0x9E3779B97F4A7C15 + w) & (1 << 64) - 1
            extra[j] = x
        h, at = np.concatenate([h, mix(extra)]), np.concatenate([at, first[short]])
    return h, doc[at] if len(at) else np.zeros(0, np.int64), at


class SpanCache:
    """What an encoder returns for each distinct byte string seen, by hash, as ragged integer rows. It holds about `limit`
    strings at most; beyond that, those stay that several blocks have had, so memory is bounded. New strings are encoded SLICE
    bytes at a time. Results don't depend on it."""

    SLICE = 1 << 17

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.blocks = np.zeros(0, np.int32)  # how many blocks had each string

    def _shrink(self) -> None:
        keep = self.blocks > 1
        if not 0 < keep.sum() <= self.limit // 2:
            self.clear()
            return
        self.keys, start, self.count = self.keys[keep], self.start[keep], self.count[keep]
        self.flat, self.start, self.blocks = ragged(self.flat, start, self.count), np.cumsum(self.count, dtype=np.int64) - self.count, self.blocks[keep] // 2

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flats, counts, total = [], [], np.concatenate([[0], np.cumsum(ends - starts)])
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(total, total[i] + self.SLICE, "right")) - 1)
            flat, count = self.encode([data[s:e].tobytes() for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())])
            flats.append(np.asarray(flat, np.int32))
            counts.append(np.asarray(count, np.int32))
            i = j
        return np.concatenate(flats), np.concatenate(counts)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in self.flat and number of integers of each span."""
        import pandas as pd

        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, keys = pd.factorize(span_hashes(data, starts, ends))
        at, known = self._find(keys)
        if len(self.keys) + len(keys) - known.sum() > self.limit:
            self._shrink()
            at, known = self._find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(keys[new], kind="stable")]
            first = np.full(len(keys), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            flat, count = self._encoded(data, starts[first[new]], ends[first[new]])
            start = len(self.flat) + np.cumsum(count, dtype=np.int64) - count
            self.flat = np.concatenate([self.flat, flat])
            place = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, place, keys[new])
            self.start, self.count, self.blocks = np.insert(self.start, place, start), np.insert(self.count, place, count), np.insert(self.blocks, place, 0)
            at = np.searchsorted(self.keys, keys)
        self.blocks[at] += 1
        return self.start[at][code], self.count[at][code].astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known


def whole_groups(batches_in: Iterable[pa.RecordBatch], same) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by group: tables of whole groups, with the starts of the groups (and the end). same(table)
    tells for each row but the first whether it is in the group of the row before it. What is held is one
    batch and the group it ends in, so groups must have a bounded size."""
    held = None
    for batch in batches_in:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        starts = np.concatenate([[0], np.flatnonzero(~same(table)) + 1])
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts
        held = table.slice(int(starts[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def fixed_width(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """uint8 [rows, width] of a binary column whose values all have that width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.binary())
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return raw[first : first + len(column) * width].reshape(-1, width)
