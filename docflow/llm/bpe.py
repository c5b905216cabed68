"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (operator 2).

Texts are cut into pre-tokens; the distinct pre-tokens of a block are merged together by one queue: a bucket per merge
rank holds positions of a doubly linked list of symbols, a three-level bitmap of 64-bit words marks the buckets in use,
find-first-set picks the lowest rank, and entries whose pair has changed since are skipped as stale. A merge costs
O(1), whatever the length of its pre-token, so a pre-token of a million bytes is no special case.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches
from .textkernel import BLOCK_BYTES, SpanCache, batches, pieces_of, ragged, texts_of

_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3
#: Ids are hashed and decoded so many at a time.
SLICE = 1 << 16


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            for m in regex.finditer(pattern, "".join(map(chr, range(low, high)))):
                out[low + m.start() : low + m.end()] = kind
    return out


def pretoken_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts as the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` does,
    but by array operations. Returns the bytes of all texts, byte starts and ends of the pre-tokens, the index of each
    text's first pre-token (and the total at the end), and the code point starts of the pre-tokens."""
    whole = "".join(texts)
    raw = whole.encode("utf-8", "replace")
    data, n = np.frombuffer(raw, np.uint8), len(whole)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if not n:
        zero = np.zeros(0, np.int64)
        return data, zero, zero, np.zeros(len(texts) + 1, np.int64), zero
    code = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    kind = _classes()[code]
    head = np.zeros(n + 1, bool)  # a text begins here (or all of them have ended)
    head[bounds] = True
    run = head[:n].copy()  # a run of one class begins here
    run[1:] |= kind[1:] != kind[:-1]
    space = code == 32
    start = run.copy()
    blank = kind == _BLANK
    # a run's single space before it belongs to its first pre-token
    start[1:] &= ~(space[:-1] & ~blank[1:] & ~head[1:n])
    # the last character of a run of white space parts from it if the text goes on
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~head[1:n])
    start[last] = True
    # contractions: a lone apostrophe that begins a pre-token, then the letters
    quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~head[1:n])
    if len(quote):
        one = code[quote + 1]
        second = np.where(quote + 2 < n, code[np.minimum(quote + 2, n - 1)], 0)
        second[head[np.minimum(quote + 2, n)]] = 0
        size = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        pair = ((one == 114) & (second == 101)) | ((one == 118) & (second == 101)) | ((one == 108) & (second == 108))
        size[pair] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        ok = after < n
        after = after[ok]
        start[after[kind[after] == _LETTER]] = True  # a letter there continues the run that the contraction cut
    at = np.flatnonzero(start)
    if len(data) == n:
        begin = at
    else:
        width = 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)
        begin = (np.cumsum(width, dtype=np.int64) - width)[at]
    return data, begin, np.concatenate([begin[1:], [len(data)]]), np.searchsorted(at, bounds), at


class _RankBitmap:
    """A set of ranks below 64**3; add, discard and least take constant time."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def discard(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))

    def least(self) -> int:
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


class ByteBPE:
    """Encoder and decoder of a rank file (base64 token, rank; one a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.size = max(ranks.values()) + 1
        vocab = [b""] * self.size
        for token, r in ranks.items():
            vocab[r] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: (left << 20 | right) -> rank of every pair of tokens that is a token
        self.pairs = {ranks[t[:k]] << 20 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        byte_pair = np.full(65536, -1, np.int64)
        for a in range(256):
            for b in range(256):
                byte_pair[a << 8 | b] = ranks.get(bytes([a, b]), -1)
        self.byte_pair = byte_pair
        self.token_length = np.fromiter(map(len, vocab), np.int32, self.size)
        self.token_start = np.cumsum(self.token_length, dtype=np.int64) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(vocab), np.uint8)
        self.cache = SpanCache(self.merge)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), lengths
        ends = np.cumsum(lengths)
        rank = np.full(n, -1, np.int64)  # of the pair that begins here; -1: none
        rank[:-1] = self.byte_pair[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[ends[lengths > 0] - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        some = np.flatnonzero(rank >= 0)
        order = some[np.argsort(rank[some], kind="stable")]
        used, cut = np.unique(rank[order], return_index=True)
        bucket = dict(zip(used.tolist(), (x.tolist() for x in np.split(order, cut[1:])))) if len(used) else {}
        queue = _RankBitmap(self.size)
        for r in bucket:
            queue.add(r)
        ids, rank, after, before = self.byte[data].tolist(), rank.tolist(), after.tolist(), before.tolist()
        get, add = self.pairs.get, queue.add
        while (r := queue.least()) >= 0:
            queue.discard(r)
            todo = bucket.pop(r)
            todo.sort()
            lower = False
            for k, i in enumerate(todo):
                if rank[i] != r:
                    continue  # stale
                j = after[i]
                ids[i], ids[j], rank[j] = r, -1, -1
                after[i] = q = after[j]
                new = -1
                if q >= 0:
                    before[q] = i
                    new = get(r << 20 | ids[q], -1)
                    if new >= 0:
                        if new in bucket:
                            bucket[new].append(i)
                        else:
                            bucket[new] = [i]
                            add(new)
                        lower = new < r
                rank[i] = new
                p = before[i]
                if p >= 0:
                    rank[p] = new = get(ids[p] << 20 | r, -1)
                    if new >= 0:
                        if new in bucket:
                            bucket[new].append(p)
                        else:
                            bucket[new] = [p]
                            add(new)
                        lower = lower or new < r
                if lower:  # a lower rank came up: it goes first, the rest of this bucket waits
                    rest = todo[k + 1 :]
                    if rest:
                        bucket[r] = rest + bucket.get(r, [])
                        add(r)
                    break
        out = np.array(ids, np.int64)
        kept = np.concatenate([[0], np.cumsum(out >= 0)])
        return out[out >= 0], kept[ends] - kept[ends - lengths]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all texts one after the other, and where each text's begin (and the total at the end). A very long text is
        encoded in pieces."""
        if len(texts) == 1 and len(texts[0]) > 2 * BLOCK_BYTES:
            ids = np.concatenate([self._encode([p])[0] for p in pieces_of(texts[0])])
            return ids, np.array([0, len(ids)])
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, begin, end, text_at, _ = pretoken_spans(texts)
        start, count = self.cache.rows(data, begin, end)
        return ragged(self.cache.flat, start, count), np.concatenate([[0], np.cumsum(count)])[text_at]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids one after the other."""
        return ragged(self.token_bytes, self.token_start[ids], self.token_length[ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder a process; its cache serves all tasks of a Python worker."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the id column, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex, of the ids as little-endian unsigned
    32-bit integers and of the decoded bytes), and ids (array<int>) if with_ids.
    A null or empty text has no tokens; rows with equal or null ids stay rows of their own; other columns are dropped,
    whatever their names. An empty table gives an empty table.
    """
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(it):
        bpe = encoder(path)
        for batch in it:
            for i, j in batches(batch.column(1)):
                part = batch.slice(i, j - i)
                ids, at = bpe.encode(texts_of(part.column(1)))
                id_hash, text_hash = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    x, y = hashlib.sha256(), hashlib.sha256()
                    for k in range(a, b, SLICE):
                        some = ids[k : min(k + SLICE, b)]
                        x.update(some.astype("<u4").data)
                        y.update(bpe.decode(some).data)
                    id_hash.append(x.hexdigest())
                    text_hash.append(y.hexdigest())
                out = [part.column(0), pa.array(np.diff(at)), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
