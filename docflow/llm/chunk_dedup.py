"""Substring dedup by content-defined chunks (operator 5).

A gear rolling hash over the last 16 bytes decides, after a word, whether a chunk ends there; so boundaries depend on
nearby text alone, and an insertion shifts no chunk but those it touches. Chunks of CHUNK_WORDS words or so are
compared by digest over the whole corpus; every occurrence but the first (least id, then place) is a repeat. Runs of
repeats of at least min_bytes are cut out of their texts; shorter ones stay, so that common phrases don't count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import small_batches
from .textkernel import SPACE, WINDOW, batches, span_hashes, texts_of

CHUNK_WORDS, MIN_CHUNK, MIN_BYTES = 4, 12, 80
_LONG_WORD, _PAD = 64, 16
_GEAR = np.random.Generator(np.random.PCG64(1979)).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_GEAR[0] = 0
_LAST = 2**63 - 1


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes up to each byte: the sum of the table's values, each shifted by its distance. Its upper 16
    bits, uint16, computed in windows."""
    out = np.empty(len(data), np.uint16)
    for at in range(0, len(data), WINDOW):
        low = max(at - _PAD, 0)
        h = _GEAR[data[low : at + WINDOW]]
        for s in (1, 2, 4, 8):
            more = h[s:] + (h[:-s] << np.uint32(s))
            h[s:] = more
        out[at : at + WINDOW] = h[at - low :] >> np.uint32(16)
    return out


def chunk_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start, digest end (without the white space after it) and text of every chunk, and where each
    text begins. A chunk goes from its start to the next one's, the last to the end of its text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer((b"\0" * _PAD).join(texts) + b"\0" * _PAD, np.uint8)
    begin = np.cumsum(lengths + _PAD) - lengths - _PAD
    owner_end = begin + lengths
    blank = SPACE[data]
    real = np.ones(len(data), bool)  # of a text, not of the padding
    real[(owner_end[:, None] + np.arange(_PAD)).reshape(-1)] = False
    h = gear(data)
    word_end = np.flatnonzero(~blank[:-1] & blank[1:] & real[:-1] & real[1:])
    cut = word_end[h[word_end] < 65536 // CHUNK_WORDS]
    # the next chunk starts at the next word
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = ~blank & real
    turn = np.diff(edge)
    ws, we = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    nxt = np.searchsorted(ws, cut + 1)
    cut, nxt = cut[nxt < len(ws)], nxt[nxt < len(ws)]
    start = ws[nxt]
    end = cut + 1
    same = np.searchsorted(owner_end, start, "right") == np.searchsorted(owner_end, cut, "right")
    start, end = start[same], end[same]
    # words longer than _LONG_WORD (text without spaces) are cut at characters, too
    big = np.flatnonzero(we - ws > _LONG_WORD)
    if len(big):
        at = np.concatenate([np.arange(ws[k] + 1, we[k]) for k in big.tolist()])
        at = at[(h[at - 1] < 65536 // 32) & ((data[at] & 0xC0) != 0x80)]
        start, end = np.concatenate([start, at]), np.concatenate([end, at])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    # each text begins with a chunk; cuts closer than MIN_CHUNK to the cut before them don't count
    head = begin[lengths > 0]
    all_start = np.concatenate([head, start])
    order = np.argsort(all_start, kind="stable")
    all_start = all_start[order]
    all_end = np.concatenate([np.full(len(head), -1), end])[order]
    first = np.concatenate([np.ones(len(head), bool), np.zeros(len(start), bool)])[order]
    keep = first.copy()
    keep[1:] |= np.diff(all_start) >= MIN_CHUNK
    all_start, all_end, first = all_start[keep], all_end[keep], first[keep]
    doc = np.searchsorted(owner_end, all_start, "right")
    stop = owner_end[doc].copy()
    follow = np.flatnonzero(~first[1:])
    stop[follow] = all_end[1:][follow]
    last = np.flatnonzero(stop == owner_end[doc])
    for k in last.tolist():  # the last chunk of a text: without white space at its end
        while stop[k] > all_start[k] and blank[stop[k] - 1]:
            stop[k] -= 1
    return data, all_start, stop, doc, begin


def _text_key(text):
    return F.xxhash64(text)


def _chunks(it):
    """(doc_id, tkey, text) -> rows (route, d1, d2, doc_id, tkey, idx, first_id). Of the chunks of one digest in a batch
    only the first goes to the corpus-wide comparison (first_id null); the others are known to be repeats."""
    for batch in it:
        order = np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
        batch = batch.take(pa.array(order))
        ids, tkey = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(ids), bool)  # not a copy of the row before
        new[1:] = (ids[1:] != ids[:-1]) | (tkey[1:] != tkey[:-1])
        batch = batch.filter(pa.array(new))
        for i, j in batches(batch.column(2), 32 << 20):
            part = batch.slice(i, j - i)
            out = []
            for a, b in batches(part.column(2)):
                texts = [t.encode() for t in texts_of(part.column(2).slice(a, b - a))]
                data, start, stop, doc, _ = chunk_spans(texts)
                n = np.bincount(doc, minlength=len(texts))
                idx = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                out.append((span_hashes(data, start, stop, 0), span_hashes(data, start, stop, 1) >> np.uint64(32), doc + a, idx))
            d1, d2, doc, idx = (np.concatenate(x) for x in zip(*out))
            ids, tkey = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
            code, keys = pd.factorize(d1 ^ d2 << np.uint64(32))
            first = np.zeros(len(keys), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            lead = first[code]
            local = lead != np.arange(len(code))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(local, tkey + idx, d1.view(np.int64))), pa.array(np.where(local, 0, d1.view(np.int64))), pa.array(d2.astype(np.uint32).view(np.int32)),
                    pa.array(ids), pa.array(tkey), pa.array(idx.astype(np.int32)), pa.array(ids[lead], mask=~local),
                ],
                names=["route", "d1", "d2", "doc_id", "tkey", "idx", "first_id"],
            )


def _repeats(it):
    """Rows sorted by digest, id, place -> the repeats: doc_id, tkey, idx, first_id. A row equal to the first one of its
    digest is that occurrence, met in another batch of documents, and no repeat."""
    held = None  # digest, and id, text and place of the first occurrence, of the last digest
    for batch in it:
        if not batch.num_rows:
            continue
        known = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        d1, d2, ids, tkey, idx = (batch.column(k).to_numpy() for k in range(5))
        at = np.flatnonzero(~known)
        a, b = d1[at], d2[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if len(at) and held is not None and held[:2] == (int(a[0]), int(b[0])):
            new[0] = False
        group = np.cumsum(new) - 1
        firsts = at[new]
        lead, *place = (np.where(group >= 0, x[firsts][np.maximum(group, 0)] if len(firsts) else 0, h) for x, h in zip((ids, tkey, idx), held[2:] if held else (0, 0, 0)))
        if len(at):
            held = (int(a[-1]), int(b[-1]), int(lead[-1]), int(place[0][-1]), int(place[1][-1]))
        again = (ids[at] != lead) | (tkey[at] != place[0]) | (idx[at] != place[1])
        rows = np.concatenate([np.flatnonzero(known), at[again]])
        first_id = np.concatenate([batch.column(5).drop_null().to_numpy(), lead[again]])
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(tkey[rows]), pa.array(idx[rows]), pa.array(first_id.astype(np.int64))], names=["doc_id", "tkey", "idx", "first_id"])


def cut_repeats(text: bytes, data: np.ndarray, start: np.ndarray, base: int, repeat: np.ndarray, min_bytes: int) -> list[tuple[int, int]]:
    """Byte spans of the text to cut: runs of repeated chunks, min_bytes or longer. start: of its chunks, in data."""
    edge = np.concatenate([start - base, [len(text)]])
    flag = np.concatenate([[0], repeat.astype(np.int8), [0]])
    turn = np.diff(flag)
    runs = zip(edge[np.flatnonzero(turn == 1)].tolist(), edge[np.flatnonzero(turn == -1)].tolist())
    return [(a, b) for a, b in runs if b - a >= min_bytes]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of docs, text_col without its repeated passages, and the column _dedup: n_chars (of the whole text),
    removed_chars, spans (code point start and end of each passage cut, in the whole text) and first_ids (documents that
    have the passages before). A column _dedup in docs is replaced; other names can't clash.

    Ids are integers; null ids come last in the order. Rows of equal id and text count as one document and are treated
    alike. Null texts stay null; an empty table gives an empty table.

    Chunks are shuffled once, by digest, 1 row per distinct digest and batch of documents: a passage that many documents
    share is merged before the shuffle. Repeats then go to their documents. Memory doesn't depend on how often
    a digest occurs."""
    small_batches(docs.sparkSession, 5000)
    names = [c for c in docs.columns if c != "_dedup"]
    text = F.col(text_col).cast("string")
    # the text travels once, beside the other columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col], F.lit(0).alias("_")).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), _text_key(text).alias("tkey"), text.alias("text"))
    rows = whole.select("doc_id", "tkey", "text").where("text is not null").mapInArrow(_chunks, "route long, d1 long, d2 int, doc_id long, tkey long, idx int, first_id long")
    repeats = (
        rows.repartition("route").sortWithinPartitions("d1", "d2", "doc_id", "tkey", "idx").select("d1", "d2", "doc_id", "tkey", "idx", "first_id")
        .mapInArrow(_repeats, "doc_id long, tkey long, idx int, first_id long")
    )
    per_doc = repeats.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("idx", "first_id")).alias("hits"))
    joined = whole.join(per_doc, ["doc_id", "tkey"], "left").select("row", "text", F.col("hits.idx").alias("idx"), F.col("hits.first_id").alias("first_id"))
    cut = StructType.fromDDL("text string, n_chars long, removed_chars long, spans array<struct<begin:long,end:long>>, first_ids array<long>")

    def run(it):
        for batch in it:
            for i, j in batches(batch.column(1)):
                part = batch.slice(i, j - i)
                texts = [t.encode() for t in texts_of(part.column(1))]
                hits, firsts, void = part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(1).is_null().to_pylist()
                some = [k for k, h in enumerate(hits) if h]
                out: list[bytes | None] = [None if v else t for t, v in zip(texts, void)]
                spans: list[list] = [[] for _ in texts]
                ids: list[list] = [[] for _ in texts]
                if some:
                    data, start, _, doc, begin = chunk_spans([texts[k] for k in some])
                    n = np.bincount(doc, minlength=len(some))
                    at = np.cumsum(n) - n
                    for x, k in enumerate(some):
                        repeat = np.zeros(n[x], bool)
                        hit = np.array(hits[k])
                        repeat[hit] = True
                        edges = start[at[x] : at[x] + n[x]]
                        cuts = cut_repeats(texts[k], data, edges, int(begin[x]), repeat, min_bytes)
                        if cuts:
                            t, kept, last = texts[k], [], 0
                            for a, b in cuts:
                                kept.append(t[last:a])
                                last = b
                            kept.append(t[last:])
                            out[k] = b"".join(kept)
                            place, chars = np.array(cuts, np.int64).reshape(-1), np.zeros(1, np.int64)
                            bits = np.frombuffer(t, np.uint8)
                            heads = np.add.reduceat(np.concatenate([(bits & 0xC0) != 0x80, [False]]), np.concatenate([[0], place]), dtype=np.int64)
                            heads[np.diff(np.concatenate([[0], place, [len(t) + 1]])) == 0] = 0
                            spans[k] = list(zip(*np.cumsum(heads)[:-1].reshape(-1, 2).T.tolist()))
                            place = edges[hit] - begin[x]
                            gone = np.zeros(len(hit), bool)
                            for a, b in cuts:
                                gone |= (place >= a) & (place < b)
                            ids[k] = sorted({f for f, g in zip(firsts[k], gone.tolist()) if g and f != _LAST})
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([o if o is None else o.decode() for o in out], pa.string()), pa.array([len(t.decode()) for t in texts], pa.int64()),
                        pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.int64())),
                    ],
                    names=["row", "text", "n_chars", "removed_chars", "spans", "first_ids"],
                )

    done = joined.mapInArrow(run, StructType([joined.schema["row"], *cut.fields]))
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], F.struct("n_chars", "removed_chars", "spans", "first_ids").alias("_dedup"))
