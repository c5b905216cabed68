"""Document fingerprints by consistent weighted sampling (operator 1).

The terms of a text are its 3-word windows, weighted by how often they occur. For each of SAMPLES hash functions, a
term k of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash, t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1); the sample is the (k, t) of the least a. Two texts share a sample with a probability equal
to their generalised Jaccard similarity, sum of min(w) over sum of max(w). As a is a function of (k, t) and
of nothing else, its bits stand for the pair in the fingerprint: 16 bits of a hash of them for each sample.

The draws come from tables: (r, b) and c by different bits of a term's 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textkernel import BLOCK_BYTES, Block, batches, ngram_hashes, span_hashes, texts_of

SAMPLES, WINDOW = 64, 3
_ROWS, _CHUNK = 1 << 14, 2048
_U = np.uint64


@lru_cache(maxsize=2)
def _draws(samples: int) -> tuple[np.ndarray, ...]:
    g = np.random.Generator(np.random.PCG64(2010))
    r = g.gamma(2.0, 1.0, (_ROWS, samples)).astype(np.float32)
    ln_c = np.log(g.gamma(2.0, 1.0, (_ROWS, samples))).astype(np.float32)
    b = g.random((_ROWS, samples), dtype=np.float32)
    return r, ln_c, b, r * (1 - b)


def sample_weighted(term: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, samples: int = SAMPLES) -> np.ndarray:
    """Signatures, uint16 [n_docs, samples], of weighted terms (64-bit hashes; doc ascends). Without terms: zeros."""
    r, ln_c, b, one = _draws(samples)
    low = np.full((n_docs, samples), np.inf, np.float32)
    i, j = (term & _U(_ROWS - 1)).astype(np.int64), (term >> _U(20) & _U(_ROWS - 1)).astype(np.int64)
    heavy = weight != 1
    for at in range(0, len(term), _CHUNK):
        part = slice(at, at + _CHUNK)
        ln_a = ln_c[j[part]] - one[i[part]]  # a weight of 1: t = 0
        if heavy[part].any():
            h = np.flatnonzero(heavy[part])
            rr, bb = r[i[part][h]], b[i[part][h]]
            t = np.floor(np.log(weight[part][h]).astype(np.float32)[:, None] / rr + bb)
            ln_a[h] = ln_c[j[part][h]] - rr * (t - bb + 1)
        d = doc[part]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        least = np.minimum.reduceat(ln_a, first, axis=0)
        low[d[first]] = np.minimum(low[d[first]], least)
    bits = (low + np.float32(0)).view(np.uint32)
    bits = bits * np.uint32(0x9E3779B1)
    bits ^= bits >> np.uint32(15)
    out = (bits * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(np.uint16)
    out[~np.isfinite(low[:, 0])] = 0
    return out


def signatures(texts: list[bytes], samples: int = SAMPLES, window: int = WINDOW) -> np.ndarray:
    """Signatures of whole texts, by the counts of their word windows."""
    import pandas as pd

    block = Block(texts)
    starts, ends, doc = block.words()
    gram, gram_doc, _ = ngram_hashes(span_hashes(block.data, starts, ends), doc, len(texts), window)
    if len(gram_doc) and (np.diff(gram_doc) < 0).any():
        order = np.argsort(gram_doc, kind="stable")
        gram, gram_doc = gram[order], gram_doc[order]
    code, _ = pd.factorize(gram ^ (gram_doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    weight = np.bincount(code)
    first = np.zeros(len(weight), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return sample_weighted(gram[first], weight, gram_doc[first], len(texts), samples)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an unbiased estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def _hex(signature: np.ndarray) -> pa.Array:
    n, raw = signature.shape[1] * 4, signature.astype(">u2").tobytes().hex()
    return pa.array([raw[k * n : k * n + n] for k in range(len(signature))], pa.string())


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """The id column and the fingerprint (4 hex digits a sample) of every whole text. A null text counts as empty, and
    a text without words has the fingerprint 00..0. Rows are independent: ties, repeats and null ids stay as they
    are; other columns are dropped, whatever their names."""

    def run(it):
        for batch in it:
            for i, j in batches(batch.column(1)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), _hex(signatures([t.encode() for t in texts_of(part.column(1))], samples))], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def spliced(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint every whole text, the text spliced with its successor's beginning, and hold both against each other.

    A row's successor is the next in descending id order (integers), after the last one the first. Null ids come last,
    rows of one id in the order of their texts; a single row succeeds itself. Null texts count as empty. Returns
    the id column, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; other columns are
    dropped, whatever their names. An empty table gives an empty table.

    The order is found without a global window: rows are cut into ranges at approximate quantiles of the id, and where many share
    an id, or have none, of the first 7 bytes of their texts. A range is a partition, and the first row of each range is
    also sent to the range before it (with those of the same id and 7 bytes). So the texts are shuffled once, and what the driver
    holds is one id a partition.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).isNull().alias("void"), F.col(text_col).cast("string").alias("t"))
    # in the order of (k, q), ascending, rows stand from the last to the first
    head = F.conv(F.rpad(F.substring(F.hex(F.encode(F.substring(F.coalesce("t", F.lit("")), 1, 7), "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")
    rows = rows.withColumn("q", -head)
    keys = rows.select("k", "q")
    quantiles = [int(x) for x in keys.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n) or []] if n > 1 else []
    least = -(2**63)
    cuts = {(c, least) for c in quantiles}
    hot = {c: m for c, m in Counter(quantiles).items() if m > 1}  # n / 2 at most
    if hot:
        shares = F.percentile_approx("q", [i / 64 for i in range(1, 64)], 1000)
        for r in keys.where(F.col("k").isin(list(hot))).groupBy("k").agg(shares.alias("s")).collect():
            m = min(hot[r.k], 64)  # with the cut at the id itself as many as the quantiles, so no more ranges than partitions
            cuts |= {(r.k, int(r.s[63 * j // m])) for j in range(1, m)}
    cut_k, cut_q = (np.array([c[x] for c in sorted(cuts)], np.int64) for x in (0, 1))

    def slots(k: np.ndarray, q: np.ndarray) -> np.ndarray:
        out, high = np.searchsorted(cut_k, k, "left"), np.searchsorted(cut_k, k, "right")
        for c in np.unique(k[high > out]).tolist():
            some = np.flatnonzero(k == c)
            low = int(out[some[0]])
            out[some] = low + np.searchsorted(cut_q[low : int(high[some[0]])], q[some], "right")
        return out

    def range_of(k, q):
        import pandas as pd

        return pd.Series(slots(k.to_numpy(), q.to_numpy()).astype(np.int32))

    slot = F.pandas_udf(range_of, "int")
    firsts = {r[0]: (r[1].k, r[1].q) for r in keys.groupBy(slot("k", "q").alias("s")).agg(F.max(F.struct("k", "q"))).collect()}  # one row a partition
    order = sorted(firsts)
    lead = {firsts[s]: order[x + 1] if x + 1 < len(order) else order[0] for x, s in enumerate(order)}
    lead_k = np.array(sorted({k for k, _ in lead}), np.int64)

    def places(k, q):
        import pandas as pd

        k, q = k.to_numpy(), q.to_numpy()
        out = [[x] for x in (slots(k, q) * 2).tolist()]
        for x in np.flatnonzero(np.isin(k, lead_k)).tolist():
            to = lead.get((int(k[x]), int(q[x])))
            if to is not None:
                out[x].append(to * 2 + 1)
        return pd.Series(out)

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(it):
        held: list[tuple] = []  # the last row so far, without its successor
        for batch in it:
            for i, j in batches(batch.column("t"), BLOCK_BYTES):
                part = batch.slice(i, j - i)
                held += zip(part.column("k").to_pylist(), part.column("void").to_pylist(), part.column("p").to_pylist(), texts_of(part.column("t")))
                now = [x for x in range(len(held) - 1) if not held[x][2] & 1]
                if now:
                    texts = [x[3] for x in held[: now[-1] + 2]]
                    edited = [spliced(texts[x], texts[x + 1]).encode() for x in now]
                    whole = signatures([t.encode() for t in texts], samples)
                    own, other, after = whole[now], signatures(edited, samples), whole[[x + 1 for x in now]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if held[x][1] else held[x][0] for x in now], pa.int64()), pa.array([len(texts[x]) for x in now], pa.int64()),
                            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), _hex(own), _hex(other), pa.array(likeness(own, other)), pa.array(likeness(own, after)),
                        ],
                        names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )
                held = held[-1:]

    spread = rows.withColumn("p", F.explode(F.pandas_udf(places, "array<long>")("k", "q")))
    ordered = spread.repartitionById(n, F.shiftright("p", 1).cast("int")).sortWithinPartitions(F.col("p").bitwiseAND(1), F.desc("k"), F.col("void"), "t")
    return ordered.mapInArrow(run, schema)

