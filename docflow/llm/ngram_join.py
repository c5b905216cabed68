"""N-gram Jaccard join by MinHash banding (operator 6).

Nodes are the distinct texts (classes of equal documents). A text's n-gram set gives bands x rows MinHash values; the
numbers are chosen so that a pair at the threshold shares a band with probability `recall` at least.
1. Texts are shuffled by band hash. Buckets of one text go; in those of up to BLOCK a pair of texts is plausible if its
   signatures agree as often as the threshold asks, less SLACK standard errors, and the bucket yields a spanning
   forest of its plausible pairs, not the pairs. Texts in larger (hot) buckets meet by single hashes instead. Plausible pairs
   agree in some number of hashes (`need`), so with hashes ordered from rare to common both have the rarest one they share among
   all but the need - 1 most common of their own. Buckets of those up to BLOCK are compared as above; the texts of a larger one are all
   joined to the least of them. So no plausible pair of a bucket is lost, and each text is shuffled a bounded number of times,
   however large a bucket is.
2. The components of those edges are the groups within which all links are looked for. In each, pairs are verified on full
   n-gram sets, and what leaves the task is each text's number of links and a spanning forest of the links.
   In groups above BLOCK texts, texts are first held against some PIVOTS of the group. As 1 - Jaccard is a metric, texts within half the
   allowed distance of one pivot (a ball) are all linked with one another: they are counted, not compared. All other pairs are
   verified block by block, a task per pair of blocks, so no group is ever in one task, and no pair of it is lost.
3. The components of those forests are the groups of near duplicates.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import free_shuffles, saved, small_batches
from .textkernel import Block, batches, fixed_width, mix, ngram_hashes, span_hashes, texts_of, whole_groups

THRESHOLD, RECALL, N_GRAM, ROWS = 0.5, 0.99, 3, 3
BLOCK, BLOCK_GRAMS, SLACK = 512, 2_000_000, 4.0
#: Pivots of a large group, on average.
PIVOTS = 16
_U = np.uint64


def band_count(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands with 1 - (1 - threshold**rows)**bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (gram, document) pairs of lower-cased texts, by document. A text of fewer than n words has one gram."""
    import pandas as pd

    block = Block([t.lower().encode() for t in texts])
    starts, ends, doc = block.words()
    gram, gram_doc, _ = ngram_hashes(span_hashes(block.data, starts, ends), doc, len(texts), n)
    order = np.argsort(gram_doc, kind="stable")
    gram, gram_doc = gram[order], gram_doc[order]
    code, keys = pd.factorize(gram ^ mix(gram_doc.astype(np.uint64)))
    first = np.zeros(len(keys), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return gram[first], gram_doc[first]


def minhash(gram: np.ndarray, doc: np.ndarray, n_docs: int, hashes: int) -> np.ndarray:
    """uint16 [n_docs, hashes] (hashed minima); doc ascends. Texts without grams: zeros."""
    g = np.random.Generator(np.random.PCG64(1997))
    a = g.integers(1, 2**32, hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = g.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)
    x = (gram >> _U(32)).astype(np.uint32) ^ gram.astype(np.uint32)
    low = np.full((n_docs, hashes), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = x[at : at + 2048, None] * a + b
        h ^= h >> np.uint32(15)
        d = doc[at : at + 2048]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        low[d[first]] = np.minimum(low[d[first]], np.minimum.reduceat(h, first, axis=0))
    low *= np.uint32(0x9E3779B1)
    low ^= low >> np.uint32(13)
    return (low * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(np.uint16)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index in the component of each of n nodes with edges i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def _pairs_of_block(mine: np.ndarray, cross: bool) -> np.ndarray:
    """Mask [m, m] of the pairs i < j that a block task owns."""
    m = len(mine)
    upper = np.triu(np.ones((m, m), bool), 1)
    return upper & (mine[:, None] != mine[None, :]) if cross else upper


def _forests(bands: int, rows: int, least: float):
    """From bucket rows (band, h, key, sig) sorted by bucket: forest edges a, b."""
    width = bands * rows

    def same(t):
        out = np.ones(t.num_rows - 1, bool)
        for c in ("band", "h"):
            v = t.column(c).to_numpy()
            out &= v[1:] == v[:-1]
        return out

    def run(it):
        for table, starts in whole_groups(it, same):
            sig, key = fixed_width(table.column("sig"), width), table.column("key").to_pylist()
            a, b = [], []
            size = np.diff(starts)
            two = starts[:-1][size == 2]
            two = two[(sig[two] == sig[two + 1]).mean(axis=1) >= least] if len(two) else two
            a += [key[x] for x in two.tolist()]
            b += [key[x + 1] for x in two.tolist()]
            for s, m in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist()):
                part, alike = sig[s : s + m], np.zeros((m, m), bool)
                for x in range(m - 1):
                    alike[x, x + 1 :] = (part[x + 1 :] == part[x]).mean(axis=1) >= least
                root = _roots(m, *np.nonzero(alike))
                for x in np.flatnonzero(root != np.arange(m)).tolist():
                    a.append(key[s + x])
                    b.append(key[s + int(root[x])])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def jaccard_matrix(texts: list[str], n: int) -> np.ndarray:
    """Jaccard similarity of the n-gram sets of all pairs of texts; 0 where both are empty."""
    import pandas as pd

    m = len(texts)
    gram, doc = gram_sets(texts, n)
    size = np.bincount(doc, minlength=m).astype(float)
    code, keys = pd.factorize(gram)
    shared = np.bincount(code, minlength=len(keys))[code] > 1
    code, _ = pd.factorize(code[shared])
    doc = doc[shared]
    both = np.zeros((m, m))
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    step = 8192
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        i, j = np.searchsorted(code, [at, at + step])
        has = np.zeros((m, min(step, int(code[-1]) + 1 - at)), np.float32)
        has[doc[i:j], code[i:j] - at] = 1
        both += has @ has.T
    union = size[:, None] + size[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def _same_block(t: pa.Table) -> np.ndarray:
    root = fixed_width(t.column("root"), 16)
    out = (root[1:] == root[:-1]).all(axis=1)
    for c in ("lo", "hi"):
        v = t.column(c).to_numpy()
        out &= v[1:] == v[:-1]
    return out


def _balls(threshold: float, n: int):
    """From rows (root, lo, hi, pivot, key, text) sorted by (root, lo), pivots and members: key of each member, and ball, the first
    pivot by key within half the allowed distance (null: none)."""
    near = 1 - (1 - threshold) / 2

    def run(it):
        for table, starts in whole_groups(it, _same_block):
            key, text = table.column("key").to_pylist(), texts_of(table.column("text").combine_chunks())
            pivot = table.column("pivot").to_numpy(zero_copy_only=False)
            keys, balls = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                mine, some = np.flatnonzero(~pivot[s:e]) + s, np.flatnonzero(pivot[s:e]) + s
                keys += [key[x] for x in mine.tolist()]
                if not len(some) or not len(mine):
                    balls += [None] * len(mine)
                    continue
                some = some[np.argsort([key[x] for x in some.tolist()], kind="stable")]
                close = jaccard_matrix([text[x] for x in [*mine.tolist(), *some.tolist()]], n)[: len(mine), len(mine) :] >= near
                balls += [key[some[c]] if f else None for c, f in zip(close.argmax(axis=1).tolist(), close.any(axis=1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(balls, pa.binary())], names=["key", "ball"])

    return run


def _verify(threshold: float, n: int):
    """From rows (root, lo, hi, mine, key, text) sorted by block pair: key, links, peer (its root in the forest of links)."""

    def run(it):
        for table, starts in whole_groups(it, _same_block):
            key, text = table.column("key").to_pylist(), texts_of(table.column("text").combine_chunks())
            mine, lo, hi = (table.column(c).to_numpy() for c in ("mine", "lo", "hi"))
            keys, links, peers = [], [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2:
                    continue
                near = (jaccard_matrix(text[s:e], n) >= threshold) & _pairs_of_block(mine[s:e], lo[s] != hi[s])
                root = _roots(e - s, *np.nonzero(near))
                degree = near.sum(axis=0) + near.sum(axis=1)
                keys += key[s:e]
                links += degree.tolist()
                peers += [key[s + x] for x in root.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(peers, pa.binary())], names=["key", "links", "peer"])

    return run


def _blocks(n: str, grams: str):
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(grams) / BLOCK_GRAMS))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (band, h, key) of the buckets of two texts or more, with their size."""
    # counted before the shuffle as far as possible; a hot bucket is split by the join, and never in one task
    return rows.join(rows.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1").hint("merge"), ["band", "h"])


def _rare(members: DataFrame, need: int) -> DataFrame:
    """Of the members (band, h, key, size) of buckets, each text's without its need - 1 most common ones. Texts that share
    `need` buckets still share one: the rarest they share, as each has the need - 1 others after it. Ties go by bucket."""
    lists = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("size", "band", "h"))).alias("all"))  # one a band at most
    kept = F.slice("all", F.lit(1), F.greatest(F.size("all") - F.lit(need - 1), F.lit(0)))
    return lists.select("key", F.explode(kept).alias("x")).select("x.band", "x.h", "key", "x.size")


def _hot_edges(hot: DataFrame) -> DataFrame:
    """Edges a, b from the members (band, h, key) of hot buckets: each text with the least one of each of its buckets."""
    heads = hot.groupBy("band", "h").agg(F.min("key").alias("head"))
    return hot.join(heads.hint("merge"), ["band", "h"]).where("key != head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_GRAM, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, key (binary, the md5 of its text), class_id, n_links, group_id, group_key.

    class_id is the least id with the very same text; n_links the number of other texts whose n-gram sets have a Jaccard
    similarity of threshold or more with this one's (words lower-cased, parted at white space); group_id the least id in the
    connected component of links, and group_key its least key. Null texts count as empty; texts without words have no links; texts of fewer than n
    words have one gram, all their words. Null ids are ignored in the minima (a class of null ids only has a null class_id);
    repeated rows stay. Other columns are dropped, whatever their names. An empty table gives an empty table.

    All sides of the joins grow with the corpus, so they are merge joins at every size: by the size of its files, which
    compression makes small, the planner would broadcast some of them."""
    bands = band_count(threshold, recall, rows)
    hashes = bands * rows
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / hashes)
    need = max(rows, math.ceil(least * hashes - 1e-9))  # texts of one bucket agree in its hashes at least
    small_batches(docs.sparkSession)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))

    def sketch(it):
        for batch in it:
            for i, j in batches(batch.column(2)):
                part = batch.slice(i, j - i)
                texts = texts_of(part.column(2))
                gram, doc = gram_sets(texts, n)
                sig = minhash(gram, doc, len(texts), hashes)
                raw, w = sig.tobytes(), hashes * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([raw[k * w : k * w + w] for k in range(len(texts))], pa.binary()), pa.array(np.bincount(doc, minlength=len(texts)))], names=["doc_id", "key", "sig", "grams"]
                )

    sketches = saved(whole.select("doc_id", "key", "text").mapInArrow(sketch, f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, key binary, sig binary, grams long"), "ngram_sketches")
    classes = saved(sketches.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.max("grams").alias("grams"), F.max("sig").alias("sig")), "ngram_classes")

    def band_rows(it):
        for batch in it:
            some = batch.filter(pc.greater(batch.column(2), 0))
            if not some.num_rows:
                continue
            sig = fixed_width(some.column(1), hashes * 2).view(np.uint16).astype(np.uint64)
            h = np.zeros((some.num_rows, bands), np.uint64)
            for r in range(rows):
                h = h * _U(0x9E3779B97F4A7C15) + sig[:, r::rows] + _U(1) if rows > 4 else (h << _U(16)) | sig[:, r::rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(bands, dtype=np.int32), some.num_rows)), pa.array(h.reshape(-1).view(np.int64)), some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), bands)))], names=["band", "h", "key"]
            )

    banded = classes.select("key", "sig", "grams").mapInArrow(band_rows, "band int, h long, key binary")
    members = saved(_shared(banded), "ngram_members")

    def narrow(it):  # 8 bits a hash suffice to tell plausible pairs
        for batch in it:
            sig = (fixed_width(batch.column(1), hashes * 2).view(np.uint16) & 255).astype(np.uint8)
            raw = sig.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[k * hashes : (k + 1) * hashes] for k in range(batch.num_rows)], pa.binary())], names=["key", "sig"])

    def hash_rows(it):  # each hash as a band of its own, after the others
        for batch in it:
            sig = fixed_width(batch.column(1), hashes * 2).view(np.uint16).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(bands, bands + hashes, dtype=np.int32), batch.num_rows)), pa.array(sig.reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), hashes)))], names=["band", "h", "key"]
            )

    hot, cold = members.where(F.col("size") > BLOCK), members.where(F.col("size") <= BLOCK)
    any_hot = not hot.isEmpty()
    if any_hot:
        of_hot = saved(classes.select("key", "sig").join(hot.select("key").distinct().hint("merge"), "key"), "ngram_hot")
        single = saved(_rare(_shared(of_hot.mapInArrow(hash_rows, "band int, h long, key binary")), need), "ngram_hashes")
        hot, cold = single.where(F.col("size") > BLOCK), cold.unionByName(single.where(F.col("size") <= BLOCK))
    cold = cold.select("band", "h", "key").join(classes.select("key", "sig").mapInArrow(narrow, "key binary, sig binary").hint("merge"), "key")
    forest = cold.repartition("band", "h").sortWithinPartitions("band", "h").select("band", "h", "key", "sig").mapInArrow(_forests(bands, rows, least), "a binary, b binary")
    if any_hot:
        forest = forest.union(_hot_edges(hot.select("band", "h", "key")))
    groups = saved(components(forest, "ngram_candidates"), "ngram_groups")
    free_shuffles(docs.sparkSession)

    sizes = groups.hint("merge").join(classes.select(F.col("key").alias("node"), "class_id", "grams"), "node")
    per_root = sizes.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("all_grams")).withColumn("blocks", _blocks("m", "all_grams"))
    wanted = saved(sizes.join(per_root.hint("merge"), "root").select(F.col("node").alias("key"), F.col("class_id").alias("doc_id"), "root", "grams", "m", "blocks"), "ngram_wanted")
    # the representative's row of each text: its id is part of the join key, so copies of one text don't meet in one task; rows of
    # one id and text become one before they are shuffled further, by the same keys
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    texts = whole.withColumn("who", who).drop("doc_id").join(wanted.withColumn("who", who).drop("doc_id").hint("merge"), ["key", "who"]).groupBy("key", "who").agg(*[F.first(c).alias(c) for c in ("root", "m", "blocks", "text")])
    large = not wanted.where("blocks > 1").isEmpty()
    counted = None
    if large:
        texts = saved(texts, "ngram_texts")
        of_group = texts.where("blocks > 1").withColumn("hi", F.lit(0))
        slot = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int")
        is_pivot = F.pmod(F.xxhash64("key", F.lit(11)), F.col("m")) < PIVOTS
        everywhere = of_group.where(is_pivot).withColumn("lo", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).withColumn("pivot", F.lit(True))
        held = of_group.withColumn("lo", slot).withColumn("pivot", F.lit(False)).unionByName(everywhere).select("root", "lo", "hi", "pivot", "key", "text")
        balls = held.repartition("root", "lo").sortWithinPartitions("root", "lo").mapInArrow(_balls(threshold, n), "key binary, ball binary")
        placed = saved(wanted.where("blocks > 1").join(balls.hint("merge"), "key", "left").select("key", "root", "grams", "ball"), "ngram_balls")
        # a few rows a group: its balls, and the rest
        unit = placed.groupBy("root", "ball").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("g")).withColumn("chunks", _blocks("n", "g"))
        in_group = Window.partitionBy("root")
        unit = saved(unit.withColumn("first", F.sum("chunks").over(in_group.orderBy(F.col("ball").isNull(), "ball")) - F.col("chunks")).withColumn("total", F.sum("chunks").over(in_group)), "ngram_units")
        mine = (F.col("first") + F.pmod(F.xxhash64("key", F.lit(5)), F.col("chunks"))).cast("int")
        all_blocks = F.sequence(F.lit(0), (F.col("total") - 1).cast("int"))
        others = F.filter(all_blocks, lambda o: F.col("ball").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("chunks")))
        spread = placed.join(unit.withColumnsRenamed({"root": "r", "ball": "b"}).hint("merge"), (F.col("root") == F.col("r")) & F.col("ball").eqNullSafe(F.col("b")))
        counted = spread.where("ball is not null").select("key", (F.col("n") - 1).alias("links"), F.col("ball").alias("peer"))
        spread = spread.select("key", "root", mine.alias("mine"), F.explode(others).alias("other"))
        apart = of_group.select("root", "key", "text").join(spread.hint("merge"), ["root", "key"]).select("root", "key", "text", "mine", "other")
    pairs = texts.where("blocks = 1").select("root", "key", "text", F.lit(0).alias("mine"), F.lit(0).alias("other"))
    pairs = (pairs.union(apart) if large else pairs).select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "key", "text")
    verified = pairs.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "key").mapInArrow(_verify(threshold, n), "key binary, links long, peer binary")
    verified = saved(verified.union(counted) if large else verified, "ngram_verified")
    free_shuffles(docs.sparkSession)
    near = components(verified.select(F.col("key").alias("a"), F.col("peer").alias("b")), "ngram_links")
    of_class = classes.select("key", "class_id").join(verified.groupBy("key").agg(F.sum("links").alias("n_links")).hint("merge"), "key", "left").join(near.select(F.col("node").alias("key"), "root").hint("merge"), "key", "left")
    of_class = saved(of_class.select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root")), "ngram_of_class")
    group_ids = of_class.groupBy("root").agg(F.min("class_id").alias("group_id"))
    result = of_class.join(group_ids.hint("merge"), "root").select("key", "class_id", "n_links", "group_id", F.col("root").alias("group_key"))
    return sketches.select("doc_id", "key").join(result.hint("merge"), "key").select("doc_id", "key", "class_id", "n_links", "group_id", "group_key")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one with the least id (of rows with equal id and
    text, one; of a group of null ids, any one of a text)."""
    names = docs.columns
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("group_key").agg(F.min(F.struct("key", F.col("doc_id").alias("d"))).alias("x"))
    keep = keep.select(F.col("x.key").alias("k"), F.col("x.d").alias("d"))
    # join and grouping have the same keys, so that texts are shuffled once
    who = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), who(F.col(id_col)).alias("who"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"))
    kept = whole.join(keep.select(F.col("k").alias("key"), who(F.col("d")).alias("who")).hint("merge"), ["key", "who"]).groupBy("key", "who").agg(F.first("row").alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
