"""The ten operators against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import bpe, chunk_dedup, edit_counts, fingerprint, graph, mixing, ngram_join, quality_model, quality_rules, sharding, tokenfile
from docflow.llm.queries import BYTE_BPE, WORD_BPE
from docflow.llm.shared import fresh_path

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


def text(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = text(150, 1)
    words = base.split(" ")
    near = [" ".join(w if i % 40 else "changed" + str(k) for i, w in enumerate(words)) for k in range(12)]
    passage = text(70, 99)
    out = [(i, t) for i, t in enumerate([base, base, base, *near, None, "", " \n ", "one", "one two", "é" * 300, "word " * 400, text(60, 5) + " " + passage, text(80, 6) + " " + passage + " " + text(30, 7), text(6000, 8), "x" * 50_000, *[text(120, 200 + k) for k in range(12)]])]
    out += [(3, near[0]), (3, near[0]), (7, "a clash of ids"), (None, text(90, 77)), (None, None), (None, "one")]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], f"s{k % 4}" if k % 7 else None, 0 if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, `a.b` string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)] + [(1, None, 0), (2, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# 1

def test_fingerprints(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in fingerprint.compare_with_next(docs).select("doc_id", "n_chars", "edited_sha256").collect() if r[0] is not None)
    order = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda x: (-x[0], x[1])) + sorted((None, t or "") for i, t, *_ in rows if i is None)
    want = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        if i is not None:
            want.append((i, len(t), sha((t[: len(t) - half] + nxt[:half]).encode())))
    assert got == sorted(want)
    assert fingerprint.compare_with_next(empty).count() == 0
    by_text = {}
    for r in docs.select("doc_id", "text").where("doc_id < 3").join(fingerprint.fingerprint_documents(docs), "doc_id").collect():
        by_text.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_estimates_generalised_jaccard():
    def grams(t):
        w = t.split()
        return Counter(zip(w, w[1:], w[2:]))

    texts = [text(300, 1000 + k) for k in range(60)]
    mixed = [" ".join(a.split()[:k * 4 + 20] + b.split()[k * 4 + 20 :]) for k, (a, b) in enumerate(zip(texts, texts[1:]))]
    repeated = [t + " " + " ".join(t.split()[:80]) for t in texts[: len(mixed)]]
    for other in (mixed, repeated):
        n = len(other)
        a, b = fingerprint.signatures([t.encode() for t in texts[:n]], 256), fingerprint.signatures([t.encode() for t in other], 256)
        want = [sum((grams(x) & grams(y)).values()) / sum((grams(x) | grams(y)).values()) for x, y in zip(texts, other)]
        error = fingerprint.likeness(a, b) - np.array(want)
        assert abs(error.mean()) < 0.012 and error.std() < 0.05


# 2

def test_bpe_matches_tiktoken(docs, rows, oracle, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, BYTE_BPE).collect())
    want = []
    for i, t, *_ in rows:
        ids = oracle.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(want)
    assert bpe.encode_documents(empty, BYTE_BPE).count() == 0


def test_bpe_pretokens_and_queue(oracle):
    b = bpe.ByteBPE(BYTE_BPE)
    r = random.Random(1)
    odd = ["", "a  b", " 's", "x's y're don't I'LL 'll '''s '!s\n's  \n\n b \t c d 　 \x1c\x1f\x85 e", "'v e'd", "日本語 テスト １２３ ½", " " * 50 + "x", "\n\n\n", "a" * 5000, "ab" * 3001, "\U0001d4b3" * 40]
    odd += ["".join(r.choice("ab' \n\ts revlmd.!1é 　𝒳½") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    odd += ["a" + chr(c) + " b" + chr(c) + "1 " + chr(c) for c in range(0, 0x3000)]
    ids, at = b.encode(odd)
    for k, t in enumerate(odd):
        assert ids[at[k] : at[k + 1]].tolist() == oracle.encode_ordinary(t)
    assert b.decode(ids).tobytes().decode() == "".join(odd)


# 3

def brute_counts(t: str):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_quality_counts(docs, rows, labels, empty):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(docs, labels).collect())
    want = []
    for i, t, *_ in rows:
        c = brute_counts(t or "")
        want.append((-1 if i is None else i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)
    assert quality_rules.apply_rules(empty, labels).count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_binomial_bound_and_cutoffs(spark):
    for n, p in ((10, 0.3), (200, 0.02)):
        from math import comb

        for k in range(0, n, 3):
            assert abs(quality_rules.binomial_tail(k, n, p) - min(1, sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))) < 1e-9
    assert quality_rules.choose([0, 0, 1, 90], 2000, 0.01, 0.01) == 2
    assert quality_rules.choose([0, 0], 20, 0.01, 0.01) == -1 and quality_rules.choose([], 0, 0.01, 0.01) == -1
    clean = [(k, text(100, k).replace("\n", ""), "en") for k in range(2000)]
    loud = [(5000 + k, text(100, k).upper().replace(" ", "!! "), "en") for k in range(30)]
    docs = spark.createDataFrame(clean + loud, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(2000)] + [(5000 + k, 0) for k in range(10)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    assert not any(out[5000 + k] for k in range(30)) and sum(out[k] for k in range(2000)) > 1900


# 4

def test_mixing(spark, docs, rows, empty):
    out = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert mine[0].source_size == sum(r.size for r in mine) and mine[0].target <= 2 * mine[0].source_size + 1e-6
        missed = [r.size for r in mine if r.size and r.copies < 2 and r.copies == min(x.copies for x in mine if x.size)]
        assert sum(r.taken for r in mine) <= mine[0].target + 1e-6 and (not missed or mine[0].target - sum(r.taken for r in mine) < max(missed))
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in out)
    assert mixing.mix_documents(empty).count() == 0
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert applied.count() == sum(r.copies for r in out) and mixing.apply_mix(empty).count() == 0


def test_mixing_fills_past_documents_that_do_not_fit(spark):
    for seed in range(3):
        sizes = [10] * 60 + [1000, 1000, 301, 302] + [1, 2, 3]
        docs = spark.createDataFrame([(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(900, "w " * 7, None), (901, "w", None)], "doc_id long, text string, source string")
        out = mixing.mix_documents(docs, ratio=0.2, seed=f"m{seed}").collect()
        assert len(out) == len(sizes) + 2
        for s in ("a", None):
            mine = [r for r in out if r.source == s]
            gap = mine[0].target - sum(r.taken for r in mine)
            assert gap > -1e-6 and all(r.size > gap for r in mine if r.copies < 1)


SIZES = (50, 200, 800)


def test_pareto_inclusion_is_near_its_probability(spark):
    """Documents of a source differ in their inclusion probability, and are taken as often as it says."""
    n, hits, expected, runs = 3000, Counter(), {}, 4
    docs = spark.createDataFrame([(k, "w " * SIZES[k % 3], "a" if k % 2 else "b") for k in range(n)], "doc_id long, text string, source string")
    for seed in range(runs):
        for r in mixing.mix_documents(docs, ratio=1.0, weights=(3, 2), seed=f"t{seed}").collect():
            hits[r.source, r.size] += r.copies
            expected[r.source, r.size] = r.expected
    for key, e in expected.items():
        assert hits[key] / runs / (n / 6) == pytest.approx(e, abs=0.04), key
    for s in "ab":
        assert expected[s, 50] + 0.02 < expected[s, 200] < expected[s, 800] - 0.02
    for s in "ab":  # on average over the words, the share of the source's target
        share = {r.source: r.target / r.source_size for r in mixing.mix_documents(docs, ratio=1.0, weights=(3, 2)).collect()}[s]
        assert sum(expected[s, k] * k for k in SIZES) / sum(SIZES) == pytest.approx(share, abs=1e-9)


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(9)
    rows = [(None, "v " * r.randint(1, 60), "a") for _ in range(12)] + [(5, "x " * r.randint(1, 60), "a") for _ in range(12)] + [(k, "w " * r.randint(1, 90), "a") for k in range(30)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + seed)
        seen.add(str(sorted((str(x.doc_id), x.size, x.copies) for x in mixing.mix_documents(docs, ratio=0.6).collect())))
    assert len(seen) == 1


# 5

def test_substring_dedup(spark, docs, rows, empty):
    cut = chunk_dedup.dedup_substrings(docs)
    assert cut.columns == [*docs.columns, "_dedup"]
    out = cut.collect()
    assert len(out) == len(rows) and {r.doc_id for r in out if r.text is None} == {i for i, t, *_ in rows if t is None}
    for r in out:
        whole = next(t for i, t, *_ in rows if i == r.doc_id and (t is None) == (r.text is None) and (t is None or len(t) == r._dedup.n_chars))
        if whole is not None:
            kept, last = "", 0
            for s in r._dedup["spans"]:
                kept, last = kept + whole[last : s.begin], s.end
            assert kept + whole[last:] == r.text
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[0]._dedup.removed_chars == 0 and by[1].text == "" and list(by[1]._dedup.first_ids) == [0]
    assert by[22]._dedup.removed_chars == 0 and by[23]._dedup.removed_chars > 250 and 22 in by[23]._dedup.first_ids  # the shared passage
    assert all(by[i]._dedup.removed_chars == 0 for i in range(26, 38))
    assert chunk_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_keeps_the_text_of_copied_rows(spark):
    t, inner = text(120, 301), text(60, 302)
    twice = inner + " " + text(40, 303) + " " + inner
    rows = [(1, t), (1, t), (2, t), (3, twice), (3, twice), (None, text(90, 304)), (None, text(90, 304))]
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = [(r.doc_id, r.text, r._dedup.removed_chars) for r in chunk_dedup.dedup_substrings(docs).collect()]
        assert sorted(x for i, x, _ in out if i == 1) == [t, t] and [x for i, x, _ in out if i == 2] == [""]
        assert [x for i, x, _ in out if i is None] == [rows[-1][1]] * 2
        kept = [x for i, x, n in out if i == 3]
        assert kept[0] == kept[1] and inner in kept[0] and len(kept[0]) < len(twice) - 150


def test_chunks_resist_shifts():
    t = text(2000, 4).encode()
    data, start, stop, doc, begin = chunk_dedup.chunk_spans([t, b"inserted words here " + t, t[:5000] + b" one more " + t[5000:]])
    chunks = [{data[a:b].tobytes() for a, b, d in zip(start, stop, doc) if d == k} for k in range(3)]
    assert len(chunks[0] - chunks[1]) <= 3 and len(chunks[0] - chunks[2]) <= 4
    data, start, stop, doc, begin = chunk_dedup.chunk_spans([b"", b" ", "中文字" .encode() * 800, b"x"])
    assert set(doc.tolist()) <= {1, 2, 3} and (doc == 2).sum() >= 1


# 6

def test_ngram_join(spark, docs, rows, empty, monkeypatch):
    texts = list(dict.fromkeys(t or "" for _, t, *_ in rows))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    near = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= ngram_join.THRESHOLD}
    degree = Counter(a for a, _ in near)
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    ids = {}
    for i, t, *_ in rows:
        k = texts.index(t or "")
        ids.setdefault(group[k], set()).add(i)
    for block in (256, 3):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        out = ngram_join.near_duplicates(docs).join(docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce("text", F.lit("")).alias("t")).distinct(), "key").collect()
        assert len(out) == len(rows)
        for r in out:
            k = texts.index(r.t)
            assert r.n_links == degree[k], r
            assert r.group_id == min((i for i in ids[group[k]] if i is not None), default=None)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.drop_near_duplicates(empty).count() == 0


def test_ngram_join_of_hot_groups(spark, monkeypatch):
    """Texts around a long passage that all share, in tight groups and loose: no link is lost, and a row is shuffled a bounded number of
    times, whatever the size of a bucket."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    r, shared, sets = random.Random(4), text(90, 700).split(), []
    texts = []
    for k in range(420):
        own = text((4, 4, 60, 140)[k % 4], 800 + k).split()
        base = list(shared)
        for _ in range((0, 3, 2, 0)[k % 4]):
            base[r.randrange(90)] = f"v{r.randrange(5)}"
        texts.append(" ".join(base + own))
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    want = [sum(len(a & b) / len(a | b) >= ngram_join.THRESHOLD for b in sets) - 1 for a in sets]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_links for x in ngram_join.near_duplicates(docs).collect()}
    assert sum(want) > 20_000 and sum(got.values()) >= 0.99 * sum(want) and all(got[k] <= want[k] for k in got)
    counts = []
    for n in (500, 1000, 2000):
        hot = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("band"), F.lit(1).cast("long").alias("h"), F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
        counts.append(ngram_join._hot_edges(hot).count() / n)
    assert max(counts) <= 1.01


def hot_pairs() -> list[str]:
    """60 texts around a long passage, and pairs with part of it whose links rest on one bucket each, that of the passage."""
    shared, texts = text(90, 700), [text(90, 700) + " " + text(6, 10_000 + k) for k in range(60)]
    for k in (206, 281, 351, 501, 941, 1025, 1373, 1428, 1784, 1985):  # picked by their signatures
        texts += [f"{shared} {text(100, 20_000 + 3 * k)} {text(90, 20_000 + 3 * k + own)}" for own in (1, 2)]
    return texts


def test_ngram_join_of_pairs_that_share_a_single_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    texts = hot_pairs()
    near = ngram_join.jaccard_matrix(texts, 3) >= ngram_join.THRESHOLD
    want = {k: int(near[k].sum()) - 1 for k in range(len(texts))}
    assert all(want[k] == 1 and near[k, k ^ 1] for k in range(60, len(texts)))
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_links for x in got} == want
    assert all(x.group_id == (x.doc_id & ~1 if x.doc_id >= 60 else 0) for x in got)


def test_rarest_buckets_hold_one_that_texts_share(spark):
    r, need = random.Random(5), 4
    buckets = [set(r.choices(range(30), [1 / (1 + b) for b in range(30)], k=9)) for _ in range(80)]
    size = Counter(b for x in buckets for b in x)
    members = spark.createDataFrame([(b, 0, bytes([k]), size[b]) for k, x in enumerate(buckets) for b in x if size[b] > 1], "band int, h long, key binary, size long")
    kept = [set() for _ in buckets]
    for x in ngram_join._rare(members, need).collect():
        kept[x.key[0]].add(x.band)
    assert sum(map(len, kept)) == sum(max(0, sum(size[b] > 1 for b in x) - need + 1) for x in buckets)
    pairs = [(a, b) for a in range(80) for b in range(a) if len(buckets[a] & buckets[b]) >= need]
    assert len(pairs) > 100 and all(kept[a] & kept[b] for a, b in pairs)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# 7

def test_edit_counts(docs, rows, oracle, empty):
    edits = F.array(F.struct(F.lit(5).alias("start"), F.lit(3).alias("n_deleted"), F.lit(" put's in").alias("inserted")), F.struct(F.lit(10**9).alias("start"), F.lit(2).alias("n_deleted"), F.lit("end").alias("inserted")), F.lit(None))
    out = edit_counts.count_with_edits(docs.withColumn("edits", edits), BYTE_BPE).collect()
    want = []
    for i, t, *_ in rows:
        t = t or ""
        e = t[:5] + " put's in" + t[8:] + "end"
        want.append((-1 if i is None else i, len(t), len(oracle.encode_ordinary(t)), len(e), len(oracle.encode_ordinary(e))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) for r in out) == sorted(want)
    big = next(r for r in out if r.n_chars > 30_000 and r.n_pretokens > 3000)
    assert big.n_encoded < 40
    assert edit_counts.count_with_edits(docs.withColumn("edits", F.lit(None).cast(edit_counts.EDITS_TYPE)), BYTE_BPE).where("edited_tokens != n_tokens").count() == 0
    assert edit_counts.count_with_edits(empty.withColumn("edits", edits), BYTE_BPE).count() == 0


def test_edit_trees_by_chance(oracle):
    b, r = bpe.ByteBPE(BYTE_BPE), random.Random(2)
    letters = "ab' \n\tsrevlmd.!1é "
    for _ in range(250):
        texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 3, 30, 200]))) for _ in range(6)]
        trees = []
        for t in texts:
            data, begin, end, _, char_at = bpe.pretoken_spans([t])
            trees.append(edit_counts.CountTree(t, np.append(char_at, len(t)), b.cache.rows(data, begin, end)[1]))
        edits = [[(r.randint(0, len(t) + 3), r.randint(0, 9), "".join(r.choice(letters) for _ in range(r.randint(0, 5)))) for _ in range(r.randint(0, 6))] for t in texts]
        edit_counts.apply_edits(b, trees, edits)
        for t, each, tree in zip(texts, edits, trees):
            for s, gone, new in each:
                s = min(s, len(t))
                t = t[:s] + new + t[s + gone :]
            assert tree.text() == t and tree.n_tokens == len(oracle.encode_ordinary(t))


# 8

def test_quality_model(spark, docs, labels, empty):
    out = quality_model.score_documents(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    assert quality_model.score_documents(empty, labels).count() == 0
    none = quality_model.score_documents(docs, labels.where("false")).collect()
    assert {round(r.score, 1) for r in none} == {0.5}


def test_quality_model_learns(spark):
    good = [(k, text(80 + k % 60, k), 1) for k in range(400)]
    bad = [(1000 + k, text(80, k).upper() if k % 2 else "spam buy " * 50 + text(20, k), 0) for k in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    y = {i: q for i, _, q in good + bad}
    out = [r for r in quality_model.score_documents(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == y[r.doc_id] for r in out]) > 0.97


def test_isotonic():
    w, t = np.array([1.0, 2, 1, 4]), np.array([1.0, 0, 1, 2])
    assert np.allclose(quality_model.isotonic(w, t), [1 / 3, 1 / 3, 3 / 5, 3 / 5])


# 9

def test_token_file(spark, docs, rows, empty):
    path = fresh_path(spark, "test_tokens")
    tokenfile.write_token_file(docs.where("doc_id is not null"), path, WORD_BPE)
    t = Tokenizer.from_file(WORD_BPE)
    at, want = 0, []
    for i, x, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tokenfile.token_index(spark, path).collect()) == sorted(want)
    plan = tokenfile.read_token_file(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    other = fresh_path(spark, "test_tokens")
    tokenfile.write_token_file(empty, other, WORD_BPE)
    assert tokenfile.token_index(spark, other).count() == 0
    tokenfile.write_token_file(docs, other, WORD_BPE)
    assert tokenfile.token_index(spark, other).count() == len(rows)


def test_span_cache_when_full():
    from docflow.llm.textkernel import Block, SpanCache

    seen = []

    def lengths(pieces):
        seen.extend(pieces)
        return np.array([len(p) for p in pieces]), np.ones(len(pieces), np.int64)

    cache = SpanCache(lengths, limit=50)
    for k in range(40):
        b = Block([" ".join(["often", "seen"] + [f"w{k}x{j}" + "y" * (j % 5) for j in range(20)]).encode()])
        s, e, _ = b.words()
        start, count = cache.rows(b.data, s, e)
        assert (cache.flat[start] == e - s).all() and (count == 1).all() and len(cache.keys) <= 72
    assert seen.count(b"often") < 5


def test_word_pieces_match_the_library():
    w, t, r = tokenfile.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE), random.Random(3)
    texts = ["".join(r.choice("ab'sS \n\t.,!?;:<|>x1éIAÉ 　≠̸́̇İßΣΑ") for _ in range(r.randint(0, 30))) for _ in range(5000)] + ["x<|endoftext|>y <|endoftext|>.", "<|EndOfText|> ABC", "", "\x1c a\x85b.c"]
    ids, at = w.encode(texts)
    for k, x in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


# 10

def test_sharding(spark, docs, rows, empty):
    names = [f"n{k}" for k in range(20)]
    table = sharding.fill_table(names, 4099)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 4099)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer))
    assert moved < 1.6 * share[19]
    out = sharding.place(docs, names, size=4099)
    assert out.columns == [*docs.columns, "shard"] and out.count() == len(rows)
    for r in out.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) % 4099
        assert r.shard == names[table[slot]]
    assert sharding.place(empty, names).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"])
