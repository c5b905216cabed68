"""Independent recomputations of what the operators return, and inputs made to break them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import bpe, chunk_dedup, edit_counts, fingerprint, ngram_join, quality_model, quality_rules, textkernel, textstats, tokenfile
from docflow.llm.queries import BYTE_BPE, WORD_BPE
from docflow.llm.shared import fresh_path

from .test_operators import brute_counts, oracle, sha, text  # noqa: F401


# hashes

def thue_morse(n: int) -> tuple[str, str]:
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


def test_texts_that_meet_modulo_a_power_of_two_stay_apart(spark, oracle):  # noqa: F811
    a, b = thue_morse(4096)
    for which in (0, 1):
        raw = np.frombuffer((a + b).encode(), np.uint8)
        h = textkernel.span_hashes(raw, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]), which)
        assert h[0] != h[1]
    assert textstats.counts([(a + "\n" + b + "\n" + a).encode()])[0][textstats.COUNTS.index("n_dup_lines")] == 1
    encoder = bpe.ByteBPE(BYTE_BPE)
    ids, at = encoder.encode([a, b])
    assert [ids[at[k] : at[k + 1]].tolist() for k in (0, 1)] == [oracle.encode_ordinary(x) for x in (a, b)]
    words, library = tokenfile.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    ids, at = words.encode([a, b])
    assert [ids[at[k] : at[k + 1]].tolist() for k in (0, 1)] == [library.encode(x, add_special_tokens=False).ids for x in (a, b)]
    assert ngram_join.jaccard_matrix([a, b], 3)[0, 1] == 0
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {(x.doc_id, x.n_links) for x in ngram_join.near_duplicates(docs).collect()} == {(1, 0), (2, 0)}


def test_span_hashes_of_long_and_short_spans():
    r = random.Random(3)
    raw = bytes(r.randrange(97, 101) for _ in range(400_000))
    data = np.frombuffer(raw, np.uint8)
    cuts = sorted({0, len(raw), 70_000, 290_000, *(r.randrange(len(raw)) for _ in range(500))} - {*range(70_001, 290_000)})
    starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
    whole = textkernel.span_hashes(data, starts, ends)
    for k in range(0, len(starts), 29):
        part = np.frombuffer(raw[starts[k] : ends[k]], np.uint8)
        assert textkernel.span_hashes(part, np.array([0]), np.array([len(part)]))[0] == whole[k]
    assert len(set(whole.tolist())) == len({raw[a:b] for a, b in zip(cuts, cuts[1:])})


def test_very_long_texts(spark, oracle):  # noqa: F811
    long = text(600_000, 12) + "\n" + "y" * 300_000 + " end"
    assert len(long) > 3 * textkernel.BLOCK_BYTES
    docs = spark.createDataFrame([(1, long), (2, "short " + text(60, 1)), (3, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, BYTE_BPE).collect()}
    ids = oracle.encode_ordinary(long)
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == sha(np.array(ids, "<u4").tobytes()) and got[1].decoded_sha256 == sha(long.encode())
    c = dict(zip(textstats.COUNTS, textstats.counts([long.encode()])[0].tolist()))
    assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == brute_counts(long)
    path = fresh_path(spark, "long_tokens")
    tokenfile.write_token_file(docs, path, WORD_BPE)
    want = np.array(Tokenizer.from_file(WORD_BPE).encode(long, add_special_tokens=False).ids + [1], "<u4")
    assert {r.doc_id: r.ids_crc32 for r in tokenfile.token_index(spark, path).collect()}[3] == zlib.crc32(want.tobytes())
    assert {r.doc_id: r._dedup.removed_chars > 0.9 * len(long) for r in chunk_dedup.dedup_substrings(docs).collect()} == {1: False, 2: False, 3: True}


# 5

def plain_chunks(t: bytes) -> list[tuple[int, int, bytes]]:
    """Start, end and content (without white space at its end) of the chunks of one text, byte by byte."""
    blank = lambda c: c in b" \t\n\v\f\r"
    gear = [int(x) for x in chunk_dedup._GEAR]
    h = [sum(gear[t[i - k]] << k for k in range(16) if i - k >= 0) % 2**32 >> 16 for i in range(len(t))]
    starts, i = [], 0
    while i < len(t):
        if blank(t[i]):
            i += 1
            continue
        j = i
        while j < len(t) and not blank(t[j]):
            j += 1
        if j - i > chunk_dedup._LONG_WORD:
            starts += [k for k in range(i + 1, j) if h[k - 1] < 65536 // 32 and t[k] & 0xC0 != 0x80]
        n = j
        while n < len(t) and blank(t[n]):
            n += 1
        if j < len(t) and n < len(t) and h[j - 1] < 65536 // chunk_dedup.CHUNK_WORDS:
            starts.append(n)
        i = j
    starts = sorted([0, *starts]) if t else []
    kept = [s for k, s in enumerate(starts) if k == 0 or s - starts[k - 1] >= chunk_dedup.MIN_CHUNK]
    return [(s, e, t[s:e].rstrip(b" \t\n\v\f\r")) for s, e in zip(kept, [*kept[1:], len(t)])]


def test_substring_dedup_against_plain_chunks(spark):
    r = random.Random(21)
    passages = [text(r.randint(4, 40), 900 + k) for k in range(12)]
    rows = [(k, " ".join(r.choice(passages) if r.random() < 0.5 else text(r.randint(1, 30), 2000 + 50 * k + j) for j in range(r.randint(1, 9)))) for k in range(60)]
    rows += [(70, "z" * 5000), (71, "z" * 5000 + " tail"), (72, "中文字符" * 400), (73, "中文字符" * 380 + "尾"), (74, ""), (75, " \n "), *zip((76, 77), thue_morse(4096))]
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        chunks = plain_chunks(b)
        flags = []
        for _, _, c in chunks:
            flags.append(c in seen)
            seen.add(c)
        out, k = b"", 0
        while k < len(chunks):
            j = k
            while j < len(chunks) and flags[j]:
                j += 1
            if j > k:
                a, e = chunks[k][0], chunks[j - 1][1]
                out += b"" if e - a >= chunk_dedup.MIN_BYTES else b[a:e]
                k = j
            else:
                out += b[chunks[k][0] : chunks[k][1]]
                k += 1
        want[i] = out.decode()
    got = {x.doc_id: x for x in chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {i: x.text for i, x in got.items()} == want
    assert any(len(x._dedup.spans) > 1 for x in got.values()) and all(x._dedup.removed_chars == len(dict(rows)[i]) - len(x.text) for i, x in got.items())


# 3

def test_kept_against_plain_rules(spark):
    """The verdict recomputed: counts by regular expressions, binomial tails by their sum, levels one by one."""
    r, docs, labels = random.Random(8), [], []
    for k in range(1300):
        words = text(r.randint(40, 90), 5000 + k).split()
        style = r.random()
        if style < 0.1:
            words = [w.upper() + "!" * r.randint(0, 2) for w in words]
        elif style < 0.2:
            words = [w + " ##" if r.random() < 0.5 else w for w in words]
        elif style < 0.25:
            words = words[:10] * 6
        docs.append((k, "\n".join(" ".join(words[a : a + 12]) for a in range(0, len(words), 12)), "en" if k % 3 else None))
        if k % 13:
            labels.append((k, int(style >= 0.25 or k % 50 == 0)))
    got = {x.doc_id: x for x in quality_rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def facts(t):
        n, chars, symbols, dup, repeat = brute_counts(t)
        upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
        return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": sum(bool(x.split()) for x in t.split("\n")), "n_upper": upper, "n_letters": upper + lower, "n_bangs": len(re.findall("[!?]", t))}

    def rejects(f, level):
        out = set()
        for rule, (top, below, sign, grid) in quality_rules.RULES.items():
            rate = f[top] / f[below] if f[below] else (0 if sign > 0 else math.inf)
            if sign * rate > sign * grid[level * len(grid) // quality_rules.LEVELS]:
                out.add(rule)
        return out

    all_facts, good = {i: facts(t) for i, t, _ in docs}, {i for i, q in labels if q == 1}
    strata = {i: lang for i, _, lang in docs}
    level = {}
    for s in set(strata.values()):
        mine = [i for i in good if strata[i] == s]
        best = -1
        for g in range(quality_rules.LEVELS):
            k, n, p = sum(bool(rejects(all_facts[i], g)) for i in mine), len(mine), quality_rules.ALPHA
            if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > quality_rules.DELTA / 2:
                break
            best = g
        level[s] = best
    assert max(level.values()) > 2
    for i, f in all_facts.items():
        base = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        failed = rejects(f, level[strata[i]]) if level[strata[i]] >= 0 else set()
        assert set(got[i].failed_rules) == failed and got[i].base_failed == base and got[i].kept == (not base and not failed)


# 8

def test_quality_model_against_plain_ridge(spark):
    """The same equations solved at once, features that approximate the Gaussian kernel, and scores like those of kernel ridge."""
    texts = [(k, text(60 + k % 80, k) if k % 3 else (text(50, k).upper() if k % 2 else "buy now! " * 30 + text(15, k))) for k in range(360)]
    y = {k: int(k % 3 > 0) for k, _ in texts}
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    stats = quality_rules.text_counts(docs, keep=("doc_id",)).cache()
    model = quality_model.fit(stats, labels)
    rows = sorted((tuple(r) for r in stats.collect()), key=lambda r: r[0])
    ids, counts = [r[0] for r in rows], np.array([r[1:] for r in rows], np.int64)
    used = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in ids])
    fold = np.array([zlib.crc32(f"fold:{i}".encode()) % 4 == 0 for i in ids])
    target = np.array([y[i] for i in ids], float)
    x = quality_model.statistics(counts)
    assert np.allclose(model.mean, x[used].mean(axis=0)) and np.allclose(model.scale, np.maximum(x[used].std(axis=0), 1e-9**0.5), rtol=1e-3)
    z = model.features(counts)
    train = used & ~fold
    weight = np.full(z.shape[1], quality_model.RIDGE * train.sum() * 2 / quality_model.FEATURES)
    weight[-1] = 1e-9
    beta = np.linalg.solve(z[train].T @ z[train] + np.diag(weight + 1e-12), z[train].T @ target[train])
    assert np.allclose(z @ beta, z @ model.beta, atol=1e-5)
    s = np.clip((x - model.mean) / model.scale, -5, 5)
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * quality_model.WIDTH**2 * s.shape[1]))
    assert np.abs(z[:, :-1] @ z[:, :-1].T - kernel).mean() < 0.06
    k, bias = kernel[np.ix_(train, train)], target[train].mean()
    exact = kernel[:, train] @ np.linalg.solve(k + quality_model.RIDGE * train.sum() * 2 / quality_model.FEATURES * np.eye(train.sum()), target[train] - bias) + bias
    assert np.corrcoef(exact[~train], (z @ model.beta)[~train])[0, 1] > 0.97
    raw, score = model.raw(counts), model.score(counts)
    assert (np.diff(score[np.argsort(raw)]) >= -1e-12).all()


# 7

def test_edits_after_a_large_insertion(oracle):  # noqa: F811
    encoder = bpe.ByteBPE(BYTE_BPE)
    t, new = text(200, 1), text(3000, 2)
    data, begin, end, _, at = bpe.pretoken_spans([t])
    tree = edit_counts.CountTree(t, np.append(at, len(t)), encoder.cache.rows(data, begin, end)[1])
    first = int(edit_counts.apply_edits(encoder, [tree], [[(500, 3, new)]])[0])
    assert first > 2500 and tree.rebuilt == 1
    t = t[:500] + new + t[503:]
    for place in (510, 5000, 12_000, len(t) - 5):
        assert edit_counts.apply_edits(encoder, [tree], [[(place, 2, "x y")]])[0] < 20
        t = t[:place] + "x y" + t[place + 2 :]
        assert tree.text() == t and tree.n_tokens == len(oracle.encode_ordinary(t))


# rows of one id or of none

def test_many_rows_of_one_id_are_spread(spark):
    rows = [(None, text(20, k)) for k in range(300)] + [(7, text(20, 1000 + k)) for k in range(300)] + [(k, text(20, 5000 + k)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = fresh_path(spark, "hot_tokens")
    tokenfile.write_token_file(docs, path, WORD_BPE)
    files = tokenfile.read_token_file(spark, path)
    assert max(r.n for r in files.groupBy("part").agg(F.count("*").alias("n")).collect()) < 350
    index = sorted((x.start, x.doc_id, x.n_tokens) for x in tokenfile.token_index(spark, path).collect())
    assert [x[1] for x in index if x[1] is None] == [None] * 300 and [x[1] for x in index[300:]] == sorted(x[1] for x in index[300:])
    assert all(a[0] + a[2] == b[0] for a, b in zip(index, index[1:]))
    order = sorted(((i, t) for i, t in rows if i is not None), key=lambda x: (-x[0], x[1])) + sorted(((None, t) for i, t in rows if i is None), key=lambda x: x[1])
    want = []
    for k, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((str(i), len(t), sha((t[: len(t) - half] + after[:half]).encode())))
    for n in ("4", "13"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = fingerprint.compare_with_next(docs)
        got = sorted((str(x.doc_id), x.n_chars, x.edited_sha256) for x in out.collect())
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == sorted(want)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    t = text(120, 77)
    rows = [(1, t, "en", "a", 1, "x"), (1, t, "en", "a", 1, "x"), (None, text(90, 5), None, None, None, None), (None, None, None, "b", 0, "y"), (4, "", "fr", "b", 0, "z"), (5, text(30_000, 6), "en", "a", 9, "w"), *[(10 + k, text(100, 300 + k), "en", "c", 5, "v") for k in range(8)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"
    spark.createDataFrame([(10, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data, least in ((rows, 10), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns, name
            docs = spark.createDataFrame(after.collect(), docs.schema)
        kept = docs.collect()
        assert len({(x.doc_id, x.text) for x in kept}) >= least and all(x.n_chars == len(x.text) for x in kept)
        encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(x.decoded_sha256 for x in encoded) == sorted(hashlib.sha256(x.text.encode()).hexdigest() for x in kept)


@pytest.mark.parametrize("bad", ["bert", "joins"])
def test_word_encoder_refuses_other_tokenisers(tmp_path, bad):
    from tokenizers import Tokenizer as T
    from tokenizers import models, pre_tokenizers, processors

    t = T(models.WordLevel({"[UNK]": 0, "a b": 1}, unk_token="[UNK]"))
    if bad == "bert":
        t.pre_tokenizer = pre_tokenizers.Split("zzz", "removed")
    else:
        t.pre_tokenizer = pre_tokenizers.Split(".", "merged_with_next")
        t.post_processor = processors.TemplateProcessing(single="$A", pair="$A $B", special_tokens=[])
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        tokenfile.WordEncoder(str(tmp_path / "t.json"))
