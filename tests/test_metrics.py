"""Error rates against brute force and over whole documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.functions import edit_distance as E
from docflow.operators import metrics as M
from docflow.plans import table_queries as Q


def brute(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(3)
    for k in range(1500):
        letters = "ab" if k % 3 else "abcdefé😀"
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        b = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) if k % 2 else "".join(c for c in a if r.random() < 0.8)
        assert E.edit_distance(E.characters(a), E.characters(b)) == brute(a, b)
        if a:
            assert E._bit_parallel(E.characters(a), E.characters(b)) == brute(a, b)


def test_edit_distance_of_long_sequences():
    r = np.random.default_rng(5)
    a = r.integers(0, 9000, 9000)
    b = np.concatenate([[9001], np.delete(a, [40, 4000]), [9002]])
    assert E.edit_distance(a, b) == 4


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents longer than 120 characters and 60 words."""
    path = str(tmp_path_factory.mktemp("metrics"))
    texts = ["é and e " * 40, "plain words of a long text été ça 中文 " * 12, "short", "", "zzzzq ee3!4 " * 30, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, dict(enumerate(texts))


def test_character_error_rate_takes_the_whole_text(spark, tables):
    path, texts = tables
    chars = {r.id: r for r in Q.char_error_rate(spark, path).collect()}
    beyond = {r.id: r for r in Q.unicode_accuracy(spark, path).collect()}
    assert chars.keys() == beyond.keys() == texts.keys()
    for k, t in texts.items():
        if t is None:
            assert chars[k].distance is None and beyond[k].distance is None
            continue
        noisy = t.translate(str.maketrans("eé", "34")) + "!"
        assert chars[k].distance == brute(t, noisy) and chars[k].rate == brute(t, noisy) / max(len(t), 1)
        only = ["".join(c for c in x if ord(c) > 127) for x in (t, noisy)]
        assert beyond[k].distance == brute(*only) and beyond[k].accuracy == 1 - min(brute(*only) / max(len(only[0]), 1), 1.0)


def test_word_error_rate_takes_all_words(spark, tables):
    path, texts = tables
    out = {r.id: r for r in Q.word_error_rate(spark, path).collect()}
    assert out.keys() == texts.keys()
    for k, t in texts.items():
        if t is None:
            assert out[k].distance is None
            continue
        w = re.findall(r"\w+", t.lower())
        noisy = ["zzzzq" if i % 7 == 3 else x for i, x in enumerate(w)] + ["yyyyq"]
        assert out[k].distance == brute(w, noisy) and out[k].rate == brute(w, noisy) / max(len(w), 1)


def test_token_error_rate_of_many_distinct_tokens(spark):
    words = [f"w{k}" for k in range(6500)]
    moved = words[:10] + ["new"] + words[10:3000] + words[3001:] + ["x", "y"]
    rows = [(1, " ".join(words), " ".join(moved)), (2, None, "a"), (3, "a b c", "b c d"), (4, "", "")]
    out = {r.id: r for r in M.token_error_rate(spark.createDataFrame(rows, "id int, expected string, actual string").coalesce(1)).collect()}
    assert [out[k].distance for k in (1, 2, 3, 4)] == [4, None, 2, 0] and out[1].rate == 4 / 6500 and out[4].rate == 0


def test_rendered_html_stats_returns_the_longest_paragraph(spark, tmp_path):
    pages = ["<p>ab</p><P class='x'>four <b>words</b>\n in all</P>", "<p><script>var long = 1;</script>x</p>", "no paragraph", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.longest_paragraph for r in Q.rendered_html_stats(spark, str(tmp_path)).collect()} == {0: 17, 1: 1, 2: 0, 3: 0}


def test_table_confidence_and_ocr_reconcile_take_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.table_id: r.n for r in Q._cells(spark, sf).groupBy("table_id").agg(F.count_distinct("row_index").alias("n")).collect()}
    assert {r.table_id: r.n_rows for r in Q.table_confidence(spark, sf).collect()} == rows
    assert Q.ocr_reconcile(spark, sf).agg(F.sum("n_ocr")).first()[0] == Q._ocr_lines(spark, sf).count()


def test_coverage_counts_rows_of_one_id_together(spark):
    rows = [(1, "a a b", "a c"), (1, None, "A b b"), (2, "x y", "y x z"), (None, "k", None), (None, "k l", "K k k"), (3, "", "q"), (4, None, None)]
    got = {r.id: (r.n_expected, r.n_actual, r.n_matched, r.coverage) for r in M.text_coverage(spark.createDataFrame(rows, "id long, expected string, actual string")).collect()}
    assert got == {1: (3, 5, 3, 1.0), 2: (2, 3, 2, 1.0), None: (3, 3, 2, 2 / 3), 3: (0, 1, 0, 1.0), 4: (0, 0, 0, 1.0)}


def test_coverage_of_single_pairs_shuffles_no_text(spark):
    pairs = spark.range(50).selectExpr("id", "concat('a b ', id) as expected", "'b c' as actual")
    plan = M.text_coverage(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
