"""The pipeline's stages one after the other, on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docflow.llm import ngram_join
from docflow.llm.shared import saved

from .test_operators import hot_pairs

r = random.Random(5)
WORDS = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(3000)]


def text(n, seed):
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = text(200, 1)
    near = " ".join("swapped" if i in (30, 90) else w for i, w in enumerate(base.split()))
    passage = text(80, 2)
    texts = [base, base, near, text(100, 3) + " " + passage, text(90, 4) + " " + passage, "too short", None, *[text(120, 50 + k) for k in range(20)]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), "test_stage")
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept, unique, cut, mixed, encoded = seen
    assert {x.doc_id for x in kept.collect()} == {0, 1, 2, 3, 4, *range(7, 27)}
    assert {x.doc_id for x in unique.collect()} == {0, 3, 4, *range(7, 27)}
    texts = {x.doc_id: x for x in cut.collect()}
    assert len(texts[4].text) < len(text(90, 4)) + 120 and all(x.n_chars == len(x.text) for x in texts.values()) and texts[3].text.endswith(text(80, 2))
    assert mixed.count() > cut.count() and encoded.count() == mixed.count()
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in again.collect()) == sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in encoded.collect())


def test_one_of_each_pair_that_shares_a_single_hot_bucket(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(hot_pairs())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect())) == [rows[0], *rows[60::2]]


def test_a_stage_begins_without_the_heap_of_those_before(spark, sf_dir):
    heap = spark._jvm.java.lang.Runtime.getRuntime().totalMemory
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[4]:  # they run no job before their result is asked for
        spark.range(1).select(F.length(F.repeat(F.lit("x"), (F.col("id") + (3 << 29)).cast("int")))).collect()
        before = heap()
        stage(spark, docs, sf_dir)
        assert heap() < before - (1 << 28)
