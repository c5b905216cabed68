"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Run
stage by stage, each result is written and reread as the next one's docs; run() does so in the shared folder.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import bpe, chunk_dedup, mixing, ngram_join, quality_rules
from docflow.llm.shared import free_heap, saved

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal and near-equal documents one stays, that with the least id."""
    return ngram_join.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document (or place) has are cut; n_chars follows the text."""
    cut = chunk_dedup.dedup_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's mix takes it: not at all, once or twice."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count and digests of every row."""
    return bpe.encode_documents(docs, BYTE_BPE, with_ids=True)


def _lean(stage):
    """The stage, begun by executors without the heap that the stages before it have left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _lean(keep_good)),
    ("n-gram Jaccard join", _lean(one_of_each_group)),
    ("substring dedup", _lean(cut_repeats)),
    ("mixing sources to target weights", _lean(mix)),
    ("byte-level BPE encoding and decoding", _lean(encode)),
]

#: The near-duplicate and passage stages compare hashes that DuckDB doesn't have, so the whole has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline_" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
