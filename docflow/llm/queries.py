"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_dedup, edit_counts, fingerprint, mixing, ngram_join, quality_model, quality_rules, sharding, tokenfile
from .shared import fresh_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "_dedup.n_chars", "_dedup.removed_chars", F.size("_dedup.spans").alias("n_spans"), "text", "_dedup.spans", "_dedup.first_ids")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "group_id")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: words put in after a quarter, 30 characters deleted in the middle, and 10 at three
    quarters replaced by the text's first 10."""
    n = F.length("text")
    edit = lambda start, gone, new: F.struct(start.cast("long").alias("start"), F.lit(gone).cast("long").alias("n_deleted"), new.alias("inserted"))
    edits = F.array(edit(F.floor(n / 4), 0, F.lit(" put in, it's 42")), edit(F.floor(n / 2), 30, F.lit("")), edit(F.floor(3 * n / 4), 10, F.substring("text", 1, 10)))
    return edit_counts.count_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")), BYTE_BPE)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "op9_token_file")
    tokenfile.write_token_file(_table(spark, sf_dir, "documents"), path, WORD_BPE)
    return tokenfile.token_index(spark, path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)
    return sharding.place(placed, SHARDS[:-1], shard_col="shard_after_loss")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_edit_counts": op7_edit_counts,
    "op8_quality_model": op8_quality_model,
    "op9_token_file": op9_token_file,
    "op10_sharding": op10_sharding,
}

_OP4_SQL = """
WITH rows AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * (1000 * size // (size + 200))) AS BIGINT) AS g_words FROM rows GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS w FROM sources),
levels AS (
    SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER b, 0) AS DOUBLE))
        / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
    FROM weighed WINDOW b AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, g_words, least(CAST(2 * source_size AS DOUBLE), w * max(level) OVER ()) AS target FROM levels),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS whole FROM targets),
odds AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS p0, CASE WHEN source_size > 0 THEN g_words / source_size ELSE 0 END AS g_mean, target - whole * source_size AS missing FROM shares),
tilted AS (
    SELECT r.*, o.* EXCLUDE (source), p0 + p0 * (1 - p0) * (((1000 * size // (size + 200)) - g_mean) / 1000) AS p
    FROM rows r JOIN odds o ON r.source IS NOT DISTINCT FROM o.source),
ranked AS (
    SELECT doc_id, source, size, source_size, target, whole, missing, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) ELSE u / (1 - u) END AS q
    FROM tilted),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q, doc_id, size) AS n FROM ranked),
left0 AS (SELECT source, n, size, missing AS gap FROM numbered WHERE size > 0 AND whole < 2 AND size <= missing),
"""


def _round_sql(k: int) -> str:
    """A round of filling: what fits in order of rank, then the longest that fits the gap."""
    return f"""r{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY n ROWS UNBOUNDED PRECEDING) <= gap AS took FROM left{k}),
g{k} AS (SELECT source, any_value(gap) - coalesce(sum(size) FILTER (WHERE took), 0) AS rest FROM r{k} GROUP BY source),
f{k} AS (SELECT r.source, r.n, r.size FROM r{k} r JOIN g{k} g ON r.source IS NOT DISTINCT FROM g.source WHERE NOT took AND size <= rest QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY size DESC, n) = 1),
left{k + 1} AS (SELECT r.source, r.n, r.size, g.rest - coalesce(f.size, 0) AS gap FROM r{k} r JOIN g{k} g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN f{k} f ON r.source IS NOT DISTINCT FROM f.source
    WHERE NOT r.took AND r.n IS DISTINCT FROM f.n AND r.size <= g.rest - coalesce(f.size, 0)),
"""


#: Rounds of filling in the SQL; the query goes on until nothing fits, which takes fewer on the given tables.
ROUNDS = 8
_OP4_SQL += "".join(map(_round_sql, range(ROUNDS))) + f"""more AS ({" UNION ALL ".join(f"SELECT source, n FROM r{k} WHERE took UNION ALL SELECT source, n FROM f{k}" for k in range(ROUNDS))})
SELECT doc_id, size, source_size, target, CAST(c * size AS BIGINT) AS taken, source, CAST(c AS INT) AS copies
FROM (SELECT d.*, CASE WHEN size > 0 THEN whole + CASE WHEN m.n IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END AS c FROM numbered d LEFT JOIN more m ON m.n = d.n AND m.source IS NOT DISTINCT FROM d.source)
"""

ORACLE_SQL: dict[str, str] = {"op4_mixing": _OP4_SQL}
