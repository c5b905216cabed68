"""Quality classifier on document statistics (operator 8).

Random Fourier features cos(x W + b) approximate a Gaussian kernel over standardised statistics of a text. The normal
equations of ridge regression are summed within partitions and then over them; their size depends on the number of
features alone. Scores of a part of the labelled rows that the fit hasn't seen calibrate the rest, isotonically, from counts in a
fixed number of bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import text_counts
from .shared import saved
from .textstats import COUNTS

FEATURES, RIDGE, WIDTH, BINS = 256, 1e-3, 0.7, 1024
_AT = {c: k for k, c in enumerate(COUNTS)}


def statistics(counts: np.ndarray) -> np.ndarray:
    """float64 [texts, statistics] of their counts; a text without words has zeros for its rates."""
    c = {k: counts[:, i].astype(float) for k, i in _AT.items()}
    words, letters, size = np.maximum(c["n_words"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1), np.maximum(c["n_bytes"], 1)
    mean = c["word_chars"] / words
    return np.stack(
        [
            np.log1p(c["n_words"]), mean, np.sqrt(np.maximum(c["sum_sq_word"] / words - (c["word_chars"] / words) ** 2, 0)), np.sqrt(c["n_symbols"] / words), c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words, c["n_upper"] / letters, np.sqrt(c["n_digits"] / size), np.sqrt(c["n_bangs"] / words), c["n_stops"] / words, c["n_marks"] / words, c["n_distinct_words"] / words,
            c["n_long_words"] / words, c["n_short_words"] / words, np.sqrt(c["n_repeat_pairs"] / words), np.log1p(c["n_lines"]), letters / size, c["n_chars"] / size,
        ],
        axis=1,
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray  # raw scores and, at each, the calibrated one
    levels: np.ndarray

    def features(self, counts: np.ndarray) -> np.ndarray:
        x = np.clip((statistics(counts) - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones((len(x), 1))], axis=1)

    def raw(self, counts: np.ndarray) -> np.ndarray:
        return self.features(counts) @ self.beta

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated, with a slight slope so that equal levels keep the order of the raw scores."""
        raw = self.raw(counts)
        return np.clip(0.998 * np.interp(raw, self.edges, self.levels) + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Least-squares nondecreasing means of bins with these weights and totals (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, t / w) for w, t, n in blocks]) if blocks else np.zeros(0)


def held_out(key):
    """Whether crc32 of the id as text is 0 modulo 5 (null: of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(len(COUNTS))], axis=1)


def fit(stats: DataFrame, labels: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE, seed: int = 8) -> QualityModel:
    """Fit on the labelled rows of stats (doc_id and counts) that aren't held out; of several labels of one id the
    least counts, and null labels don't. A fourth of the rows calibrates. Without rows, all scores are 0.5."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    rows = stats.join(known, F.col("doc_id") == F.col("id")).where(~held_out(F.col("doc_id"))).withColumn("fold", F.crc32(F.concat(F.lit("fold:"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0)
    rows = saved(rows.select("y", "fold", *COUNTS), "quality_fit")

    d = statistics(np.zeros((1, len(COUNTS)))).shape[1]

    def moments(it):
        total = np.zeros(2 * d + 1)
        for batch in it:
            x = statistics(_matrix(batch, 2))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    def summed(partial, size: int) -> np.ndarray:
        """A vector that the partitions of rows have sums of: added up by Spark, `size` numbers come to the driver."""
        out = np.zeros(size)
        for r in rows.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out

    first = summed(moments, 2 * d + 1)
    g = np.random.Generator(np.random.PCG64(seed))
    n = int(first[0])
    mean = first[1 : d + 1] / n if n else np.zeros(d)
    var = first[d + 1 :] / n - mean**2 if n else np.ones(d)
    scale = np.sqrt(np.maximum(var, 1e-9))
    model = QualityModel(mean, scale, g.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, features)), g.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not n:
        return model
    at_i, at_j = np.triu_indices(features + 1)

    def normal(it):
        a, b, count = 0.0, 0.0, 0
        for batch in it:
            use = ~batch.column(1).to_numpy(zero_copy_only=False)
            z, y = model.features(_matrix(batch, 2))[use], batch.column(0).to_numpy()[use]
            a, b, count = a + z.T @ z, b + z.T @ y, count + len(y)
        if count:
            value = np.concatenate([a[at_i, at_j], b])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["k", "v"])

    sums = summed(normal, len(at_i) + features + 1)
    a = np.zeros((features + 1, features + 1))
    a[at_i, at_j] = sums[: len(at_i)]
    a = a + a.T - np.diag(np.diag(a))
    weight = np.full(features + 1, ridge * max(a[-1, -1], 1) * 2 / features)
    weight[-1] = 1e-9
    model.beta = np.linalg.solve(a + np.diag(weight + 1e-12), sums[len(at_i) :])

    def binned(it):
        for batch in it:
            use = batch.column(1).to_numpy(zero_copy_only=False)
            raw = np.clip(model.raw(_matrix(batch, 2))[use], -0.5, 1.5)
            if len(raw):
                yield pa.RecordBatch.from_arrays([pa.array(((raw + 0.5) / 2 * (BINS - 1)).round().astype(np.int32)), pa.array(batch.column(0).to_numpy()[use].astype(np.int64))], names=["bin", "y"])

    bins = sorted(rows.mapInArrow(binned, "bin int, y long").groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("s")).collect())  # BINS rows at most
    if bins:
        k, w, t = (np.array(x, float) for x in zip(*bins))
        prior = t.sum() / w.sum()
        model.edges, model.levels = k / (BINS - 1) * 2 - 0.5, isotonic(w + 0.1, t + 0.1 * prior)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= cutoff) of every row of docs.

    Texts are read once; their counts are kept in the shared folder for the fit and the scores. Null texts count as
    empty and get the score of a text without words; null ids are held out or not as the empty text is; repeated rows stay.
    Other columns are dropped, whatever their names. An empty table gives an empty table."""
    stats = saved(text_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=("doc_id",)), "quality_statistics")
    model = fit(stats, labels.select(F.col(id_col).alias("doc_id"), "quality"))

    def run(it):
        for batch in it:
            score = model.score(_matrix(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
