"""Quality rules with risk-controlled thresholds (operator 3).

Each rule compares a rate of a text with a cutoff. The cutoffs of all rules get stricter together in LEVELS steps, and
a stratum (a language, say) gets the strictest level that labelled holdout rows prove safe. For the texts labelled good, whether
a level rejects them by any rule is a Bernoulli trial, and the exact binomial tail P(X <= k; n, alpha) is the p-value
of "it falsely rejects more than alpha". From the mildest level on, levels are tested in fixed order until one isn't
significant, so the levels need no correction; over the strata it is Bonferroni's, delta / strata for each, so that with
confidence 1 - delta no stratum loses more than alpha of its good texts. A stratum with too few labels to prove anything
has no cutoffs: nothing is rejected there but by the base rule.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import saved, small_batches
from .textkernel import batches, texts_of
from .textstats import COUNTS, counts

ALPHA, DELTA, LEVELS = 0.03, 0.05, 16

#: rule -> (numerator, denominator, sign, grid from mild to strict); a text is rejected if sign * rate > sign * cutoff.
#: The grids end at values in common use for web text, so that proof alone can't drive them into ordinary text.
RULES: dict[str, tuple[str, str, int, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", 1, (1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines", "n_lines", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
    "repeats": ("n_repeat_words", "n_words", 1, (0.45, 0.4, 0.35, 0.3)),
    "shouting": ("n_upper", "n_letters", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
    "exclaims": ("n_bangs", "n_words", 1, (1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "long_words": ("word_chars", "n_words", 1, (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
    "short_words": ("word_chars", "n_words", -1, (1.5, 2.0, 2.5, 2.75, 3.0)),
}


def _rate(rule: str, col=F.col):
    top, bottom, _, _ = RULES[rule]
    below = col("n_upper") + col("n_lower") if bottom == "n_letters" else col(bottom)
    return F.when(below > 0, col(top) / below).otherwise(F.lit(0.0) if RULES[rule][2] > 0 else F.lit(math.inf))


def cutoff(rule: str, level: int) -> float:
    """The rule's cutoff at a level of 0 (mild) to LEVELS - 1."""
    grid = RULES[rule][3]
    return grid[level * len(grid) // LEVELS]


def text_counts(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang"), with_text: bool = False) -> DataFrame:
    """The columns of keep, the text as __text if with_text, and the counts of every whole text. A null text has none of anything."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = StructType([*(kept.schema.fields if with_text else kept.schema.fields[:-1]), *(StructField(c, LongType()) for c in COUNTS)])

    def run(it):
        for batch in it:
            column = batch.num_columns - 1
            for i, j in batches(batch.column(column)):
                part = batch.slice(i, j - i)
                found = counts([t.encode() for t in texts_of(part.column(column))])
                n = column + with_text
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(found[:, k].copy()) for k in range(len(COUNTS)))], names=[*batch.schema.names[:n], *COUNTS])

    return kept.mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly."""
    if k >= n:
        return 1.0
    i = np.arange(0, k + 1, dtype=float)
    lg = np.vectorize(math.lgamma, otypes=[float])
    logs = math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """Index of the strictest level proved to reject at most alpha of the good texts, testing from the first on;
    -1 if none. rejected: how many of n good texts each level rejects."""
    best = -1
    for g, k in enumerate(rejected):
        if n == 0 or k > alpha * n or binomial_tail(int(k), int(n), alpha) > level:
            break
        best = g
    return best


def fit_cutoffs(stats: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum of stats (null is one): stratum, n_good, and a cutoff per rule (null: the rule is off there).

    Good texts are those with a label and no label other than 1; rows without label, or with a null one, say nothing."""
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__q"), F.max(label_col).alias("__r")).where("__q = 1 and __r = 1").select("__id")
    rejects = lambda g: functools.reduce(operator.or_, [F.lit(RULES[r][2]) * _rate(r) > RULES[r][2] * cutoff(r, g) for r in RULES])
    names = [f"rejected_{g}" for g in range(LEVELS)]
    beyond = [F.sum(rejects(g).cast("long")).alias(n) for g, n in enumerate(names)]
    seen = stats.join(good, stats[id_col] == good["__id"], "left_semi").groupBy(F.col(stratum_col).alias("stratum")).agg(F.count(F.lit(1)).alias("n_good"), *beyond)
    strata = stats.select(F.col(stratum_col).alias("stratum")).distinct()
    n_strata = strata.count()
    table = strata.alias("a").join(seen.alias("b"), F.col("a.stratum").eqNullSafe(F.col("b.stratum")), "left").select("a.stratum", F.coalesce("n_good", F.lit(0)).alias("n_good"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    kind = table.schema["stratum"].dataType.simpleString()

    def run(it):
        for pdf in it:
            at = [choose([row[n] for n in names], row["n_good"], alpha, delta / max(n_strata, 1)) for row in pdf[["n_good", *names]].to_dict("records")]
            out = pd.DataFrame({"stratum": pdf["stratum"], "n_good": pdf["n_good"]})
            for r in RULES:
                out[f"cut_{r}"] = pd.Series([None if a < 0 else cutoff(r, a) for a in at], dtype=object)
            yield out

    return table.mapInPandas(run, f"stratum {kind}, n_good long, " + ", ".join(f"cut_{r} double" for r in RULES))


def judge(stats: DataFrame, cutoffs: DataFrame, *, stratum_col: str = "lang") -> DataFrame:
    """stats with base_failed, failed_rules (the names of the rules that reject the text) and kept."""
    c = cutoffs.alias("c")
    joined = stats.alias("s").join(c, F.col(f"s.{stratum_col}").eqNullSafe(F.col("c.stratum")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(F.coalesce(RULES[r][2] * _rate(r) > RULES[r][2] * F.col(f"cut_{r}"), F.lit(False)), F.lit(r)) for r in RULES]))
    return joined.select("s.*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every row's counts, base_failed (under 50 words, or over half of them in repeated windows), failed_rules and kept.

    Texts are read once; the counts are kept in the shared folder for fitting and judging. A null text has no words, so
    it fails the base rule; a null stratum is a stratum; null and repeated ids are judged row by row. Other columns of
    docs are dropped, whatever their names. An empty table gives an empty table; without labels only the base rule
    counts."""
    stats = saved(text_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("lang"), F.col(text_col).alias("text"))), "quality_counts")
    cutoffs = saved(fit_cutoffs(stats, labels.select(F.col(id_col).alias("doc_id"), F.col("quality")), alpha=alpha, delta=delta), "quality_cutoffs")
    return judge(stats, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that apply_rules keeps, with all their columns. Rows are judged where they are read, so texts
    are not shuffled."""
    names = docs.columns
    stats = text_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("lang"), F.col(text_col).alias("text")))
    cutoffs = saved(fit_cutoffs(saved(stats, "quality_counts"), labels.select(F.col(id_col).alias("doc_id"), F.col("quality")), alpha=alpha, delta=delta), "quality_cutoffs")
    # the text travels once, beside the other columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col], F.lit(0).alias("_")).alias("row"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    judged = judge(text_counts(whole, keep=("row", "lang"), with_text=True), cutoffs).where("kept")
    return judged.select(*[(F.col("__text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names])
