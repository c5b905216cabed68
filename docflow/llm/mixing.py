"""Mixing sources to target weights by Pareto order sampling (operator 4).

A source's target is its share, by weight, of a budget of words, at most max_copies times its size; what is above goes
to the others by weight. f = target / size of a source; each of its documents is taken floor(f) times for certain. The rest,
f - floor(f) = p on average over the source's words, is shared out with unequal inclusion probabilities that rise with length,
so that fragments are taken less often than whole documents: p_i = p + p (1 - p) (g_i - G), g_i = size / (size + HALF) in
thousandths, G its mean over the source's words. Then sum(p_i size_i) = p sum(size_i), and p_i is between p**2 and p (2 - p).
Documents are ranked by Q = odds(u) / odds(p_i), u a hash of id and text, and taken in ascending order of Q as long as the words
fit what is missing, then the longest that fits the gap; and so on with those that fit what is left, until none does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

WORDS = r"[^\x20\x09-\x0D]+"
BINS, HALF = 4096, 200


def source_targets(sizes: DataFrame, *, ratio: float, max_copies: int, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target and g_words (kept as it is) of every source. sizes: source, source_size, g_words. The
    windows run over one row a source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    budget = ratio * F.sum("source_size").over(everything)
    # water-filling: were this source and all of lower size per weight at their limit, the level of the others
    level = (budget - F.coalesce(F.sum(F.col("source_size") * max_copies).over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    return numbered.withColumn("level", level).withColumn("target", F.least((F.col("source_size") * max_copies).cast("double"), F.col("w") * F.max("level").over(everything))).select("source", "source_size", "target", "g_words")


def _one_round(left: DataFrame) -> DataFrame:
    """Documents (source, bin, n, size, gap) that fit their source's gap one by one -> the same, with took and the gap left."""
    in_bin = Window.partitionBy("source", "bin").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    below = left.groupBy(F.col("source").alias("s2"), F.col("bin").alias("b2")).agg(F.sum("size").alias("words"))
    below = below.withColumn("below", F.sum("words").over(Window.partitionBy("s2").orderBy("b2")) - F.col("words")).drop("words")
    summed = left.withColumn("so_far", F.sum("size").over(in_bin))
    summed = summed.join(below.hint("merge"), summed["source"].eqNullSafe(below["s2"]) & (summed["bin"] == below["b2"]))
    ranked = saved(summed.select("source", "bin", "n", "size", "gap", (F.col("below") + F.col("so_far") <= F.col("gap")).alias("took")), "mix_pass")
    gaps = saved(ranked.groupBy(F.col("source").alias("s3")).agg((F.first("gap") - F.coalesce(F.sum(F.when(F.col("took"), F.col("size"))), F.lit(0))).alias("rest")), "mix_gaps")
    fits = ranked.where("not took").join(gaps, F.col("source").eqNullSafe(F.col("s3"))).where("size <= rest")
    last = fits.groupBy(F.col("source").alias("s4")).agg(F.max(F.struct("size", (-F.col("bin")).alias("b"), (-F.col("n")).alias("k"))).alias("x"))
    last = saved(gaps.join(last, F.col("s3").eqNullSafe(F.col("s4")), "left").select("s3", (F.col("rest") - F.coalesce("x.size", F.lit(0))).alias("rest"), (-F.col("x.b")).alias("b"), (-F.col("x.k")).alias("k")), "mix_last")
    extra = F.coalesce((F.col("bin") == F.col("b")) & (F.col("n") == F.col("k")), F.lit(False))
    return ranked.join(last, F.col("source").eqNullSafe(F.col("s3"))).select("source", "bin", "n", "size", F.col("rest").alias("gap"), (F.col("took") | extra).alias("took"))


def mix_documents(
    docs: DataFrame, *, ratio: float = 1.5, max_copies: int = 2, weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, expected (copies, before sampling).

    Sources in the order of their code points, null last, have the weights in turn. A null text has size 0 and isn't
    taken. The random number is a hash of id and text, so rows of one id or of none differ unless their texts are equal, too;
    equal rows count one by one. The result doesn't depend on the order of rows. No row is taken more than
    max_copies times; a source's words come up to its target, short of it by less than any document not taken. Other
    columns are dropped, whatever their names. An empty table gives an empty table.

    Texts are read once; all that is shuffled are ids and sizes. A source is never in one task: ranks are summed in
    BINS bins a source, and only within a bin are rows put in order. A round passes over the documents that still fit. After
    a document is taken for its length none longer is left, so the next round ends with a gap below that length: the
    number of rounds grows with the logarithm of the gap; most tables need one or two.
    """
    text_md5 = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("m"))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), text_md5.alias("m"))
    rows = saved(rows.select(F.col(id_col).alias("doc_id"), "source", "size", draw.alias("u")), "mix_sizes")
    g = F.floor(1000 * F.col("size") / (F.col("size") + HALF))  # thousandths: sums of them are exact
    sizes = saved(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * g).alias("g_words")), ratio=ratio, max_copies=max_copies, weights=weights), "mix_targets")
    known = sizes.select(
        F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(0).alias("whole"), F.when(F.col("source_size") > 0, F.col("g_words") / F.col("source_size")).otherwise(0.0).alias("g_mean")
    ).withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0))
    ranked = rows.join(known, rows["source"].eqNullSafe(known["s"])).withColumn("p", F.col("p") + F.col("p") * (1 - F.col("p")) * ((g - F.col("g_mean")) / 1000))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.withColumn("q", F.when((F.col("p") > 0) & (F.col("p") < 1), odds).otherwise(F.col("u") / (1 - F.col("u"))))
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS)).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    in_bin = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size")
    ranked = saved(ranked.withColumn("n", F.row_number().over(in_bin)).select("doc_id", "source", "size", "source_size", "target", "whole", "missing", "p", "bin", "n"), "mix_ranked")
    left = ranked.where((F.col("size") > 0) & (F.col("whole") < max_copies) & (F.col("size") <= F.col("missing"))).select("source", "bin", "n", "size", F.col("missing").alias("gap"))
    rounds = []
    while not rounds or not left.isEmpty():
        taken = saved(_one_round(left), "mix_round")
        rounds.append(taken.where("took").select(F.col("source").alias("s2"), F.col("bin").alias("b2"), F.col("n").alias("n2"), F.lit(1).alias("more")))
        left = taken.where("not took and size <= gap").drop("took")
    more = reduce(DataFrame.union, rounds)
    out = ranked.join(more.hint("merge"), ranked["source"].eqNullSafe(more["s2"]) & (ranked["bin"] == more["b2"]) & (ranked["n"] == more["n2"]), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("more", F.lit(0))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), (F.col("whole") + F.when(F.col("whole") < max_copies, F.col("p")).otherwise(0.0)).alias("expected"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs with all their columns, each as often as mix_documents takes it. Rows with equal id, source and size
    share their copies out among them. Texts are shuffled once, to meet the number of copies by id."""
    names = docs.columns
    copies = mix_documents(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # rows of one id, source and size can't be told apart here: the n-th of them in docs gets the n-th number of copies
    alike = ["doc_id", "source", "size"]
    count = copies.groupBy(*alike).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies")).where("copies[0] > 0")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("a"), F.col(source_col).alias("b"), size.alias("c"))
    met = rows.join(count.hint("merge"), F.col("a").eqNullSafe(F.col("doc_id")) & F.col("b").eqNullSafe(F.col("source")) & (F.col("c") == F.col("size")))
    # almost all have one row each; where there are more, they are numbered
    one = met.where(F.size("copies") == 1).select("row", F.col("copies")[0].alias("n"))
    numbered = Window.partitionBy("a", "b", "c").orderBy(F.xxhash64("row"))
    more = met.where(F.size("copies") > 1).withColumn("k", F.row_number().over(numbered)).select("row", F.get("copies", F.col("k") - 1).alias("n"))
    return one.union(more).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*[F.col("row").getField(c).alias(c) for c in names])
