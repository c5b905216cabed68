"""Evaluation: coverage, error rates, order, groups, warnings, links, rendered pages, performance."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..functions.edit_distance import characters, edit_distance
from .tables import multiset_match, with_scores


def token_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """How often each token occurs in each text: id, token, n."""
    return texts.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def text_coverage(pairs: DataFrame) -> DataFrame:
    """pairs (id, expected, actual; of one id counted together): n_expected, n_actual, n_matched tokens as multisets and coverage (1 without
    expected ones)."""
    none = F.array().cast("array<string>")
    each = pairs.select("id", F.coalesce(T.tokens("expected"), none).alias("e"), F.coalesce(T.tokens("actual"), none).alias("a"))
    # a pair is counted in its row, where it is; only where an id has several are their tokens brought together. To look for those takes the ids alone
    if not pairs.groupBy("id").count().where("count > 1").isEmpty():
        each = each.groupBy("id").agg(F.flatten(F.collect_list("e")).alias("e"), F.flatten(F.collect_list("a")).alias("a"))

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = []
                for e, a in zip(batch.column(1), batch.column(2)):
                    e, a = e.as_py(), a.as_py()
                    n = Counter(e)
                    rows.append((len(e), len(a), sum(min(k, n[t]) for t, k in Counter(a).items() if t in n)))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_expected", "n_actual", "n_matched"])

    out = each.mapInArrow(run, StructType([pairs.schema["id"], *(StructField(c, LongType()) for c in ("n_expected", "n_actual", "n_matched"))]))
    return out.select("id", "n_expected", "n_actual", "n_matched", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_matched") / F.col("n_expected")).alias("coverage"))


def _error_rates(pairs: DataFrame, pieces) -> DataFrame:
    """id, distance and rate of pairs (id, a, b). pieces: of the Arrow columns a and b, yields rows' number and their two sequences."""

    def run(it):
        for batch in it:
            distance, rate = [None] * batch.num_rows, [None] * batch.num_rows
            for k, a, b in pieces(batch.column(1), batch.column(2)):
                distance[k] = edit_distance(a, b)
                rate[k] = distance[k] / max(len(a), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance, pa.int32()), pa.array(rate, pa.float64())], names=["id", "distance", "rate"])

    return pairs.mapInArrow(run, StructType([pairs.schema["id"], StructField("distance", IntegerType()), StructField("rate", DoubleType())]))


def character_error_rate(pairs: DataFrame) -> DataFrame:
    """id, distance and rate (distance by the length of expected, 1 at least), over the whole texts."""

    def pieces(a, b):
        for k, (x, y) in enumerate(zip(a, b)):
            if x.is_valid and y.is_valid:
                yield k, characters(x.as_py()), characters(y.as_py())

    return _error_rates(pairs.select("id", "expected", "actual"), pieces)


def unicode_accuracy(pairs: DataFrame) -> DataFrame:
    """id, distance and accuracy (1 - distance / length, 0 at least) over the characters beyond ASCII of pairs (id, expected, actual), composed
    (NFC) and without Markdown markup. Without such characters in expected: 1 less any in actual."""

    def pieces(a, b):
        one = lambda x: characters("".join(c for c in x if ord(c) > 127))
        for k, (x, y) in enumerate(zip(pc.utf8_normalize(a, "NFC"), pc.utf8_normalize(b, "NFC"))):
            if x.is_valid and y.is_valid:
                yield k, one(x.as_py()), one(y.as_py())

    rates = _error_rates(pairs.select("id", T.comparable_text("expected").alias("expected"), T.comparable_text("actual").alias("actual")), pieces)
    return rates.select("id", "distance", (1 - F.least("rate", F.lit(1.0))).alias("accuracy"))


def token_error_rate(pairs: DataFrame) -> DataFrame:
    """id, distance and rate over tokens: each distinct token becomes a number, however many there are."""

    def pieces(a, b):
        codes = pc.dictionary_encode(pa.concat_arrays([a.flatten(), b.flatten()])).indices.to_numpy()
        ends = [np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy()).tolist() for x in (a, b)]
        i, j = 0, len(codes) - (ends[1][-1] if ends[1] else 0)
        base = j
        for k, (x, y) in enumerate(zip(*ends)):
            if a[k].is_valid and b[k].is_valid:
                yield k, codes[i:x], codes[j : base + y]
            i, j = x, base + y

    return _error_rates(pairs.select("id", T.tokens("expected").alias("a"), T.tokens("actual").alias("b")), pieces)


def group_f1(expected: DataFrame, actual: DataFrame, by: str, item: str) -> DataFrame:
    """Multiset precision, recall and f1 of items (paragraphs, say) per value of by."""
    count = lambda d: d.groupBy(by, item).agg(F.count(F.lit(1)).alias("n"))
    return multiset_match(count(expected), count(actual), [by], [item])


def missing_items(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows without a partner, as a multiset."""
    return expected.exceptAll(actual)


def phrase_scores(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """For texts (id, text) and phrases (id, phrase, keep): how many phrases that should go are gone (n_matched of n_expected) and
    how many of those gone should be: precision and recall of removal."""
    met = phrases.join(texts, "id").withColumn("gone", T.occurrences(F.col("text"), F.col("phrase")) == 0)
    sums = met.groupBy("id").agg(F.count(F.when(~F.col("keep"), 1)).alias("n_expected"), F.count(F.when(F.col("gone"), 1)).alias("n_actual"), F.count(F.when(F.col("gone") & ~F.col("keep"), 1)).alias("n_matched"))
    return with_scores(sums)


def code_set_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Sets of codes per id (id, codes): missing, extra, precision, recall, f1."""
    none = F.expr("cast(array() as array<string>)")
    both = expected.select("id", F.array_distinct("codes").alias("e")).join(actual.select("id", F.array_distinct("codes").alias("a")), "id", "full_outer").select("id", F.coalesce("e", none).alias("e"), F.coalesce("a", none).alias("a"))
    sums = both.select("id", F.size("e").cast("long").alias("n_expected"), F.size("a").cast("long").alias("n_actual"), F.size(F.array_intersect("e", "a")).cast("long").alias("n_matched"), F.array_join(F.array_sort(F.array_except("e", "a")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("a", "e")), ",").alias("extra"))
    return with_scores(sums)


def micro_average(scores: DataFrame) -> DataFrame:
    """One row for all: sums of the counts, and the scores of the sums."""
    return with_scores(scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_expected", "n_actual", "n_matched")]))


ASSET_RULES = (
    ("empty", "^$"), ("absolute", r"^/"), ("backslash", r"\\"), ("scheme", r"^[A-Za-z][A-Za-z0-9+.-]*:"), ("parent", r"(^|/)\.\.(/|$)"), ("control", r"[\x00-\x1F]"), ("outside", r"^(?!assets/)"),
)


def asset_path_failures(path):
    """Names of the rules that a path of an asset breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(path, F.lit("")).rlike(p), F.lit(n)) for n, p in ASSET_RULES]))


def markdown_asset_links(x):
    """Targets of links and images in Markdown that point into assets/."""
    targets = F.regexp_extract_all(x, F.lit(r"\]\(<?([^)>\s]+)>?(?:\s+\"[^\"]*\")?\)"), F.lit(1))
    return F.filter(F.transform(targets, lambda t: F.regexp_replace(t, r"^\./|[#?].*$", "")), lambda t: t.startswith("assets/"))


def broken_links(links: DataFrame, assets: DataFrame) -> DataFrame:
    """Links (doc_id, path) without an asset of that path."""
    return links.join(assets.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")


def duplicates(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def markdown_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of Markdown texts (id, text): id, path (position), type, depth, content."""
    parts = F.filter(F.split("text", r"\n{2,}"), lambda b: F.trim(b) != "")
    each = texts.select("id", F.posexplode(parts).alias("path", "raw"))
    raw = F.col("raw")
    kind = (
        F.when(raw.rlike(r"^#{1,6}\s"), "heading").when(raw.rlike(r"^(```|~~~)"), "code").when(raw.rlike(r"^\$\$"), "math").when(raw.rlike(r"^\|.*\|"), "table").when(raw.rlike(r"^<table"), "html-table")
        .when(raw.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").when(raw.rlike(r"^!\["), "image").when(raw.rlike(r"^<a id="), "anchor").otherwise("paragraph")
    )
    depth = F.when(raw.rlike(r"^#{1,6}\s"), F.length(F.regexp_extract(raw, r"^(#{1,6})\s", 1)))
    return each.select("id", "path", kind.alias("type"), depth.cast("int").alias("depth"), T.collapse(F.regexp_replace(raw, r"^#{1,6}\s+", "")).alias("content"))


def ast_differences(expected: DataFrame, actual: DataFrame, limit: int = 20) -> DataFrame:
    """Where the blocks of two Markdown texts differ: id, n_differences and the first ones (path:what)."""
    e = expected.select("id", "path", F.struct("type", "depth", "content").alias("e"))
    a = actual.select("id", "path", F.struct("type", "depth", "content").alias("a"))
    what = F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing").when(F.col("e.type") != F.col("a.type"), "type").when(~F.col("e.depth").eqNullSafe(F.col("a.depth")), "depth").when(F.col("e.content") != F.col("a.content"), "content")
    both = e.join(a, ["id", "path"], "full_outer").withColumn("what", what)
    list_ = F.slice(F.array_sort(F.collect_list(F.when(F.col("what").isNotNull(), F.struct("path", "what")))), 1, limit)
    return both.groupBy("id").agg(F.count("what").alias("n_differences"), F.array_join(F.transform(list_, lambda s: F.concat(s["path"].cast("string"), F.lit(":"), s["what"])), ",").alias("differences"))


def rendered_html_stats(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Counts of a rendered page: headings, paragraphs, list items, links, tables, text_chars, longest_paragraph."""
    h = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " "))
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    paragraphs = F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    sizes = F.transform(paragraphs, lambda p: F.length(F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " "))))
    return pages.select(
        F.col(id_col), count(r"(?i)<h[1-6]\b").alias("headings"), count(r"(?i)<p\b").alias("paragraphs"), count(r"(?i)<li\b").alias("list_items"), count(r"(?i)<a\b").alias("links"), count(r"(?i)<table\b").alias("tables"),
        F.length(text).cast("long").alias("text_chars"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("longest_paragraph"),
    )


def throughput_profile(samples: DataFrame, by: list[str], *, ms: str, items: str) -> DataFrame:
    """Per group: n, min, max, mean and median of the durations, their sum, the items and items a second (6 decimals)."""
    r = lambda c: T.round_half_up(c, 6)
    out = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), r(F.min(ms)).alias("min_ms"), r(F.max(ms)).alias("max_ms"), r(F.avg(ms)).alias("mean_ms"), r(F.median(ms)).alias("median_ms"), r(F.sum(ms)).alias("total_ms"), F.sum(items).cast("double").alias("items")
    )
    return out.withColumn("items_per_second", F.when(F.col("total_ms") > 0, T.round_half_up(F.col("items") * 1000 / F.col("total_ms"), 3)).otherwise(0.0))


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each baseline row (id, metric, value) against the current one: threshold, passed. Throughput: at least .8 of the
    baseline and 10; startup: at most 8 times it and 250 ms; memory: at most twice it and 256 MiB. Without a current value: failed."""
    c = current.select("id", "metric", F.col("value").alias("current"))
    m = F.col("metric")
    limit = F.when(m == "throughput", F.greatest(0.8 * F.col("value"), F.lit(10.0))).when(m == "startup", F.least(8 * F.col("value"), F.lit(250.0))).when(m == "memory", F.least(2 * F.col("value"), F.lit(268435456.0)))
    passed = F.when(m == "throughput", F.col("current") >= F.col("threshold")).otherwise(F.col("current") <= F.col("threshold"))
    return baseline.join(c, ["id", "metric"], "left").withColumn("threshold", limit).withColumn("passed", F.coalesce(passed, F.lit(False))).select("id", "metric", F.col("value").alias("baseline"), "current", "threshold", "passed")


def provider_comparison(samples: DataFrame) -> DataFrame:
    """samples (id, provider, rate) paired by id: cpu, gpu and speedup (null without both)."""
    wide = samples.groupBy("id").pivot("provider", ["cpu", "gpu"]).agg(F.max("rate"))
    return wide.withColumn("speedup", F.when((F.col("cpu") > 0) & F.col("gpu").isNotNull(), T.round_half_up(F.col("gpu") / F.col("cpu"), 6)))


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
