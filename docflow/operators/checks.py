"""More checks of results: hyphenation, memory, rendered pages, HTML and public tables, snippets on pages, traces."""

from __future__ import annotations

import html.parser
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import adjacency_pairs, multiset_match


def hyphenation_accuracy(texts: DataFrame) -> DataFrame:
    """texts (id, markdown, repaired, rejected: arrays of terms): id, n_matched, missing and present terms, accuracy (the share of repaired
    terms that occur; without any: 1 if no rejected one does) and passed."""
    m = T.comparable_text("markdown")
    has = lambda t: m.contains(T.comparable_text(t))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    out = texts.select("id", some("repaired").alias("want"), F.filter(some("repaired"), has).alias("got"), F.filter(some("rejected"), has).alias("present"))
    accuracy = F.when(F.size("want") == 0, F.when(F.size("present") == 0, 1.0).otherwise(0.0)).otherwise(F.size("got") / F.size("want"))
    return out.select("id", F.size("got").alias("n_matched"), F.array_except("want", "got").alias("missing"), "present", accuracy.alias("accuracy"), ((accuracy == 1) & (F.size("present") == 0)).alias("passed"))


def memory_profile(samples: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group of samples (order, rss, heap, pages): the first sample's rss, the growth to the last and to the peak of rss and heap, and the
    peak's growth a page."""
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    out = samples.groupBy(*by).agg(first("rss").alias("base"), (last("rss") - first("rss")).alias("rss_delta"), (F.max("rss") - first("rss")).alias("rss_peak_delta"), (last("heap") - first("heap")).alias("heap_delta"), (F.max("heap") - first("heap")).alias("heap_peak_delta"), F.sum("pages").alias("pages"))
    return out.withColumn("peak_delta_per_page", F.when(F.col("pages") > 0, T.round_half_up(F.col("rss_peak_delta") / F.col("pages"), 3)))


def rendered_gate(stats: DataFrame, *, id_col: str = "page_id", min_text: int | None = None, min_headings: int | None = None, min_paragraphs: int | None = None, max_paragraph: int | None = None) -> DataFrame:
    """What rendered_html_stats gives against bounds: the id, failures (names of the counts beyond them) and passed."""
    bounds = [("text_chars", min_text, False), ("headings", min_headings, False), ("paragraphs", min_paragraphs, False), ("longest_paragraph", max_paragraph, True)]
    failed = [F.when((F.col(c) > b) if most else (F.col(c) < b), F.lit(c)) for c, b, most in bounds if b is not None]
    out = stats.select(id_col, F.array_compact(F.array(*failed)).alias("failures") if failed else F.array().cast("array<string>").alias("failures"))
    return out.withColumn("passed", F.size("failures") == 0)


class _Tables(html.parser.HTMLParser):
    """Cells of HTML tables on an occupancy grid."""

    def __init__(self):
        super().__init__()
        self.cells: list[tuple] = []
        self.table, self.row, self.column, self.open = -1, -1, 0, None
        self.taken: set[tuple[int, int]] = set()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row, self.taken = self.table + 1, -1, set()
        elif tag == "tr":
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th") and self.table >= 0 and self.row >= 0:
            self._close()
            a = dict(attrs)
            span = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
            while (self.row, self.column) in self.taken:
                self.column += 1
            h, w = span("rowspan"), span("colspan")
            self.taken |= {(self.row + i, self.column + j) for i in range(min(h, 1000)) for j in range(min(w, 1000))}
            self.open = [self.table, self.row, self.column, h, w, ""]
            self.column += w

    def handle_data(self, data):
        if self.open:
            self.open[5] += data

    def _close(self):
        if self.open:
            t = self.open
            self.cells.append((t[0], t[1], t[2], t[3], t[4], " ".join(t[5].split())))
            self.open = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()


def html_table_cells(pages: DataFrame, *, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """The id, table_no, row_index, column_index, row_span, column_span and text of every cell of HTML tables, columns counted on the occupancy
    grid."""
    names = ("table_no", "row_index", "column_index", "row_span", "column_span")

    def run(it):
        for batch in it:
            ids, rows = [], []
            for k, doc in enumerate(batch.column(1).to_pylist()):
                p = _Tables()
                p.feed(doc or "")
                p.close()
                ids += [k] * len(p.cells)
                rows += p.cells
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, pa.int32()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=[id_col, *names, "text"])

    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} int" for n in names) + ", text string")


def html_table_diff(expected: DataFrame, actual: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Cells in which two relations of html_table_cells differ: the id, place, what (missing, extra, text, span) and both texts."""
    at = [id_col, "table_no", "row_index", "column_index"]
    cell = lambda d, n: d.select(*at, F.struct("text", "row_span", "column_span").alias(n))
    both = cell(expected, "e").join(cell(actual, "a"), at, "full_outer")
    span = (F.col("e.row_span") != F.col("a.row_span")) | (F.col("e.column_span") != F.col("a.column_span"))
    what = F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing").when(span, "span").when(F.col("e.text") != F.col("a.text"), "text")
    return both.withColumn("what", what).where("what is not null").select(*at, "what", F.col("e.text").alias("expected"), F.col("a.text").alias("actual"))


def public_table_oracle(expected: DataFrame, actual: DataFrame, *, min_adjacency: float = 0.9, min_spans: float = 0.9) -> DataFrame:
    """Per expected table (cells with spans): f1 of adjacent pairs and of placed cells, the bounds that are missed, and passed. A table without
    actual cells is missing."""
    from .summaries import span_accuracy

    pairs = multiset_match(adjacency_pairs(expected), adjacency_pairs(actual), ["table_id"], ["way", "a", "b"]).select("table_id", F.col("f1").alias("adjacency"))
    spans = span_accuracy(expected, actual).select("table_id", F.col("f1").alias("spans"))
    out = expected.select("table_id").distinct().join(pairs, "table_id", "left").join(spans, "table_id", "left").join(actual.select("table_id").distinct().withColumn("found", F.lit(True)), "table_id", "left").fillna(0.0, ["adjacency", "spans"])
    errors = F.array_compact(F.array(F.when(F.col("found").isNull(), "missing"), F.when(F.col("adjacency") + 1e-12 < min_adjacency, "adjacency"), F.when(F.col("spans") + 1e-12 < min_spans, "spans")))
    return out.select("table_id", "adjacency", "spans", errors.alias("errors"), (F.size(errors) == 0).alias("passed"))


def snippets_on_pages(results: DataFrame, snippets: DataFrame) -> DataFrame:
    """results (id, markdown, regions with md_start, md_end, page_index) and snippets (id, snippet, page_index): whether some occurrence of each
    snippet meets a range of the source map that has a region on the page."""
    parts = F.split("markdown", F.concat(F.lit("\\Q"), F.col("snippet"), F.lit("\\E")), -1)
    n = F.length("snippet")
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + n).cast("int").alias("at"), F.concat(acc["starts"], F.array((acc["at"] + F.length(p)).cast("int"))).alias("starts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["starts"]
    meets = F.exists(starts, lambda s: F.exists("regions", lambda r: (r["page_index"] == F.col("page_index")) & (s < r["md_end"]) & (r["md_start"] < s + n)))
    return snippets.join(results, "id", "left").select("id", "snippet", "page_index", F.coalesce((n > 0) & meets, F.lit(False)).alias("found"))


def _clean(value, depth: int = 0):
    if isinstance(value, str):
        return value[:4000] + "...<truncated>" if len(value) > 4000 else value
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if depth >= 8:
        return "[MaxDepth]"
    if isinstance(value, list):
        return [_clean(x, depth + 1) for x in value[:200]] + [f"...{len(value) - 200} more items"] * (len(value) > 200)
    secret = lambda k: k not in ("passwordprovided", "passwordsource") and any(w in k for w in ("password", "passphrase", "secret"))
    out = {k: "[redacted]" if secret(k.lower()) else _clean(v, depth + 1) for k, v in list(value.items())[:200]}
    return out | ({"__omittedKeys": len(value) - 200} if len(value) > 200 else {})


def sanitized_trace(events: DataFrame, *, json_col: str = "json") -> DataFrame:
    """events with their JSON made fit for a log: secrets redacted by key, long texts, lists and objects cut, depth bounded, keys in order. What
    isn't JSON becomes null."""

    def one(raw):
        try:
            return None if raw is None else json.dumps(_clean(json.loads(raw)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    def run(it):
        at = None
        for batch in it:
            at = batch.schema.get_field_index(json_col) if at is None else at
            yield batch.set_column(at, json_col, pa.array([one(x) for x in batch.column(at).to_pylist()], pa.string()))

    return events.withColumn(json_col, F.col(json_col).cast("string")).mapInArrow(run, events.withColumn(json_col, F.col(json_col).cast("string")).schema)
