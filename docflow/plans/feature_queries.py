"""Queries over ruled grids, page plans, projections and further checks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import acceptance as A
from ..operators import blocks as B
from ..operators import checks as C
from ..operators import figures as FG
from ..operators import grids as G
from ..operators import layout as L
from ..operators import ocr as O
from ..operators import raster as R
from ..operators import summaries as SU
from ..operators import tables as TB
from ..operators import warnings as W
from ..shared import fresh_path, spread_evenly
from ..sources import ocr_json
from ..sources import sinks as SK
from .table_queries import CELLS, _cells
from .text_queries import LINES, _lines

SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A grid of three columns on a page for each customer


def _grid_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rulings and lines. The first two cells of the top row are one on every third page; every fifth page's last ruling is too short."""
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer").select(F.floor(k / 30).alias("doc_id"), (k % 30).cast("int").alias("page_index"), (k % 4 + 2).cast("int").alias("n"), (k % 3 == 0).alias("merged"), (k % 5 == 0).alias("short"))
    rule = lambda o, x1, y1, x2, y2: F.struct(F.lit(o).alias("orientation"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))
    low = 700 - 20 * F.col("n")
    across = F.transform(F.sequence(F.lit(0), F.col("n")), lambda r: rule("h", F.lit(50), 700 - 20 * r, F.when(F.col("short") & (r == F.col("n")), 250).otherwise(350), 700 - 20 * r))
    down = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda v: rule("v", 50 + 100 * v, low, 50 + 100 * v, F.when(F.col("merged") & (v == 1), 680).otherwise(700)))
    rulings = c.select("doc_id", "page_index", F.explode(F.concat(across, down)).alias("r")).select("doc_id", "page_index", "r.*")
    cell = c.select("doc_id", "page_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    line = lambda extra, no, dy: cell.select("doc_id", "page_index", (F.col("r") * 10 + F.col("c") + no).alias("line_no"), F.concat(F.lit(extra), F.col("r").cast("string"), F.lit(","), F.col("c").cast("string")).alias("text"), (60.0 + 100 * F.col("c")).alias("x"), (700 - 20 * F.col("r") - dy).cast("double").alias("y"), F.lit(30.0).alias("width"), F.lit(8.0).alias("height"))
    outside = c.select("doc_id", "page_index", F.lit(9999).alias("line_no"), F.lit("below").alias("text"), F.lit(60.0).alias("x"), F.lit(100.0).alias("y"), F.lit(30.0).alias("width"), F.lit(8.0).alias("height"))
    return rulings, line("a", 0, 9).unionByName(line("b", 1000, 18)).unionByName(outside)


_GRID = """g AS (SELECT c_custkey // 30 AS doc_id, CAST(c_custkey % 30 AS INT) AS page_index, CAST(c_custkey % 4 + 2 AS INT) AS n, c_custkey % 3 = 0 AS merged, c_custkey % 5 = 0 AS short FROM customer),
gc AS (SELECT doc_id, page_index, r, c, merged, CASE WHEN merged AND r = 0 AND c = 0 THEN 2 ELSE 1 END AS span, merged AND r = 0 AND c = 1 AS covered FROM g, (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 3)) AS c) WHERE r < n)"""


def grid_shapes(spark, sf_dir):
    return G.ruled_grids(_grid_parts(spark, sf_dir)[0]).select("doc_id", "page_index", "grid_no", "n_rows", "n_columns", "complete", F.array_join("x", " ").alias("x"), F.element_at("y", 1).alias("top"), F.element_at("y", -1).alias("low"))


SQL["grid_shapes"] = f"WITH {_GRID} SELECT doc_id, page_index, 0 AS grid_no, n AS n_rows, 3 AS n_columns, NOT merged AND NOT short AS complete, '50.0 150.0 250.0 350.0' AS x, 700.0::DOUBLE AS top, 700.0::DOUBLE - 20 * n AS low FROM g"


def grid_cells(spark, sf_dir):
    return G.ruled_cells(*_grid_parts(spark, sf_dir)).drop("line_nos")


SQL["grid_cells"] = f"""WITH {_GRID} SELECT doc_id, page_index, 0 AS grid_no, CAST(r AS INT) AS row_index, CAST(c AS INT) AS column_index, 1 AS row_span, span AS column_span, covered,
    CASE WHEN covered THEN '' WHEN span = 2 THEN 'a0,0 a0,1 b0,0 b0,1' ELSE 'a' || r || ',' || c || ' b' || r || ',' || c END AS text FROM gc"""


def grid_lines(spark, sf_dir):
    """The lines that a grid's cells take."""
    return G.table_of_lines(G.ruled_cells(*_grid_parts(spark, sf_dir)))


SQL["grid_lines"] = f"WITH {_GRID} SELECT doc_id, page_index, CAST(r * 10 + c + d AS INT) AS line_no, 0 AS grid_no FROM gc, (VALUES (0), (1000)) v(d)"


def grid_summary(spark, sf_dir):
    return G.grid_summary(G.ruled_grids(_grid_parts(spark, sf_dir)[0]))


SQL["grid_summary"] = f"WITH {_GRID} SELECT doc_id, page_index, 1::BIGINT AS n_grids, CASE WHEN NOT merged AND NOT short THEN 1 ELSE 0 END::BIGINT AS n_complete, CAST(3 * n AS BIGINT) AS n_cells FROM g"


def grid_exports(spark, sf_dir):
    return G.export_choice(G.ruled_cells(*_grid_parts(spark, sf_dir)))


SQL["grid_exports"] = f"WITH {_GRID} SELECT doc_id, page_index, 0 AS grid_no, TRUE AS exported, CASE WHEN merged THEN 'html' ELSE 'gfm' END AS form, CASE WHEN merged THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence FROM g"

# HTML tables and accuracy of spans


def _spanned(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir).withColumn("column_span", F.when((F.col("row_index") == 0) & (F.col("column_index") == 2), 2).otherwise(1)).withColumn("row_span", F.lit(1)).withColumn("covered", (F.col("row_index") == 0) & (F.col("column_index") == 3))


def html_table_cells(spark, sf_dir):
    """Cells of HTML tables, read back on the occupancy grid."""
    h = TB.html_tables(_spanned(spark, sf_dir)).withColumnRenamed("table_id", "doc_id")
    return C.html_table_cells(h)


SQL["html_table_cells"] = f"WITH {CELLS} SELECT table_id AS doc_id, 0 AS table_no, CAST(row_index AS INT) AS row_index, CAST(column_index AS INT) AS column_index, 1 AS row_span, CASE WHEN row_index = 0 AND column_index = 2 THEN 2 ELSE 1 END AS column_span, trim(text) AS text FROM cells WHERE NOT (row_index = 0 AND column_index = 3)"


def html_table_diff(spark, sf_dir):
    """Tables against the same with some cells changed, one lost and one without its span."""
    cells = _spanned(spark, sf_dir)
    expected = C.html_table_cells(TB.html_tables(cells).withColumnRenamed("table_id", "doc_id"))
    i, j, t = F.col("row_index"), F.col("column_index"), F.col("table_id")
    other = cells.withColumn("text", F.when((i * 4 + j + t) % 6 == 0, "changed").otherwise(F.col("text"))).withColumn("column_span", F.when((t % 2 == 0) & (i == 0), 1).otherwise(F.col("column_span"))).where(~((i == 1) & (j == 3)))
    return C.html_table_diff(expected, C.html_table_cells(TB.html_tables(other).withColumnRenamed("table_id", "doc_id")))


SQL["html_table_diff"] = f"""WITH {CELLS}, c AS (SELECT table_id, CAST(row_index AS INT) AS i, CAST(column_index AS INT) AS j, trim(text) AS text FROM cells WHERE NOT (row_index = 0 AND column_index = 3)),
d AS (SELECT *, CASE WHEN i = 1 AND j = 3 THEN 'missing' WHEN i = 0 AND j = 2 AND table_id % 2 = 0 THEN 'span' WHEN (i * 4 + j + table_id) % 6 = 0 THEN 'text' END AS what, (i * 4 + j + table_id) % 6 = 0 AS changed FROM c)
SELECT table_id AS doc_id, 0 AS table_no, i AS row_index, j AS column_index, what, text AS expected, CASE WHEN what = 'missing' THEN NULL WHEN changed THEN 'changed' ELSE text END AS actual FROM d WHERE what IS NOT NULL"""


def public_tables(spark, sf_dir):
    """Tables against an oracle: equal ones, ones with a cell changed, and missing ones."""
    cells = _spanned(spark, sf_dir)
    t = F.col("table_id")
    actual = cells.where(t % 4 != 3).withColumn("text", F.when((t % 4 > 0) & (F.col("column_index") < t % 4), F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return C.public_table_oracle(cells, actual, min_adjacency=0.5, min_spans=0.7).select("table_id", F.array_join("errors", ",").alias("errors"), "passed", F.round("spans", 6).alias("spans"))


SQL["public_tables"] = f"""WITH {CELLS}, n AS (SELECT table_id, table_id % 4 AS m FROM (SELECT DISTINCT table_id FROM cells))
SELECT table_id, CASE m WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'adjacency,spans' ELSE 'missing,adjacency,spans' END AS errors, m < 2 AS passed, [1.0, 0.75, 0.5, 0.0][CAST(m + 1 AS INT)]::DOUBLE AS spans FROM n"""


def rendered_gate(spark, sf_dir):
    from ..operators.metrics import rendered_html_stats

    gate = C.rendered_gate(rendered_html_stats(_read(spark, sf_dir, "pages")), min_text=800, min_headings=1, min_paragraphs=3, max_paragraph=400)
    return gate.select("page_id", F.array_join("failures", ",").alias("failures"), "passed")


SQL["rendered_gate"] = r"""WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g') AS h FROM pages),
s AS (SELECT page_id, len(regexp_extract_all(h, '(?i)<h[1-6]\b')) AS headings, len(regexp_extract_all(h, '(?i)<p\b')) AS paragraphs, length(trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS chars,
    coalesce(list_max(list_transform(regexp_extract_all(h, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: length(trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))))), 0) AS longest FROM h),
f AS (SELECT page_id, concat_ws(',', CASE WHEN chars < 800 THEN 'text_chars' END, CASE WHEN headings < 1 THEN 'headings' END, CASE WHEN paragraphs < 3 THEN 'paragraphs' END, CASE WHEN longest > 400 THEN 'longest_paragraph' END) AS failures FROM s) SELECT page_id, failures, failures = '' AS passed FROM f"""

# M11, A7, J15, F26, M18


def hyphenation(spark, sf_dir):
    """Terms that must or mustn't occur, by part."""
    p = _read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 4)
    md = F.concat(F.lit("A **number** of "), F.when(F.col("k") < 2, "hyphenated ").otherwise("hyphen- ated "), F.lit("words, "), F.when(F.col("k") == 1, "co- operate").otherwise("cooperate"))
    want = F.when(F.col("k") == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("hyphenated"), F.lit("cooperate")))
    out = C.hyphenation_accuracy(p.select(F.col("p_partkey").alias("id"), md.alias("markdown"), want.alias("repaired"), F.array(F.lit("co- operate")).alias("rejected")))
    return out.select("id", "n_matched", F.array_join("missing", ",").alias("missing"), F.array_join("present", ",").alias("present"), "accuracy", "passed")


SQL["hyphenation"] = """SELECT p_partkey AS id, [2, 1, 1, 0][CAST(p_partkey % 4 + 1 AS INT)] AS n_matched, ['', 'cooperate', 'hyphenated', ''][CAST(p_partkey % 4 + 1 AS INT)] AS missing, CASE WHEN p_partkey % 4 = 1 THEN 'co- operate' ELSE '' END AS present,
    [1.0, 0.5, 0.5, 1.0][CAST(p_partkey % 4 + 1 AS INT)]::DOUBLE AS accuracy, p_partkey % 4 IN (0, 3) AS passed FROM part"""


def memory_profile(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") * 1000 + F.col("event_id") % 7).cast("long").alias("rss"), (F.col("event_id") * 37 % 1009).alias("heap"), (F.col("event_id") % 3).alias("pages"))
    return C.memory_profile(e, ["user_id"], "event_id")


SQL["memory_profile"] = """WITH e AS (SELECT user_id, event_id, CAST(floor(value) * 1000 + event_id % 7 AS BIGINT) AS rss, event_id * 37 % 1009 AS heap, event_id % 3 AS pages FROM events),
m AS (SELECT user_id, arg_min(rss, event_id) AS base, arg_max(rss, event_id) AS last_rss, max(rss) AS top, arg_min(heap, event_id) AS h0, arg_max(heap, event_id) AS h1, max(heap) AS htop, CAST(sum(pages) AS BIGINT) AS pages FROM e GROUP BY 1)
SELECT user_id, base, last_rss - base AS rss_delta, top - base AS rss_peak_delta, h1 - h0 AS heap_delta, htop - h0 AS heap_peak_delta, pages, CASE WHEN pages > 0 THEN floor((top - base) / pages * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS peak_delta_per_page FROM m"""


def snippet_pages(spark, sf_dir):
    """Whether a snippet occurs in what the source map puts on a page."""
    k = F.col("p_partkey").cast("string")
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), k.alias("k"))
    first, second = F.concat(F.lit("aaa "), "k", F.lit(" (b)")), F.concat(F.lit("ccc "), "k")
    n = F.length(first)
    region = lambda a, b, page: F.struct(a.cast("int").alias("md_start"), b.cast("int").alias("md_end"), F.lit(page).alias("page_index"))
    results = p.select("id", F.concat(first, F.lit("\n\n"), second).alias("markdown"), F.array(region(F.lit(0), n, 0), region(n + 2, n + 2 + F.length(second), 1)).alias("regions"))
    wanted = F.array(*[F.struct(s.alias("snippet"), F.lit(page).alias("page_index")) for s in (F.lit("aaa"), F.lit("ccc"), F.lit("(b)"), F.col("k"), F.lit("zzz"), F.lit("")) for page in (0, 1)])
    return C.snippets_on_pages(results, p.select("id", F.explode(wanted).alias("w")).select("id", "w.*"))


SQL["snippet_pages"] = "SELECT p_partkey AS id, CASE s WHEN 'k' THEN CAST(p_partkey AS VARCHAR) ELSE s END AS snippet, page AS page_index, (s IN ('aaa', '(b)') AND page = 0) OR (s = 'ccc' AND page = 1) OR s = 'k' AS found FROM part, (VALUES ('aaa'), ('ccc'), ('(b)'), ('k'), ('zzz'), ('')) v(s), (VALUES (0), (1)) w(page)"


def trace_sanitized(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 10 == 9, "no json").otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("userPassword"), F.lit(True).alias("passwordProvided"), F.repeat(F.lit("y"), 3990 + (F.col("event_id") % 20).cast("int")).alias("long"), F.struct(F.lit("x").alias("clientSecret"), F.col("user_id").alias("id")).alias("who"))))
    return C.sanitized_trace(e.select("event_id", raw.alias("json")))


SQL["trace_sanitized"] = """SELECT event_id, CASE WHEN event_id % 10 < 9 THEN '{"long":"' || repeat('y', CAST(least(4000, 3990 + event_id % 20) AS INT)) || CASE WHEN event_id % 20 > 10 THEN '...<truncated>' ELSE '' END || '","passwordProvided":true,"type":"' || event_type || '","userPassword":"[redacted]","who":{"clientSecret":"[redacted]","id":' || user_id || '}}' END AS json FROM events"""


def acceptance_rules(spark, sf_dir):
    """Named criteria over results: some met, some not, one unknown."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), (F.col("c_custkey") % 3).alias("k"))
    table = "array<struct<page_index:int,kind:string,confidence:double,rows:int,columns:int>>"
    some = F.array(F.struct(F.lit(0).alias("page_index"), F.lit("ruled").alias("kind"), F.lit(0.9).alias("confidence"), F.lit(3).alias("rows"), F.lit(2).alias("columns")))
    results = c.select(
        "doc_id", F.when(F.col("k") == 0, "# T\n\n- a\n\n<p dir=\"rtl\">x</p>\n").when(F.col("k") == 1, "word- break\n").otherwise("").alias("markdown"), F.array().cast("array<struct<block_no:int,kind:string,text:string,page_index:int,md_start:int,md_end:int>>").alias("blocks"),
        F.when(F.col("k") == 0, some).otherwise(F.array().cast(table)).alias("tables"), F.array().cast("array<struct<kind:string>>").alias("figures"), F.array().cast("array<string>").alias("assets"), F.array().cast("array<struct<code:string>>").alias("warnings"), F.when(F.col("k") == 2, "none").otherwise("pdf-text").alias("mode"),
        F.lit("digital").alias("source_type"), F.when(F.col("k") == 0, F.array(F.lit("two-column"))).otherwise(F.array().cast("array<string>")).alias("observed"), F.array().cast("array<struct<name:string,value:string,state:string,checked:boolean>>").alias("form_fields"), F.lit("classic-xref").alias("parse_mode"),
    )
    cases = c.select("doc_id", F.array(F.lit("extract_title"), F.lit("repair_line_end_hyphenation"), F.lit("no_such_rule")).alias("must"), F.array(F.lit("emit_empty_markdown"), F.lit("drop_bidi_markup"), F.lit("interleave_columns_line_by_line")).alias("must_not"), F.array(F.lit("three_rows"), F.lit("unordered_list")).alias("structure"), F.lit("pdf-text").alias("expected_mode"))
    return A.evaluate(results, cases)


SQL["acceptance_rules"] = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey % 3 AS k FROM customer), v(rule, label, a, b, c) AS (VALUES ('must', 'extract_title', TRUE, FALSE, FALSE), ('must', 'repair_line_end_hyphenation', TRUE, FALSE, TRUE), ('must', 'no_such_rule', FALSE, FALSE, FALSE),
    ('mustNot', 'emit_empty_markdown', TRUE, TRUE, FALSE), ('mustNot', 'drop_bidi_markup', TRUE, FALSE, FALSE), ('mustNot', 'interleave_columns_line_by_line', TRUE, FALSE, FALSE), ('structure', 'three_rows', TRUE, FALSE, FALSE), ('structure', 'unordered_list', TRUE, FALSE, FALSE), ('mode', 'pdf-text', TRUE, TRUE, FALSE))
SELECT doc_id, rule, label, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c.c END AS passed, label = 'no_such_rule' AS unknown FROM (SELECT c.doc_id, c.k, v.rule, v.label, v.a, v.b, v.c FROM c, v) c"""


def acceptance_files(spark, sf_dir):
    """Acceptance files written from customers and read as cases."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    body = F.concat(
        F.lit("# a case\nid: case-"), k.cast("string"), F.lit("\ngate: text-mvp\nexpectedMode: pdf-text\nmust:\n  - extract_title # yes\n"), F.when(k % 2 == 0, "  - preserve_lists\n").otherwise(""), F.lit("mustNot:\n  - emit_empty_markdown\nmetrics:\n  minTextCoverage: 0.98\n  name: x\nsnippets:\n  - page: "),
        (k % 9).cast("string"), F.lit('\n    contains: "'), F.col("c_name"), F.lit(': text"\nstructure:\n  expected:\n    - heading_level_1\n'),
    )
    cases = A.read_cases(c.select(F.concat(F.lit("cases/"), k.cast("string"), F.lit(".yaml")).alias("path"), body.alias("content")))
    return cases.select("case_id", "gate", "expected_mode", F.array_join("must", ",").alias("must"), F.array_join("must_not", ",").alias("must_not"), F.array_join("structure", ",").alias("structure"), F.col("snippets")[0]["page"].alias("page"), F.col("snippets")[0]["contains"].alias("contains"), F.col("metrics")["minTextCoverage"].alias("coverage"), F.size("metrics").alias("n_metrics"))


SQL["acceptance_files"] = """SELECT 'case-' || c_custkey AS case_id, 'text-mvp' AS gate, 'pdf-text' AS expected_mode, CASE WHEN c_custkey % 2 = 0 THEN 'extract_title,preserve_lists' ELSE 'extract_title' END AS must, 'emit_empty_markdown' AS must_not, 'heading_level_1' AS structure,
    CAST(c_custkey % 9 AS INT) AS page, c_name || ': text' AS contains, 0.98::DOUBLE AS coverage, 1 AS n_metrics FROM customer"""


def manifest_entries(spark, sf_dir):
    """A corpus manifest written from suppliers and read back."""
    path = fresh_path(spark, "manifest")
    k = F.col("s_suppkey")
    entry = F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.lit("pdf").alias("kind"), F.concat(F.lit("corpus/"), "s_name", F.lit(".pdf")).alias("path"), F.struct(F.when(k % 2 == 0, "url").otherwise("generated").alias("type"), F.when(k % 2 == 0, F.concat(F.lit("https://example.org/"), k.cast("string"))).alias("url")).alias("source"),
                     F.struct(F.lit("CC0-1.0").alias("name"), F.lit("none").alias("notes")).alias("license"), F.when(k % 3 > 0, F.array(F.lit("tagged"), F.lit("two-column"))).alias("features"))
    whole = _read(spark, sf_dir, "supplier").agg(F.collect_list(entry).alias("entries")).select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "entries")).alias("value"))  # a manifest is one small file
    whole.write.text(path)
    return A.read_manifest(spark, path).withColumn("features", F.array_join("features", ",")).drop("acceptance_path")


SQL["manifest_entries"] = "SELECT 's' || s_suppkey AS id, 'pdf' AS kind, 'corpus/' || s_name || '.pdf' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'url' ELSE 'generated' END AS source_type, CASE WHEN s_suppkey % 2 = 0 THEN 'https://example.org/' || s_suppkey END AS url, 'CC0-1.0' AS license, CASE WHEN s_suppkey % 3 > 0 THEN 'tagged,two-column' ELSE '' END AS features FROM supplier"


def pdf_observed(spark, sf_dir):
    """What the reader observes in files of eight structures and in turned and cropped pages."""
    from ..operators.pipeline import convert_built
    from ..shared import saved
    from ..sources.pdf import samples

    kinds = samples.STRUCTURES
    file = lambda k: samples.page_geometry(k) if k % 9 == 8 else samples.structured(kinds[k % 9], f"Part {k}\nsecond line\nNote: it.")
    kept = ("parse_mode", "encrypted", "linearized", "n_revisions", "n_object_streams", "pages", "lines", "images")
    whole = convert_built(_read(spark, sf_dir, "part").select("p_partkey"), file, keep=kept, tolerant=True).select("path", *kept, "markdown", "tables", "figures")
    files = saved(whole, "observed").withColumnRenamed("path", "doc_id").repartition("doc_id")
    return A.observed(files).select(F.col("doc_id").cast("long").alias("part"), F.array_join("observed", ",").alias("observed"))


SQL["pdf_observed"] = """SELECT p_partkey AS part, CASE p_partkey % 9 WHEN 1 THEN 'xref-stream,object-stream,' WHEN 2 THEN 'xref-stream,object-stream,' WHEN 3 THEN 'incremental-update,xref-prev,' WHEN 5 THEN 'encrypted,rc4-40,standard-security-handler-r2,' ELSE '' END
    || CASE WHEN p_partkey % 9 < 8 THEN 'reading-order' ELSE concat_ws(',', CASE WHEN p_partkey % 4 > 0 THEN 'rotated-page' END, CASE WHEN p_partkey % 2 = 1 THEN 'cropped-page' END) END AS observed FROM part"""

# plans


def _routed(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("digital", "scanned", "hybrid", "unknown"))), (k % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(F.floor(k / 20).alias("doc_id"), (k % 20).cast("int").alias("page_index"), kind.alias("source_type"), (k % 5 * 90 % 360).cast("int").alias("rotation"), (F.col("p_size") * 30.0 + 100).alias("width_pt"), (F.col("p_size") * 17.5 + 200).alias("height_pt"))


_ROUTED = """rt AS (SELECT p_partkey AS k, p_partkey // 20 AS doc_id, CAST(p_partkey % 20 AS INT) AS page_index, p_partkey % 4 IN (1, 2) AS goes, p_partkey % 5 * 90 % 360 AS turn, p_size * 30.0::DOUBLE + 100 AS w0, p_size * 17.5::DOUBLE + 200 AS h0 FROM part),
rx AS (SELECT *, CAST(greatest(1, ceil(CASE WHEN turn % 180 = 90 THEN h0 ELSE w0 END * 150.0::DOUBLE / 72 - 0.000000001)) AS BIGINT) * CAST(greatest(1, ceil(CASE WHEN turn % 180 = 90 THEN w0 ELSE h0 END * 150.0::DOUBLE / 72 - 0.000000001)) AS BIGINT) AS px FROM rt)"""


def preprocessing_plan(spark, sf_dir):
    routed = _routed(spark, sf_dir)
    plan = O.preprocessing_plan(routed, R.raster_plan(routed.where("page_index % 7 != 6"), dpi=150, max_pixels=4_000_000), denoise=False)
    return plan.withColumn("operations", F.array_join("operations", ",")).withColumn("deferred", F.array_join("deferred", ","))


SQL["preprocessing_plan"] = f"""WITH {_ROUTED}, s AS (SELECT *, CASE WHEN page_index % 7 = 6 THEN 'metadata-only' WHEN px > 4000000 THEN 'skipped-pixel-limit' ELSE 'planned' END AS status FROM rx WHERE goes)
SELECT doc_id, page_index, CAST((360 - turn) % 360 AS INT) AS rotation_correction, concat_ws(',', CASE WHEN turn > 0 THEN 'normalize-page-rotation' END, CASE WHEN status = 'planned' THEN 'estimate-deskew,binarize' END) AS operations, CASE WHEN status = 'metadata-only' THEN 'estimate-deskew,binarize' ELSE '' END AS deferred, status FROM s"""


def gpu_plan(spark, sf_dir):
    routed = _routed(spark, sf_dir)
    return R.gpu_plan(routed, R.raster_plan(routed.where("page_index % 7 != 6"), dpi=150), max_pixels=6_000_000, max_bytes=20_000_000).select("doc_id", "page_index", "status", F.col("batch_no").isNotNull().alias("batched"))


SQL["gpu_plan"] = f"WITH {_ROUTED}, s AS (SELECT *, CASE WHEN page_index % 7 = 6 THEN 'missing-raster' WHEN px > 6000000 THEN 'exceeds-batch-pixel-limit' WHEN px * 4 > 20000000 THEN 'exceeds-memory-limit' ELSE 'planned' END AS status FROM rx WHERE goes) SELECT doc_id, page_index, status, status = 'planned' AS batched FROM s"


def ocr_languages(spark, sf_dir):
    """Languages of pages: the last override, else the defaults; then the models an adapter would load."""
    pages = _routed(spark, sf_dir).select("doc_id", "page_index")
    over = pages.where("page_index % 3 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select("doc_id", "page_index", F.col("n").alias("ord"), F.when(F.col("n") == 2, F.array(F.lit(" deu"), F.lit("eng"), F.lit("deu "))).otherwise(F.array(F.lit("fra"))).alias("languages"))
    chosen = O.page_languages(pages, ["eng ", "spa", "eng"], over)
    return SU.ocr_plan(chosen)


SQL["ocr_languages"] = """WITH p AS (SELECT p_partkey % 20 % 3 = 0 AS o FROM part), l AS (SELECT unnest(CASE WHEN o THEN ['deu', 'eng'] ELSE ['eng', 'spa'] END) AS language FROM p)
SELECT language, count(*) AS n_pages, 'tesseract.js' AS adapter, 'adapter-default/' || language || '.traineddata' AS model FROM l GROUP BY 1"""


def script_languages(spark, sf_dir):
    k = F.col("p_partkey") % 6
    given = F.when(k == 0, F.array(F.lit(" deu "), F.lit(""), F.lit("deu"))).when(k == 1, F.array(F.lit(" ")))
    scripts = F.when(k == 2, F.array(F.lit("CJK"), F.lit("japanese"))).when(k == 3, F.array(F.lit(" rtl "), F.lit("klingon"))).when(k == 4, F.array(F.lit("vertical"), F.lit("latin")))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(O.language_selection(given, scripts), ",").alias("languages"))


SQL["script_languages"] = "SELECT p_partkey, ['deu', 'eng', 'eng,chi_sim,chi_tra,jpn,kor', 'eng,ara,heb', 'eng,jpn_vert', 'eng'][CAST(p_partkey % 6 + 1 AS INT)] AS languages FROM part"


def binarized(spark, sf_dir):
    """An image of p_size by 2 grey pixels for each part, made black or white."""
    grey = lambda v: F.concat(F.lpad(F.hex(v), 2, "0"), F.lpad(F.hex(v), 2, "0"), F.lpad(F.hex(v), 2, "0"), F.lit("7F"))
    k = F.col("p_partkey")
    px = F.unhex(F.concat(F.repeat(grey(k % 256), F.col("p_size")), F.repeat(grey(k * 7 % 256), F.col("p_size"))))
    out = R.preprocess_images(spread_evenly(_read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(k.alias("image_id"), F.col("p_size").alias("width"), F.lit(2).alias("height"), px.alias("rgba")), mode="binarize")
    return out.select("image_id", "width", F.md5("rgba").alias("md5"))


SQL["binarized"] = "SELECT p_partkey AS image_id, p_size AS width, md5(unhex(repeat(CASE WHEN p_partkey % 256 >= 128 THEN 'FFFFFF7F' ELSE '0000007F' END, p_size) || repeat(CASE WHEN p_partkey * 7 % 256 >= 128 THEN 'FFFFFF7F' ELSE '0000007F' END, p_size))) AS md5 FROM part"


def adaptive(spark, sf_dir):
    """A grey image of 40 by 40 for each part with one darker pixel in the middle, which alone becomes black."""
    g = F.col("p_partkey") % 200 + 50
    px = lambda v: F.concat(F.lpad(F.hex(v), 2, "0"), F.lpad(F.hex(v), 2, "0"), F.lpad(F.hex(v), 2, "0"), F.lit("FF"))
    raw = F.unhex(F.concat(F.repeat(px(g), F.lit(40 * 20 + 20)), px(g - F.col("p_partkey") % 20), F.repeat(px(g), F.lit(40 * 40 - 40 * 20 - 21))))
    out = R.preprocess_images(spread_evenly(_read(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").alias("image_id"), F.lit(40).alias("width"), F.lit(40).alias("height"), raw.alias("rgba")))
    h = F.hex("rgba")
    return out.select("image_id", (F.length(F.regexp_replace(h, "FFFFFFFF", "")) / 8).cast("int").alias("n_black"), (F.instr(h, "000000FF") / 8).cast("int").alias("first_black"))


SQL["adaptive"] = "SELECT p_partkey AS image_id, CASE WHEN p_partkey % 20 > 7 THEN 1 ELSE 0 END AS n_black, CASE WHEN p_partkey % 20 > 7 THEN 820 ELSE 0 END AS first_black FROM part"

# SRC17, SRC19, SNK3, J1, J4, B11-B14, L7-L10, P9, P12-P15, F11, V2, V3, W7


def ocr_results(spark, sf_dir):
    """OCR results written as JSON and read as boxes: boxes before lines before words, corners under several names, the last result of a page."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 4)
    v = F.col("event_id") % 50
    box = lambda **kw: F.array(F.struct(F.col("event_type").alias("text"), F.lit(90.0).alias("confidence"), *[c.cast("double").alias(n) for n, c in kw.items()]))
    plain, corners, named = box(x=v, y=v + 1, width=v + 2, height=v + 3), box(left=v, top=v + 9, right=v + 5, bottom=v + 1), box(x0=v, y0=v + 9, x1=v + 5, y1=v + 1)
    empty = lambda d: d.cast("string")  # noqa: E731, F841
    page = F.struct(F.lit(0).alias("pageIndex"), F.when(F.col("k") == 0, plain).alias("boxes"), F.when(F.col("k") < 3, corners).alias("lines"), named.alias("words"))
    old = F.struct(F.lit(0).alias("pageIndex"), F.lit(None).cast(plain_type(plain)).alias("boxes"), F.lit(None).cast(plain_type(corners, True)).alias("lines"), F.array(F.struct(F.lit("old").alias("text"), F.lit(1.0).alias("confidence"), *[F.lit(0.0).alias(n) for n in ("x0", "y0", "x1", "y1")])).alias("words"))
    path = fresh_path(spark, "ocr_results")
    e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("doc_id"), F.lit(1).alias("schemaVersion"), F.array(old, page).alias("results"))).alias("value")).write.text(path)
    boxes = ocr_json.read_ocr_results(spark, path, multi_line=False)
    return boxes.select(F.col("doc_id").cast("long").alias("event_id"), "page_index", "box_no", "text", "confidence", "x", "y", "width", "height", "coordinate_space")


def plain_type(_, corners: bool = False) -> str:
    return "array<struct<text:string,confidence:double," + ("left:double,top:double,right:double,bottom:double" if corners else "x:double,y:double,width:double,height:double") + ">>"


SQL["ocr_results"] = """SELECT event_id, 0 AS page_index, 0 AS box_no, event_type AS text, 90.0::DOUBLE AS confidence, (event_id % 50)::DOUBLE AS x, (event_id % 50 + CASE event_id % 4 WHEN 0 THEN 1 ELSE 9 END)::DOUBLE AS y, (CASE event_id % 4 WHEN 0 THEN event_id % 50 + 2 ELSE 5 END)::DOUBLE AS width,
    (CASE event_id % 4 WHEN 0 THEN event_id % 50 + 3 ELSE 8 END)::DOUBLE AS height, 'page' AS coordinate_space FROM events"""


def csv_read_back(spark, sf_dir):
    """CSV sidecars read back into cells, guards taken off."""
    return ocr_json.csv_cells(TB.csv_sidecars(_cells(spark, sf_dir)))


SQL["csv_read_back"] = f"WITH {CELLS} SELECT table_id, CAST(row_index AS INT) AS row_index, CAST(column_index AS INT) AS column_index, trim(text) AS text FROM cells"


def ocr_debug_files(spark, sf_dir):
    from .table_queries import _ocr_lines

    files = SK.ocr_debug_assets(_ocr_lines(spark, sf_dir))
    j = F.from_json("content", "pageIndex int, boxes array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>")
    return files.withColumn("j", j).select("doc_id", "path", "j.pageIndex", F.size("j.boxes").alias("n_boxes"), F.round(F.aggregate("j.boxes", F.lit(0.0), lambda a, b: a + b["x"] + b["width"]), 3).alias("total"), F.col("j.boxes")[0]["text"].alias("first"))


def _ocr_sql() -> str:
    from .table_queries import BOXES

    return f"WITH {BOXES} SELECT doc_id, 'assets/ocr-page-1.json' AS path, 0 AS pageIndex, CAST(count(*) AS INT) AS n_boxes, round(sum(x + width), 3)::DOUBLE AS total, arg_min(text, box_no) AS \"first\" FROM ocr GROUP BY 1"


SQL["ocr_debug_files"] = _ocr_sql()


def marked_lines(spark, sf_dir):
    """Lines with the role of their marked content: a later mark of one number counts."""
    lines = _lines(spark, sf_dir).withColumn("mcid", F.when(F.col("line_no") % 3 > 0, F.col("line_no") % 3)).select("doc_id", "page_index", "line_no", "mcid", F.lit(None).cast("string").alias("structure_role"), F.lit(None).cast("string").alias("structure_path"))
    pages = lines.select("doc_id", "page_index").distinct()
    mark = lambda mcid, ord_, role: F.struct(F.lit(mcid).alias("mcid"), F.lit(ord_).alias("ord"), F.lit(role).alias("role"), F.lit("Document/" + role).alias("path"))
    marks = pages.select("doc_id", "page_index", F.explode(F.array(mark(1, 0, "P"), mark(1, 5, "H1"), mark(2, 1, "LI"))).alias("m")).select("doc_id", "page_index", "m.*")
    return SU.marked_lines(lines, marks).select("doc_id", "line_no", "structure_role", "structure_path")


SQL["marked_lines"] = f"WITH {LINES} SELECT doc_id, line_no, CASE line_no % 3 WHEN 1 THEN 'H1' WHEN 2 THEN 'LI' END AS structure_role, CASE line_no % 3 WHEN 1 THEN 'Document/H1' WHEN 2 THEN 'Document/LI' END AS structure_path FROM lines"


def outline_levels(spark, sf_dir):
    """Lines whose text is an outline's title get its depth; the first of equal titles counts."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    line = lambda n, t, size: F.struct(F.lit(n).alias("line_no"), t.alias("text"), F.lit(size).alias("font_size"))
    lines = c.select("doc_id", F.explode(F.array(line(0, F.concat(F.lit(" "), "c_name", F.lit("  x")), 12.0), line(1, F.lit("Body text here."), 12.0), line(2, F.lit("Large"), 20.0), line(3, F.lit("Body again."), 12.0))).alias("l")).select("doc_id", "l.*").withColumn("page_index", F.lit(0)).withColumn("x", F.lit(72.0)).withColumn("y", 700.0 - 30 * F.col("line_no"))
    outlines = c.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("item_no"), F.concat("c_name", F.lit(" x")).alias("title"), F.lit(3).alias("depth")), F.struct(F.lit(1).alias("item_no"), F.concat("c_name", F.lit(" x")).alias("title"), F.lit(5).alias("depth")))).alias("o")).select("doc_id", "o.*")
    return B.heading_levels(lines, outlines).select("doc_id", "line_no", F.col("heading_level").alias("level"))


SQL["outline_levels"] = "SELECT c_custkey AS doc_id, n AS line_no, CASE n WHEN 0 THEN 3 WHEN 2 THEN 1 END AS level FROM customer, (VALUES (0), (1), (2), (3)) v(n)"


def coalesced_spans(spark, sf_dir):
    """Spans of a line that are one: of the same font and source, without a gap."""
    o = _read(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    s = o.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("line_no"), F.col("l_linenumber").alias("span_no"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("text"), F.when(F.col("l_linenumber") % 4 < 2, "A").otherwise("B").alias("font_name"), F.lit("ltr").alias("direction"), F.lit("pdf").alias("source"), (F.col("l_linenumber") * 10.0).alias("x"), F.lit(10.0).alias("width"), F.lit(10.0).alias("font_size"))
    return SU.coalesced_spans(s).select("doc_id", "text", "font_name", "x", "width")


SQL["coalesced_spans"] = """WITH s AS (SELECT l_orderkey AS d, l_linenumber AS n, CASE WHEN l_linenumber % 4 < 2 THEN 'A' ELSE 'B' END AS f FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), r AS (SELECT *, CASE WHEN lag(f) OVER w = f AND lag(n) OVER w = n - 1 THEN 0 ELSE 1 END AS b FROM s WINDOW w AS (PARTITION BY d ORDER BY n)),
g AS (SELECT *, sum(b) OVER (PARTITION BY d ORDER BY n) AS run FROM r) SELECT d AS doc_id, string_agg('s' || n, '' ORDER BY n) AS text, f AS font_name, 10.0::DOUBLE * min(n) AS x, 10.0::DOUBLE * (max(n) - min(n) + 1) AS width FROM g GROUP BY d, run, f"""


def sidebars(spark, sf_dir):
    """Columns that hold at most 45 % of their page's widest one."""
    o = _read(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    lines = o.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("l_linenumber") > 2).cast("int").alias("column_no"), F.when(F.col("l_linenumber") > 2, 300.0).otherwise(72.0).alias("x"), (700.0 - 14 * F.col("l_linenumber")).alias("y"), F.lit(100.0).alias("width"), F.lit(12.0).alias("height"))
    return SU.sidebar_regions(lines)


SQL["sidebars"] = """WITH c AS (SELECT l_orderkey AS d, CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END AS c, count(*) AS n, min(700.0::DOUBLE - 14 * l_linenumber) AS y, max(700.0::DOUBLE - 14 * l_linenumber) AS y2 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY d) AS most FROM c)
SELECT d AS doc_id, 0 AS page_index, c AS column_no, n AS n_lines, CASE c WHEN 1 THEN 300.0 ELSE 72.0 END::DOUBLE AS x, y, 100.0::DOUBLE AS width, y2 + 12 - y AS height FROM m WHERE n <= 0.45 * most"""


def text_directions(spark, sf_dir):
    """Directions of lines and the vote of each page."""
    p = _read(spark, sf_dir, "part")
    words = F.when(F.col("p_partkey") % 5 == 0, "שלום abc עולם").when(F.col("p_partkey") % 5 == 1, "12 + 3").otherwise(F.col("p_name"))
    lines = p.select(F.floor(F.col("p_partkey") / 7).alias("doc_id"), F.lit(0).alias("page_index"), F.col("p_partkey").alias("line_no"), words.alias("text"))
    own = lines.select("doc_id", "line_no", T.direction("text").alias("direction"))
    return own.join(L.dominant_direction(lines).select("doc_id", F.col("direction").alias("page_direction")), "doc_id")


SQL["text_directions"] = """WITH l AS (SELECT p_partkey // 7 AS doc_id, p_partkey AS line_no, CASE p_partkey % 5 WHEN 0 THEN 'rtl' WHEN 1 THEN 'unknown' ELSE 'ltr' END AS direction FROM part), v AS (SELECT doc_id, count(*) FILTER (WHERE direction = 'rtl') AS r, count(*) FILTER (WHERE direction = 'ltr') AS n FROM l GROUP BY 1)
SELECT l.doc_id, line_no, direction, CASE WHEN r > n THEN 'rtl' WHEN n > 0 THEN 'ltr' ELSE 'unknown' END AS page_direction FROM l JOIN v USING (doc_id)"""


def vertical_columns(spark, sf_dir):
    """Lines of vertical pages: columns from the right, each from the top."""
    o = _read(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    n = F.col("l_linenumber")
    lines = o.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), n.alias("line_no"), (400.0 - 30 * (n % 3) + 2 * F.floor(n / 3)).alias("x"), (600.0 - 50 * F.floor(n / 3)).alias("y"), F.lit(12.0).alias("width"), F.lit(40.0).alias("height"))
    return L.vertical_order(lines).select("doc_id", "line_no", "reading_no")


SQL["vertical_columns"] = "SELECT l_orderkey AS doc_id, l_linenumber AS line_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber // 3) - 1 AS INT) AS reading_no FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"


def tag_conflicts(spark, sf_dir):
    """Headings' tags at odds with their lines: without text, too long, or smaller than the body."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    line = lambda n, t, size, role: F.struct(F.lit(n).alias("line_no"), t.alias("text"), F.lit(size).alias("font_size"), F.lit(role).alias("structure_role"))
    lines = c.select("doc_id", F.explode(F.array(line(0, F.lit("Fine"), 12.0, "H1"), line(1, F.lit(" "), 12.0, "H2"), line(2, F.repeat(F.lit("x"), 155 + (F.col("doc_id") % 10).cast("int")), 12.0, "H3"), line(3, F.lit("small"), 9.0, "H4"), line(4, F.lit("small"), 9.0, "P"))).alias("l")).select("doc_id", "l.*")
    found = W.tag_conflicts(lines, c.withColumn("body_size", F.lit(12.0)))
    return found.select("doc_id", "code", "n_conflicts", F.array_join("samples", ",").alias("samples"))


SQL["tag_conflicts"] = "SELECT c_custkey AS doc_id, 'structure.tagged_layout_conflict' AS code, CASE WHEN c_custkey % 10 > 5 THEN 3 ELSE 2 END::BIGINT AS n_conflicts, CASE WHEN c_custkey % 10 > 5 THEN '1,2,3' ELSE '1,3' END AS samples FROM customer"


def figure_blocks(spark, sf_dir):
    """Figures put before the block of their caption, and what comes after renumbered."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    block = lambda n, k, t, first: F.struct(F.lit(n).alias("block_no"), F.lit(k).alias("kind"), t.alias("text"), F.lit(first).alias("first_line"), F.lit(1).alias("n_lines"))
    blocks = c.select("doc_id", F.explode(F.array(block(0, "heading", F.lit("# A"), 0), block(1, "paragraph", F.lit("Figure 3. It."), 1), block(2, "paragraph", F.lit("End."), 5))).alias("b")).select("doc_id", "b.*")
    figures = c.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("page_index"), F.lit(1).alias("line_no"), F.lit(1).alias("figure_no"), F.lit(3).alias("number"))
    return FG.insert_figures(blocks, figures).select("doc_id", "block_no", "kind", "text")


SQL["figure_blocks"] = """WITH b AS (SELECT c_custkey AS d, n, k, t FROM customer, (VALUES (0.0, 'heading', '# A'), (0.5, 'figure', '*[Figure 3 preview unavailable; metadata retained.]*'), (1.0, 'paragraph', 'Figure 3. It.'), (2.0, 'paragraph', 'End.')) v(n, k, t) WHERE k <> 'figure' OR c_custkey % 2 = 0)
SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY n) - 1 AS INT) AS block_no, k AS kind, t AS text FROM b"""


def alt_texts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", SU.alt_text("text").alias("alt"))


SQL["alt_texts"] = r"SELECT doc_id, nullif(left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 240), '') AS alt FROM documents"


def line_samples(spark, sf_dir):
    """The first five lines of each document, cut for diagnostics (the report's own limits)."""
    return SK.truncated_samples(_lines(spark, sf_dir))


SQL["line_samples"] = f"WITH {LINES}, n AS (SELECT doc_id, line_no, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines) SELECT doc_id, line_no, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS text FROM n WHERE n <= 5"

QUERIES = {
    name: globals()[name]
    for name in (
        "grid_shapes", "grid_cells", "grid_lines", "grid_summary", "grid_exports", "html_table_cells", "html_table_diff", "public_tables", "rendered_gate", "hyphenation", "memory_profile", "snippet_pages", "trace_sanitized", "acceptance_rules", "acceptance_files", "manifest_entries", "pdf_observed",
        "preprocessing_plan", "gpu_plan", "ocr_languages", "script_languages", "binarized", "adaptive", "ocr_results", "csv_read_back", "ocr_debug_files", "marked_lines", "outline_levels", "coalesced_spans", "sidebars", "text_directions",
        "vertical_columns", "tag_conflicts", "figure_blocks", "alt_texts", "line_samples",
    )
}
