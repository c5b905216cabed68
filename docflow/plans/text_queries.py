"""Queries over the line relation of `documents`, each with the SQL that gives the same rows.

Documents hold plain prose, so forms that the operators look for are put in by position: k = (7 doc_id + line_no) mod 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import layout as L
from ..operators import warnings as W
from ..operators.lines import lines_from_documents

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_documents(_docs(spark, sf_dir)).withColumn("k", F.expr("pmod(doc_id * 7 + line_no, 20)"))


LINES = """lines AS (
    SELECT doc_id, CAST(ord - 1 AS INT) AS line_no, CAST((ord - 1) // 46 AS INT) AS page_index, text, 72.0::DOUBLE AS x, 720.0::DOUBLE - 14.0::DOUBLE * ((ord - 1) % 46) AS y,
        6.0::DOUBLE * length(text) AS width, 12.0::DOUBLE AS height, 12.0::DOUBLE AS font_size, (doc_id * 7 + ord - 1) % 20 AS k
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents WHERE text IS NOT NULL))"""


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def lines_of_documents(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", "page_index", "text", "x", "y", "width", "font_size")


SQL = {"lines_from_documents": f"WITH {LINES} SELECT doc_id, line_no, page_index, text, x, y, width, font_size FROM lines"}


# Running content

def _running(lines: DataFrame) -> DataFrame:
    k = F.col("k")
    return (
        lines.withColumn("text", F.when(k == 18, "Annual  report header").when(k == 19, F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string"))).when(k == 17, F.concat(F.lit("once "), F.col("line_no").cast("string"))).otherwise(F.col("text")))
        .withColumn("y", F.when(k == 18, 760.0).when(k == 19, 40.0).when(k == 17, 750.0).otherwise(F.col("y"))).withColumn("font_size", F.when(k >= 17, 9.0).otherwise(12.0))
    )


RUNNING = """run AS (
    SELECT doc_id, line_no, page_index, k, x, width, height,
        CASE WHEN k = 18 THEN 'Annual  report header' WHEN k = 19 THEN 'Page ' || (page_index + 1) WHEN k = 17 THEN 'once ' || line_no ELSE text END AS text,
        CASE WHEN k = 18 THEN 760.0 WHEN k = 19 THEN 40.0 WHEN k = 17 THEN 750.0 ELSE y END AS y, CASE WHEN k >= 17 THEN 9.0 ELSE 12.0 END AS font_size
    FROM lines)"""
PAGE_NO = r"(font_size <= 10 AND (y >= 740 OR y <= 60) AND regexp_matches(trim(text), '(?i)^(?:page\s*)?\d+(?:\s*/\s*\d+)?$'))"


def running_content_removal(spark, sf_dir):
    return L.remove_running_content(_running(_lines(spark, sf_dir))).select("doc_id", "line_no", "text")


SQL["running_content_removal"] = f"""WITH {LINES}, {RUNNING},
c AS (SELECT *, count(*) FILTER (WHERE font_size <= 10 AND (y >= 740 OR y <= 60)) OVER (PARTITION BY doc_id, {_norm('text')}) AS n FROM run)
SELECT doc_id, line_no, text FROM c WHERE NOT {PAGE_NO} AND NOT (font_size <= 10 AND (y >= 740 OR y <= 60) AND n >= 2)"""


def line_predicates(spark, sf_dir):
    lines = _running(_lines(spark, sf_dir))
    k = F.col("k")
    mark = F.when(k == 3, "- ").when(k == 4, "7. ").when(k == 7, "Note: ").when(k == 8, "Figure 3. ").when(k == 9, "Table 2 ").when(k == 10, "# ")
    t = F.when(k == 11, "-12.5%").otherwise(F.concat(F.coalesce(mark, F.lit("")), F.col("text")))
    return lines.withColumn("text", t).select(
        "doc_id", "line_no", T.is_running_candidate("font_size", "y").alias("running"), T.is_page_number("text", "font_size", "y").alias("page_number"), T.is_running_title("text", "font_size", "y").alias("running_title"),
        T.is_list_item("text").alias("list_item"), T.list_number("text").alias("list_number"), T.starts_block("text").alias("block_start"), T.is_callout("text").alias("callout"), T.caption_target("text").alias("caption"),
        T.is_numeric_cell("text").alias("numeric"), T.ends_paragraph("text").alias("terminal"),
    )


SQL["line_predicates"] = f"""WITH {LINES}, {RUNNING},
m AS (SELECT doc_id, line_no, font_size, y, CASE WHEN k = 11 THEN '-12.5%' ELSE CASE k WHEN 3 THEN '- ' WHEN 4 THEN '7. ' WHEN 7 THEN 'Note: ' WHEN 8 THEN 'Figure 3. ' WHEN 9 THEN 'Table 2 ' WHEN 10 THEN '# ' ELSE '' END || text END AS text FROM run)
SELECT doc_id, line_no, font_size <= 10 AND (y >= 740 OR y <= 60) AS running, {PAGE_NO} AS page_number, font_size <= 10 AND y >= 740 AND regexp_matches(text, '[A-Za-z]') AS running_title,
    regexp_matches(trim(text), '^(?:[-*]|(\\d+)[.)])\\s+(.+)$') AS list_item, TRY_CAST(nullif(regexp_extract(trim(text), '^(?:[-*]|(\\d+)[.)])\\s+(.+)$', 1), '') AS BIGINT) AS list_number,
    regexp_matches(ltrim(text), '^([#>]|\\d+[.)]\\s|[-+]\\s)') AS block_start, regexp_matches(text, '(?i)^(note|tip|warning|important|caution):\\s+') AS callout,
    CASE WHEN regexp_matches(text, '(?i)^fig(?:ure|\\.)?\\s+\\d+\\b') THEN 'figure' WHEN regexp_matches(text, '(?i)^table\\s+\\d+\\b') THEN 'table' END AS caption,
    regexp_matches(trim(text), '^[-+]?\\d+(?:\\.\\d+)?%?$') AS numeric, regexp_matches(rtrim(text), '[.!?:;)。！？．｡]$') AS terminal
FROM m"""


# A1, B2, W3, T-2: font sizes and headings

def _sized(lines: DataFrame) -> DataFrame:
    k = F.col("k")
    return lines.withColumn("font_size", F.when(k == 0, 22.0).when(k.isin(1, 2), 16.0).when(k == 3, 10.75).when((k >= 4) & (k <= 9), 11.0).otherwise(12.0))


SIZED = """sized AS (SELECT doc_id, line_no, page_index, k, x, y, width, height, text, CASE WHEN k = 0 THEN 22.0 WHEN k IN (1, 2) THEN 16.0 WHEN k = 3 THEN 10.75 WHEN k BETWEEN 4 AND 9 THEN 11.0 ELSE 12.0 END::DOUBLE AS font_size FROM lines),
halves AS (SELECT *, floor(font_size * 2 + 0.5) / 2 AS half FROM sized),
body AS (SELECT doc_id, coalesce(max(CASE WHEN r = 1 THEN half END), 12.0) AS body_size FROM (
    SELECT doc_id, half, row_number() OVER (PARTITION BY doc_id ORDER BY has DESC, n DESC, half) AS r FROM (
        SELECT doc_id, CASE WHEN trim(text) <> '' THEN half END AS half, CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END AS has, count(*) AS n FROM halves GROUP BY 1, 2, 3)) GROUP BY doc_id)"""
LEVELS = """ranks AS (SELECT doc_id, half, rk FROM (SELECT doc_id, half, dense_rank() OVER (PARTITION BY doc_id ORDER BY half DESC) AS rk FROM (
    SELECT DISTINCT h.doc_id, h.half FROM halves h JOIN body b USING (doc_id) WHERE trim(h.text) <> '' AND h.half >= greatest(15.0, b.body_size + 2))) WHERE rk <= 6),
leveled AS (SELECT h.*, CAST(r.rk AS INT) AS heading_level FROM halves h LEFT JOIN ranks r ON r.doc_id = h.doc_id AND r.half = h.half)"""


def dominant_font_size(spark, sf_dir):
    return B.dominant_font_size(_sized(_lines(spark, sf_dir)))


SQL["dominant_font_size"] = f"WITH {LINES}, {SIZED} SELECT doc_id, body_size FROM body"


def heading_levels(spark, sf_dir):
    return B.heading_levels(_sized(_lines(spark, sf_dir))).select("doc_id", "line_no", "font_size", "heading_level")


SQL["heading_levels"] = f"WITH {LINES}, {SIZED}, {LEVELS} SELECT doc_id, line_no, font_size, heading_level FROM leveled"


# paragraphs

def _spaced(lines: DataFrame) -> DataFrame:
    i = F.expr("pmod(line_no, 46)")
    k = F.col("k")
    t = F.when(k == 6, F.concat(F.regexp_replace("text", "[.!?:;)]+$", ""), F.lit("-"))).when(F.expr("pmod(doc_id * 7 + line_no - 1, 20)") == 6, F.lower("text")).when(k < 12, F.regexp_replace("text", "[.!?:;)]+$", "")).otherwise(F.col("text"))
    return lines.withColumn("y", F.col("y") - 4.0 * F.pmod(i, F.lit(4))).withColumn("text", t)


SPACED = r"""spaced AS (SELECT doc_id, line_no, page_index, x, y - 4.0 * ((line_no % 46) % 4) AS y, width, font_size, k,
    CASE WHEN k = 6 THEN regexp_replace(text, '[.!?:;)]+$', '') || '-' WHEN (doc_id * 7 + line_no - 1) % 20 = 6 THEN lower(text) WHEN k < 12 THEN regexp_replace(text, '[.!?:;)]+$', '') ELSE text END AS text FROM lines),
flags AS (SELECT *, CASE WHEN coalesce(lag(page_index) OVER w = page_index AND abs(lag(x) OVER w - x) <= 4 AND abs(lag(font_size) OVER w - font_size) <= 0.5 AND lag(y) OVER w - y > 0
        AND lag(y) OVER w - y <= greatest(14.0, 1.35 * font_size) AND NOT regexp_matches(rtrim(lag(text) OVER w), '[.!?:;)。！？．｡]$') AND trim(text) <> '' AND trim(lag(text) OVER w) <> '', FALSE) THEN 0 ELSE 1 END AS fresh
    FROM spaced WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
paras AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph_no FROM flags)"""


def paragraph_islands(spark, sf_dir):
    return B.paragraph_islands(_spaced(_lines(spark, sf_dir))).groupBy("doc_id", "paragraph_no").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


SQL["paragraph_islands"] = f"WITH {LINES}, {SPACED} SELECT doc_id, paragraph_no, min(line_no) AS first_line, count(*) AS n_lines FROM paras GROUP BY 1, 2"


def paragraph_join(spark, sf_dir):
    return B.join_parts(B.paragraph_islands(_spaced(_lines(spark, sf_dir))), ["doc_id", "paragraph_no"])


SQL["paragraph_join"] = f"""WITH {LINES}, {SPACED},
norm AS (SELECT doc_id, paragraph_no, line_no, {_norm('text')} AS t FROM paras),
parts AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, paragraph_no ORDER BY line_no) AS nxt FROM norm)
SELECT doc_id, paragraph_no, string_agg(CASE WHEN nxt IS NULL THEN t WHEN regexp_matches(t, '[A-Za-z]-$') AND regexp_matches(nxt, '^[a-z]') THEN left(t, length(t) - 1) ELSE t || ' ' END, '' ORDER BY line_no) AS text,
    min(line_no) AS first_line, count(*) AS n_lines FROM parts GROUP BY 1, 2"""


# lists

def _listed(lines: DataFrame) -> DataFrame:
    k = F.col("k")
    t = F.when(k.isin(3, 4, 5), F.concat(F.lit("- "), F.col("text"))).when(k.isin(6, 7), F.concat(F.col("line_no").cast("string"), F.lit(") "), F.col("text"))).otherwise(F.col("text"))
    return lines.withColumn("text", t).withColumn("x", F.when(k.isin(4, 7), 96.0).when(k == 5, 100.0).otherwise(F.col("x")))


LISTED = r"""listed AS (SELECT doc_id, line_no, CASE WHEN k IN (4, 7) THEN 96.0 WHEN k = 5 THEN 100.0 ELSE x END AS x,
    CASE WHEN k IN (3, 4, 5) THEN '- ' || text WHEN k IN (6, 7) THEN line_no || ') ' || text ELSE text END AS text FROM lines)"""


def list_items(spark, sf_dir):
    lines = _listed(_lines(spark, sf_dir)).where(T.is_list_item("text"))
    return lines.select("doc_id", "line_no", T.list_number("text").alias("number"), T.list_depth_text(F.lit(1), T.list_number("text"), T.list_text("text")).alias("text"))


_ITEM = r"'^(?:[-*]|(\d+)[.)])\s+(.+)$'"
SQL["list_items"] = f"""WITH {LINES}, {LISTED}, items AS (SELECT doc_id, line_no, TRY_CAST(nullif(regexp_extract(trim(text), {_ITEM}, 1), '') AS BIGINT) AS number, regexp_extract(trim(text), {_ITEM}, 2) AS t FROM listed WHERE regexp_matches(trim(text), {_ITEM}))
SELECT doc_id, line_no, number, '  ' || CASE WHEN number IS NULL THEN '- ' ELSE number || '. ' END || t AS text FROM items"""

_PLAIN = "regexp_replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_\\[\\]])', '\\\\\\1', 'g')"


def list_blocks(spark, sf_dir):
    lines = _listed(_lines(spark, sf_dir).withColumn("text", F.translate("text", "@", " ")))
    return B.list_blocks(lines)


SQL["list_blocks"] = f"""WITH {LINES.replace("6.0::DOUBLE * length(text)", "6.0::DOUBLE").replace("page_index, text,", "page_index, translate(text, '@', ' ') AS text,")}, {LISTED},
m AS (SELECT *, regexp_matches(trim(text), {_ITEM}) AS item FROM listed),
s AS (SELECT *, sum(CASE WHEN item AND NOT coalesce(lag_item, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS list_no FROM (SELECT *, lag(item) OVER (PARTITION BY doc_id ORDER BY line_no) AS lag_item FROM m)),
i AS (SELECT doc_id, line_no, CAST(list_no AS BIGINT) AS list_no, TRY_CAST(nullif(regexp_extract(trim(text), {_ITEM}, 1), '') AS BIGINT) AS number, {_PLAIN.format(f"regexp_extract(trim(text), {_ITEM}, 2)")} AS t,
    CASE WHEN x >= 90 AND min(x) OVER (PARTITION BY doc_id) < 90 THEN 1 ELSE 0 END AS lvl FROM s WHERE item)
SELECT doc_id, list_no, min(line_no) AS first_line, count(*) AS n_items, string_agg(repeat('  ', lvl) || CASE WHEN number IS NULL THEN '- ' ELSE number || '. ' END || t, chr(10) ORDER BY line_no) AS text FROM i GROUP BY 1, 2"""


# Code; P7, B7: equations

def _coded(lines: DataFrame) -> DataFrame:
    k = F.col("k")
    t = F.when(k == 12, F.concat(F.lit("a"), F.col("line_no").cast("string"), F.lit(" = b + 1"))).when(k == 15, F.concat(F.lit("run ``"), F.col("line_no").cast("string"))).when(k == 16, F.lit("return x;")).when(k == 17, F.lit("return `y`;")).otherwise(F.lit("plain"))
    return lines.withColumn("text", t).withColumn("x", F.when(k == 12, 120.0).when(k.isin(16, 17), 108.0).otherwise(F.col("x"))).withColumn("width", F.when(k == 12, 60.0).otherwise(400.0)).withColumn("base_font", F.when(k == 15, "Courier"))


CODED = """coded AS (SELECT doc_id, line_no, page_index, y, font_size, CASE WHEN k = 12 THEN 120.0 WHEN k IN (16, 17) THEN 108.0 ELSE x END AS x, CASE WHEN k = 12 THEN 60.0 ELSE 400.0 END AS width, k = 15 AS mono,
    CASE WHEN k = 12 THEN 'a' || line_no || ' = b + 1' WHEN k = 15 THEN 'run ``' || line_no WHEN k = 16 THEN 'return x;' WHEN k = 17 THEN 'return `y`;' ELSE 'plain' END AS text, k FROM lines)"""


def code_blocks(spark, sf_dir):
    return B.code_blocks(_coded(_lines(spark, sf_dir)))


SQL["code_blocks"] = f"""WITH {LINES}, {CODED},
m AS (SELECT *, mono OR (x >= min(x) OVER (PARTITION BY doc_id) + 32 AND text LIKE '%;') AS code FROM coded),
f AS (SELECT *, CASE WHEN code AND NOT coalesce(lag(code) OVER w AND lag(page_index) OVER w = page_index AND lag(y) OVER w - y > 0 AND lag(y) OVER w - y <= 24, FALSE) THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS code_no FROM f),
t AS (SELECT *, repeat(' ', CAST(floor((x - min(x) OVER (PARTITION BY doc_id, code_no)) / 12 + 0.5) AS INT)) || rtrim(text) AS line FROM g WHERE code),
b AS (SELECT doc_id, code_no, min(line_no) AS first_line, count(*) AS n_lines, bool_or(mono) AS mono, string_agg(line, chr(10) ORDER BY line_no) AS text FROM t GROUP BY 1, 2)
SELECT doc_id, code_no, first_line, n_lines, text, CASE WHEN text LIKE '%``%' OR text LIKE '%`%' THEN CASE WHEN text LIKE '%```%' THEN '~~~' ELSE '```' END ELSE '```' END AS fence FROM b WHERE mono OR n_lines >= 2"""


def equation_blocks(spark, sf_dir):
    return B.equation_blocks(_coded(_lines(spark, sf_dir)))


SQL["equation_blocks"] = f"""WITH {LINES}, {CODED}, d AS (SELECT *, min(x) OVER (PARTITION BY doc_id) AS l, max(width) OVER (PARTITION BY doc_id) AS w FROM coded),
m AS (SELECT *, k = 12 AND (x - l >= 24 OR width <= 0.72 * w) AS eq FROM d),
f AS (SELECT *, CASE WHEN eq AND NOT coalesce(lag(eq) OVER o AND lag(page_index) OVER o = page_index AND lag(y) OVER o - y > 0 AND lag(y) OVER o - y <= 24, FALSE) THEN 1 ELSE 0 END AS fresh FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equation_no FROM f)
SELECT doc_id, equation_no, min(line_no) AS first_line, count(*) AS n_lines, '$$' || chr(10) || string_agg(trim(text), chr(10) ORDER BY line_no) || chr(10) || '$$' AS text FROM g WHERE eq GROUP BY 1, 2"""


# strings

def _marked(lines: DataFrame) -> DataFrame:
    k = F.col("k")
    t = F.when(k == 11, F.concat(F.lit("_x_ <b>[1]*"), F.col("text"))).when(k == 12, F.concat(F.lit("a \\ `b` & "), F.col("text"))).when(k == 13, F.concat(F.lit("# "), F.col("text"))).when(k == 14, F.concat(F.lit("3. "), F.col("text"))).when(k == 15, F.concat(F.lit("+ plus "), F.col("text"))).otherwise(F.col("text"))
    return lines.withColumn("text", F.translate(t, "@", " "))


MARKED = r"""marked AS (SELECT doc_id, line_no, translate(CASE k WHEN 11 THEN '_x_ <b>[1]*' || text WHEN 12 THEN 'a \ `b` & ' || text WHEN 13 THEN '# ' || text WHEN 14 THEN '3. ' || text WHEN 15 THEN '+ plus ' || text ELSE text END, '@', ' ') AS text FROM lines)"""


def markdown_escape(spark, sf_dir):
    lines = _marked(_lines(spark, sf_dir))
    return lines.select("doc_id", "line_no", T.escape_markdown("text").alias("escaped"), T.escape_paragraph("text").alias("paragraph"), T.escape_cell("text").alias("cell"), T.escape_html("text").alias("html"), T.truncate("text").alias("short"))


_ESC = _PLAIN.format("text")
SQL["markdown_escape"] = f"""WITH {LINES}, {MARKED}, e AS (SELECT *, {_ESC} AS escaped FROM marked)
SELECT doc_id, line_no, escaped, regexp_replace(regexp_replace(escaped, '^([#+-])', '\\\\\\1'), '^(\\d+)([.)]\\s)', '\\1\\\\\\2') AS paragraph, replace(escaped, '|', '\\|') AS cell,
    replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS short FROM e"""


def autolinks(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    k, n = F.col("k"), F.col("line_no").cast("string")
    t = F.when(k == 5, F.concat(F.lit("see https://example.org/p"), n, F.lit(". And"))).when(k == 6, F.concat(F.lit("(www.example.org/a_b"), n, F.lit(") or"))).when(k == 7, F.concat(F.lit("mail ann.b@example.org, x_y"))).otherwise(F.lit("none here_"))
    return lines.withColumn("text", t).select("doc_id", "line_no", F.array_join(F.transform(T.links("text"), T.link_target), " ").alias("targets"), T.escape_inline("text").alias("markdown"))


SQL["autolinks"] = f"""WITH {LINES}
SELECT doc_id, line_no, CASE k WHEN 5 THEN 'https://example.org/p' || line_no WHEN 6 THEN 'https://www.example.org/a_b' || line_no WHEN 7 THEN 'mailto:ann.b@example.org' ELSE '' END AS targets,
    CASE k WHEN 5 THEN 'see <https://example.org/p' || line_no || '>. And' WHEN 6 THEN '([www.example.org/a\\_b' || line_no || '](https://www.example.org/a_b' || line_no || ')) or' WHEN 7 THEN 'mail <ann.b@example.org>, x\\_y' ELSE 'none here\\_' END AS markdown FROM lines"""


def comparable_text(spark, sf_dir):
    lines = _marked(_lines(spark, sf_dir))
    return lines.select("doc_id", "line_no", T.comparable_text("text").alias("comparable"), F.array_join(T.tokens("text"), " ").alias("tokens"), T.direction("text").alias("direction"), T.normalize_text("text").alias("normal"), T.occurrences(F.col("text"), F.lit("er")).alias("n_er"))


SQL["comparable_text"] = f"""WITH {LINES}, {MARKED}
SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^#{{1,6}}\\s+', ''), '^\\s*(?:[-*+]|\\d+[.)])\\s+', ''), '\\\\([\\\\`*_\\[\\]#+.()|-])', '\\1', 'g'), '[|`*_<>]+', ' ', 'g'), '\\s+', ' ', 'g')) AS comparable,
    array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') AS tokens, CASE WHEN len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) > 0 THEN 'ltr' ELSE 'unknown' END AS direction,
    {_norm('text')} AS normal, CAST((length(text) - length(replace(text, 'er', ''))) / 2 AS BIGINT) AS n_er FROM marked"""


# layout

def _columns(lines: DataFrame) -> DataFrame:
    """Even documents: two columns on each page, the second half of its lines on the right; a line over both in the middle."""
    i = F.expr("pmod(line_no, 46)")
    two = (F.col("doc_id") % 2 == 0)
    return lines.withColumn("x", F.when(two & (i >= 20) & (i < 40), 324.0).otherwise(72.0)).withColumn("y", F.when(two & (i >= 20) & (i < 40), 720.0 - 14 * (i - 20)).when(two & (i >= 40), 720.0 - 14 * (i - 20)).otherwise(F.col("y"))).withColumn("width", F.when(two & (i == 40), 480.0).otherwise(200.0))


COLUMNS = """cols AS (SELECT doc_id, line_no, page_index, text, font_size, line_no % 46 AS i, doc_id % 2 = 0 AS two,
    CASE WHEN doc_id % 2 = 0 AND line_no % 46 BETWEEN 20 AND 39 THEN 324.0 ELSE 72.0 END AS x,
    CASE WHEN doc_id % 2 = 0 AND line_no % 46 >= 20 THEN 720.0 - 14 * (line_no % 46 - 20) ELSE y END AS y, count(*) FILTER (WHERE doc_id % 2 = 0 AND line_no % 46 BETWEEN 20 AND 39) OVER (PARTITION BY doc_id, page_index) AS n_right FROM lines)"""


def reading_order_columns(spark, sf_dir):
    return L.reading_order(_columns(_lines(spark, sf_dir))).select("doc_id", "line_no", "column_no", "reading_no")


SQL["reading_order_columns"] = f"""WITH {LINES}, {COLUMNS},
p AS (SELECT *, two AND n_right >= 2 AS many FROM cols),
s AS (SELECT *, many AND i = 40 AS spans, CASE WHEN NOT many THEN 0 WHEN i < 40 AND i >= 20 THEN 1 ELSE 0 END AS c FROM p),
g AS (SELECT *, 2 * sum(CASE WHEN spans THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY y DESC, x, line_no ROWS UNBOUNDED PRECEDING) - CASE WHEN spans THEN 1 ELSE 0 END AS seg FROM s)
SELECT doc_id, line_no, CAST(CASE WHEN spans THEN 0 ELSE c END AS INT) AS column_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, seg, CASE WHEN spans THEN 0 ELSE c END, -y, x, line_no) - 1 AS INT) AS reading_no FROM g"""


def row_groups(spark, sf_dir):
    k = F.col("k")
    lines = _lines(spark, sf_dir)
    moved = lines.withColumn("y", F.when(k.isin(17, 13), F.col("y") + 14 - 1.5).otherwise(F.col("y"))).withColumn("x", F.when(k.isin(17, 13), 300.0).otherwise(F.col("x")))
    return L.group_rows(moved).select("doc_id", "page_index", "row_no", F.size("line_nos").cast("long").alias("n_lines"), F.array_join(F.transform("line_nos", lambda x: x.cast("string")), ",").alias("line_nos"))


SQL["row_groups"] = f"""WITH {LINES},
m AS (SELECT doc_id, page_index, line_no, CASE WHEN k IN (13, 17) THEN y + 12.5 ELSE y END AS y FROM lines),
f AS (SELECT *, CASE WHEN coalesce(abs(lag(y) OVER w - y) <= 3.0, FALSE) THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y DESC, line_no)),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id, page_index ORDER BY y DESC, line_no ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS row_no FROM f)
SELECT doc_id, page_index, row_no, count(*) AS n_lines, string_agg(line_no::VARCHAR, ',' ORDER BY y DESC, line_no) AS line_nos FROM r GROUP BY 1, 2, 3"""


def layout_regions(spark, sf_dir):
    k = F.col("k")
    lines = _running(_lines(spark, sf_dir))
    t = F.when(k == 7, F.concat(F.lit("Note: "), F.col("text"))).when(k == 8, F.concat(F.lit("Figure 4. "), F.col("text"))).when(k == 9, F.concat(F.lit("Table 1. "), F.col("text"))).when(k == 10, F.concat(F.lit("2. "), F.col("text"))).otherwise(F.col("text"))
    lines = lines.withColumn("text", t).withColumn("y", F.when(k == 10, 100.0).otherwise(F.col("y"))).withColumn("font_size", F.when(k == 10, 8.0).otherwise(F.col("font_size")))
    return L.layout_regions(lines).select("doc_id", "line_no", "kind", "target", "y")


SQL["layout_regions"] = f"""WITH {LINES}, {RUNNING} SELECT doc_id, line_no, CASE k WHEN 19 THEN 'page_number' WHEN 7 THEN 'callout' WHEN 10 THEN 'footnote' ELSE 'caption' END AS kind,
    CASE k WHEN 8 THEN 'figure' WHEN 9 THEN 'table' END AS target, CASE WHEN k = 10 THEN 100.0 ELSE y END AS y FROM run WHERE k IN (7, 8, 9, 10, 19)"""


def layout_kinds(spark, sf_dir):
    return L.layout_kind(_columns(_lines(spark, sf_dir)))


SQL["layout_kinds"] = f"""WITH {LINES}, {COLUMNS} SELECT doc_id, page_index, CASE WHEN max(n_right) >= 2 THEN 2 ELSE 1 END AS n_columns, CASE WHEN max(n_right) >= 2 THEN 'multi-column' ELSE 'single-column' END AS kind FROM cols GROUP BY 1, 2"""


def text_ordering_warnings(spark, sf_dir):
    lines = _columns(_lines(spark, sf_dir))
    return W.ordering_warnings(lines).select("doc_id", "code", "page_index", "line_no")


SQL["text_ordering_warnings"] = f"""WITH {LINES}, {COLUMNS},
j AS (SELECT *, lag(page_index) OVER w = page_index AND y - lag(y) OVER w > greatest(6.0, 0.5 * font_size) AND abs(x - lag(x) OVER w) > 96 AS jump FROM cols WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, 'text.ordering_uncertain' AS code, page_index, min(line_no) AS line_no FROM j WHERE jump GROUP BY doc_id, page_index"""


# SNK1, W6, B1: Markdown documents

def _document_lines(spark, sf_dir) -> DataFrame:
    """Sized lines with running content taken out, in the flagship's geometry."""
    lines = _running(_sized(_lines(spark, sf_dir)).withColumnRenamed("font_size", "_s")).withColumn("font_size", F.when(F.col("k") >= 17, 9.0).otherwise(F.col("_s"))).drop("_s")
    clean = F.when(F.col("k").isin(0, 1, 2), F.translate("text", "@", " ")).otherwise(F.translate("text", "@", " "))
    return L.remove_running_content(lines.withColumn("text", clean))


def markdown_document(spark, sf_dir):
    """The flagship: documents as Markdown, one row each."""
    return B.markdown_documents(B.document_blocks(_document_lines(spark, sf_dir)))


def source_map(spark, sf_dir):
    return B.source_map(B.document_blocks(_document_lines(spark, sf_dir)))


DOCUMENT = rf"""doc0 AS (
    SELECT doc_id, line_no, page_index, k, x, translate(CASE WHEN k = 18 THEN 'Annual  report header' WHEN k = 19 THEN 'Page ' || (page_index + 1) WHEN k = 17 THEN 'once ' || line_no ELSE text END, '@', ' ') AS text,
        CASE WHEN k = 18 THEN 760.0 WHEN k = 19 THEN 40.0 WHEN k = 17 THEN 750.0 ELSE y END AS y,
        CASE WHEN k >= 17 THEN 9.0 WHEN k = 0 THEN 22.0 WHEN k IN (1, 2) THEN 16.0 WHEN k = 3 THEN 10.75 WHEN k BETWEEN 4 AND 9 THEN 11.0 ELSE 12.0 END::DOUBLE AS font_size FROM lines),
doc1 AS (SELECT *, count(*) FILTER (WHERE font_size <= 10 AND (y >= 740 OR y <= 60)) OVER (PARTITION BY doc_id, {_norm('text')}) AS n FROM doc0),
kept AS (SELECT *, floor(font_size * 2 + 0.5) / 2 AS half FROM doc1 WHERE NOT {PAGE_NO} AND NOT (font_size <= 10 AND (y >= 740 OR y <= 60) AND n >= 2)),
body AS (SELECT doc_id, half AS body_size FROM (SELECT doc_id, half, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, half) AS r FROM kept WHERE trim(text) <> '' GROUP BY doc_id, half) WHERE r = 1),
ranks AS (SELECT doc_id, half, rk FROM (SELECT doc_id, half, dense_rank() OVER (PARTITION BY doc_id ORDER BY half DESC) AS rk FROM (
    SELECT DISTINCT h.doc_id, h.half FROM kept h JOIN body b USING (doc_id) WHERE trim(h.text) <> '' AND h.half >= greatest(15.0, b.body_size + 2))) WHERE rk <= 6),
typed AS (SELECT h.*, r.rk AS level, {_norm('h.text')} AS t, CASE WHEN r.rk IS NOT NULL THEN 'heading' WHEN regexp_matches(trim(h.text), {_ITEM}) THEN 'list' ELSE 'paragraph' END AS kind
    FROM kept h LEFT JOIN ranks r ON r.doc_id = h.doc_id AND r.half = h.half WHERE trim(h.text) <> ''),
marks AS (SELECT *, CASE WHEN coalesce(CASE kind WHEN 'list' THEN lag(kind) OVER w = 'list' WHEN 'paragraph' THEN lag(kind) OVER w = 'paragraph' AND lag(page_index) OVER w = page_index AND abs(lag(x) OVER w - x) <= 4
        AND abs(lag(font_size) OVER w - font_size) <= 0.5 AND lag(y) OVER w - y > 0 AND lag(y) OVER w - y <= greatest(14.0, 1.35 * font_size) AND NOT regexp_matches(rtrim(lag(text) OVER w), '[.!?:;)。！？．｡]$') ELSE FALSE END, FALSE) THEN 0 ELSE 1 END AS fresh
    FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
nos AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS block_no FROM marks),
nexts AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, block_no ORDER BY line_no) AS nxt FROM nos),
joined AS (SELECT doc_id, block_no, kind, max(level) AS level, string_agg(CASE kind WHEN 'heading' THEN t WHEN 'list' THEN CASE WHEN regexp_extract(t, {_ITEM}, 1) = '' THEN '- ' ELSE regexp_extract(t, {_ITEM}, 1) || '. ' END || {_PLAIN.format(f'regexp_extract(t, {_ITEM}, 2)')} || CASE WHEN nxt IS NULL THEN '' ELSE chr(10) END
    ELSE CASE WHEN nxt IS NULL THEN t WHEN regexp_matches(t, '[A-Za-z]-$') AND regexp_matches(nxt, '^[a-z]') THEN left(t, length(t) - 1) ELSE t || ' ' END END, '' ORDER BY line_no) AS t FROM nexts GROUP BY 1, 2, 3),
blocks AS (SELECT doc_id, block_no, kind, CASE kind WHEN 'heading' THEN repeat('#', CAST(level AS INT)) || ' ' || {_PLAIN.format('t')} WHEN 'list' THEN t ELSE regexp_replace(regexp_replace({_PLAIN.format('t')}, '^([#+-])', '\\\1'), '^(\d+)([.)]\s)', '\1\\\2') END AS text FROM joined)"""

SQL["markdown_document"] = f"WITH {LINES}, {DOCUMENT} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) || chr(10) AS markdown, count(*) AS n_blocks FROM blocks GROUP BY doc_id"
SQL["source_map"] = f"""WITH {LINES}, {DOCUMENT}, m AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS md_start FROM blocks)
SELECT doc_id, block_no, kind, md_start, md_start + length(text) AS md_end FROM m"""


QUERIES = {
    "lines_from_documents": lines_of_documents,
    "running_content_removal": running_content_removal,
    "line_predicates": line_predicates,
    "dominant_font_size": dominant_font_size,
    "heading_levels": heading_levels,
    "paragraph_islands": paragraph_islands,
    "paragraph_join": paragraph_join,
    "list_items": list_items,
    "list_blocks": list_blocks,
    "code_blocks": code_blocks,
    "equation_blocks": equation_blocks,
    "markdown_escape": markdown_escape,
    "autolinks": autolinks,
    "comparable_text": comparable_text,
    "reading_order_columns": reading_order_columns,
    "row_groups": row_groups,
    "layout_regions": layout_regions,
    "layout_kinds": layout_kinds,
    "text_ordering_warnings": text_ordering_warnings,
    "markdown_document": markdown_document,
    "source_map": source_map,
}
