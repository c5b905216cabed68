"""Queries over tables, page images, OCR boxes and evaluation, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import figures as FG
from ..operators import metrics as M
from ..operators import ocr as O
from ..operators import raster as R
from ..operators import tables as TB
from ..operators import warnings as W
from ..operators.lines import lines_from_html
from .text_queries import LINES, _lines


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL: dict[str, str] = {}

# F12, F14, SNK2, B10: suppliers in tables of ten rows under a header row


def _cells(spark, sf_dir) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("table_id"), (F.pmod(F.col("s_suppkey"), F.lit(10)) + 1).cast("int").alias("row_index"), "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    cell = lambda c, v: F.struct(F.lit(c).alias("column_index"), v.cast("string").alias("text"))
    note = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("a|b, \"c\" <"), F.col("s_nationkey").cast("string"), F.lit(">"))).otherwise(F.concat(F.lit("=1+"), F.col("s_nationkey").cast("string")))
    body = s.select("table_id", "row_index", F.explode(F.array(cell(0, F.col("s_suppkey")), cell(1, F.col("s_name")), cell(2, F.floor("s_acctbal").cast("long")), cell(3, note))).alias("c")).select("table_id", "row_index", "c.column_index", "c.text")
    heads = F.array(*[cell(i, F.lit(h)) for i, h in enumerate(("Key", "Name", "Balance", "Note"))])
    head = s.select("table_id").distinct().select("table_id", F.lit(0).alias("row_index"), F.explode(heads).alias("c")).select("table_id", "row_index", "c.column_index", "c.text")
    return head.unionByName(body)


CELLS = """sup AS (SELECT s_suppkey // 10 AS table_id, CAST(s_suppkey % 10 + 1 AS INT) AS row_index, * FROM supplier),
cells AS (
    SELECT table_id, row_index, 0 AS column_index, s_suppkey::VARCHAR AS text FROM sup UNION ALL SELECT table_id, row_index, 1, s_name FROM sup UNION ALL SELECT table_id, row_index, 2, CAST(floor(s_acctbal) AS BIGINT)::VARCHAR FROM sup
    UNION ALL SELECT table_id, row_index, 3, CASE WHEN s_suppkey % 3 = 0 THEN 'a|b, "c" <' || s_nationkey || '>' ELSE '=1+' || s_nationkey END FROM sup
    UNION ALL SELECT DISTINCT table_id, 0, c, h FROM sup, (VALUES (0, 'Key'), (1, 'Name'), (2, 'Balance'), (3, 'Note')) v(c, h))"""


def gfm_table(spark, sf_dir):
    return TB.gfm_tables(_cells(spark, sf_dir))


SQL["gfm_table"] = rf"""WITH {CELLS},
esc AS (SELECT *, replace(regexp_replace(replace(replace(replace(trim(text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]])', '\\\1', 'g'), '|', '\|') AS t FROM cells),
num AS (SELECT table_id, column_index, coalesce(bool_and(regexp_matches(text, '^[-+]?\d+(?:\.\d+)?%?$')) FILTER (WHERE row_index > 0), FALSE) AS n FROM cells GROUP BY 1, 2),
rule AS (SELECT table_id, '| ' || string_agg(CASE WHEN n THEN '---:' ELSE '---' END, ' | ' ORDER BY column_index) || ' |' AS line FROM num GROUP BY 1),
r AS (SELECT table_id, row_index, '| ' || string_agg(t, ' | ' ORDER BY column_index) || ' |' AS line FROM esc GROUP BY 1, 2),
u AS (SELECT table_id, row_index * 2 AS o, line FROM r UNION ALL SELECT table_id, 1, line FROM rule)
SELECT table_id, string_agg(line, chr(10) ORDER BY o) AS markdown FROM u GROUP BY 1"""


def html_table(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("column_span", F.when((F.col("row_index") == 0) & (F.col("column_index") == 2), 2).otherwise(1)).withColumn("covered", (F.col("row_index") == 0) & (F.col("column_index") == 3))
    return TB.html_tables(cells)


SQL["html_table"] = f"""WITH {CELLS},
c AS (SELECT table_id, row_index, column_index, CASE WHEN row_index = 0 THEN 'th' ELSE 'td' END AS tag, CASE WHEN row_index = 0 AND column_index = 2 THEN ' colspan="2"' ELSE '' END AS span,
    replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM cells WHERE NOT (row_index = 0 AND column_index = 3)),
r AS (SELECT table_id, row_index, '    <tr>' || chr(10) || string_agg('      <' || tag || span || '>' || t || '</' || tag || '>' || chr(10), '' ORDER BY column_index) || '    </tr>' || chr(10) AS line FROM c GROUP BY 1, 2)
SELECT table_id, '<table>' || chr(10) || '  <thead>' || chr(10) || string_agg(line, '') FILTER (WHERE row_index = 0) || '  </thead>' || chr(10) || coalesce('  <tbody>' || chr(10) || string_agg(line, '' ORDER BY row_index) FILTER (WHERE row_index > 0) || '  </tbody>' || chr(10), '') || '</table>' AS html FROM r GROUP BY 1"""


def csv_sidecar(spark, sf_dir):
    csv = TB.csv_sidecars(_cells(spark, sf_dir))
    named = TB.sidecar_names(csv.select(F.lit(0).alias("doc_id"), F.floor(F.col("table_id") / 3).cast("int").alias("page_index"), F.col("table_id").alias("table_no"), "csv"))
    return named.select("table_no", "asset_id", "path", "csv")


SQL["csv_sidecar"] = rf"""WITH {CELLS},
g AS (SELECT *, CASE WHEN regexp_matches(trim(text), '^[=+\-@]') THEN '''' || trim(text) ELSE trim(text) END AS t FROM cells),
q AS (SELECT *, CASE WHEN regexp_matches(t, '[",\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS f FROM g),
r AS (SELECT table_id, row_index, string_agg(f, ',' ORDER BY column_index) AS line FROM q GROUP BY 1, 2),
t AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row_index) || chr(10) AS csv FROM r GROUP BY 1)
SELECT table_id AS table_no, 'table-page-' || (table_id // 3 + 1) || '-' || row_number() OVER (PARTITION BY table_id // 3 ORDER BY table_id) || '-csv' AS asset_id,
    'assets/table-page-' || (table_id // 3 + 1) || '-' || row_number() OVER (PARTITION BY table_id // 3 ORDER BY table_id) || '-csv.csv' AS path, csv FROM t"""


def numeric_columns(spark, sf_dir):
    return TB.numeric_columns(_cells(spark, sf_dir))


SQL["numeric_columns"] = rf"""WITH {CELLS} SELECT table_id, column_index, coalesce(bool_and(regexp_matches(text, '^[-+]?\d+(?:\.\d+)?%?$')) FILTER (WHERE row_index > 0), FALSE) AS is_numeric, count(*) FILTER (WHERE row_index > 0) AS n_body FROM cells GROUP BY 1, 2"""


def table_confidence(spark, sf_dir):
    return TB.borderless_confidence(_cells(spark, sf_dir))


SQL["table_confidence"] = rf"""WITH {CELLS},
num AS (SELECT table_id, column_index, coalesce(bool_and(regexp_matches(text, '^[-+]?\d+(?:\.\d+)?%?$')) FILTER (WHERE row_index > 0), FALSE) AS n FROM cells GROUP BY 1, 2),
a AS (SELECT table_id, avg(CASE WHEN n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM num GROUP BY 1), b AS (SELECT table_id, count(DISTINCT row_index) AS n_rows FROM cells GROUP BY 1)
SELECT table_id, n_rows, CASE WHEN ratio > 0 THEN floor(least(0.85::DOUBLE, 0.55::DOUBLE + 0.25::DOUBLE * ratio + CASE WHEN n_rows >= 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS confidence FROM a JOIN b USING (table_id)"""

# Accuracy of a table whose cells were changed


def _changed(cells: DataFrame) -> DataFrame:
    hit = (F.col("row_index") * 5 + F.col("column_index") + F.col("table_id")) % 7 == 0
    return cells.withColumn("text", F.when(hit, F.lit("changed")).otherwise(F.col("text")))


CHANGED = "changed AS (SELECT table_id, row_index, column_index, CASE WHEN (row_index * 5 + column_index + table_id) % 7 = 0 THEN 'changed' ELSE text END AS text FROM cells)"
_SCORES = """CASE WHEN n_actual > 0 THEN n_matched / n_actual WHEN n_expected = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN n_expected > 0 THEN n_matched / n_expected WHEN n_actual = 0 THEN 1.0 ELSE 0.0 END AS recall"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1"


def _match_sql(by: str, keys: str, e: str, a: str) -> str:
    """Multiset match of relations e and a (by, keys, n)."""
    using = f"{by}, {keys}" if keys else by
    return f"""m AS (SELECT {by}, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS n_expected, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS n_actual, CAST(coalesce(sum(CASE WHEN e.n IS NOT NULL AND a.n IS NOT NULL THEN least(e.n, a.n) END), 0) AS BIGINT) AS n_matched
    FROM {e} e FULL JOIN {a} a USING ({using}) GROUP BY {by}), s AS (SELECT *, {_SCORES} FROM m)"""


def _pairs_sql(name: str, src: str) -> str:
    return f"""{name}0 AS (SELECT table_id, row_index, column_index, lower(trim(text)) AS a FROM {src} WHERE trim(text) <> ''),
{name}1 AS (SELECT table_id, 'right' AS way, a, lead(a) OVER (PARTITION BY table_id, row_index ORDER BY column_index) AS b FROM {name}0 UNION ALL SELECT table_id, 'down', a, lead(a) OVER (PARTITION BY table_id, column_index ORDER BY row_index) FROM {name}0),
{name} AS (SELECT table_id, way, a, b, count(*) AS n FROM {name}1 WHERE b IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def cell_adjacency(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return TB.multiset_match(TB.adjacency_pairs(cells), TB.adjacency_pairs(_changed(cells)), ["table_id"], ["way", "a", "b"])


SQL["cell_adjacency"] = f"WITH {CELLS}, {CHANGED}, {_pairs_sql('pe', 'cells')}, {_pairs_sql('pa', 'changed')}, {_match_sql('table_id', 'way, a, b', 'pe', 'pa')} SELECT *, {_F1} FROM s"


def csv_accuracy(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    count = lambda d: d.withColumn("t", T.csv_unguard(F.trim("text"))).where("t != ''").groupBy("table_id", "t").agg(F.count(F.lit(1)).alias("n"))
    guarded = _changed(cells).withColumn("text", F.when(F.col("text").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col("text"))).otherwise(F.col("text")))
    return TB.multiset_match(count(cells), count(guarded), ["table_id"], ["t"])


SQL["csv_accuracy"] = f"WITH {CELLS}, {CHANGED}, ce AS (SELECT table_id, trim(text) AS t, count(*) AS n FROM cells WHERE trim(text) <> '' GROUP BY 1, 2), ca AS (SELECT table_id, trim(text) AS t, count(*) AS n FROM changed WHERE trim(text) <> '' GROUP BY 1, 2), {_match_sql('table_id', 't', 'ce', 'ca')} SELECT *, {_F1} FROM s"


def table_precision_recall(spark, sf_dir):
    """All tables at once: keys are format and rows."""
    gfm = TB.gfm_tables(_cells(spark, sf_dir)).select(F.lit("gfm").alias("format"), F.col("markdown").alias("rows"), (F.col("table_id") % 3).alias("g"))
    actual = gfm.withColumn("rows", F.when(F.col("g") == 1, F.concat("rows", F.lit("x"))).otherwise(F.col("rows")))
    count = lambda d: d.groupBy(F.lit("all").alias("report"), "format", "rows").agg(F.count(F.lit(1)).alias("n"))
    return M.micro_average(TB.multiset_match(count(gfm), count(actual), ["report"], ["format", "rows"]))


SQL["table_precision_recall"] = f"""WITH {CELLS}, t AS (SELECT DISTINCT table_id FROM cells), m AS (SELECT count(*) AS n_expected, count(*) AS n_actual, count(*) FILTER (WHERE table_id % 3 <> 1) AS n_matched FROM t), s AS (SELECT *, {_SCORES} FROM m) SELECT *, {_F1} FROM s"""

# Text metrics


def _pairs(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"))
    return d.join(b, F.col("id") % 40 == F.col("item_id")).select("id", "expected", F.col("text").alias("actual"))


PAIRS = "pairs AS (SELECT d.doc_id AS id, b.text AS expected, d.text AS actual FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id)"


def token_coverage(spark, sf_dir):
    return M.text_coverage(_pairs(spark, sf_dir))


SQL["token_coverage"] = f"""WITH {PAIRS},
e AS (SELECT id, unnest(regexp_extract_all(lower(expected), '[\\p{{L}}\\p{{N}}]+')) AS token FROM pairs), a AS (SELECT id, unnest(regexp_extract_all(lower(actual), '[\\p{{L}}\\p{{N}}]+')) AS token FROM pairs),
ec AS (SELECT id, token, count(*) AS n FROM e GROUP BY 1, 2), ac AS (SELECT id, token, count(*) AS n FROM a GROUP BY 1, 2), {_match_sql('id', 'token', 'ec', 'ac')}
SELECT p.id, coalesce(n_expected, 0) AS n_expected, coalesce(n_actual, 0) AS n_actual, coalesce(n_matched, 0) AS n_matched, CASE WHEN coalesce(n_expected, 0) = 0 THEN 1.0 ELSE n_matched / n_expected END AS coverage FROM (SELECT id FROM pairs) p LEFT JOIN s USING (id)"""


def _noisy(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("expected"))
    return d.select("id", "expected", F.concat(F.translate("expected", "eé", "34"), F.lit("!")).alias("actual"))


#: No e or é is left in actual, so each takes an edit of its own, and the length grows by one: the distances below are exact for whole texts.
NOISY = "noisy AS (SELECT doc_id AS id, text AS expected FROM documents)"


def char_error_rate(spark, sf_dir):
    return M.character_error_rate(_noisy(spark, sf_dir))


SQL["char_error_rate"] = f"WITH {NOISY}, d AS (SELECT id, expected, CAST(length(regexp_replace(expected, '[^eé]', '', 'g')) + 1 AS INT) AS distance FROM noisy) SELECT id, distance, distance / greatest(length(expected), 1) AS rate FROM d"


def word_error_rate(spark, sf_dir):
    """One word in seven replaced, and one more at the end."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.tokens("text"), " ").alias("expected"))
    w = F.transform(F.split("expected", " "), lambda x, i: F.when(i % 7 == 3, F.lit("zzzzq")).otherwise(x))
    return M.token_error_rate(d.select("id", "expected", F.concat(F.array_join(w, " "), F.lit(" yyyyq")).alias("actual")))


SQL["word_error_rate"] = """WITH w AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents)
SELECT id, CAST((n + 3) // 7 + 1 AS INT) AS distance, ((n + 3) // 7 + 1) / greatest(n, 1) AS rate FROM w"""


def unicode_accuracy(spark, sf_dir):
    """1 - distance / length over the characters beyond ASCII of each document."""
    return M.unicode_accuracy(_noisy(spark, sf_dir))


SQL["unicode_accuracy"] = f"WITH {NOISY}, d AS (SELECT id, length(regexp_replace(expected, '[\\x00-\\x7F]+', '', 'g')) AS n, CAST(length(regexp_replace(expected, '[^é]+', '', 'g')) AS INT) AS distance FROM noisy) SELECT id, distance, 1 - least(distance / greatest(n, 1), 1.0::DOUBLE) AS accuracy FROM d"


def paragraph_grouping(spark, sf_dir):
    lines = _lines(spark, sf_dir).where("trim(text) != ''").select(F.col("doc_id").alias("id"), "text", "k")
    return M.group_f1(lines, lines.where("k != 3").withColumn("text", F.when(F.col("k") == 4, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))), "id", "text")


SQL["paragraph_grouping"] = f"""WITH {LINES}, p AS (SELECT doc_id AS id, text, k FROM lines WHERE trim(text) <> ''), pe AS (SELECT id, text, count(*) AS n FROM p GROUP BY 1, 2),
pa AS (SELECT id, CASE WHEN k = 4 THEN text || ' x' ELSE text END AS text, count(*) AS n FROM p WHERE k <> 3 GROUP BY 1, 2), {_match_sql('id', 'text', 'pe', 'pa')} SELECT *, {_F1} FROM s"""


def missing_paragraphs(spark, sf_dir):
    lines = _lines(spark, sf_dir).where("trim(text) != ''")
    return M.missing_items(lines.select("doc_id", "text"), lines.where("k % 5 != 0").select("doc_id", "text"))


SQL["missing_paragraphs"] = f"WITH {LINES}, p AS (SELECT doc_id, text, k FROM lines WHERE trim(text) <> '') SELECT doc_id, text FROM p EXCEPT ALL SELECT doc_id, text FROM p WHERE k % 5 <> 0"


def running_content_scores(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    phrases = d.select("id", F.explode(F.array(F.struct(F.lit("the ").alias("phrase"), F.lit(True).alias("keep")), F.struct(F.lit("der ").alias("phrase"), F.lit(False).alias("keep")), F.struct(F.lit("qqq").alias("phrase"), F.lit(False).alias("keep")))).alias("p")).select("id", "p.*")
    return M.phrase_scores(d, phrases)


SQL["running_content_scores"] = f"""WITH p AS (SELECT doc_id AS id, text, unnest(['the ', 'der ', 'qqq']) AS phrase, unnest([TRUE, FALSE, FALSE]) AS keep FROM documents),
m AS (SELECT id, count(*) FILTER (WHERE NOT keep) AS n_expected, count(*) FILTER (WHERE NOT contains(text, phrase)) AS n_actual, count(*) FILTER (WHERE NOT keep AND NOT contains(text, phrase)) AS n_matched FROM p GROUP BY 1), s AS (SELECT *, {_SCORES} FROM m) SELECT *, {_F1} FROM s"""


def warning_scores(spark, sf_dir):
    """Codes by label: expected from quality, actual from toxicity."""
    l = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    codes = lambda a, b: F.array_compact(F.array(F.when(F.col("quality") == a, F.lit("table.low_confidence")), F.when(F.col("toxic") == b, F.lit("ocr.disabled")), F.when(F.col("id") % 3 == 0, F.lit("text.ordering_uncertain"))))
    return M.code_set_scores(l.select("id", codes(0, 1).alias("codes")), l.select("id", codes(1, 1).alias("codes")))


SQL["warning_scores"] = f"""WITH l AS (SELECT doc_id AS id, quality = 0 AS e1, quality = 1 AS a1, toxic = 1 AS t, doc_id % 3 = 0 AS o FROM labels),
m AS (SELECT id, (e1::INT + t::INT + o::INT)::BIGINT AS n_expected, (a1::INT + t::INT + o::INT)::BIGINT AS n_actual, ((e1 AND a1)::INT + t::INT + o::INT)::BIGINT AS n_matched,
    CASE WHEN e1 AND NOT a1 THEN 'table.low_confidence' ELSE '' END AS missing, CASE WHEN a1 AND NOT e1 THEN 'table.low_confidence' ELSE '' END AS extra FROM l), s AS (SELECT *, {_SCORES} FROM m) SELECT *, {_F1} FROM s"""

# Links, blocks, rendered pages


def asset_links(spark, sf_dir):
    """Every line's path: eight kinds of good and bad ones, by the line's number."""
    lines, n = _lines(spark, sf_dir), F.col("line_no").cast("string")
    kinds = ("assets/t", "/etc/x", "../up", "a\\b", "https://example.org", "", "other/x", "assets/../x")
    k = F.col("line_no") % 8
    path = F.when(k == 0, F.concat(F.lit("assets/t"), n, F.lit(".csv"))).otherwise(F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")))
    md = F.concat(F.lit("see [t](./"), path, F.lit("#r) and [u](other)"))
    return lines.select("doc_id", "line_no", F.array_join(M.asset_path_failures(path), ",").alias("failures"), F.array_join(M.markdown_asset_links(md), " ").alias("links"))


SQL["asset_links"] = f"""WITH {LINES} SELECT doc_id, line_no, ['', 'absolute,outside', 'parent,outside', 'backslash,outside', 'scheme,outside', 'empty,outside', 'outside', 'parent'][CAST(line_no % 8 + 1 AS INT)] AS failures,
    CASE line_no % 8 WHEN 0 THEN 'assets/t' || line_no || '.csv' WHEN 7 THEN 'assets/../x' ELSE '' END AS links FROM lines"""


def broken_links(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    path = F.concat(F.lit("assets/"), (F.col("line_no") % 9).cast("string"))
    return M.duplicates(M.broken_links(lines.select("doc_id", path.alias("path")), lines.where("k < 10").select("doc_id", path.alias("path"))), ["doc_id", "path"])


SQL["broken_links"] = f"WITH {LINES}, l AS (SELECT doc_id, 'assets/' || (line_no % 9) AS path, k FROM lines) SELECT doc_id, path, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM l a WHERE a.k < 10 AND a.doc_id = l.doc_id AND a.path = l.path) GROUP BY 1, 2 HAVING count(*) > 1"


def markdown_ast_diff(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n+", "\n\n").alias("text"))
    e = d.withColumn("text", F.concat(F.lit("# Title\n\n"), "text"))
    a = d.withColumn("text", F.concat(F.when(F.col("id") % 3 == 0, "## Title\n\n").when(F.col("id") % 3 == 1, "Title\n\n").otherwise("# Titles\n\n"), F.col("text"), F.lit("\n\n- more")))
    return M.ast_differences(M.markdown_blocks(e), M.markdown_blocks(a)).select("id", "n_differences", F.split("differences", ",")[0].alias("first"))


SQL["markdown_ast_diff"] = "SELECT doc_id AS id, 2::BIGINT AS n_differences, '0:' || CASE doc_id % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'type' ELSE 'content' END AS \"first\" FROM documents"


def rendered_html_stats(spark, sf_dir):
    return M.rendered_html_stats(_read(spark, sf_dir, "pages"))


SQL["rendered_html_stats"] = r"""WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g') AS h FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(h, '(?i)<h[1-6]\b')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(h, '(?i)<p\b')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(h, '(?i)<li\b')) AS BIGINT) AS list_items,
    CAST(len(regexp_extract_all(h, '(?i)<a\b')) AS BIGINT) AS links, CAST(len(regexp_extract_all(h, '(?i)<table\b')) AS BIGINT) AS tables, length(trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars,
    CAST(coalesce(list_max(list_transform(regexp_extract_all(h, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: length(trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))))), 0) AS BIGINT) AS longest_paragraph FROM h"""


def html_lines(spark, sf_dir):
    return lines_from_html(_read(spark, sf_dir, "pages")).select("doc_id", "line_no", "text")


SQL["html_lines"] = r"""WITH f AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|\n', ' ', 'g'), '(?i)</(?:p|h[1-6]|li|div|tr|nav|footer|article|title)>|<br\s*/?>', chr(10), 'g') AS h FROM pages WHERE html IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(string_split(h, chr(10)), lambda t: trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda t: t <> '') AS l FROM f)
SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no FROM s UNION ALL SELECT doc_id, '' AS text, 0 AS line_no FROM s WHERE len(l) = 0"""

# Performance reports


def throughput_profile(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", F.floor("value").cast("double").alias("ms"), (F.col("user_id") % 5).alias("pages"))
    return M.throughput_profile(e, ["event_type"], ms="ms", items="pages").drop("mean_ms", "items_per_second")


SQL["throughput_profile"] = "WITH e AS (SELECT event_type, floor(value)::DOUBLE AS ms, user_id % 5 AS pages FROM events) SELECT event_type, count(*) AS n, min(ms) AS min_ms, max(ms) AS max_ms, median(ms) AS median_ms, sum(ms) AS total_ms, CAST(sum(pages) AS DOUBLE) AS items FROM e GROUP BY 1"


def regression_gate(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, ("throughput", "startup", "memory"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("metric"), F.col("p_retailprice").alias("value"), "p_size")
    current = p.where("p_size < 45").select("id", "metric", (F.col("value") * F.col("p_size") / 20).alias("value"))
    return M.regression_gate(current, p.select("id", "metric", "value"))


SQL["regression_gate"] = """WITH p AS (SELECT p_partkey AS id, ['throughput', 'startup', 'memory'][(p_partkey % 3 + 1)::INT] AS metric, p_retailprice AS baseline, CASE WHEN p_size < 45 THEN p_retailprice * p_size / 20 END AS current FROM part),
t AS (SELECT *, CASE metric WHEN 'throughput' THEN greatest(0.8::DOUBLE * baseline, 10.0) WHEN 'startup' THEN least(8 * baseline, 250.0) ELSE least(2 * baseline, 268435456.0) END AS threshold FROM p)
SELECT id, metric, baseline, current, threshold, coalesce(CASE WHEN metric = 'throughput' THEN current >= threshold ELSE current <= threshold END, FALSE) AS passed FROM t"""


def provider_comparison(spark, sf_dir):
    s = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "gpu").otherwise("cpu").alias("provider"), F.col("l_quantity").alias("rate"))
    return M.provider_comparison(s)


SQL["provider_comparison"] = "WITH s AS (SELECT l_orderkey AS id, max(l_quantity) FILTER (WHERE l_linenumber % 2 = 1) AS cpu, max(l_quantity) FILTER (WHERE l_linenumber % 2 = 0) AS gpu FROM lineitem GROUP BY 1) SELECT id, cpu, gpu, CASE WHEN cpu > 0 AND gpu IS NOT NULL THEN floor(gpu / cpu * 1000000 + 0.5) / 1000000 END AS speedup FROM s"

# Scans and OCR


def _page_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir)
    pages = lines.select("doc_id", "page_index").distinct().withColumn("width_pt", F.lit(612.0)).withColumn("height_pt", F.lit(792.0))
    few = (F.col("doc_id") % 5).isin(1, 2)
    text = lines.where(~few | (F.col("line_no") % 46 < F.col("doc_id") % 5)).withColumn("hidden", (F.col("doc_id") % 5 == 3) & (F.col("k") < 10)).withColumn("width", F.lit(100.0))
    w = F.when(F.col("doc_id") % 5 == 4, 100.0).otherwise(600.0)
    images = pages.where("doc_id % 5 > 0").select("doc_id", "page_index", F.lit(0.0).alias("x"), F.when(F.col("doc_id") % 10 == 3, 400.0).otherwise(0.0).alias("y"), w.alias("width"), F.when(F.col("doc_id") % 10 == 3, 420.0).otherwise(780.0).alias("height"))
    return pages, text, images.withColumn("area", F.col("width") * F.col("height"))


SIGNALS = f"""{LINES},
pg AS (SELECT DISTINCT doc_id, page_index FROM lines),
tx AS (SELECT doc_id, page_index, line_no, x, y, 100.0::DOUBLE AS width, height, doc_id % 5 = 3 AND k < 10 AS hidden FROM lines WHERE doc_id % 5 NOT IN (1, 2) OR line_no % 46 < doc_id % 5),
im AS (SELECT doc_id, page_index, 0.0::DOUBLE AS x, CASE WHEN doc_id % 10 = 3 THEN 400.0 ELSE 0.0 END::DOUBLE AS y, CASE WHEN doc_id % 5 = 4 THEN 100.0 ELSE 600.0 END::DOUBLE AS width, CASE WHEN doc_id % 10 = 3 THEN 420.0 ELSE 780.0 END::DOUBLE AS height FROM pg WHERE doc_id % 5 > 0),
t AS (SELECT doc_id, page_index, count(*) FILTER (WHERE NOT hidden) AS n_lines, count(*) FILTER (WHERE hidden) AS n_hidden, coalesce(sum(width * height) FILTER (WHERE NOT hidden), 0) AS text_area FROM tx GROUP BY 1, 2),
i AS (SELECT doc_id, page_index, count(*) AS n_images, sum(width * height) AS image_area FROM im GROUP BY 1, 2),
h AS (SELECT tx.doc_id, tx.page_index, min(coalesce(greatest(least(tx.x + tx.width, im.x + im.width) - greatest(tx.x, im.x), 0) * greatest(least(tx.y + tx.height, im.y + im.height) - greatest(tx.y, im.y), 0) / (tx.width * tx.height), 0)) AS low
    FROM tx LEFT JOIN im ON im.doc_id = tx.doc_id AND im.page_index = tx.page_index WHERE hidden GROUP BY 1, 2),
g AS (SELECT doc_id, page_index, coalesce(n_lines, 0) AS n_lines, coalesce(n_hidden, 0) AS n_hidden, coalesce(n_images, 0) AS n_images, floor(least(coalesce(image_area, 0) / 484704.0::DOUBLE, 1.0) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS coverage, coalesce(text_area, 0) / 484704.0::DOUBLE AS text_ratio, coalesce(low, 0) AS low
    FROM pg LEFT JOIN t USING (doc_id, page_index) LEFT JOIN i USING (doc_id, page_index) LEFT JOIN h USING (doc_id, page_index)),
sg AS (SELECT doc_id, page_index, n_lines, n_hidden, n_images, coverage, coverage >= 0.5 AS dominant, n_lines < 3 AND text_ratio < 0.01 AS little_text, coverage >= 0.5 AND n_hidden > 0 AS hidden_overlay, coverage >= 0.5 AND n_hidden > 0 AND low < 0.5 AS mismatch FROM g),
rt AS (SELECT *, CASE WHEN mismatch OR hidden_overlay THEN 'hybrid' WHEN dominant AND little_text THEN 'scanned' WHEN dominant AND n_lines > 0 THEN 'hybrid' WHEN n_lines > 0 THEN 'digital' WHEN n_images > 0 THEN 'scanned' ELSE 'unknown' END AS source_type,
    CASE WHEN mismatch THEN 0.6 WHEN hidden_overlay THEN 0.9 WHEN dominant AND little_text THEN CASE WHEN n_lines = 0 THEN 0.95 ELSE 0.85 END WHEN dominant AND n_lines > 0 THEN 0.75 WHEN n_lines > 0 THEN CASE WHEN n_images = 0 THEN 0.9 ELSE 0.65 END WHEN n_images > 0 THEN 0.85 ELSE 0.2 END::DOUBLE AS routing_confidence FROM sg)"""


def scan_detection(spark, sf_dir):
    return O.route_pages(O.scan_signals(*_page_parts(spark, sf_dir)))


SQL["scan_detection"] = f"WITH {SIGNALS} SELECT * FROM rt"


def document_source_type(spark, sf_dir):
    return O.document_source_type(scan_detection(spark, sf_dir)).drop("confidence")


SQL["document_source_type"] = f"""WITH {SIGNALS}, c AS (SELECT doc_id, count(*) FILTER (WHERE source_type = 'digital') AS n_digital, count(*) FILTER (WHERE source_type = 'scanned') AS n_scanned, count(*) FILTER (WHERE source_type = 'hybrid') AS n_hybrid, count(*) FILTER (WHERE source_type = 'unknown') AS n_unknown FROM rt GROUP BY 1)
SELECT *, CASE WHEN n_hybrid > 0 OR (n_digital > 0 AND n_scanned > 0) THEN 'hybrid' WHEN n_scanned > 0 THEN 'scanned' WHEN n_digital > 0 THEN 'digital' ELSE 'unknown' END AS source_type FROM c"""


def _boxes(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.floor(i / 40).alias("doc_id"), F.lit(0).alias("page_index"), (i % 40).alias("box_no"), F.when(i % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit("  x"))).alias("text"), F.when(i % 13 == 0, None).otherwise(F.floor("value")).cast("double").alias("confidence"),
        (10.0 * (i % 8)).alias("x"), (20.0 * (i % 40)).alias("y"), F.when(i % 17 == 0, 0.0).otherwise(80.0).alias("width"), F.lit(10.0).alias("height"), F.when(i % 2 == 0, "raster").otherwise("page").alias("coordinate_space"), F.lit(1224.0).alias("width_px"), F.lit(1584.0).alias("height_px"),
    )


BOXES = """bx AS (SELECT event_id // 40 AS doc_id, 0 AS page_index, event_id % 40 AS box_no, event_id % 11 = 0 AS blank, event_type || ' x' AS text, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE floor(value) END AS c, event_id % 2 = 0 AS raster, 10.0::DOUBLE * (event_id % 8) AS x, 20.0::DOUBLE * (event_id % 40) AS y, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE 80.0 END::DOUBLE AS w FROM events),
ocr AS (SELECT doc_id, page_index, box_no, text, floor(least(greatest(CASE WHEN c > 1 THEN c / 100 ELSE c END, 0.0), 1.0) * 1000000.0 + 0.5) / 1000000.0 AS confidence, CASE WHEN raster THEN x / 2 ELSE x END AS x, CASE WHEN raster THEN 792.0 - (y + 10.0) / 2 ELSE y END AS y, CASE WHEN raster THEN w / 2 ELSE w END AS width, CASE WHEN raster THEN 5.0 ELSE 10.0 END::DOUBLE AS height FROM bx WHERE NOT blank AND w > 0)"""


def _ocr_lines(spark, sf_dir) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    pages = boxes.select("doc_id", "page_index").distinct().withColumn("width_pt", F.lit(612.0)).withColumn("height_pt", F.lit(792.0))
    return O.normalize_boxes(boxes, pages)


def ocr_normalize(spark, sf_dir):
    return _ocr_lines(spark, sf_dir)


SQL["ocr_normalize"] = f"WITH {BOXES} SELECT * FROM ocr"


def ocr_reconcile(spark, sf_dir):
    pages, text, images = _page_parts(spark, sf_dir)
    ocr = _ocr_lines(spark, sf_dir)
    return O.reconcile(O.route_pages(O.scan_signals(pages, text, images)), text, ocr)


SQL["ocr_reconcile"] = f"""WITH {SIGNALS}, {BOXES}, p AS (SELECT doc_id, page_index, count(*) AS n_pdf FROM tx GROUP BY 1, 2), o AS (SELECT doc_id, page_index, count(*) AS n_ocr FROM ocr GROUP BY 1, 2),
a AS (SELECT doc_id, page_index, coalesce(source_type, 'unknown') AS s, coalesce(mismatch, FALSE) AS mm, coalesce(n_pdf, 0) AS n_pdf, coalesce(n_ocr, 0) AS n_ocr FROM rt FULL JOIN p USING (doc_id, page_index) FULL JOIN o USING (doc_id, page_index))
SELECT doc_id, page_index, n_pdf, n_ocr, CASE WHEN n_pdf = 0 AND n_ocr = 0 THEN 'none' WHEN n_ocr = 0 THEN 'pdf-text' WHEN n_pdf = 0 THEN 'ocr' WHEN s = 'scanned' THEN 'ocr' WHEN s = 'digital' THEN 'pdf-text' WHEN s = 'hybrid' THEN CASE WHEN mm THEN 'ocr' ELSE 'pdf-text' END ELSE 'both' END AS selected,
    CASE WHEN n_pdf = 0 AND n_ocr = 0 THEN 'no-text' WHEN n_ocr = 0 THEN 'no-ocr-text' WHEN n_pdf = 0 THEN 'no-pdf-text' WHEN s = 'scanned' THEN 'scanned-page' WHEN s = 'digital' THEN 'digital-page' WHEN s = 'hybrid' THEN CASE WHEN mm THEN 'geometry-mismatch' ELSE 'aligned-hidden-text' END ELSE 'unknown-page' END AS reason FROM a"""


def ocr_region_antijoin(spark, sf_dir):
    _, text, _ = _page_parts(spark, sf_dir)
    return O.ocr_outside_pdf(_ocr_lines(spark, sf_dir), text).select("doc_id", "box_no", "text")


SQL["ocr_region_antijoin"] = f"""WITH {SIGNALS}, {BOXES}, rel AS (SELECT tx.* FROM tx JOIN lines l ON l.doc_id = tx.doc_id AND l.line_no = tx.line_no WHERE NOT tx.hidden AND trim(l.text) <> '')
SELECT doc_id, box_no, text FROM ocr o WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.doc_id = o.doc_id AND r.page_index = o.page_index
    AND greatest(least(o.x + o.width, r.x + r.width) - greatest(o.x, r.x), 0) * greatest(least(o.y + o.height, r.y + r.height) - greatest(o.y, r.y), 0) / least(o.width * o.height, r.width * r.height) >= 0.5)"""

# Raster and batches


def _raster_pages(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("doc_id"), (F.col("p_partkey") % 20).cast("int").alias("page_index"), (F.col("p_size") * 30.0 + 100).alias("width_pt"), (F.col("p_size") * 17.5 + 200).alias("height_pt"), (F.col("p_partkey") % 4 * 90).alias("rotation"))


RASTER = """rp AS (SELECT p_partkey // 20 AS doc_id, CAST(p_partkey % 20 AS INT) AS page_index, CASE WHEN p_partkey % 2 = 1 THEN p_size * 17.5::DOUBLE + 200 ELSE p_size * 30.0::DOUBLE + 100 END AS w, CASE WHEN p_partkey % 2 = 1 THEN p_size * 30.0::DOUBLE + 100 ELSE p_size * 17.5::DOUBLE + 200 END AS h FROM part),
px AS (SELECT doc_id, page_index, CAST(greatest(1, ceil(w * 150.0::DOUBLE / 72 - 0.000000001)) AS BIGINT) AS width_px, CAST(greatest(1, ceil(h * 150.0::DOUBLE / 72 - 0.000000001)) AS BIGINT) AS height_px, CAST(greatest(1, ceil(w * 36.0::DOUBLE / 72 - 0.000000001)) AS BIGINT) AS thumb_width, CAST(greatest(1, ceil(h * 36.0::DOUBLE / 72 - 0.000000001)) AS BIGINT) AS thumb_height FROM rp)"""


def raster_plan(spark, sf_dir):
    return R.raster_plan(_raster_pages(spark, sf_dir), dpi=150, max_pixels=6_000_000)


SQL["raster_plan"] = f"WITH {RASTER} SELECT *, width_px * height_px AS pixels, CASE WHEN width_px * height_px > 6000000 THEN 'skipped' ELSE 'planned' END AS status FROM px"


def batch_plan(spark, sf_dir):
    return R.batch_plan(R.raster_plan(_raster_pages(spark, sf_dir), dpi=150, max_pixels=6_000_000))


SQL["batch_plan"] = f"""WITH RECURSIVE {RASTER}, q AS (SELECT doc_id, page_index, width_px * height_px AS p, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS n FROM px),
f AS (SELECT doc_id, n, page_index, CASE WHEN p > 8000000 THEN 0 ELSE p END AS s, 0 AS b, p > 8000000 AS big FROM q WHERE n = 1
    UNION ALL SELECT q.doc_id, q.n, q.page_index, CASE WHEN q.p > 8000000 THEN f.s WHEN f.s > 0 AND f.s + q.p > 8000000 THEN q.p ELSE f.s + q.p END, CASE WHEN q.p <= 8000000 AND f.s > 0 AND f.s + q.p > 8000000 THEN f.b + 1 ELSE f.b END, q.p > 8000000
    FROM f JOIN q ON q.doc_id = f.doc_id AND q.n = f.n + 1)
SELECT doc_id, page_index, CASE WHEN NOT big THEN b END AS batch_no FROM f"""

# V1, K5, K6


def figure_regions(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("text", F.when(F.col("k") == 8, F.concat(F.lit("Figure "), (F.col("line_no") + 1).cast("string"), F.lit(". x"))).otherwise(F.col("text")))
    rulings = lines.where("k in (2, 5) and doc_id % 3 > 0").select("doc_id", "page_index", (F.col("x") + F.col("k")).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 200 - F.col("k")).alias("x2"), F.col("y").alias("y2"))
    images = lines.where("k = 4 and doc_id % 3 < 2").select("doc_id", "page_index", "x", "y", F.lit(90.0).alias("width"), F.lit(5.0).alias("height"))
    return FG.detect_figures(lines, rulings, images).drop("text")


SQL["figure_regions"] = f"""WITH {LINES}, cap AS (SELECT doc_id, page_index, line_no, y + height AS top FROM lines WHERE k = 8),
v AS (SELECT c.doc_id, c.page_index, c.line_no, min(r.x + r.k) AS x1, min(r.y) AS y1, max(r.x + 200 - r.k) AS x2, max(r.y) AS y2, count(*) AS n FROM cap c JOIN lines r ON r.doc_id = c.doc_id AND r.page_index = c.page_index AND r.k IN (2, 5) AND r.doc_id % 3 > 0 AND r.y >= c.top GROUP BY 1, 2, 3),
i AS (SELECT c.doc_id, c.page_index, c.line_no, min(r.x) AS x1, min(r.y) AS y1, max(r.x + 90) AS x2, max(r.y + 5) AS y2, count(*) AS n FROM cap c JOIN lines r ON r.doc_id = c.doc_id AND r.page_index = c.page_index AND r.k = 4 AND r.doc_id % 3 < 2 AND r.y >= c.top GROUP BY 1, 2, 3),
u AS (SELECT *, 'vector' AS kind FROM v UNION ALL SELECT *, 'image' FROM i WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = i.doc_id AND v.line_no = i.line_no))
SELECT doc_id, page_index, line_no, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY line_no) AS INT) AS figure_no, CAST(line_no + 1 AS INT) AS number, kind, x1::DOUBLE AS x, y1::DOUBLE AS y, (x2 - x1)::DOUBLE AS width, (y2 - y1)::DOUBLE AS height, n AS n_items FROM u"""


def result_confidence(spark, sf_dir):
    _, text, _ = _page_parts(spark, sf_dir)
    d = _read(spark, sf_dir, "documents").select("doc_id").join(text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pdf_lines"), F.count_distinct("page_index").alias("n_layout_pages")), "doc_id", "left").fillna(0, ["n_pdf_lines", "n_layout_pages"])
    d = d.withColumn("ocr_confidence", F.when(F.col("doc_id") % 2 == 0, 80.0)).withColumn("table_confidence", F.when(F.col("doc_id") % 3 == 0, 0.87654))
    modes = W.extraction_mode(d.withColumn("n_ocr_lines", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))).select("doc_id", "mode")
    return W.confidence(d).join(modes, "doc_id")


SQL["result_confidence"] = f"""WITH {SIGNALS}, n AS (SELECT doc_id, count(*) AS n FROM tx GROUP BY 1), d AS (SELECT doc_id, coalesce(n, 0) AS n, doc_id % 2 = 0 AS o FROM documents LEFT JOIN n USING (doc_id))
SELECT doc_id, CASE WHEN n > 0 OR o THEN 0.25 ELSE 0.0 END::DOUBLE AS overall, CASE WHEN n > 0 THEN 0.4 WHEN o THEN 0.8 ELSE 0.0 END::DOUBLE AS text, CASE WHEN n > 0 THEN 0.35 ELSE 0.0 END::DOUBLE AS layout, CASE WHEN doc_id % 3 = 0 THEN 0.877 ELSE 0.0 END::DOUBLE AS tables,
    CASE WHEN n > 0 AND o THEN 'hybrid' WHEN n > 0 THEN 'pdf-text' WHEN o THEN 'ocr' ELSE 'none' END AS mode FROM d"""

QUERIES = {
    name: globals()[name]
    for name in (
        "gfm_table", "html_table", "csv_sidecar", "numeric_columns", "table_confidence", "cell_adjacency", "csv_accuracy", "table_precision_recall", "token_coverage", "char_error_rate", "word_error_rate", "unicode_accuracy",
        "paragraph_grouping", "missing_paragraphs", "running_content_scores", "warning_scores", "asset_links", "broken_links", "markdown_ast_diff", "rendered_html_stats", "html_lines", "throughput_profile", "regression_gate",
        "provider_comparison", "scan_detection", "document_source_type", "ocr_normalize", "ocr_reconcile", "ocr_region_antijoin", "raster_plan", "batch_plan", "figure_regions", "result_confidence",
    )
}
