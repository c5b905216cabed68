"""Tables: GFM, HTML and CSV forms of cells, numeric columns, and the accuracy of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _ordered(struct_cols: list[str], field: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(*struct_cols))), lambda s: s[field])


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Columns of each table whose body (all rows but row 0) isn't empty and is numeric throughout: table_id, column_index,
    is_numeric, n_body. cells: table_id, row_index, column_index, text."""
    body = F.col("row_index") > 0
    return cells.groupBy("table_id", "column_index").agg(
        F.coalesce(F.bool_and(F.when(body, T.is_numeric_cell("text"))), F.lit(False)).alias("is_numeric"), F.count(F.when(body, 1)).alias("n_body")
    )


def gfm_tables(cells: DataFrame) -> DataFrame:
    """table_id, markdown: a header row, a rule (right-aligned over numeric columns), the body."""
    align = numeric_columns(cells).groupBy("table_id").agg(_ordered(["column_index", F.when(F.col("is_numeric"), "---:").otherwise("---").alias("a")], "a").alias("marks"))
    rows = cells.withColumn("t", T.escape_cell(T.collapse(F.coalesce("text", F.lit(""))))).groupBy("table_id", "row_index").agg(F.concat(F.lit("| "), F.array_join(_ordered(["column_index", "t"], "t"), " | "), F.lit(" |")).alias("line"))
    tables = rows.groupBy("table_id").agg(_ordered(["row_index", "line"], "line").alias("lines")).join(align, "table_id")
    rule = F.concat(F.lit("| "), F.array_join("marks", " | "), F.lit(" |"))
    return tables.select("table_id", F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))), "\n").alias("markdown"))


def html_tables(cells: DataFrame) -> DataFrame:
    """table_id, html: row 0 is the head; spans above 1 as attributes; covered cells left out.
    cells may have row_span, column_span and covered."""
    has = lambda c: c in cells.columns
    span = F.concat(*[F.when(F.col(c) > 1, F.concat(F.lit(f' {a}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("") if has(c) else F.lit("") for c, a in (("row_span", "rowspan"), ("column_span", "colspan"))])
    tag = F.when(F.col("row_index") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("      <"), tag, span, F.lit(">"), T.escape_html(T.collapse(F.coalesce("text", F.lit("")))), F.lit("</"), tag, F.lit(">\n"))
    shown = cells.where(~F.coalesce("covered", F.lit(False))) if has("covered") else cells
    rows = shown.withColumn("t", cell).groupBy("table_id", "row_index").agg(F.concat(F.lit("    <tr>\n"), F.array_join(_ordered(["column_index", "t"], "t"), ""), F.lit("    </tr>\n")).alias("line"))
    tables = rows.groupBy("table_id").agg(_ordered(["row_index", "line"], "line").alias("lines"))
    body = F.when(F.size("lines") > 1, F.concat(F.lit("  <tbody>\n"), F.array_join(F.slice("lines", F.lit(2), F.size("lines") - 1), ""), F.lit("  </tbody>\n"))).otherwise("")
    return tables.select("table_id", F.concat(F.lit("<table>\n  <thead>\n"), F.col("lines")[0], F.lit("  </thead>\n"), body, F.lit("</table>")).alias("html"))


def csv_sidecars(cells: DataFrame) -> DataFrame:
    """table_id, csv: cells guarded against formulas and quoted where needed, rows ended by a line feed. Covered cells are blank."""
    text = F.when(F.col("covered"), F.lit("")).otherwise(F.col("text")) if "covered" in cells.columns else F.col("text")
    rows = cells.withColumn("t", T.csv_cell(text)).groupBy("table_id", "row_index").agg(F.array_join(_ordered(["column_index", "t"], "t"), ",").alias("line"))
    return rows.groupBy("table_id").agg(F.concat(F.array_join(_ordered(["row_index", "line"], "line"), "\n"), F.lit("\n")).alias("csv"))


def sidecar_names(tables: DataFrame) -> DataFrame:
    """tables (page_index, table_no in the document's order) with the id and path of their CSV file."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("table_no"))
    asset = F.concat(F.lit("table-page-"), (F.col("page_index") + 1).cast("string"), F.lit("-"), n.cast("string"), F.lit("-csv"))
    return tables.withColumn("asset_id", asset).withColumn("path", F.concat(F.lit("assets/"), F.col("asset_id"), F.lit(".csv")))


def borderless_confidence(cells: DataFrame) -> DataFrame:
    """table_id, n_rows, confidence of tables without rules: min(.85, .55 + .25 * share of numeric columns + .1 if three rows or
    more); null without a numeric column."""
    cols = numeric_columns(cells).groupBy("table_id").agg(F.avg(F.col("is_numeric").cast("double")).alias("ratio"))
    rows = cells.groupBy("table_id").agg(F.count_distinct("row_index").alias("n_rows"))
    value = F.least(F.lit(0.85), 0.55 + 0.25 * F.col("ratio") + F.when(F.col("n_rows") >= 3, 0.1).otherwise(0.0))
    return rows.join(cols, "table_id").select("table_id", "n_rows", F.when(F.col("ratio") > 0, T.round_half_up(value, 3)).alias("confidence"))


def adjacency_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of neighbouring cells that aren't empty: table_id, way (right or down), a, b, n (how often)."""
    t = F.lower(T.collapse("text"))
    c = cells.select("table_id", "row_index", "column_index", t.alias("a")).where("a != ''")
    right = c.withColumn("b", F.lead("a").over(Window.partitionBy("table_id", "row_index").orderBy("column_index"))).withColumn("way", F.lit("right"))
    down = c.withColumn("b", F.lead("a").over(Window.partitionBy("table_id", "column_index").orderBy("row_index"))).withColumn("way", F.lit("down"))
    return right.unionByName(down).where("b is not null").groupBy("table_id", "way", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def multiset_match(expected: DataFrame, actual: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Per group (columns by): expected, actual and matched counts of multisets (keys, n), precision, recall and f1. Both empty
    give 1, one empty 0."""
    e, a = expected.withColumnRenamed("n", "_e"), actual.withColumnRenamed("n", "_a")
    both = e.join(a, [*by, *keys], "full_outer")
    sums = both.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("_e", "n_expected"), ("_a", "n_actual"), (F.least("_e", "_a") * F.col("_e").isNotNull().cast("int") * F.col("_a").isNotNull().cast("int"), "n_matched"))])
    return with_scores(sums)


def with_scores(counts: DataFrame) -> DataFrame:
    """counts (n_expected, n_actual, n_matched) with precision, recall and f1."""
    ratio = lambda d: F.when(F.col(d) > 0, F.col("n_matched") / F.col(d)).when((F.col("n_expected") == 0) & (F.col("n_actual") == 0), 1.0).otherwise(0.0)
    scored = counts.withColumn("precision", ratio("n_actual")).withColumn("recall", ratio("n_expected"))
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
