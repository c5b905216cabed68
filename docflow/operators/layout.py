"""Running content, rows, columns and reading order of the line relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def remove_running_content(lines: DataFrame, *, keep_titles: bool = False) -> DataFrame:
    """Page numbers go, and so do small lines at the page's edges whose text the document has there twice or more."""
    return running_content(lines, "_gone", keep_titles=keep_titles).where("not _gone").drop("_gone")


def running_content(lines: DataFrame, name: str, *, keep_titles: bool = False) -> DataFrame:
    """lines with what remove_running_content takes away marked in a column of that name."""
    norm = T.collapse("text")
    candidate = T.is_running_candidate("font_size", "y")
    times = F.count(F.when(candidate, 1)).over(Window.partitionBy("doc_id", norm))
    repeated = candidate & (times >= 2)
    if keep_titles:
        repeated &= ~T.is_running_title("text", "font_size", "y")
    gone = T.is_page_number("text", "font_size", "y") | repeated
    return lines.withColumn(name, gone)


def _fold_rows(items: Column) -> Column:
    """Rows of items (struct y, x, tol, line_no; sorted): an item joins the last row if its y is within the larger tolerance of the
    row's running mean."""
    start = F.expr("cast(array() as array<struct<y:double,tol:double,n:int,line_nos:array<int>>>)")

    def step(rows: Column, item: Column) -> Column:
        last = F.element_at(rows, -1)
        fits = F.coalesce(F.abs(last["y"] - item["y"]) <= F.greatest(last["tol"], item["tol"]), F.lit(False))
        grown = F.struct(
            ((last["y"] * last["n"] + item["y"]) / (last["n"] + 1)).alias("y"), F.greatest(last["tol"], item["tol"]).alias("tol"), (last["n"] + 1).alias("n"), F.concat(last["line_nos"], F.array(item["line_no"])).alias("line_nos")
        )
        new = F.struct(item["y"].alias("y"), item["tol"].alias("tol"), F.lit(1).alias("n"), F.array(item["line_no"]).alias("line_nos"))
        return F.when(F.size(rows) == 0, F.array(new)).when(fits, F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(grown))).otherwise(F.concat(rows, F.array(new)))

    return F.aggregate(items, start, step)


def group_rows(lines: DataFrame) -> DataFrame:
    """Visual rows of each page, top down: doc_id, page_index, row_no, y (mean), line_nos (left to right). The fold runs in the
    JVM over one page's lines."""
    item = F.struct((-F.col("y")).alias("down"), "x", "line_no", "y", F.greatest(F.lit(2.0), 0.25 * F.col("font_size")).alias("tol"))
    pages = lines.where(T.is_finite("x") & T.is_finite("y")).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = pages.select("doc_id", "page_index", F.posexplode(_fold_rows(F.col("items"))).alias("row_no", "r"))
    return rows.select("doc_id", "page_index", "row_no", F.col("r.y").alias("y"), F.col("r.line_nos").alias("line_nos"))


def _fold_columns(xs: Column, tol: Column) -> Column:
    """Columns of left edges (ascending): the first whose running mean is within tol takes an edge."""
    start = F.expr("cast(array() as array<struct<x:double,n:int>>)")

    def step(cols: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(cols, lambda c: F.abs(c["x"] - x) <= tol), F.lit(True))
        grown = F.transform(cols, lambda c, i: F.when(i + 1 == hit, F.struct(((c["x"] * c["n"] + x) / (c["n"] + 1)).alias("x"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when(hit > 0, grown).otherwise(F.concat(cols, F.array(F.struct(x.alias("x"), F.lit(1).alias("n")))))

    return F.aggregate(xs, start, step)


def detect_columns(lines: DataFrame) -> DataFrame:
    """Text columns of each page: doc_id, page_index, columns (left edges, two or more; else empty)."""
    pages = lines.where(T.is_finite("x") & T.is_finite("y")).groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.median("font_size").alias("size"))
    found = F.filter(_fold_columns(F.col("xs"), F.greatest(F.lit(36.0), 3 * F.col("size"))), lambda c: c["n"] >= 2)
    apart = F.filter(found, lambda c, i: (i == 0) | (c["x"] - F.coalesce(F.get(found, i - 1)["x"], F.lit(-1e9)) >= 96))
    edges = F.transform(apart, lambda c: c["x"])
    empty = F.expr("cast(array() as array<double>)")
    return pages.select("doc_id", "page_index", F.when((F.size("xs") >= 4) & (F.size(edges) >= 2), edges).otherwise(empty).alias("columns"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with column_no, segment and reading_no (0-based, per document). A line that spans from the first to the last column
    begins a segment; within one, columns are read left to right, each top down. A page with a line without geometry keeps
    its input order."""
    page = Window.partitionBy("doc_id", "page_index")
    with_cols = lines.join(detect_columns(lines), ["doc_id", "page_index"], "left").withColumn("columns", F.coalesce("columns", F.expr("cast(array() as array<double>)")))
    many = F.size("columns") >= 2
    nearest = F.array_min(F.transform("columns", lambda c, i: F.struct(F.abs(c - F.col("x")).alias("d"), i.alias("i"))))["i"]
    spans = many & (F.col("x") <= F.element_at("columns", 1) + 24) & (F.col("x") + F.col("width") >= F.element_at("columns", -1) + 24)
    placed = with_cols.withColumn("known", F.min(T.is_finite("x") & T.is_finite("y")).over(page)).withColumn("spans", F.coalesce(F.when(many, spans), F.lit(False)))
    down = page.orderBy(F.desc("y"), "x", "line_no")
    placed = placed.withColumn("segment", F.when(F.col("known"), 2 * F.sum(F.col("spans").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("spans").cast("int")).otherwise(0))
    placed = placed.withColumn("column_no", F.when(F.col("known") & many & ~F.col("spans"), nearest).otherwise(0))
    order = Window.partitionBy("doc_id").orderBy(
        "page_index", F.when(F.col("known"), F.col("segment")), F.when(F.col("known"), F.col("column_no")), F.when(F.col("known"), -F.col("y")), F.when(F.col("known"), F.col("x")), "line_no"
    )
    return placed.withColumn("reading_no", F.row_number().over(order) - 1).drop("columns", "known", "spans")


def layout_regions(lines: DataFrame) -> DataFrame:
    """Callouts, footnotes, captions and page numbers: doc_id, page_index, line_no, kind, target, and the box."""
    kind = (
        F.when(T.is_page_number("text", "font_size", "y"), "page_number").when(T.is_callout("text"), "callout")
        .when(T.is_footnote("text", "font_size", "y"), "footnote").when(T.caption_target("text").isNotNull(), "caption")
    )
    return lines.withColumn("kind", kind).where("kind is not null").select("doc_id", "page_index", "line_no", "kind", F.when(F.col("kind") == "caption", T.caption_target("text")).alias("target"), "x", "y", "width", "height")


def layout_kind(lines: DataFrame) -> DataFrame:
    """single-column, multi-column or unknown for each page, with the number of columns."""
    return detect_columns(lines).select("doc_id", "page_index", F.greatest(F.size("columns"), F.lit(1)).alias("n_columns"), F.when(F.size("columns") >= 2, "multi-column").otherwise("single-column").alias("kind"))


def dominant_direction(lines: DataFrame) -> DataFrame:
    """Vote of a page's lines: vertical only if above both others; rtl if above ltr; else ltr if there is any."""
    d = F.col("direction") if "direction" in lines.columns else T.direction("text")
    votes = lines.withColumn("_d", d).groupBy("doc_id", "page_index").agg(*[F.sum((F.col("_d") == k).cast("int")).alias(k) for k in ("vertical", "rtl", "ltr")])
    pick = F.when((F.col("vertical") > F.col("rtl")) & (F.col("vertical") > F.col("ltr")), "vertical").when(F.col("rtl") > F.col("ltr"), "rtl").when(F.col("ltr") > 0, "ltr").otherwise("unknown")
    return votes.select("doc_id", "page_index", pick.alias("direction"))


def vertical_order(lines: DataFrame) -> DataFrame:
    """Lines of vertical pages: columns right to left by their axis, within tol of the running mean, each top down."""
    axis = F.col("x") + F.col("width") / 2
    item = F.struct((-axis).alias("down"), (-F.col("y")).alias("x"), "line_no", axis.alias("y"), F.greatest(F.lit(4.0), 0.75 * F.col("width")).alias("tol"))
    pages = lines.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(item)).alias("items"), F.map_from_entries(F.collect_list(F.struct("line_no", "y"))).alias("ys"))
    cols = pages.select("doc_id", "page_index", "ys", F.posexplode(_fold_rows(F.col("items"))).alias("column_no", "r"))
    each = cols.select("doc_id", "page_index", "column_no", F.explode("r.line_nos").alias("line_no"), "ys").withColumn("y", F.col("ys")[F.col("line_no")])
    order = Window.partitionBy("doc_id", "page_index").orderBy("column_no", F.desc("y"), "line_no")
    return each.select("doc_id", "page_index", "line_no", "column_no", (F.row_number().over(order) - 1).alias("reading_no"))
