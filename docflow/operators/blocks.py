"""Headings, paragraphs, lists, code and equations as islands of the line relation, and the Markdown they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

def _doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def dominant_font_size(lines: DataFrame) -> DataFrame:
    """The most frequent size, to the half point, of each document's lines with text; the least on a tie; 12 without any."""
    half = T.round_half_up(F.col("font_size") * 2) / 2
    seen = lines.groupBy("doc_id").agg(F.mode(F.when((F.trim("text") != "") & T.is_finite("font_size"), half), True).alias("body_size"))
    return seen.select("doc_id", F.coalesce("body_size", F.lit(12.0)).alias("body_size"))


def heading_levels(lines: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """lines with heading_level (null: none). A tag H1 to H6 (structure_role) that isn't at odds with the text goes
    first, then the depth of the outline item of that title (its first), then size: sizes of max(15, body + 2) or
    more, the six largest in turn."""
    half = T.round_half_up(F.col("font_size") * 2) / 2
    doc = Window.partitionBy("doc_id")
    body = F.mode(F.when((F.trim("text") != "") & T.is_finite("font_size"), half), True).over(doc)
    sized = lines.withColumn("_half", half).withColumn("body_size", F.coalesce(body, F.lit(12.0)))
    big = F.when((F.trim("text") != "") & (F.col("_half") >= F.greatest(F.lit(15.0), F.col("body_size") + 2)), F.col("_half"))
    # the sizes of a document are few: half points
    sizes = F.slice(F.sort_array(F.collect_set(big).over(doc), asc=False), 1, 6)
    out = sized.withColumn("_rank", F.nullif(F.array_position(sizes, F.col("_half")), F.lit(0)))
    level = F.col("_rank")
    if outlines is not None:
        title = outlines.withColumn("_t", F.lower(T.normalize_text("title"))).where("_t != ''")
        first = title.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_t").orderBy("item_no"))).where("_n = 1").select(F.col("doc_id").alias("_d"), "_t", F.least(F.greatest("depth", F.lit(1)), F.lit(6)).alias("_depth"))
        out = out.join(first, (F.col("doc_id") == F.col("_d")) & (F.lower(T.normalize_text("text")) == F.col("_t")), "left").drop("_d", "_t")
        level = F.coalesce(F.col("_depth"), level)
    if "structure_role" in lines.columns:
        tag = F.regexp_extract(F.coalesce("structure_role", F.lit("")), "^H([1-6])$", 1)
        ok = (tag != "") & tagged_heading_conflict(F.col("text"), F.col("font_size"), F.col("body_size")).isNull()
        level = F.when(ok, tag.cast("int")).otherwise(level)
    return out.withColumn("heading_level", level.cast("int")).drop("_half", "_rank", "_depth", "body_size")


def tagged_heading_conflict(text: Column, size: Column, body: Column) -> Column:
    """Why a line tagged as heading isn't one: empty, too long, or smaller than 0.85 times the body; else null."""
    return F.when(T.collapse(text) == "", "empty").when(F.length(T.collapse(text)) > 160, "too-long").when(size < 0.85 * body, "small")


def continues_paragraph() -> Column:
    """Whether a line continues the paragraph of the line before it: same page, left edges within 4, sizes within 0.5,
    a gap of at most max(14, 1.35 times the size), and the line before doesn't end a sentence."""
    lag = lambda c: F.lag(c).over(_doc())
    gap = lag("y") - F.col("y")
    geometry = T.is_finite("x") & T.is_finite("y") & T.is_finite(lag("x")) & T.is_finite(lag("y"))
    return F.coalesce(
        (lag("page_index") == F.col("page_index")) & geometry & (F.abs(lag("x") - F.col("x")) <= 4) & (F.abs(lag("font_size") - F.col("font_size")) <= 0.5)
        & (gap > 0) & (gap <= F.greatest(F.lit(14.0), 1.35 * F.col("font_size"))) & ~T.ends_paragraph(lag("text")) & (F.trim("text") != "") & (F.trim(lag("text")) != ""),
        F.lit(False),
    )


def paragraph_islands(lines: DataFrame) -> DataFrame:
    """lines with paragraph_no: a running count of the lines that don't continue the one before."""
    flagged = lines.withColumn("_new", (~continues_paragraph()).cast("int"))
    return flagged.withColumn("paragraph_no", F.sum("_new").over(_doc().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def join_parts(lines: DataFrame, group: list[str]) -> DataFrame:
    """One text for each group of lines: hyphens at line ends repaired, no space between CJK characters, else one."""
    w = Window.partitionBy(*group).orderBy("line_no")
    t, nxt = F.col("_norm"), F.col("_next")
    lines = lines.withColumn("_norm", T.normalize_text("text")).withColumn("_next", F.lead("_norm").over(w))
    piece = F.when(nxt.isNull(), t).when(T.repairs_hyphen(t, nxt), F.substring(t, 1, F.length(t) - 1)).otherwise(F.concat(t, T.part_separator(t, nxt)))
    return (
        lines.withColumn("_p", piece).groupBy(*group)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_p"))), lambda s: s["_p"]), "").alias("text"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
    )


def islands(lines: DataFrame, member: Column, joins: Column, name: str) -> DataFrame:
    """The lines with member, numbered by maximal runs: a run goes on while the line before is a member, too, and joins holds."""
    flagged = lines.withColumn("_m", F.coalesce(member, F.lit(False)))
    follows = F.coalesce(F.lag("_m").over(_doc()), F.lit(False)) & F.coalesce(joins, F.lit(False))
    numbered = flagged.withColumn("_s", (F.col("_m") & ~follows).cast("int")).withColumn(name, F.sum("_s").over(_doc().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("_m").drop("_m", "_s")


def close_below(factor: float = 2.0, least: float = 24.0) -> Column:
    """The line before is on the same page and at most max(least, factor * size) above."""
    gap = F.lag("y").over(_doc()) - F.col("y")
    return (F.lag("page_index").over(_doc()) == F.col("page_index")) & (gap > 0) & (gap <= F.greatest(F.lit(least), factor * F.col("font_size")))


def list_blocks(lines: DataFrame) -> DataFrame:
    """Runs of list lines: doc_id, list_no, first_line, n_items, text (items of two spaces a level, one a line).

    Levels are the ranks of the document's left edges of items, edges within 12 points being one."""
    items = islands(lines, T.is_list_item("text"), F.lit(True), "list_no")
    stops = items.groupBy("doc_id").agg(_stops(F.array_sort(F.collect_set("x"))).alias("stops"))
    level = F.coalesce(F.array_min(F.transform("stops", lambda s, i: F.struct(F.abs(s - F.col("x")).alias("d"), i.alias("i"))))["i"], F.lit(0))
    text = T.list_depth_text(level, T.list_number("text"), T.escape_inline(T.list_text("text")))
    return items.join(stops, "doc_id").withColumn("_t", text).groupBy("doc_id", "list_no").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_t"))), lambda s: s["_t"]), "\n").alias("text"))


def _stops(xs: Column) -> Column:
    """Running means of ascending positions, a position within 12 of the first such mean belonging to it."""
    start = F.expr("cast(array() as array<struct<x:double,n:int>>)")

    def step(cols: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(cols, lambda c: F.abs(c["x"] - x) <= 12), F.lit(True))
        grown = F.transform(cols, lambda c, i: F.when(i + 1 == hit, F.struct(((c["x"] * c["n"] + x) / (c["n"] + 1)).alias("x"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when(hit > 0, grown).otherwise(F.concat(cols, F.array(F.struct(x.alias("x"), F.lit(1).alias("n")))))

    return F.transform(F.aggregate(xs, start, step), lambda c: c["x"])


def code_blocks(lines: DataFrame) -> DataFrame:
    """Runs of code lines (monospace, or 32 points right of the body's left edge and code-like) with a monospace line or two
    lines at least: doc_id, code_no, first_line, n_lines, text (indented by 12 points a space) and fence."""
    mono = T.is_monospace("base_font") if "base_font" in lines.columns else F.lit(False)
    left = F.min("x").over(Window.partitionBy("doc_id"))
    flagged = lines.withColumn("_left", left).withColumn("_mono", mono)
    runs = islands(flagged, F.col("_mono") | ((F.col("x") >= F.col("_left") + 32) & T.is_code_like("text")), close_below(), "code_no")
    base = F.min("x").over(Window.partitionBy("doc_id", "code_no"))
    indented = F.concat(F.repeat(F.lit(" "), F.greatest(T.round_half_up((F.col("x") - base) / 12).cast("int"), F.lit(0))), F.rtrim("text"))
    blocks = runs.withColumn("_t", indented).groupBy("doc_id", "code_no").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max("_mono").alias("mono"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_t"))), lambda s: s["_t"]), "\n").alias("text"))
    return blocks.where("mono or n_lines >= 2").select("doc_id", "code_no", "first_line", "n_lines", "text", T.code_fence("text").alias("fence"))


def equation_blocks(lines: DataFrame) -> DataFrame:
    """Runs of equation lines: doc_id, equation_no, first_line, n_lines, text (fenced by $$)."""
    doc = Window.partitionBy("doc_id")
    flagged = lines.withColumn("_left", F.min("x").over(doc)).withColumn("_w", F.max("width").over(doc))
    runs = islands(flagged, T.is_equation("text", "x", "width", "_left", "_w"), close_below(), "equation_no")
    joined = runs.groupBy("doc_id", "equation_no").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    return joined.select("doc_id", "equation_no", "first_line", "n_lines", F.concat(F.lit("$$\n"), F.replace("t", F.lit("$$"), F.lit("\\$\\$")), F.lit("\n$$")).alias("text"))


def document_blocks(lines: DataFrame) -> DataFrame:
    """Headings, lists and paragraphs of each document in order: doc_id, block_no, kind, text (Markdown), first_line, n_lines.

    Priority heading, list item, paragraph; a heading is a block of its own, list items next to each other are one block."""
    leveled = heading_levels(lines).where(F.trim("text") != "")
    kind = F.when(F.col("heading_level").isNotNull(), "heading").when(T.is_list_item("text"), "list").otherwise("paragraph")
    typed = leveled.withColumn("kind", kind)
    before = F.lag("kind").over(_doc())
    go_on = F.when(F.col("kind") == "list", before == "list").when(F.col("kind") == "paragraph", (before == "paragraph") & continues_paragraph()).otherwise(F.lit(False))
    numbered = typed.withColumn("_new", (~F.coalesce(go_on, F.lit(False))).cast("int")).withColumn("block_no", F.sum("_new").over(_doc().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    w = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    t, nxt = F.col("_norm"), F.col("_next")
    numbered = numbered.withColumn("_norm", T.normalize_text("text")).withColumn("_next", F.lead("_norm").over(w))
    item = T.list_depth_text(F.lit(0), T.list_number(t), T.escape_inline(T.list_text(t)))
    part = F.when(nxt.isNull(), t).when(T.repairs_hyphen(t, nxt), F.substring(t, 1, F.length(t) - 1)).otherwise(F.concat(t, T.part_separator(t, nxt)))
    piece = F.when(F.col("kind") == "heading", t).when(F.col("kind") == "list", F.concat(item, F.when(nxt.isNull(), F.lit("")).otherwise(F.lit("\n")))).otherwise(part)
    blocks = numbered.withColumn("_p", piece).groupBy("doc_id", "block_no", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_p"))), lambda s: s["_p"]), "").alias("_t"), F.max("heading_level").alias("level"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines")
    )
    text = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), T.escape_inline("_t"))).when(F.col("kind") == "list", F.col("_t")).otherwise(T.escape_paragraph("_t"))
    return blocks.select("doc_id", "block_no", "kind", text.alias("text"), "first_line", "n_lines")


def markdown_documents(blocks: DataFrame) -> DataFrame:
    """One Markdown text a document: blocks parted by an empty line, a line feed at the end; doc_id, markdown, n_blocks."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"])
    return blocks.groupBy("doc_id").agg(F.concat(F.array_join(texts, "\n\n"), F.lit("\n")).alias("markdown"), F.count(F.lit(1)).alias("n_blocks"))


def source_map(blocks: DataFrame) -> DataFrame:
    """Where each block lies in its document's Markdown, in code points: doc_id, block_no, kind, md_start, md_end."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    return blocks.select("doc_id", "block_no", "kind", start.alias("md_start"), (start + F.length("text")).alias("md_end"))
