"""What a conversion leaves behind: Markdown, assets, attachments, OCR debug files, HTML for reading."""

from __future__ import annotations

import html as H
import os
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def assets_of(converted: DataFrame) -> DataFrame:
    """doc_id, path and content of every table's CSV file."""
    return converted.select("doc_id", F.explode("assets").alias("a")).select("doc_id", "a.asset_id", "a.path", F.lit("text/csv").alias("media_type"), F.col("a.content").alias("content"))


def attachment_assets(attachments: DataFrame) -> DataFrame:
    """doc_id, asset_id, path, media_type and content (base64) of attached files. Names are made safe; the second and further
    of a name in a document get its number before the extension."""
    safe = F.regexp_replace(F.regexp_replace(F.col("name"), r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "-")
    safe = F.when(F.regexp_replace(safe, r"[.-]", "") == "", "attachment").otherwise(F.regexp_replace(safe, r"^[.-]+", ""))
    named = attachments.withColumn("safe", safe).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", F.lower("safe")).orderBy("attachment_no")))
    stem, ext = F.regexp_extract("safe", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("safe", r"^(.*?)(\.[^.]*)?$", 2)
    file = F.when(F.col("n") == 1, F.col("safe")).otherwise(F.concat(stem, F.lit("-"), (F.col("attachment_no") + 1).cast("string"), ext))
    slug = F.lower(F.regexp_replace("safe", r"[^A-Za-z0-9]+", "-"))
    return named.select("doc_id", F.concat(F.lit("attachment-"), (F.col("attachment_no") + 1).cast("string"), F.lit("-"), slug).alias("asset_id"), F.concat(F.lit("assets/attachments/"), file).alias("path"), "media_type", F.base64("content").alias("content"))


def ocr_debug_assets(ocr_lines: DataFrame) -> DataFrame:
    """doc_id, path and content: a JSON file of each page's OCR boxes."""
    box = F.struct("text", "confidence", "x", "y", "width", "height")
    pages = ocr_lines.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct(F.col("box_no").alias("n"), box.alias("box")))).alias("b"))
    body = F.to_json(F.struct(F.col("page_index").alias("pageIndex"), F.transform("b", lambda x: x["box"]).alias("boxes")))
    return pages.select("doc_id", F.concat(F.lit("assets/ocr-page-"), (F.col("page_index") + 1).cast("string"), F.lit(".json")).alias("path"), body.alias("content"))


def write_markdown(converted: DataFrame, folder: str) -> None:
    """One text file per document, <doc_id>.md, written by the tasks; folder must be one that all executors see."""

    def run(it):
        for batch in it:
            for doc, md in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                os.makedirs(folder, exist_ok=True)
                part = os.path.join(folder, f".{doc}.{os.getpid()}")
                with open(part, "w", encoding="utf-8") as f:
                    f.write(md or "")
                os.replace(part, os.path.join(folder, f"{re.sub('[^A-Za-z0-9._-]', '-', str(doc))}.md"))
            yield batch.slice(0, 0)

    converted.select(F.col("doc_id").cast("string"), "markdown").mapInArrow(run, "doc_id string, markdown string").write.format("noop").mode("overwrite").save()


def _inline(text: str) -> str:
    text = re.sub(r"&lt;|&gt;|&amp;", lambda m: {"&lt;": "<", "&gt;": ">", "&amp;": "&"}[m[0]], text)
    out = H.escape(re.sub(r"\\([\\`*_\[\]#+.()|-])", r"\1", text), quote=False)
    return re.sub(r"&lt;(https?://[^\s&]+)&gt;", r'<a href="\1">\1</a>', out)


def render_html(markdown: str) -> str:
    """Markdown as this package writes it to HTML."""
    out = []
    for block in re.split(r"\n{2,}", markdown.strip()):
        lines = block.split("\n")
        if m := re.match(r"^(#{1,6})\s+(.*)", block):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif block.startswith(("<", "$$")):
            out.append(block)
        elif m := re.match(r"^(`{3,}|~{3,})\n(.*)\n\1$", block, re.S):
            out.append(f"<pre><code>{H.escape(m[2])}</code></pre>")
        elif len(lines) > 1 and lines[0].startswith("|") and re.match(r"^\|(?:\s*:?-+:?\s*\|)+$", lines[1]):
            row = lambda line, tag: "<tr>" + "".join(f"<{tag}>{_inline(c.strip())}</{tag}>" for c in re.split(r"(?<!\\)\|", line)[1:-1]) + "</tr>"
            out.append("<table>" + row(lines[0], "th") + "".join(row(x, "td") for x in lines[2:]) + "</table>")
        elif all(re.match(r"^\s*(?:-|\d+\.)\s", x) for x in lines):
            tag = "ol" if re.match(r"^\s*\d", lines[0]) else "ul"
            items = "".join("<li>" + _inline(re.sub(r"^\s*(?:-|\d+\.)\s+", "", x)) + "</li>" for x in lines)
            out.append(f"<{tag}>{items}</{tag}>")
        elif block:
            out.append(f"<p>{_inline(block)}</p>")
    return "\n".join(out)


def html_documents(converted: DataFrame) -> DataFrame:
    """doc_id and html of every document, by Arrow batches."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render_html(m or "") for m in b.column(1).to_pylist()], pa.string())], names=["doc_id", "html"])

    return converted.select(F.col("doc_id").cast("string"), "markdown").mapInArrow(run, "doc_id string, html string")


def truncated_samples(lines: DataFrame, limit: int = 5) -> DataFrame:
    """The first lines of each document, cut for diagnostics."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("_n", n).where(F.col("_n") <= limit).select("doc_id", "line_no", T.truncate("text").alias("text"))
