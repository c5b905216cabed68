"""Acceptance of conversions: named criteria over facts of a result, and YAML files that list them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _has(pattern: str, column: str = "markdown"):
    return lambda: F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def _kind(name: str):
    return lambda: F.array_contains(F.coalesce(F.col("blocks.kind"), F.array().cast("array<string>")), name)


def _warned(code: str):
    return lambda: F.array_contains(F.coalesce(F.col("warnings.code"), F.array().cast("array<string>")), code)


def _feature(name: str):
    """A feature that the reader observed in the file (observed_features), with text that came out of it."""
    return lambda: F.array_contains(F.coalesce("observed", F.array().cast("array<string>")), name) & (F.length(F.trim("markdown")) > 0)


def _unseen(name: str):
    return lambda: ~_feature(name)()


def _table(condition: str):
    return lambda: F.exists(F.coalesce("tables", F.expr("cast(array() as array<struct<page_index:int,kind:string,confidence:double,rows:int,columns:int>>)")), lambda t: {"ruled": t["kind"] == "ruled", "borderless": t["kind"] == "borderless", "any": F.lit(True), "rows3": t["rows"] >= 3, "rows6": t["rows"] >= 6, "columns3": t["columns"] >= 3}[condition])


_TEXT, _GFM = _has(r"\S"), _has(r"(?m)^\|(?: *:?-+:? *\|)+$")
_HEADING, _LIST = _has(r"(?m)^#{1,6} "), _has(r"(?m)^\s*(?:- |\d+\. )")
_GARBAGE = _has(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]")

#: label -> condition on columns markdown, blocks, tables, figures, assets, warnings, mode, source_type, observed, form_fields
MUST = {
    "extract_main_text": _TEXT, "preserve_body_text": _TEXT, "preserve_paragraph_order": _TEXT, "extract_title": _has(r"(?m)^# "), "extract_headings": _HEADING, "preserve_heading": _HEADING, "preserve_section_headings": _HEADING, "extract_bullet_list": _has(r"(?m)^\s*- "),
    "preserve_lists": _LIST, "preserve_list_order": _LIST, "detect_visible_table": _table("ruled"), "detect_borderless_table": _table("borderless"), "detect_cell_span": _has(r'(?:row|col)span="'), "emit_gfm_table": _GFM, "emit_html_table": _has("<table>"), "emit_csv_sidecar": lambda: F.size("assets") > 0,
    "preserve_tables": _table("any"), "preserve_table_cells": _table("any"), "preserve_continued_table_rows": _table("any"), "preserve_column_alignment": _has(r"---:"), "detect_vector_figure_region": lambda: F.exists("figures", lambda f: f["kind"] == "vector"), "preserve_caption": _has(r"(?im)^(?:figure|table)\s+\d+"),
    "detect_footnote_region": _has(r"(?m)^(?:\d+\\?\.|[a-z]\)) "), "preserve_footnote_text": _has(r"(?m)^(?:\d+\\?\.|[a-z]\)) "), "emit_bidi_markup": _has('dir="rtl"'), "extract_rtl_text": _has(r"[\x{0590}-\x{08FF}]"), "preserve_rtl_reading_order": _has(r"[\x{0590}-\x{08FF}]"),
    "emit_vertical_writing_markup": _has("writing-mode: vertical-rl"), "extract_vertical_text": _has("writing-mode: vertical-rl"), "preserve_vertical_column_order": _has("writing-mode: vertical-rl"), "extract_cjk_text": _has(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"),
    "join_cjk_wrapped_lines_without_spaces": lambda: ~_has(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}] [\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")(), "extract_ocr_text": lambda: F.col("mode").isin("ocr", "hybrid"), "route_as_scanned": lambda: F.col("source_type") == "scanned", "route_as_hybrid": lambda: F.col("source_type") == "hybrid",
    "repair_line_end_hyphenation": lambda: ~_has(r"[A-Za-z]- [a-z]")(), "preserve_page_anchors": _has(r'<a id="page-\d+"></a>'), "preserve_references": _has(r"(?im)^#{1,6} .*references"), "preserve_appendices": _has(r"(?im)^#{1,6} .*appendix"), "extract_acroform_fields": lambda: F.size("form_fields") > 0,
    "preserve_field_values": lambda: F.exists("form_fields", lambda f: f["value"].isNotNull()), "preserve_button_states": lambda: F.exists("form_fields", lambda f: f["state"].isNotNull()), "report_form_metadata": lambda: F.size("form_fields") > 0, "repair_damaged_xref": lambda: F.col("parse_mode") == "object-scan-repair",
    "scan_indirect_objects": lambda: F.col("parse_mode") == "object-scan-repair", "resolve_xref_stream": lambda: F.col("parse_mode").startswith("xref-stream"), "require_password_before_extraction": _feature("encrypted"), "decrypt_with_known_user_password": _feature("encrypted"), "preserve_decrypted_text_order": _feature("encrypted"),
    "read_rotated_page": _feature("rotated-page"), "respect_crop_box": _feature("cropped-page"), "preserve_visible_crop_text": _feature("cropped-page"), "follow_prev_xref_chain": _feature("xref-prev"), "follow_xref_prev_chain": _feature("xref-prev"), "prefer_newest_object_revision": _feature("incremental-update"),
    "extract_updated_revision_text": _feature("incremental-update"), "resolve_object_stream": _feature("object-stream"), "resolve_qpdf_object_stream": _feature("object-stream"), "resolve_qpdf_xref_stream": _feature("xref-stream"), "resolve_linearized_pdf": _feature("linearized"), "detect_columns": _feature("two-column"),
    "preserve_left_then_right_reading_order": _feature("two-column"), "detect_repeated_header": _feature("headers"), "detect_repeated_footer": _feature("footers"), "preserve_tagged_pdf_signal": _feature("tagged"), "preserve_table_note": _feature("table-note"), "normalize_coordinates": _feature("rotated-page"),
    "prefer_aligned_hidden_text": _feature("hidden-ocr-overlay"), "use_ocr_for_bad_hidden_region": _feature("hidden-ocr-overlay"), "meet_ocr_error_thresholds": lambda: F.col("mode").isin("ocr", "hybrid"), "preserve_nist_publication_identifier": _has(r"NIST\s+(?:SP|Special Publication)\s*800-\d+"), "preserve_withdrawn_notice": _has("(?i)withdrawn"),
}
MUST_NOT = {
    "emit_empty_markdown": lambda: ~_TEXT(), "emit_binary_garbage": _GARBAGE, "fall_back_to_unstructured_binary_scan": lambda: F.coalesce(F.col("parse_mode") == "stream-scan", F.lit(False)), "keep_unrepaired_line_end_hyphen": _has(r"[A-Za-z]- [a-z]"), "drop_bidi_markup": lambda: ~_has('dir="rtl"')(),
    "drop_vertical_writing_markup": lambda: ~_has("writing-mode: vertical-rl")(), "insert_synthetic_cjk_spaces": _has(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}] [\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"), "flatten_all_sections_into_one_paragraph": lambda: ~_HEADING(), "flatten_table_to_unstructured_paragraph": lambda: ~(_GFM() | _has("<table>")()),
    "emit_broken_gfm_for_spans": lambda: _GFM() & _has('colspan="')(), "flatten_vertical_columns": lambda: ~_has("writing-mode: vertical-rl")(), "drop_spanned_header": lambda: ~_has(r'colspan="')(), "bypass_encryption_without_password": _warned("security.password_required"), "omit_withdrawn_notice": lambda: ~_has("(?i)withdrawn")(),
    "drop_checked_state": lambda: ~F.exists("form_fields", lambda f: F.coalesce(f["checked"], F.lit(False))), "invent_missing_form_values": lambda: F.exists("form_fields", lambda f: f["value"] == "undefined"), "split_wrapped_cjk_paragraph": _has(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]\n\n[\x{3040}-\x{30FF}]"),
    "drop_rotated_text": _unseen("rotated-page"), "drop_compressed_page_objects": _unseen("object-stream"), "use_stale_page_tree": _unseen("incremental-update"), "ignore_newest_xref_revision": _unseen("incremental-update"), "emit_ocr_duplicate_text": lambda: F.col("markdown").rlike(r"(?m)^(.{12,})\n\n\1$"), "repeat_running_header_in_body": lambda: F.col("markdown").rlike(r"(?ms)^(.{4,40})$.*^\1$.*^\1$"),
    "drop_table_note": _unseen("table-note"), "trust_repaired_output_without_diagnostics": lambda: (F.col("parse_mode") == "object-scan-repair") & (F.size("warnings") == 0), "drop_continued_rows": lambda: ~_table("any")(), "merge_adjacent_columns": _unseen("two-column"), "drop_title_page_metadata": lambda: ~_HEADING(),
    "drop_authenticator_requirement_tables": lambda: ~_table("any")(), "emit_bad_hidden_text": lambda: (F.col("source_type") == "hybrid") & (F.col("mode") == "pdf-text"), "fold_note_into_table": _has(r"(?im)^\|.*\b(?:note|notes)[:.].*\|$"), "interleave_columns_line_by_line": _unseen("two-column"),
    "interleave_footnote_inside_body_sentence": _has(r"(?m)[a-z,]\n\n(?:\d+\\?\.|[a-z]\)) [^\n]*\n\n[a-z]"), "invent_chart_data": lambda: (F.size("figures") > 0) & _table("borderless")(), "invent_missing_values": _has(r"\b(?:undefined|NaN|None)\b"), "merge_rows_across_columns": _unseen("two-column"),
    "move_caption_before_body": _has(r"(?i)^(?:figure|table)\s+\d+"), "prefer_hidden_media_box_content": _unseen("cropped-page"), "reverse_rtl_fragments": lambda: ~_has('dir="rtl"')(), "treat_acroform_metadata_as_user_filled_values": lambda: F.exists("form_fields", lambda f: F.coalesce(f["value"] == f["name"], F.lit(False))),
}
STRUCTURE = {
    "paragraph": _kind("paragraph"), "paragraphs": _kind("paragraph"), "heading_level_1": _has(r"(?m)^# "), "heading_level_2": _has(r"(?m)^## "), "section_headings": _HEADING, "lists": _LIST, "unordered_list": _has(r"(?m)^- "), "gfm_table": _GFM, "html_table": _has("<table>"), "csv_sidecar": lambda: F.size("assets") > 0,
    "column_span": _has('colspan="'), "aligned_numeric_columns": _has("---:"), "visible_table": _table("ruled"), "borderless_table": _table("borderless"), "tables": _table("any"), "three_rows": _table("rows3"), "six_rows": _table("rows6"), "three_columns": _table("columns3"), "figure": lambda: F.size("figures") > 0,
    "figures": lambda: F.size("figures") > 0, "caption": _has(r"(?im)^(?:figure|table)\s+\d+"), "abstract": _has("(?i)abstract"), "references": _has("(?i)references"), "appendices": _has("(?i)appendix"), "footnote": _has(r"(?m)^(?:\d+\\?\.|[a-z]\)) "), "bidi_markup": _has('dir="rtl"'), "rtl_paragraph": _has('dir="rtl"'),
    "vertical_rl_markup": _has("vertical-rl"), "vertical_writing": _has("vertical-rl"), "cjk_paragraph": _has(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"), "acroform_fields": lambda: F.size("form_fields") > 0, "acroform_metadata": lambda: F.size("form_fields") > 0, "ocr_text_lines": lambda: F.col("mode").isin("ocr", "hybrid"),
    "mixed_pdf_ocr_regions": lambda: F.col("mode") == "hybrid", "object_scan_repair": lambda: F.col("parse_mode") == "object-scan-repair", "xref_stream": lambda: F.col("parse_mode").startswith("xref-stream"), "hyphenation_repair": lambda: ~_has(r"[A-Za-z]- [a-z]")(), "withdrawal_notice": _has("(?i)withdrawn"), "title_page": _has(r"(?m)^# "),
    **{label: _feature(feature) for label, feature in {"multi_page": "multi-page", "long_document": "long-document", "scientific_paper": "scientific-paper", "tagged_pdf": "tagged", "crop_box": "cropped-page", "page_rotation_90": "rotated-page", "linearized": "linearized", "incremental_update": "incremental-update", "newest_revision": "incremental-update", "object_stream": "object-stream", "rc4-40": "rc4-40", "standard-security-handler-r2": "standard-security-handler-r2", "xref_prev_chain": "xref-prev", "two_columns": "two-column", "two_column_layout": "two-column", "reading_order": "reading-order", "header_footer_removal": "headers", "table_note": "table-note", "continued_table_parts": "split-table", "vector_paths": "vector-figure"}.items()},
}
MODES = {
    "pdf-text": lambda: F.col("mode") == "pdf-text", "ocr": lambda: F.col("mode") == "ocr", "hybrid": lambda: F.col("mode") == "hybrid", "asset-only": lambda: ~_TEXT() & (F.size("assets") > 0), "metadata-only": lambda: ~_TEXT() & (F.size("form_fields") > 0), "unsupported": lambda: F.lit(False),
}


def observed_features(parsed: DataFrame, converted: DataFrame) -> DataFrame:
    """doc_id and observed: what the parsed files and their conversion show, by the names that cases use. One row for each of converted."""
    return observed(converted.select("doc_id", "markdown", "tables", "figures").join(parsed.dropDuplicates(["doc_id"]).drop("warnings"), "doc_id", "left"))


def observed(files: DataFrame) -> DataFrame:
    """observed_features of files with what was read of each and its conversion in one row. Where they come partitioned by doc_id, nothing is shuffled."""
    from ..sources.pdf.reader import relation
    from . import layout as L

    lines = relation(files, "lines")
    columns = L.detect_columns(lines).groupBy("doc_id").agg(F.max(F.size("columns") >= 2).alias("two"))
    edges = L.running_content(lines, "gone").where(F.coalesce("gone", F.lit(True))).groupBy("doc_id").agg(F.max(F.col("y") >= 740).alias("top"), F.max(F.col("y") <= 60).alias("low"))
    facts = files.join(columns, "doc_id", "left").join(edges, "doc_id", "left")
    page = lambda test: F.exists("pages", test)
    md = lambda p: F.col("markdown").rlike(p)
    shown = {
        "rotated-page": page(lambda p: F.pmod(p["rotation"], F.lit(360.0)) != 0), "cropped-page": page(lambda p: p["crop_box"] != p["media_box"]), "multi-page": F.size("pages") > 1, "long-document": F.size("pages") >= 20,
        "tagged": F.exists("lines", lambda x: x["structure_role"].isNotNull()), "xref-stream": F.col("parse_mode").contains("xref-stream"), "object-stream": F.col("n_object_streams") > 0, "encrypted": F.col("encrypted"), "rc4-40": F.col("encrypted"), "standard-security-handler-r2": F.col("encrypted"),
        "incremental-update": F.col("n_revisions") > 1, "xref-prev": F.col("n_revisions") > 1, "linearized": F.col("linearized"), "two-column": F.col("two"), "headers": F.col("top"), "footers": F.col("low"), "hidden-ocr-overlay": F.exists("lines", lambda x: x["hidden"]) & (F.size("images") > 0),
        "vector-figure": F.exists("figures", lambda f: f["kind"] == "vector"), "split-table": F.size("tables") > 1, "table-note": md(r"(?im)^(?:table )?notes?[:.]"), "scientific-paper": md("(?i)abstract") & md("(?i)references"), "reading-order": F.size("lines") > 1,
    }
    return facts.select("doc_id", F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in shown.items()])).alias("observed"))


def evaluate(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Checks of results against cases: doc_id, rule (must, mustNot, structure, mode), label, passed, and unknown (no such label:
    failed). results: what pipeline.convert_documents gives, with parse_mode, form_fields and observed (observed_features); cases: doc_id, must,
    must_not, structure (arrays of labels), expected_mode."""
    wanted = cases.select(
        "doc_id",
        F.explode(
            F.concat(
                F.transform("must", lambda x: F.struct(F.lit("must").alias("rule"), x.alias("label"))), F.transform("must_not", lambda x: F.struct(F.lit("mustNot").alias("rule"), x.alias("label"))), F.transform("structure", lambda x: F.struct(F.lit("structure").alias("rule"), x.alias("label"))),
                F.array(F.struct(F.lit("mode").alias("rule"), F.col("expected_mode").alias("label"))),
            )
        ).alias("w"),
    ).select("doc_id", "w.rule", "w.label")

    def facts(rules: dict, negate: bool = False) -> Column:
        return F.create_map(*[y for label, rule in rules.items() for y in (F.lit(label), F.coalesce(~rule() if negate else rule(), F.lit(False)))])

    known = results.select("doc_id", F.create_map(F.lit("must"), facts(MUST), F.lit("mustNot"), facts(MUST_NOT, True), F.lit("structure"), facts(STRUCTURE), F.lit("mode"), facts(MODES)).alias("facts"))
    met = wanted.join(known, "doc_id", "left").withColumn("got", F.col("facts")[F.col("rule")][F.col("label")])
    return met.select("doc_id", "rule", "label", F.coalesce("got", F.lit(False)).alias("passed"), F.col("got").isNull().alias("unknown"))


def parse_acceptance(text: str) -> dict:
    """The part of YAML that acceptance files use: nested maps by indentation, lists of scalars or of flat maps."""

    def scalar(v: str):
        v = re.sub(r"\s+#.*$", "", v).strip()
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        return {"true": True, "false": False, "null": None, "": None, "[]": []}.get(v, int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d*\.\d+", v) else v)

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.strip().startswith("#") and x.strip() != "---"]

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- "):
            out: list = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                item = lines[at][1][2:]
                if re.match(r"^[\w.-]+:(\s|$)", item):
                    lines[at] = (indent + 2, item)
                    value, at = block(at, indent + 2)
                else:
                    value, at = scalar(item), at + 1
                out.append(value)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            key, _, rest = lines[at][1].partition(":")
            at += 1
            if rest.strip():
                found[key] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                found[key], at = block(at, lines[at][0])
            else:
                found[key] = None
        return found, at

    return block(0, lines[0][0])[0] if lines else {}


CASE = "case_id string, gate string, expected_mode string, must array<string>, must_not array<string>, structure array<string>, snippets array<struct<page:int,contains:string>>, metrics map<string,double>"


def read_cases(files: DataFrame) -> DataFrame:
    """CASE of acceptance files (path, content): one row a file, with its path. Lists that are absent are empty; a file without id has its name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("path string, " + CASE)
    arrow = to_arrow_schema(schema)

    def one(path: str | None, text: str | None) -> dict:
        c = parse_acceptance(text or "")
        c = c if isinstance(c, dict) else {}
        some = lambda v: [str(x) for x in v if x is not None] if isinstance(v, list) else []
        inner = lambda k: c[k] if isinstance(c.get(k), dict) else {}
        return {
            "path": path, "case_id": str(c.get("id") or re.sub(r"\.\w+$", "", (path or "").rpartition("/")[2])), "gate": c.get("gate") and str(c["gate"]), "expected_mode": c.get("expectedMode") and str(c["expectedMode"]), "must": some(c.get("must")), "must_not": some(c.get("mustNot")),
            "structure": some(inner("structure").get("expected")), "snippets": [{"page": x.get("page"), "contains": str(x.get("contains"))} for x in c.get("snippets") or [] if isinstance(x, dict)], "metrics": {k: float(v) for k, v in inner("metrics").items() if isinstance(v, (int, float))},
        }

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_pylist([one(p, t) for p, t in zip(*(c.to_pylist() for c in batch.columns))], schema=arrow)

    return files.select("path", F.col("content").cast("string")).mapInArrow(run, schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a corpus manifest (JSON with a list `entries`): id, kind, path, source_type, url, license, features and acceptance_path."""
    entry = "id:string,kind:string,path:string,source:struct<type:string,url:string,description:string,command:string>,license:struct<name:string,notes:string>,features:array<string>,acceptancePath:string"
    raw = spark.read.schema(f"schemaVersion int, entries array<struct<{entry}>>").option("multiLine", "true").json(path)
    e = raw.select(F.explode("entries").alias("e"))
    return e.select("e.id", "e.kind", "e.path", F.col("e.source.type").alias("source_type"), F.col("e.source.url").alias("url"), F.col("e.license.name").alias("license"), F.coalesce("e.features", F.array().cast("array<string>")).alias("features"), F.col("e.acceptancePath").alias("acceptance_path"))
