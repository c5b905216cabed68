"""PDF files to relations: each file is parsed by one Python function, in the task that read it."""

from __future__ import annotations

import hashlib
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from ...shared import spread, spread_evenly
from .content import Interpreter, merge_rulings, page_size, scan_streams
from .document import Document, Limits
from .values import PdfError


def _struct(spec: str) -> S.StructType:
    kinds = {"s": S.StringType(), "i": S.IntegerType(), "d": S.DoubleType(), "b": S.BooleanType(), "x": S.BinaryType(), "S": S.ArrayType(S.StringType()), "D": S.ArrayType(S.DoubleType())}
    return S.StructType([S.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


RELATIONS: dict[str, S.StructType] = {
    "pages": _struct("page_index:i width_pt:d height_pt:d rotation:d user_unit:d media_box:D crop_box:D"),
    "lines": _struct(
        "line_no:i page_index:i text:s x:d y:d width:d height:d font_size:d font_name:s base_font:s font_trusted:b has_to_unicode:b source:s confidence:d direction:s text_render_mode:i hidden:b mcid:i structure_role:s structure_path:S"
    ),
    "rulings": _struct("ruling_no:i page_index:i orientation:s x1:d y1:d x2:d y2:d width:d segment_count:i"),
    "images": _struct("page_index:i draw_no:i name:s x:d y:d width:d height:d area:d image_width:i image_height:i"),
    "outlines": _struct("item_no:i title:s depth:i"),
    "form_fields": _struct("field_no:i name:s type:s value:s page_index:i read_only:b required:b button:s state:s checked:b signer:s signed_at:s signature_status:s"),
    "annotations": _struct("annotation_no:i page_index:i subtype:s contents:s uri:s rect:D"),
    "attachments": _struct("attachment_no:i name:s media_type:s content:x"),
    "warnings": _struct("code:s message:s page_index:i"),
}
SCHEMA = S.StructType(
    [S.StructField("doc_id", S.StringType()), S.StructField("path", S.StringType()), S.StructField("pdf_version", S.StringType()), S.StructField("parse_mode", S.StringType()), S.StructField("has_xfa", S.BooleanType())]
    + [S.StructField("encrypted", S.BooleanType()), S.StructField("linearized", S.BooleanType()), S.StructField("n_revisions", S.IntegerType()), S.StructField("n_object_streams", S.IntegerType())]
    + [S.StructField(n, S.ArrayType(t)) for n, t in RELATIONS.items()]
)

#: Files are returned together up to so many bytes and files.
_BATCH_BYTES, _BATCH_FILES = 4 << 20, 64

_CODES = {"pdf.encryption.password_required": "security.password_required", "pdf.encryption.password_incorrect": "security.password_incorrect", "pdf.encryption.unsupported": "security.unsupported_encryption"}


def _warning(e: Exception, page: int | None = None) -> dict:
    code = e.code if isinstance(e, PdfError) else "pdf.syntax"
    code = _CODES.get(code, code if code.startswith("security.") or code == "pdf.invalid_header" else "pdf.parse_failed")
    return {"code": code, "message": f"{getattr(e, 'code', type(e).__name__)}: {e}"[:300], "page_index": page}


_BROKEN = (PdfError, ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OverflowError, UnicodeError)


def parse_file(data: bytes, *, password: str | None = None, tolerant: bool = False, limits: Limits | None = None, attachments: bool = False, only: tuple[str, ...] | None = None) -> dict:
    """The relations of one file. What can't be read becomes a warning, never an exception: a page that fails keeps what was
    read of the others, and a file without readable structure is scanned for content streams."""
    limits = limits or Limits()
    out: dict = {n: [] for n in RELATIONS} | {"pdf_version": None, "parse_mode": None, "has_xfa": None, "encrypted": None, "linearized": None, "n_revisions": None, "n_object_streams": None}
    began = time.monotonic()
    try:
        doc = Document(data, password=password, tolerant=tolerant, limits=limits)
    except _BROKEN as e:
        w = _warning(e)
        out["warnings"].append(w)
        if w["code"] == "pdf.parse_failed" and not ("too_" in getattr(e, "code", "")):
            out["lines"] = [x | {"line_no": n} for n, x in enumerate(scan_streams(data, limits))]
            out["parse_mode"] = "stream-scan"
        return out
    out["pdf_version"], out["parse_mode"] = doc.version, doc.mode
    for name, read in (("outlines", doc.outlines), ("form_fields", doc.form_fields), ("annotations", doc.annotations), ("attachments", doc.attachments)):
        if only is not None and name not in only and "warnings" not in only:
            continue
        try:
            out[name] = read()
        except _BROKEN as e:
            out["warnings"].append(_warning(e))
    if not attachments:
        out["attachments"] = [a | {"content": None} for a in out["attachments"]]
    try:
        out["has_xfa"], marks = doc.has_xfa(), doc.structure() if only is None or "lines" in only or "warnings" in only else {}
    except _BROKEN as e:
        marks = {}
        out["warnings"].append(_warning(e))
    rulings: list[dict] = []
    drawn = only is None or not {"lines", "rulings", "images", "warnings"}.isdisjoint(only)
    for page in doc.pages:
        w, h = page_size(page)
        out["pages"].append({"page_index": page.index, "width_pt": w, "height_pt": h, "rotation": page.rotation, "user_unit": page.unit, "media_box": page.media, "crop_box": page.crop})
        if not drawn:
            continue
        it = Interpreter(doc, page, marks)
        try:
            if time.monotonic() - began > limits.max_seconds:
                raise PdfError("security.timeout", "the file takes too long")
            it.run()
        except _BROKEN as e:
            it._finish()
            out["warnings"].append(_warning(e, page.index))
        out["lines"] += it.lines
        out["images"] += it.images
        rulings += merge_rulings(it.rulings)
    out["lines"] = [x | {"line_no": n} for n, x in enumerate(out["lines"])]
    out["rulings"] = [x | {"ruling_no": n} for n, x in enumerate(rulings)]
    out |= {"encrypted": doc.key is not None, "linearized": b"/Linearized" in data[:1024], "n_revisions": doc.revisions, "n_object_streams": len(doc.members)}
    return out


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path and content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def parse_files(
    binary: DataFrame, *, passwords: dict[str, str] | None = None, password: str | None = None, password_col: str | None = None, tolerant: bool = False, limits: Limits | None = None, attachments: bool = False, only: tuple[str, ...] | None = None
) -> DataFrame:
    """One row a file (path, content): doc_id (SHA-256 of the content) and its relations as arrays. A null content counts as empty.

    Passwords: one for all files (password), by the file's name (passwords, for few files, as the dictionary goes to every task), or
    in a column of binary (password_col; null: none), which scales with the files. only: the relations that are wanted; the others are
    empty, and what only they need isn't read."""
    passwords = passwords or {}

    def run(it):
        def read():
            for batch in it:
                keys = batch.column(2).to_pylist()
                for k, (path, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                    raw = data.as_py() or b""
                    yield path, raw, parse_file(raw, password=keys[k] or passwords.get((path or "").rpartition("/")[2], password), tolerant=tolerant, limits=limits, attachments=attachments, only=only)

        yield from _batches(read())

    return spread(binary.select("path", "content", (F.col(password_col) if password_col else F.lit(None)).cast("string").alias("password"))).mapInArrow(run, SCHEMA)


def parse_built(rows: DataFrame, build, *, tolerant: bool = False, limits: Limits | None = None, attachments: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """parse_files of the files that build(*values) makes of rows; path: the first column. Rows are spread over the cores, and a file is read
    where and when it is built, so only those of one small batch are ever held."""

    def run(it):
        def read():
            for batch in it:
                for path, *rest in zip(*batch.columns):
                    path = path.as_py()
                    raw = build(path, *(x.as_py() for x in rest))
                    yield str(path), raw, parse_file(raw, tolerant=tolerant, limits=limits, attachments=attachments, only=only)

        yield from _batches(read())

    return spread_evenly(rows).mapInArrow(run, SCHEMA)


def relation_built(rows: DataFrame, build, name: str, key: str, *, tolerant: bool = False, limits: Limits | None = None, attachments: bool = False) -> DataFrame:
    """The rows of one relation of those files, with the first column of rows, a number, as key: as parse_built would give them with explode, but
    made as plain rows at once."""
    schema = S.StructType([S.StructField(key, S.LongType()), *RELATIONS[name].fields])
    arrow = to_arrow_schema(schema)

    def run(it):
        found = []
        for batch in it:
            for values in zip(*batch.columns):
                values = [x.as_py() for x in values]
                for x in parse_file(build(*values), tolerant=tolerant, limits=limits, attachments=attachments, only=(name,))[name]:
                    x[key] = values[0]
                    found.append(x)
                if len(found) >= 512:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)
                    found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return spread_evenly(rows).mapInArrow(run, schema)


def _batches(parsed):
    """Batches of SCHEMA of files (path, content, relations)."""
    arrow = to_arrow_schema(SCHEMA)
    rows, size = [], 0
    for path, raw, row in parsed:
        rows.append(row | {"doc_id": hashlib.sha256(raw).hexdigest(), "path": path})
        size += len(raw)
        if size > _BATCH_BYTES or len(rows) == _BATCH_FILES:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def relation(parsed: DataFrame, name: str) -> DataFrame:
    """One of RELATIONS as rows, with doc_id."""
    return parsed.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*")


def read_headers(binary: DataFrame) -> DataFrame:
    """path, length, pdf_version (null without a valid header), by the JVM alone."""
    head = F.decode(F.substring("content", 1, 32), "ISO-8859-1")
    version = F.regexp_extract(head, r"^%PDF-(\d\.\d)", 1)
    return binary.select("path", F.length("content").alias("length"), F.when((F.length("content") >= 8) & (version != ""), version).alias("pdf_version"))
