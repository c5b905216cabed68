"""The Python data source `pdf`: spark.read.format("pdf").load(folder)."""

from __future__ import annotations

import glob
import hashlib
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .reader import SCHEMA, parse_file


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfSource(DataSource):
    """One row a file, in the schema of reader.SCHEMA. Options: path (folder, file or glob that every node sees), tolerant
    (false), attachments (false), password, filesPerPartition (32). For object stores, use reader.files and parse_files."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        path = self.options["path"].removeprefix("file:")
        found = sorted(glob.glob(os.path.join(path, "**", "*.pdf"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        n = int(self.options.get("filesPerPartition", "32"))
        return [_Files(found[i : i + n]) for i in range(0, len(found), n)] or [_Files([])]

    def read(self, partition):
        flag = lambda k: self.options.get(k, "false").lower() == "true"
        for path in partition.paths:
            with open(path, "rb") as f:
                raw = f.read()
            row = parse_file(raw, password=self.options.get("password"), tolerant=flag("tolerant"), attachments=flag("attachments")) | {"doc_id": hashlib.sha256(raw).hexdigest(), "path": path}
            yield tuple([[tuple(r.get(c.name) for c in f.dataType.elementType) for r in row[f.name]] if isinstance(row.get(f.name), list) else row.get(f.name) for f in SCHEMA])


def register(spark) -> None:
    spark.dataSource.register(PdfSource)
