"""Streaming ingest of PDF files: an extension, as there is no streaming in what the conversion does."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import convert_documents
from ..shared import fresh_path, remove
from ..sources.pdf.reader import parse_files

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def convert_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, *, pattern: str = "*.pdf", max_files: int = 1000, trigger: dict | None = None, **options) -> StreamingQuery:
    """Convert the files that arrive in a folder; each batch is appended to output (Parquet, by batch number, so that a batch that
    is run again replaces itself). trigger: as DataStreamWriter.trigger takes it; by default what is there is converted and
    the query ends."""
    arriving = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)

    def batch(df, number: int) -> None:
        path = fresh_path(df.sparkSession, "ingest_parsed")
        convert_documents(parse_files(df.select("path", "content")), parsed_to=path, **options).write.mode("overwrite").parquet(f"{output}/batch={number}")
        remove(df.sparkSession, path)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrival_counts(spark: SparkSession, folder: str, *, window: str = "10 minutes", late: str = "1 hour"):
    """A stream of files and bytes per window of their modification time, with a watermark for late files."""
    arriving = spark.readStream.format("binaryFile").schema(_BINARY).load(folder)
    return arriving.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
