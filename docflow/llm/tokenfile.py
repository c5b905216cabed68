"""Token ids in ORC files (operator 9).

A data set is a directory of ORC files, one a partition, in ascending id order: the columns doc_id, part (number of the
partition), pos (ids before the document within its part), n_tokens and ids. ORC stores the integers run-length
encoded, keeps minima and maxima per stripe and per row group of ROW_GROUP rows, and a Bloom filter on doc_id, so that
readers split at stripes and a look-up by id skips what can't hold it.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches
from .textkernel import BLOCK_BYTES, SPACE, Block, SpanCache, batches, pieces_of, ragged, texts_of

END_ID, ROW_GROUP = 1, 1000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True


class WordEncoder:
    """Encodes texts by a tokenizers file whose pre-tokeniser never joins across ASCII white space, nor from an ASCII
    letter to one of `.,;:!?`: pieces cut there are encoded one by one, each distinct one once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: whether the tokeniser lower-cases texts itself: pieces that differ in that are one then
        self.lowers = [x.ids for x in self.tokenizer.encode_batch(["ABC Xyz", "abc xyz"], add_special_tokens=False)]
        self.lowers = self.lowers[0] == self.lowers[1]
        self._check()
        self.cache = SpanCache(self._pieces)

    def _check(self) -> None:
        """Refuse a file whose tokeniser joins pieces that are cut here, or adds ids at the ends of a text."""
        whole = ["It is, at 12 o'clock; done!  Now\twhat?\nNo. Yes: no", "a. b, c! d? e; f: g", "x  y\r\nz"]
        for text in whole:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            parts = re.findall(r"[.,;:!?]+[^\sA-Za-z]*|(?:[^\s.,;:!?]|(?<![A-Za-z])[.,;:!?])+", text)
            if ids != [x for p in parts for x in self.tokenizer.encode(p, add_special_tokens=False).ids]:
                raise ValueError("this tokeniser joins text across white space or marks, so its texts can't be encoded in pieces")

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.int64, int(count.sum())), count

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all texts one after the other, and where each text's begin (and the total at the end). A very long
        text is encoded in pieces."""
        if len(texts) == 1 and len(texts[0]) > 2 * BLOCK_BYTES:
            ids = np.concatenate([*(self._encode([p])[0] for p in pieces_of(texts[0])), np.array([] if end_id is None else [end_id], np.int32)])
            return ids, np.array([0, len(ids)])
        return self._encode(texts, end_id)

    def _encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        block = Block([t.encode() for t in texts])
        if self.lowers and b"<|" not in block.data.tobytes():  # special tokens keep their case
            block.data = _LOWER[block.data]
        inside = ~SPACE[block.data]
        begin = np.zeros(len(block.data), bool)
        begin[1:] = inside[1:] & (~inside[:-1] | (_LETTERS[block.data[:-1]] & _MARKS[block.data[1:]]))
        begin[:1] = inside[:1]
        starts = np.flatnonzero(begin)
        stop = np.concatenate([np.flatnonzero(inside[:-1] & (~inside[1:] | begin[1:])) + 1, [len(inside)] * int(inside[-1])]).astype(np.int64)
        start, count = self.cache.rows(block.data, starts, stop)
        at = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, np.concatenate([block.starts, [len(block.data)]]))]
        ids = ragged(self.cache.flat, start, count)
        if end_id is not None:
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
        return ids, at


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a process; its cache serves all tasks of a Python worker."""
    return WordEncoder(path)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text without special tokens, append end_id to each, and write the ids to path in ascending id
    order. Texts are shuffled once, by ranges of the id. Null texts count as empty (end_id alone); null ids come
    first, rows of one id in the order of their texts; ranges part at (id, beginning of the text), so that many rows of one id or of
    none are spread, too. Other columns are dropped, whatever their names."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def run(it):
        from pyspark import TaskContext

        part_no, pos, enc = TaskContext.get().partitionId(), 0, word_encoder(tokenizer)
        for batch in it:
            for i, j in batches(batch.column(1)):
                part = batch.slice(i, j - i)
                ids, at = enc.encode(texts_of(part.column(1)), end_id)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(j - i, part_no, np.int32)), pa.array(pos + at[:-1]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "pos", "n_tokens", "ids"],
                )
                pos += int(at[-1])

    (
        rows.repartitionByRange(n, F.col("doc_id"), F.substring("t", 1, 32)).sortWithinPartitions("doc_id", "t")
        .mapInArrow(run, "doc_id long, part int, pos long, n_tokens long, ids array<int>")
        .write.mode("overwrite").option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(ROW_GROUP))
        .orc(path)
    )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, pos, n_tokens, ids of a written data set; conditions on doc_id are pushed down to the stripes,
    row groups and Bloom filters."""
    return spark.read.schema("doc_id long, part int, pos long, n_tokens long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (unsigned crc32 of its ids as
    little-endian unsigned 32-bit integers), read back from the files. An empty data set gives an empty table."""
    files = read_token_file(spark, path)
    # one row a part: bounded by the number of partitions written
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))

    def run(it):
        for batch in it:
            lists = batch.column(3)
            at, raw = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "part", "pos", "ids").mapInArrow(run, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
