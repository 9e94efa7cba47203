"""Packing by power-of-two decomposition: no sequence crosses documents and nothing is padded.

A document of n ids becomes n // window pieces of the full window and one piece for each binary digit of the rest, the
longest first. Each piece is a sequence of its own, with a length that is a power of two, so sequences of equal length
form a bucket from which batches of one shape are drawn. sequence_id holds the bucket in its top bits, then the task
and a counter, so a bucket's ids lie together; a task that is run again after a loss gives the same ids. The work is
a map over the rows: no shuffle.

Defined results: a NULL or empty text is the end id alone. Rows that share a doc_id are packed each for itself. A
NULL doc_id stays NULL. Other columns are not looked at and may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm import tokens
from lumenlex.shared import giving_back

WINDOW, END_ID = 1024, 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
FLUSH = 4 << 20


def pieces(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; window is a power of two."""
    out = [(i, window) for i in range(0, n - window + 1, window)]
    start, rest = n - n % window, n % window
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece, ids packed as little-endian unsigned 32-bit numbers."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    files = files or tokens.default_files()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, made = tokens.load(files), np.zeros(window.bit_length(), np.int64)
        task = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held = [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in pieces(n, window):
                    bucket = length.bit_length() - 1
                    sequence = bucket << 56 | task << 36 | int(made[bucket])
                    made[bucket] += 1
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, bucket, sequence, 0))
                held += len(ids) + 64
                if held > FLUSH:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row for each piece of every document."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
