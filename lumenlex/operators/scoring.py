"""Scores of a batch of queries worked out where the documents are, in Arrow batches of an index's texts.

All terms of a document lie in its row, so its score for a query is whole without a shuffle, and a task passes on no more
than each query's best of what it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lumenlex.functions import bm25
from lumenlex.operators.index import slices
from lumenlex.shared import giving_back

#: Pairs of a posting and a query that are added up at once, about; rows that a task keeps before it passes them on.
PAIRS, KEPT = 2_000_000, 4_000_000


@dataclass(frozen=True)
class Batch:
    """Queries by term: starts[t] to starts[t + 1] are the queries that have the term, with its weight in each."""

    qids: list
    terms: list[str]
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    allowed: np.ndarray | None = None  # by query and chunk of documents, each of width ids
    width: int = 1


def batch(rows: list, chunks: list | None = None, width: int = 1, n_chunks: int = 0) -> Batch:
    """Of rows (qid, term, weight); chunks: (qid, chunk) pairs, to score nothing else."""
    rows = sorted(rows, key=lambda r: r["term"])
    number: dict = {}
    query = np.array([number.setdefault(r["qid"], len(number)) for r in rows], np.int64)
    terms, counts = np.unique(np.array([r["term"] for r in rows], object), return_counts=True)
    allowed = None
    if chunks is not None:
        allowed = np.zeros((len(number), n_chunks), bool)
        for qid, chunk in chunks:
            allowed[number[qid], chunk] = True
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return Batch(list(number), list(terms), starts, query, np.array([r["weight"] for r in rows], float), allowed, width)


def best(texts: DataFrame, asked: Batch, qid: StructField, most: int, stats, digits: int) -> DataFrame:
    """qid, score, mapped_id from texts(mapped_id, len, terms): from each task at least every query's ``most`` best."""
    of = {"avgdl": stats["avgdl"], "k1": stats["k1"], "b": stats["b"]}
    kind = to_arrow_type(qid.dataType)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = pa.array(asked.qids, kind)
        for q, score, doc in _best(batches, asked, max(1, most), of, digits):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(score), pa.array(doc)], ["qid", "score", "mapped_id"])

    return texts.select("mapped_id", "len", "terms").mapInArrow(run, StructType([StructField("qid", qid.dataType), StructField("score", DoubleType()), StructField("mapped_id", LongType())]))


def _best(batches: Iterator[pa.RecordBatch], asked: Batch, most: int, of: dict, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    least = np.full(len(asked.qids), -np.inf)  # a query's most-th score so far: nothing below it is among its best
    held, n = [], 0
    full = min(PAIRS, max(100_000, 4 * most * len(asked.qids)))
    for q, score, doc in _scored(batches, asked, of, digits):
        good = score >= least[q]
        held.append((q[good], score[good], doc[good]))
        n += len(held[-1][0])
        if n > full:
            held = [_cut(held, most, least)]
            n = len(held[0][0])
            full = max(full, 2 * n)
            if n > KEPT:
                yield held[0]
                held, n = [], 0
    if held:
        yield _cut(held, most, least)


def _cut(held: list, most: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best of each query among held; raises least to the last of them."""
    q, score, doc = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((doc, -score, q))
    q, score, doc = q[order], score[order], doc[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    last = rank == most - 1
    least[q[last]] = np.maximum(least[q[last]], score[last])
    good = rank < most
    return q[good], score[good], doc[good]


def _scored(batches: Iterator[pa.RecordBatch], asked: Batch, of: dict, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, score and document of every pair that shares a term, rounded half up."""
    terms, n_terms, scale = pa.array(asked.terms, pa.string()), len(asked.terms), 10.0**digits
    for b in batches:
        ids, lens = (b.column(c).to_numpy() for c in ("mapped_id", "len"))
        for rows, row, codes, words in slices(b.column("terms")):
            known = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            key, tf = np.unique(row[known >= 0] * n_terms + known[known >= 0], return_counts=True)
            doc, term = np.divmod(key, n_terms)
            doc += rows.start
            part = bm25.saturation(tf, lens[doc], of["avgdl"], of["k1"], of["b"])
            queries = asked.starts[term + 1] - asked.starts[term]
            upto, low = np.cumsum(queries), 0
            while low < len(doc):
                high = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right"))
                high = int(np.searchsorted(doc, doc[max(low, high - 1)], "right"))  # whole documents
                size = queries[low:high]
                of_posting = np.repeat(np.arange(low, high), size)
                at = np.arange(len(of_posting)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(asked.starts[term[low:high]], size)
                q, d = asked.query[at], doc[of_posting]
                value = asked.weight[at] * part[of_posting]
                if asked.allowed is not None:
                    on = asked.allowed[q, ids[d] // asked.width]
                    q, d, value = q[on], d[on], value[on]
                q, d, value = _added(q, d, value, len(asked.qids))
                yield q, np.floor(value * scale + 0.5) / scale, ids[d]
                low = high


def _added(q: np.ndarray, d: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value added up by query and document."""
    if not len(q):
        return q, d, value
    first = d.min()
    width = int(d.max() - first) + 1
    cell = q * width + (d - first)
    if n * width <= 4 * len(cell):
        cells = np.flatnonzero(np.bincount(cell, minlength=n * width))
        sums = np.bincount(cell, weights=value, minlength=n * width)[cells]
    else:
        cells, place = np.unique(cell, return_inverse=True)
        sums = np.bincount(place, weights=value)
    return cells // width, cells % width + first, sums
