"""The inverted index as tables: docs, texts, postings, terms, blocks, doc_len, stats.

Texts move once, by a range sort of raw_id, and are kept as terms joined by spaces. Their terms are counted where the
document is, in Arrow batches, so a posting moves once as well: by a range sort of term and document. Postings carry
the document's length, and neither bounds nor scores need a join with the lengths. A run of ``block_size`` postings of
a term is a block with the largest contribution in it.

Both sorts number rows inside their range as they are written; what lies in the ranges before is at most one row for
each range, which is broadcast and added as the tables are read. A term that very many documents hold spreads over many
ranges, and no row is moved or written again for its number.

N is the highest mapped_id that has tokens, plus one; the mean length counts documents with tokens. Both bounds and
scores use the same mean, so a bound is never below a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlex.functions import bm25, text
from lumenlex.functions.porter2 import stem as stem_word
from lumenlex.operators.dense import dense_ids
from lumenlex.shared import giving_back, scratch

BLOCK_SIZE = 128
TABLES = ("docs", "texts", "postings", "terms", "blocks", "doc_len", "stats")
#: What is written: rows of texts and postings numbered inside their range, and what the ranges before hold.
PARTS = ("listed", "ranges", "sorted", "edges", "bounds", "stats")
#: Bytes of terms that are counted at once, and tokens for each range of postings at most about.
SLICE, TOKENS = 8 << 20, 2_000_000
IN_RANGE = 33  # bits of monotonically_increasing_id below the partition's number


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # raw_id, mapped_id
    texts: DataFrame  # mapped_id, len, terms: joined by spaces, documents with tokens
    postings: DataFrame  # term, mapped_id, tf, len, no: within the term, gap: to the posting before, or mapped_id
    terms: DataFrame  # term, df, idf, term_ub
    blocks: DataFrame  # term, block_no, start_doc, end_doc, n, block_ub
    doc_len: DataFrame  # mapped_id, len
    stats: DataFrame  # one row: n_docs, total_docs, total_tokens, avgdl, k1, b, block_size, stemmed
    parts: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def save(self, path: str) -> None:
        """Writes the index under path, replacing what is there."""
        if not self.parts:
            raise ValueError("only an index that was built or loaded can be saved")
        for name in PARTS:
            _write(self.parts[name], f"{path}/{name}", "overwrite")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        parts = {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
        mapped = _mapped(parts["listed"], parts["ranges"])
        full, bounds = mapped.where("len > 0"), parts["bounds"]
        return Index(
            mapped.select("raw_id", "mapped_id"),
            full.select("mapped_id", "len", "terms"),
            _numbered(parts["sorted"], parts["edges"]),
            bounds.where("block_no = 0").select("term", "df", "idf", "term_ub"),
            bounds.select("term", "block_no", "start_doc", "end_doc", "n", "block_ub"),
            full.select("mapped_id", "len"),
            parts["stats"],
            parts,
        )


def _write(table: DataFrame, path: str, mode: str = "error") -> DataFrame:
    table.write.mode(mode).option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def map_ids(raw_ids: DataFrame, column: str) -> DataFrame:
    """raw_id, mapped_id: dense from 0 in the order of raw_id. Each row gets a number, repeats too."""
    return dense_ids(raw_ids.select(F.col(column).alias("raw_id")), F.col("raw_id"), name="mapped_id")


def listed(docs: DataFrame, stem: bool = False) -> DataFrame:
    """raw_id, len, terms, at of docs(raw_id, text), in ranges of raw_id: texts are tokenized where they arrive."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("raw_id", "text").repartitionByRange(n, "raw_id").sortWithinPartitions("raw_id")
    split = rows.select("raw_id", text.terms(F.col("text")).alias("terms"))
    flat = split.select("raw_id", F.coalesce(F.greatest(F.size("terms"), F.lit(0)), F.lit(0)).cast("long").alias("len"), F.array_join("terms", " ").alias("terms"))
    if stem:
        flat = flat.mapInArrow(_stems, flat.schema)
    return flat.withColumn("at", F.monotonically_increasing_id())


def _ranges(kept: DataFrame) -> DataFrame:
    """_range, _before: the rows in the ranges before, a row for each range."""
    counts = kept.groupBy(F.shiftright("at", IN_RANGE).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))


def _mapped(kept: DataFrame, ranges: DataFrame) -> DataFrame:
    """raw_id, mapped_id, len, terms: dense ids from the place inside the range."""
    placed = kept.withColumn("_range", F.shiftright("at", IN_RANGE)).join(F.broadcast(ranges), "_range")
    return placed.select("raw_id", (F.col("_before") + F.col("at").bitwiseAND(F.lit((1 << IN_RANGE) - 1))).alias("mapped_id"), "len", "terms")


def slices(terms: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, pa.Array]]:
    """(rows, row of each token, code of each token, words by code) of terms joined by spaces, SLICE bytes at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(terms):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        lists = pc.split_pattern(terms.slice(low, high - low), " ")
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(high - low), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        yield slice(low, high), row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        low = high


_stem = lru_cache(50_000)(stem_word)


@giving_back
def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """terms, stemmed: each distinct word of a slice once. Rows without terms stay empty."""
    for batch in batches:
        for rows, row, codes, words in slices(batch.column("terms")):
            part = batch.slice(rows.start, rows.stop - rows.start)
            stems = pa.array([_stem(w) for w in words.to_pylist()], pa.string())
            starts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), stems.take(pa.array(codes))), " ")
            yield pa.RecordBatch.from_arrays([joined if c == "terms" else part.column(c) for c in part.schema.names], part.schema.names)


@giving_back
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, mapped_id, tf, len of texts(mapped_id, len, terms), a row for each term of a document."""
    for batch in batches:
        for rows, row, codes, words in slices(batch.column("terms")):
            n = rows.stop - rows.start
            key, tf = np.unique(codes * n + row, return_counts=True)
            code, at = np.divmod(key, n)
            at = pa.array(at + rows.start)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code)), batch.column("mapped_id").take(at), pa.array(tf.astype(np.int64)), batch.column("len").take(at)], ["term", "mapped_id", "tf", "len"])


@giving_back
def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings with their place within the term in this range, and the gap to the one before it there."""
    part, last, rank, doc = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        terms, docs = batch.column("term"), batch.column("mapped_id").to_numpy()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or terms[0].as_py() != last
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        ranks = np.where(start < 0, rank + at, at - start)  # -1: the term of the batch before goes on
        gaps = docs - np.where(new, 0, np.concatenate([[doc], docs[:-1]]))
        last, rank, doc = terms[n - 1].as_py(), int(ranks[-1]) + 1, int(docs[-1])
        more = [pa.array(np.full(n, part, np.int32)), pa.array(ranks.astype(np.int32)), pa.array(gaps)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_range", "_rank", "_gap"])


def sorted_postings(texts: DataFrame, tokens: int) -> DataFrame:
    """term, mapped_id, tf, len, _range, _rank, _gap in the order of term and document."""
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // TOKENS)
    counted = texts.mapInArrow(_counted, "term string, mapped_id long, tf long, len long")
    moved = counted.repartitionByRange(n, "term", "mapped_id").sortWithinPartitions("term", "mapped_id")
    return moved.mapInArrow(_ranked, "term string, mapped_id long, tf long, len long, _range int, _rank int, _gap long")


def _edges(kept: DataFrame) -> DataFrame:
    """_range, _term, _before, _last of ranges that begin inside a term: its postings in the ranges before, and the last of
    these. No more rows than ranges."""
    ends = sorted(tuple(r) for r in kept.groupBy("_range").agg(F.min("term"), F.max("term")).collect())
    carried = {r: first for (_, _, end), (r, first, _) in zip(ends, ends[1:], strict=False) if first == end}
    out = []
    if carried:
        of = F.col("term").isin(*set(carried.values()))
        sums = kept.where(of).groupBy("term", "_range").agg(F.count(F.lit(1)), F.max("mapped_id")).collect()
        held: dict[str, list] = {}
        for term, at, n, last in sorted(tuple(r) for r in sums):
            before = held.get(term, [0, 0])
            if carried.get(at) == term:
                out.append((at, term, *before))
            held[term] = [before[0] + n, last]
    return kept.sparkSession.createDataFrame(out, "_range int, _term string, _before long, _last long").coalesce(1)


def _numbered(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """term, mapped_id, tf, len, no, gap: the edges added to the places inside a range."""
    of = edges.select(F.col("_range").alias("_at"), "_term", "_before", "_last")
    placed = kept.join(F.broadcast(of), (F.col("_range") == F.col("_at")) & (F.col("term") == F.col("_term")), "left")
    no = (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long").alias("no")
    gap = F.when((F.col("_rank") == 0) & F.col("_last").isNotNull(), F.col("mapped_id") - F.col("_last")).otherwise(F.col("_gap")).alias("gap")
    return placed.select("term", "mapped_id", "tf", "len", no, gap)


def corpus_stats(doc_len: DataFrame) -> DataFrame:
    return doc_len.agg(
        (F.coalesce(F.max("mapped_id"), F.lit(-1)) + 1).cast("long").alias("n_docs"),
        F.count(F.lit(1)).alias("total_docs"),
        F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum("len") / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"),
    )


def block_bounds(numbered: DataFrame, stats: DataFrame, k1: float = bm25.K1, b: float = bm25.B, block_size: int = BLOCK_SIZE) -> DataFrame:
    """term, block_no, start_doc, end_doc, n, block_ub, df, idf, term_ub of postings numbered within their term as no.

    The blocks of a term, one for each ``block_size`` postings, meet in one range.
    """
    row = stats.first()
    part = bm25.saturation(F.col("tf"), F.col("len"), F.lit(row["avgdl"]), k1, b)
    runs = numbered.groupBy("term", F.floor(F.col("no") / block_size).cast("long").alias("block_no")).agg(
        F.min("mapped_id").alias("start_doc"), F.max("mapped_id").alias("end_doc"), F.count(F.lit(1)).alias("n"), F.max(part).alias("_most")
    )
    n = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = Window.partitionBy("term")
    whole = runs.repartitionByRange(n, "term").sortWithinPartitions("term", "block_no").withColumns({"df": F.sum("n").over(of), "_whole": F.max("_most").over(of)})
    weighed = whole.withColumn("idf", bm25.idf(F.lit(row["n_docs"]), F.col("df")))
    return weighed.select("term", "block_no", "start_doc", "end_doc", "n", (F.col("_most") * F.col("idf")).alias("block_ub"), "df", "idf", (F.col("_whole") * F.col("idf")).alias("term_ub"))


def build(docs: DataFrame, k1: float = bm25.K1, b: float = bm25.B, block_size: int = BLOCK_SIZE, stem: bool = False, path: str | None = None) -> Index:
    """The index of docs(raw_id, text), written under path, which must not exist, or in the shared folder."""
    k1, b = bm25.checked(k1, b)
    if block_size < 1:
        raise ValueError(f"block_size must be at least 1: {block_size}")
    spark = docs.sparkSession
    path = path or scratch(spark, "index")
    kept = _write(listed(docs, stem), f"{path}/listed")
    texts = _mapped(kept, _write(_ranges(kept), f"{path}/ranges")).where("len > 0").select("mapped_id", "len", "terms")
    meta = corpus_stats(texts).select("*", F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(block_size).alias("block_size"), F.lit(stem).alias("stemmed"))
    stats = _write(meta, f"{path}/stats")
    placed = _write(sorted_postings(texts, stats.first()["total_tokens"]), f"{path}/sorted")
    numbered = _numbered(placed, _write(_edges(placed), f"{path}/edges"))
    _write(block_bounds(numbered, stats, k1, b, block_size), f"{path}/bounds")
    return Index.load(spark, path)
