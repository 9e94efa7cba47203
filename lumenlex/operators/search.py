"""BM25 top-k over an index: exhaustive, pruned by block bounds, and in batches.

Results are ordered by score, then by the smaller mapped_id. Scores are rounded to DIGITS decimals first, so documents
with equal contributions tie, in whichever order these were summed. Query terms that the index does not know are dropped;
repeated ones count each time; documents that score 0 are returned if nothing better fills the k.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlex.functions import bm25
from lumenlex.operators import scoring
from lumenlex.operators.index import Index
from lumenlex.shared import cut

#: Query terms of a batch up to this many are sent to every task, which scores whole documents; more are shuffled.
SMALL_BATCH, DIGITS, SLACK = 200_000, 6, 2e-6
#: Pairs of a query and a chunk that are sent to every task at most.
SMALL_PAIRS = 1_000_000
#: Ids of a chunk at least, chunks at most, chunks that give the first bound, blocks of a term that bounds itself.
WIDTH, CHUNKS, SEEDS, FEW_BLOCKS = 4_096, 65_536, 4, 8


def _checked(k: int) -> int:
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    return k


def _part(tf: Column, length: Column, stats) -> Column:
    return bm25.saturation(tf, length, F.lit(stats["avgdl"]), stats["k1"], stats["b"])


def _weights(index: Index, terms: list[str]) -> dict[str, tuple[float, int]]:
    """idf times repeats, and df, of the query's known terms: as many rows as the query has terms."""
    repeats = Counter(terms)
    rows = index.terms.where(F.col("term").isin(*repeats)).select("term", "idf", "df").collect() if repeats else []
    return {r["term"]: (r["idf"] * repeats[r["term"]], r["df"]) for r in rows}


def _scores(postings: DataFrame, weights: dict[str, tuple[float, int]], stats) -> DataFrame:
    """mapped_id, score of every posting's document; the terms reach the scan as a filter."""
    found = postings.where(F.col("term").isin(*weights))
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, (w, _) in sorted(weights.items())])
    return found.groupBy("mapped_id").agg(F.round(F.sum(weight * _part(F.col("tf"), F.col("len"), stats)), DIGITS).alias("score"))


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "mapped_id").limit(k)


def search(index: Index, terms: list[str], k: int = 10, exhaustive: bool = True) -> DataFrame:
    """score, mapped_id of the k best documents."""
    stats, weights = index.stats.first(), _weights(index, terms)
    spark = index.postings.sparkSession
    if not weights or not _checked(k):
        return spark.createDataFrame([], "mapped_id long, score double")
    if exhaustive:
        return _top(_scores(index.postings, weights, stats), k)
    one = spark.createDataFrame([(0, list(terms))], "qid int, terms array<string>")
    return search_batch(index, one, k, exhaustive=False).orderBy("rank").select("mapped_id", "score")


def _cells(index: Index, known: DataFrame, width: int, stats) -> DataFrame:
    """term, chunk, ub: the most that the term can add to a document of that stretch of ``width`` ids.

    Terms of few postings give their own chunks and exact bounds, the others those of the blocks that touch a chunk.
    """
    wanted = _small(known.select("term", "df", "idf").distinct())
    few = F.col("df") <= FEW_BLOCKS * stats["block_size"]
    part = _part(F.col("tf"), F.col("len"), stats) * F.col("idf")
    rare = index.postings.join(wanted.where(few), "term").select("term", _chunk("mapped_id", width).alias("chunk"), part.alias("ub"))
    spans = F.explode(F.sequence(_chunk("start_doc", width), _chunk("end_doc", width))).alias("chunk")
    common = index.blocks.join(wanted.where(~few), "term").select("term", spans, F.col("block_ub").alias("ub"))
    return rare.unionByName(common).groupBy("term", "chunk").agg(F.greatest(F.max("ub"), F.lit(0.0)).alias("ub"))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than SMALL_BATCH rows."""
    return F.broadcast(df) if df.count() <= SMALL_BATCH else df


def _chunk(column: str, width: int) -> Column:
    return F.floor(F.col(column) / width)


def _kept(index: Index, known: DataFrame, rows: list | None, most: int, stats) -> tuple[DataFrame, int]:
    """qid, chunk of those chunks of each query whose bound reaches its ``most``-th score in its best chunks; their width.

    The axis of documents is cut into chunks of at least WIDTH ids, at most CHUNKS of them. A query that finds fewer
    documents in its SEEDS best chunks has no bound yet, and keeps all its chunks.
    """
    width = max(WIDTH, -(-stats["n_docs"] // CHUNKS))
    cells = _cells(index, known, width, stats)
    sums = cut(known.join(cells, "term").groupBy("qid", "chunk").agg(F.sum(F.col("ub") * F.col("repeats")).alias("ub")))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ub"), "chunk"))
    seeds = cut(sums.withColumn("at", best).where(F.col("at") <= SEEDS).select("qid", "chunk"))
    scored = _scored(index, known, rows, most, stats, seeds, width)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "mapped_id"))
    bound = scored.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") == most).select("qid", F.col("score").alias("bound"))
    reach = sums.join(bound, "qid", "left").where(F.col("bound").isNull() | (F.col("ub") >= F.col("bound") - SLACK))
    return cut(reach.select("qid", "chunk")), width


def _scored(index: Index, known: DataFrame, rows: list | None, most: int, stats, chunks: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """qid, mapped_id, score: every query's ``most`` best and maybe more; with chunks(qid, chunk), only of documents there.

    rows: those of known, if they are few enough to be sent to every task.
    """
    pairs = None
    if rows is not None and chunks is not None:
        pairs = chunks.limit(SMALL_PAIRS + 1).collect()
    n_chunks = stats["n_docs"] // (width or 1) + 1
    if not rows or pairs is not None and (len(pairs) > SMALL_PAIRS or len({r["qid"] for r in rows}) * n_chunks > 64 * SMALL_PAIRS):
        weighed = known.select("qid", "term", "weight")
        return _batch_scores(index, weighed if chunks is None else weighed.join(chunks, "qid"), stats, width)
    texts = index.texts
    if pairs is not None:
        there = texts.sparkSession.createDataFrame([(c,) for c in sorted({c for _, c in pairs})], "chunk long")
        texts = texts.join(F.broadcast(there), _chunk("mapped_id", width) == F.col("chunk"), "left_semi")
    return scoring.best(texts, scoring.batch(rows, pairs, width or 1, n_chunks), known.schema["qid"], most, stats, DIGITS)


def _batch_scores(index: Index, asked: DataFrame, stats, width: int | None = None) -> DataFrame:
    """qid, mapped_id, score from asked(qid, term, weight[, chunk]); with chunks, only of documents there."""
    postings, on = index.postings, ["term"]
    if width is not None:
        postings, on = postings.withColumn("chunk", _chunk("mapped_id", width)), ["term", "chunk"]
    part = F.col("weight") * _part(F.col("tf"), F.col("len"), stats)
    return postings.join(asked, on).groupBy("qid", "mapped_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def search_batch(index: Index, queries: DataFrame, k: int = 10, exhaustive: bool = True) -> DataFrame:
    """qid, rank, score, mapped_id for queries(qid, terms[, k]); a query's own k wins over the common one.

    Not exhaustive: chunks of documents that cannot reach a query's best are not scored for it; results are the same.
    """
    stats, _ = index.stats.first(), _checked(k)
    own = "k" in queries.columns
    most = queries.agg(F.max("k")).first()[0] or 0 if own else k
    asked = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("repeats"))
    known = _small(asked).join(index.terms.select("term", "idf", "df"), "term")
    known = cut(known.select("qid", "term", (F.col("idf") * F.col("repeats")).alias("weight"), "repeats", "idf", "df"))
    rows = known.select("qid", "term", "weight").limit(SMALL_BATCH + 1).collect()
    rows = rows if len(rows) <= SMALL_BATCH else None
    if exhaustive or most < 1:
        scores = _scored(index, known, rows, most, stats)
    else:
        scores = _scored(index, known, rows, most, stats, *_kept(index, known, rows, most, stats))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "mapped_id"))
    ranked = scores.withColumn("rank", rank).where(F.col("rank") <= most)  # a literal bound lets Spark cut each group early
    if own:
        ranked = ranked.join(queries.select("qid", "k"), "qid").where(F.col("rank") <= F.col("k"))
    return ranked.select("qid", "rank", "score", "mapped_id")


def decoded(index: Index, results: DataFrame) -> DataFrame:
    """results with raw_id for mapped_id; the k rows are the small side of the join."""
    return results.join(index.docs, "mapped_id").drop("mapped_id")
