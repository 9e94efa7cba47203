"""Registered queries over an index of ``documents``, and their SQL.

The index of a folder is built once for a session, written to the shared folder, and read from there by each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.functions import bm25, text
from lumenlex.functions.porter2 import stemmed
from lumenlex.operators import evaluate, querysets, search
from lumenlex.operators import index as ix
from lumenlex.shared import scratch

TERMS = ("antion", "retion", "aning", "reing")
_BUILT: dict[tuple[str, str, bool], str] = {}


def index_of(spark: SparkSession, sf_dir: str, stem: bool = False) -> ix.Index:
    key = (spark.sparkContext.applicationId, sf_dir, stem)
    if key not in _BUILT:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("raw_id"), "text")
        path = scratch(spark, "index")
        ix.build(docs, stem=stem, path=path)
        _BUILT[key] = path
    return ix.Index.load(spark, _BUILT[key])


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, terms: the benchmark's passages as queries, repeats kept."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("qid"), text.terms(F.col("text")).alias("terms"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search(index_of(spark, sf_dir), list(TERMS), 10)).select("mapped_id", "score")


def bm25_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search(index_of(spark, sf_dir), list(TERMS), 10, exhaustive=False)).select("mapped_id", "score")


def bm25_topk_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    return rounded(search.decoded(i, search.search(i, list(TERMS), 10))).select("raw_id", "score")


def bm25_unknown_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search(index_of(spark, sf_dir), ["antion", "zzzznosuchterm"], 10)).select("mapped_id", "score")


def bm25_duplicate_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search(index_of(spark, sf_dir), ["antion", "antion", "retion"], 10)).select("mapped_id", "score")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search_batch(index_of(spark, sf_dir), asked(spark, sf_dir), 10)).select("qid", "rank", "mapped_id", "score")


def bm25_batch_own_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir).withColumn("k", (F.col("qid") % 5 + 1).cast("int"))
    return rounded(search.search_batch(index_of(spark, sf_dir), queries)).select("qid", "rank", "mapped_id", "score")


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    stats = i.stats.first()
    found = i.postings.where(F.col("term").isin(*TERMS)).join(i.terms.select("term", "df"), "term")
    value = bm25.score(F.lit(stats["n_docs"]), F.col("df"), F.col("tf"), F.col("len"), F.lit(stats["avgdl"]))
    return rounded(found.groupBy("mapped_id").agg(F.sum(value).alias("score")))


def bm25_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    value = bm25.saturation(F.col("tf"), F.col("len"), F.lit(i.stats.first()["avgdl"]))
    return i.postings.where(F.col("term").isin(*TERMS)).select("term", "mapped_id", F.round(value, 6).alias("saturation"))


def run_trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    results = search.decoded(i, search.search_batch(i, asked(spark, sf_dir), 5)).withColumnRenamed("raw_id", "doc_id")
    return rounded(evaluate.trec_run(results, "bm25"))


def run_marco(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    return search.decoded(i, search.search_batch(i, asked(spark, sf_dir), 5)).select("qid", F.col("raw_id").alias("pid"), "rank")


def bm25_batch_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_batch(index_of(spark, sf_dir), asked(spark, sf_dir), 10, exhaustive=False)
    return rounded(found).select("qid", "rank", "mapped_id", "score")


def rank_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned against exhaustive search at k = 1000: the benchmark's passages as queries."""
    i, queries = index_of(spark, sf_dir), asked(spark, sf_dir)
    runs = [search.search_batch(i, queries, 1000, exhaustive) for exhaustive in (False, True)]
    return evaluate.safety_summary(evaluate.rank_safety(*runs))


def retrieval_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known items: each passage of the benchmark is relevant in the documents that hold it whole."""
    i = index_of(spark, sf_dir)
    run = search.decoded(i, search.search_batch(i, asked(spark, sf_dir), 100)).select("qid", "rank", F.col("raw_id").alias("doc_id"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # A document that holds a passage of three words or more has its longest inner word: an equi-join, then the test.
    parts = F.split("text", "[ \n]")
    inner = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    words = items.select(F.col("item_id").alias("qid"), F.col("text").alias("passage"), F.array_max(inner)["w"].alias("word"))
    held = docs.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("word")).join(words, "word").where(F.contains("text", "passage"))
    out = evaluate.effectiveness(run, held.select("qid", "doc_id"), 10, 100)
    return out.select("queries", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


def dense_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ix.map_ids(docs, "doc_id")


def id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "lookup")
    ix.map_ids(docs, "doc_id").write.mode("overwrite").parquet(path)
    lookup = spark.read.parquet(path)
    return docs.select("doc_id", "n_chars").join(lookup, F.col("doc_id") == F.col("raw_id")).select("mapped_id", "raw_id", "n_chars")


def doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's length; those without tokens have 0."""
    i = index_of(spark, sf_dir)
    return i.docs.select("mapped_id").join(i.doc_len, "mapped_id", "left").select("mapped_id", F.coalesce("len", F.lit(0)).alias("len"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).stats.select("n_docs", "total_docs", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.select("term", "mapped_id", "tf")


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).terms.select("term", "df").orderBy(F.desc("df"), "term")


def term_ub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).terms.select("term", F.round("term_ub", 6).alias("term_ub"))


def block_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).blocks.select("term", "block_no", "start_doc", "end_doc", "n", F.round("block_ub", 6).alias("block_ub"))


def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap to the document before, within each block; the first of a block is absolute."""
    delta = F.when(F.col("no") % ix.BLOCK_SIZE == 0, F.col("mapped_id")).otherwise(F.col("gap"))
    return index_of(spark, sf_dir).postings.select("term", "mapped_id", delta.alias("delta"))


def df_band_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querysets.band(index_of(spark, sf_dir).terms, 0.01)


def df_band_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querysets.band(index_of(spark, sf_dir).terms, 0.1, rare=True)


def df_band_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querysets.band(index_of(spark, sf_dir).terms, 0.001, rare=None)


def df_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querysets.cumulative(index_of(spark, sf_dir).terms)


def df_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.percentile("df", F.array(*map(F.lit, (0.5, 0.9, 0.99, 0.9999))))
    row = index_of(spark, sf_dir).terms.agg(at.alias("at"), F.max("df").alias("max_df"), F.count(F.lit(1)).alias("n_terms"))
    return row.select(*[F.round(F.col("at")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99", "p9999"))], "max_df", "n_terms")


def query_set_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querysets.sampled(index_of(spark, sf_dir).terms, 200)


def query_set_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querysets.sampled(index_of(spark, sf_dir).terms, 200, weighted=True)


def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = index_of(spark, sf_dir).terms.select("term")
    return terms.select("term", stemmed(F.col("term")).alias("stem"))


def bm25_topk_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlex.functions.porter2 import stem

    return rounded(search.search(index_of(spark, sf_dir, stem=True), [stem(t) for t in TERMS], 10)).select("mapped_id", "score")


QUERIES = {
    f.__name__ if f is not stats else "corpus_stats": f
    for f in (
        bm25_topk, bm25_topk_pruned, bm25_topk_raw, bm25_unknown_term, bm25_duplicate_term, bm25_batch, bm25_batch_pruned, bm25_batch_own_k, bm25_scores, bm25_saturation,
        run_trec, run_marco, rank_safety, retrieval_effectiveness, dense_id, id_roundtrip, doc_len, stats, postings, term_df, term_ub, block_meta, posting_deltas,
        df_band_top, df_band_bottom, df_band_skewed, df_cumsum, df_percentiles, query_set_uniform, query_set_weighted, stemmed_vocabulary, bm25_topk_stemmed,
    )
}

_SAT = bm25.saturation_sql("p.tf", "l.len", "s.avgdl")
INDEX_SQL = f"""
  mapped AS (SELECT doc_id AS raw_id, row_number() OVER (ORDER BY doc_id) - 1 AS mapped_id, text FROM documents),
  tokens AS (SELECT mapped_id, unnest({text.terms_sql("text")}) AS term FROM mapped),
  postings AS (SELECT term, mapped_id, count(*) AS tf FROM tokens GROUP BY term, mapped_id),
  lens AS (SELECT mapped_id, count(*) AS len FROM tokens GROUP BY mapped_id),
  s AS (SELECT max(mapped_id) + 1 AS n_docs, count(*) AS total_docs, sum(len)::BIGINT AS total_tokens, sum(len) / count(*)::DOUBLE AS avgdl FROM lens),
  dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  parts AS (SELECT p.term, p.mapped_id, p.tf, {_SAT} AS sat, ln(s.n_docs::DOUBLE / d.df) AS idf, d.df FROM postings p JOIN lens l USING (mapped_id) JOIN dfs d USING (term), s),
  blocked AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY mapped_id) - 1) // {ix.BLOCK_SIZE} AS block_no FROM parts),
  asked AS (SELECT item_id AS qid, unnest({text.terms_sql("text")}) AS term FROM benchmark),
  scored AS (SELECT a.qid, p.mapped_id, round(sum(p.idf * p.sat), 6) AS score FROM asked a JOIN parts p USING (term) GROUP BY a.qid, p.mapped_id),
  run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, mapped_id) AS rank FROM scored),
  placed AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS position, count(*) OVER () AS n FROM dfs)"""


def _with(select: str) -> str:
    return f"WITH {INDEX_SQL}\n{select}"


def _topk(terms: list[str], k: int = 10) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"SELECT p.mapped_id, round(sum(p.idf * p.sat), 6) AS score FROM (VALUES {values}) q(term) JOIN parts p USING (term) GROUP BY p.mapped_id ORDER BY score DESC, p.mapped_id LIMIT {k}"


_IN = ", ".join(f"'{t}'" for t in TERMS)
ORACLES = {
    "bm25_topk": _with(_topk(list(TERMS))),
    "bm25_topk_pruned": _with(_topk(list(TERMS))),
    "bm25_topk_raw": _with(f"SELECT m.raw_id, t.score FROM ({_topk(list(TERMS))}) t JOIN mapped m USING (mapped_id)"),
    "bm25_unknown_term": _with(_topk(["antion", "zzzznosuchterm"])),
    "bm25_duplicate_term": _with(_topk(["antion", "antion", "retion"])),
    "bm25_batch": _with("SELECT qid, rank::INTEGER AS rank, mapped_id, round(score, 6) AS score FROM run WHERE rank <= 10"),
    "bm25_batch_own_k": _with("SELECT qid, rank::INTEGER AS rank, mapped_id, round(score, 6) AS score FROM run WHERE rank <= qid % 5 + 1"),
    "bm25_scores": _with(f"SELECT mapped_id, round(sum(idf * sat), 6) AS score FROM parts WHERE term IN ({_IN}) GROUP BY mapped_id"),
    "bm25_saturation": _with(f"SELECT term, mapped_id, round(sat, 6) AS saturation FROM parts WHERE term IN ({_IN})"),
    "run_trec": _with("SELECT qid, 'Q0' AS q0, raw_id AS doc_id, rank::INTEGER AS rank, round(score, 6) AS score, 'bm25' AS tag FROM run JOIN mapped USING (mapped_id) WHERE rank <= 5"),
    "run_marco": _with("SELECT qid, raw_id AS pid, rank::INTEGER AS rank FROM run JOIN mapped USING (mapped_id) WHERE rank <= 5"),
    "bm25_batch_pruned": _with("SELECT qid, rank::INTEGER AS rank, mapped_id, round(score, 6) AS score FROM run WHERE rank <= 10"),
    "rank_safety": _with("SELECT count(DISTINCT qid) AS queries, count(DISTINCT qid) AS rank_matches, 0 AS ids_missing, 0 AS ids_extra, count(DISTINCT qid) AS score_ranges_equal FROM run"),
    "retrieval_effectiveness": _with("""SELECT count(*) AS queries, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 6) AS mrr, round(avg(hits / n::DOUBLE), 6) AS recall FROM (
  SELECT b.item_id, count(*) AS n, min(r.rank) AS first, count(r.rank) FILTER (WHERE r.rank <= 100) AS hits FROM benchmark b JOIN mapped m ON contains(m.text, b.text)
  LEFT JOIN (SELECT * FROM run WHERE rank <= 100) r ON r.qid = b.item_id AND r.mapped_id = m.mapped_id GROUP BY b.item_id)"""),
    "dense_id": "SELECT doc_id AS raw_id, row_number() OVER (ORDER BY doc_id) - 1 AS mapped_id FROM documents",
    "id_roundtrip": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS mapped_id, doc_id AS raw_id, n_chars FROM documents",
    "doc_len": _with("SELECT m.mapped_id, coalesce(l.len, 0) AS len FROM mapped m LEFT JOIN lens l USING (mapped_id)"),
    "corpus_stats": _with("SELECT n_docs, total_docs, total_tokens, round(avgdl, 6) AS avgdl FROM s"),
    "postings": _with("SELECT term, mapped_id, tf FROM postings"),
    "term_df": _with("SELECT term, df FROM dfs ORDER BY df DESC, term"),
    "term_ub": _with("SELECT term, round(max(idf * sat), 6) AS term_ub FROM parts GROUP BY term"),
    "block_meta": _with("SELECT term, block_no, min(mapped_id) AS start_doc, max(mapped_id) AS end_doc, count(*) AS n, round(max(idf * sat), 6) AS block_ub FROM blocked GROUP BY term, block_no"),
    "posting_deltas": _with("SELECT term, mapped_id, mapped_id - lag(mapped_id, 1, 0) OVER (PARTITION BY term, block_no ORDER BY mapped_id) AS delta FROM blocked"),
    "df_band_top": _with("SELECT term, df FROM placed WHERE position < floor(n * 0.01)"),
    "df_band_bottom": _with("SELECT term, df FROM placed WHERE position >= n - floor(n * 0.1)"),
    "df_band_skewed": _with("SELECT term, df FROM placed WHERE position < floor(n * 0.001) OR position >= n - floor(n * 0.001)"),
    "df_cumsum": _with("SELECT term, df, position, sum(df) OVER (ORDER BY position)::BIGINT AS upto FROM placed"),
    "df_percentiles": _with("SELECT round(quantile_cont(df, 0.5), 6) AS p50, round(quantile_cont(df, 0.9), 6) AS p90, round(quantile_cont(df, 0.99), 6) AS p99, round(quantile_cont(df, 0.9999), 6) AS p9999, max(df) AS max_df, count(*) AS n_terms FROM dfs"),
}
