"""Comparing and measuring runs: rank safety, effectiveness, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_safety(one: DataFrame, other: DataFrame) -> DataFrame:
    """For each qid: whether both runs list the same ids in the same order, ids missing from and extra in the first,
    and the range of scores in each (NULL for an empty list). Runs: qid, rank, score, mapped_id."""

    def listed(run: DataFrame, side: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct("rank", "mapped_id")))
        return run.groupBy("qid").agg(F.transform(pairs, lambda p: p["mapped_id"]).alias(f"{side}_ids"), F.min("score").alias(f"{side}_min"), F.max("score").alias(f"{side}_max"))

    both = listed(one, "a").join(listed(other, "b"), "qid", "full")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce("a_ids", none), F.coalesce("b_ids", none)
    return both.select("qid", (a == b).alias("rank_match"), F.size(F.array_except(b, a)).alias("missing"), F.size(F.array_except(a, b)).alias("extra"), "a_min", "a_max", "b_min", "b_max")


def safety_summary(compared: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    near = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance
    return compared.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum(F.col("rank_match").cast("int")).alias("rank_matches"),
        F.sum("missing").alias("ids_missing"),
        F.sum("extra").alias("ids_extra"),
        F.count_if(near("min") & near("max")).alias("score_ranges_equal"),
    )


def effectiveness(run: DataFrame, relevant: DataFrame, depth: int, recall_depth: int) -> DataFrame:
    """queries, mrr, recall: the mean reciprocal rank within depth and the mean recall within recall_depth.

    run: qid, rank, doc_id. relevant: qid, doc_id. Means are over the queries that have something relevant.
    """
    wanted = relevant.distinct()
    hits = run.join(wanted, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= recall_depth).alias("hits"))
    each = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).join(hits, "qid", "left")
    return each.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.when(F.col("first") <= depth, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"),
        F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"),
    )


def latency(times: DataFrame, column: Column) -> DataFrame:
    """mean, p50, p95, p99, max and min, percentiles interpolated linearly."""
    at = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    row = times.agg(F.avg(column).alias("mean"), at.alias("at"), F.max(column).alias("max"), F.min(column).alias("min"))
    return row.select("mean", F.col("at")[0].alias("p50"), F.col("at")[1].alias("p95"), F.col("at")[2].alias("p99"), "max", "min")


def trec_run(results: DataFrame, tag: str) -> DataFrame:
    """qid, Q0, doc_id, rank, score, tag: the fields of a TREC run file, in its order."""
    return results.select("qid", F.lit("Q0").alias("q0"), "doc_id", "rank", "score", F.lit(tag).alias("tag"))
