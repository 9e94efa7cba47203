"""Query sets drawn from bands of the vocabulary by document frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlex.operators.dense import dense_ids
from lumenlex.shared import cut

# The bands and lengths of the standard sets.
BANDS = {"random": None, "common": (0.01, False), "very_common": (0.0001, False), "rare": (0.1, True), "skewed": (0.0001, None)}
LENGTHS, SHORT_LENGTHS, DRAWS = (5, 10), (3, 4), 8


def by_df(terms: DataFrame) -> DataFrame:
    """terms with position: 0 for the highest df, ties by term."""
    return dense_ids(terms, F.desc("df"), F.col("term"), name="position")


def band(terms: DataFrame, fraction: float, rare: bool | None = False) -> DataFrame:
    """The int(n * fraction) terms of highest df; rare: of lowest df; None: both."""
    placed = by_df(terms)
    n = placed.count()
    k = int(n * fraction)
    top, bottom = placed.where(F.col("position") < k), placed.where(F.col("position") >= n - k)
    chosen = top.unionByName(bottom) if rare is None else bottom if rare else top
    return chosen.select("term", "df")


def _unit(*of: Column) -> Column:
    """A number in (0, 1) that only depends on of."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sampled(terms: DataFrame, n_queries: int, lengths: tuple[int, int] = LENGTHS, seed: int = 42, weighted: bool = False) -> DataFrame:
    """qid, text: queries of distinct terms, uniform or weighted by df over all terms, the same at each run.

    Terms lie side by side on a line, each as wide as its weight: df, or 1. A query draws points by hashes and takes
    the first terms that they hit, which is sampling without replacement. A query whose draws hit too few distinct
    terms (a small or very skewed vocabulary) takes the others by the smallest -ln(hash) / weight over all terms that
    it does not have yet, which continues the same sampling.
    """
    low, high = lengths
    placed = cumulative(terms).withColumn("weight", F.col("df")) if weighted else by_df(terms).withColumn("weight", F.lit(1)).withColumn("upto", F.col("position") + 1)
    # Kept, as the cells, the total and the queries left short read it.
    spans = cut(placed.select("term", "weight", (F.col("upto") - F.col("weight")).alias("start"), "upto"))
    total, n = spans.agg(F.max("upto"), F.count(F.lit(1))).first()
    if not n:
        return terms.sparkSession.createDataFrame([], "qid long, text string")
    want = F.least(F.lit(low) + F.floor(_unit(F.lit(seed), F.lit("length"), F.col("qid")) * (high - low + 1)), F.lit(n)).alias("want")
    queries = terms.sparkSession.range(n_queries).withColumnRenamed("id", "qid").select("qid", want)
    # Points meet terms by cells as wide as the mean weight: no more cells than twice the terms.
    width = max(1, total // n)
    cell = lambda c: F.floor(c / width)
    point = F.least(F.floor(_unit(F.lit(seed), F.lit("draw"), F.col("qid"), F.col("draw")) * F.lit(total)), F.lit(total - 1))
    draws = queries.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS * high - 1)))).withColumn("at", point).withColumn("cell", cell(F.col("at")))
    cells = spans.select("term", "start", "upto", F.explode(F.sequence(cell(F.col("start")), cell(F.col("upto") - 1))).alias("cell"))
    hit = draws.join(cells, "cell").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("upto")))
    firsts = hit.groupBy("qid", "want", "term").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("draw"))
    picked = cut(firsts.withColumn("rank", rank).where(F.col("rank") <= F.col("want")).select("qid", "rank", "term"))
    counts = picked.groupBy("qid").agg(F.count(F.lit(1)).alias("have"))
    short = queries.join(counts, "qid", "left").na.fill(0, ["have"]).where(F.col("have") < F.col("want"))
    key = -F.log(_unit(F.lit(seed), F.lit("key"), F.col("qid"), F.col("term"))) / F.col("weight")
    left = short.crossJoin(spans.select("term", "weight")).join(picked.select("qid", "term"), ["qid", "term"], "left_anti")
    more = left.withColumn("no", F.row_number().over(Window.partitionBy("qid").orderBy(key, "term"))).where(F.col("no") <= high).where(F.col("have") + F.col("no") <= F.col("want"))
    picked = picked.unionByName(more.select("qid", (F.col("have") + F.col("no")).cast("int").alias("rank"), "term"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda p: p["term"]), " ")
    return picked.groupBy("qid").agg(text.alias("text"))


def standard_sets(terms: DataFrame, n_queries: int = 2000, seed: int = 42, short: bool = False) -> dict[str, DataFrame]:
    """The standard query sets by name, and one weighted by df."""
    lengths, out = SHORT_LENGTHS if short else LENGTHS, {}
    for name, part in BANDS.items():
        out[name] = sampled(terms if part is None else band(terms, *part), n_queries, lengths, seed)
    return out | {"weighted": sampled(terms, n_queries, lengths, seed, weighted=True)}


def cumulative(terms: DataFrame) -> DataFrame:
    """terms with upto: the sum of df over the terms of at least that df, by ranges and offsets."""
    placed = by_df(terms).withColumn("_chunk", F.floor(F.col("position") / 4096))
    sums = placed.groupBy("_chunk").agg(F.sum("df").alias("_sum"))
    before = sums.select("_chunk", F.coalesce(F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("df").over(Window.partitionBy("_chunk").orderBy("position"))
    return placed.withColumn("_own", within).join(before, "_chunk").select("term", "df", "position", (F.col("_before") + F.col("_own")).alias("upto"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
