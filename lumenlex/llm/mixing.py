"""Mixing sources to target weights by subset-sum budget fitting.

Sources in order of code points, NULL last, weigh 1, 2, 3, 1, ... and share all words; a target stops at ``cap`` times
its source's words and the excess is shared again by weight. A source takes each document ``epochs`` times, as often
as its target allows, and fits the remaining budget by a subset: documents are counted by exact length, each length
first gives its proportional share, the largest then fill the budget down to ``window`` words, and a
bounded-knapsack dynamic program over all lengths left, shortest first, closes the gap as far as any of them can. Within a length, documents are picked in the
order of a seeded hash.

Only counts meet in one place: a source's counts by length (as many rows as it has lengths) in one task, sources
never on the driver. Ranks within a length are local to one of 1,024 slices of the hash, with offsets from the slice
counts, so that a length that holds a third of all rows spreads over tasks.

Defined results: a NULL or empty text has size 0 and is taken ``epochs`` times, which is 0 words. Rows that share a
doc_id are documents of their own; equal rows are interchangeable. Without words all targets are 0. Columns of the
input may bear any name that does not start with ``__mix_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlex.operators.dense import dense_ids
from lumenlex.shared import cut

WEIGHTS, CAP, SEED, WINDOW_WORDS = (1, 2, 3), 3, 17, 1 << 16
SLICE_BITS = 10
WHITE = " \t\n\x0b\x0c\r"
KEYS = ["__mix_source", "__mix_null", "__mix_size", "__mix_slice"]


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return docs.withColumns(
        {
            "__mix_source": F.coalesce("source", F.lit("")),
            "__mix_null": F.col("source").isNull(),
            "__mix_size": n_words(F.col("text")),
            "__mix_order": order,
            "__mix_slice": F.shiftrightunsigned(order, 64 - SLICE_BITS).cast("int"),
        }
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """__mix_source, __mix_null, source_size, target from the first three. Each round shares what full sources leave."""
    ranked = dense_ids(totals, F.col("__mix_null"), F.col("__mix_source"), name="__mix_no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__mix_no") % len(weights) + 1).cast("int"))
    weighed = cut(ranked.withColumn("__mix_weight", weight.cast("double")))
    most, level = F.col("source_size") * float(cap), 0.0
    words = weighed.agg(F.sum("source_size")).first()[0] or 0
    while words:
        full = most < F.lit(level) * F.col("__mix_weight")
        row = weighed.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("__mix_weight")))).first()
        raised = (words - row[0]) / row[1] if row[1] else level
        if raised <= level:
            break
        level = raised
    return weighed.select("__mix_source", "__mix_null", "source_size", F.least(most, F.lit(level) * F.col("__mix_weight")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW_WORDS) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to budget from below as can be found."""
    taken = np.zeros(len(sizes), np.int64)
    words = int((sizes * counts).sum())
    if budget <= 0 or words == 0:
        return taken
    if budget >= words:
        return counts.astype(np.int64)
    taken = np.floor(counts * (budget / words)).astype(np.int64)
    left, rest = counts - taken, budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= window:
            break
        more = min(int(left[i]), (rest - 1) // int(sizes[i])) if sizes[i] else 0
        taken[i] += more
        left[i] -= more
        rest -= more * int(sizes[i])
    # Which sums up to rest can be reached, and by which step each was first: the steps before it reach what is left.
    rest = int(rest)
    reach, first, steps = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int64), []
    reach[0] = True
    for i in np.flatnonzero((left > 0) & (sizes > 0) & (sizes <= rest)):
        n, lot = min(int(left[i]), rest // int(sizes[i])), 1
        while n > 0 and not reach[rest]:
            lot = min(lot, n)
            by = lot * int(sizes[i])
            new = reach[:-by] & ~reach[by:]
            first[by:][new] = len(steps)
            reach[by:] |= new
            steps.append((int(i), lot))
            n, lot = n - lot, lot * 2
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, lot = steps[first[at]]
        taken[i] += lot
        at -= lot * int(sizes[i])
    return taken


def plans(counts: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For each source, size and slice: n_before (rows in lower slices), n_take, epochs, source_size, target."""
    by_size = counts.groupBy("__mix_source", "__mix_null", "__mix_size").agg(F.sum("__mix_n").alias("__mix_n"))
    totals = by_size.groupBy("__mix_source", "__mix_null").agg(F.sum(F.col("__mix_size") * F.col("__mix_n")).cast("long").alias("source_size"))
    aims = cut(targets(totals, weights, cap))

    def of_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__mix_size", ignore_index=True)  # the fit depends on the order, and a shuffle's differs
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        epochs = int(target // size) if size else 0
        lengths = rows["__mix_size"].to_numpy()
        taken = fit(lengths, rows["__mix_n"].to_numpy(), round(target - epochs * size))
        return rows.assign(epochs=epochs, n_take=taken).drop(columns="__mix_n")

    schema = "__mix_source string, __mix_null boolean, __mix_size long, source_size long, target double, epochs int, n_take long"
    fitted = cut(by_size.join(aims, ["__mix_source", "__mix_null"]).groupBy("__mix_source", "__mix_null").applyInPandas(of_source, schema))
    lower = Window.partitionBy("__mix_source", "__mix_null", "__mix_size").orderBy("__mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("n_before", F.coalesce(F.sum("__mix_n").over(lower), F.lit(0))).drop("__mix_n")
    return before.join(fitted, KEYS[:3])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """docs with __mix_size, source_size, target and __mix_copies, how often the mix takes the row."""
    rows = sized(docs, seed)
    counts = cut(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__mix_n")))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("__mix_order", "doc_id"))
    plan = plans(counts, weights, cap).select(*KEYS, F.struct("n_before", "n_take", "epochs", "source_size", "target").alias("__mix_plan"))
    placed = rows.withColumn("__mix_rank", rank).join(plan, KEYS)
    picked = (F.col("__mix_plan.n_before") + F.col("__mix_rank") <= F.col("__mix_plan.n_take")).cast("int")
    return placed.withColumn("__mix_copies", F.col("__mix_plan.epochs") + picked)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    out = mix(docs, weights, cap, seed).where(F.col("__mix_copies") > 0)
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, size, source_size, target, taken for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    size, plan = F.col("__mix_size"), F.col("__mix_plan")
    return mix(docs).select("doc_id", size.alias("size"), plan["source_size"].alias("source_size"), plan["target"].alias("target"), (size * F.col("__mix_copies")).alias("taken"))
