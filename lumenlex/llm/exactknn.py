"""Exact top-k inner products by a pivot-distance index.

A vector x becomes (x, sqrt(M - |x|^2)) with M the largest squared norm, and a query (q, 0): the largest inner product
then is the smallest distance. Vectors are keyed by their nearest pivot and the distance to it, sorted, and cut into
annuli. A query first looks into the annulus that it lies in itself; its k-th score there bounds how far better
ones can be. It then meets annuli in the order of their least possible distance, by the triangle inequality, and
stops where that exceeds the bound, which tightens on the way. Scores are exact integers; the bounds only exclude.

Pivots are picked from a bounded sample (``SAMPLE`` vectors of each dimension); every vector is indexed.

Defined results: a component x is floor(256 * x). Scores beyond 64 bits are held at their ends. Vectors that are NULL, empty or hold NULL or
non-finite components take no part, nor do rows without vec_id. Rows that share a vec_id count once, the least vector
stays. Vectors of other dimensions than the query's are no candidates. Other columns are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenlex.llm import vectors as V
from lumenlex.shared import cut

SAMPLE, PIVOTS, BLOCK, QUERY_BLOCK, K = 2048, 32, 1024, 256, 5
EXACT, MOST, LONG = float(1 << 53), sys.float_info.max, (1 << 63) - 1


def scaled(v: Column) -> Column:
    """floor(256 * x); a double beyond 53 bits has no fraction to drop, and none is infinite after it."""
    times = lambda x: F.least(F.greatest(x * 256.0, F.lit(-MOST)), F.lit(MOST))
    return F.transform(v, lambda x: F.when(F.abs(times(x)) < EXACT, F.floor(times(x)).cast("double")).otherwise(times(x)))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n points, each the farthest from those before it."""
    picked, near = [0], np.linalg.norm(points - points[0], axis=1)
    while len(picked) < min(n, len(points)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(points - points[picked[-1]], axis=1))
    return points[picked]


def lifted(m: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(most - (m * m).sum(1), 0))[:, None]])


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in 64-bit or in unbounded integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    if most < LONG / 2:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q).astype(object) @ whole(c).astype(object).T, -LONG, LONG).astype(np.int64)


def indexed(rows: DataFrame, pivots: dict[int, np.ndarray], most: dict[int, float]) -> DataFrame:
    """dim, vec_id, v, pivot, dist of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                away = np.linalg.norm(lifted(V.matrix(part.column("v")), most[dim])[:, None, :] - pivots[dim][None], axis=2)
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), part.column("vec_id"), part.column("v"), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])],
                    names=["dim", "vec_id", "v", "pivot", "dist"],
                )

    return rows.select("dim", "vec_id", "v").mapInArrow(run, "dim int, vec_id long, v array<double>, pivot int, dist double")


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where is_query holds, the k best other rows."""
    rows = cut(V.usable(vectors).withColumn("v", scaled(F.col("v"))))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    most = {r["dim"]: r["most"] for r in rows.groupBy("dim").agg(F.max(square).alias("most")).collect()}  # one row for each dimension
    pivots = {dim: farthest_first(lifted(m, most[dim]), PIVOTS) for dim, m in V.sample(rows, SAMPLE).items()}
    n = V.shards(rows)
    placed = cut(indexed(rows, pivots, most))
    in_order = lambda df: df.repartitionByRange(n, "dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id")

    def annulus(columns: dict[str, np.ndarray], m: np.ndarray) -> dict:
        return {"least": float(columns["dist"].min()), "most": float(columns["dist"].max())}

    def reach(columns: dict[str, np.ndarray], m: np.ndarray) -> dict:
        flat = np.hstack([m, np.zeros((len(m), 1))])
        away = np.linalg.norm(flat[:, None, :] - pivots[m.shape[1]][None], axis=2)
        return {"near": away.min(0).tolist(), "far": away.max(0).tolist(), "home": int(np.bincount(columns["pivot"]).argmax())}

    blocks = cut(V.packed(in_order(placed), ["dim", "pivot"], BLOCK, annulus, "least double, most double"))
    asking = cut(V.packed(in_order(placed.where(is_query)), ["dim"], QUERY_BLOCK, reach, "near array<double>, far array<double>, home int"))
    near, far = (F.element_at(c, F.col("pivot") + 1) for c in ("q_near", "q_far"))
    # The least distance that any query of the block can have to any vector of the annulus.
    bound = F.nanvl(F.greatest(F.lit(0.0), near - F.col("most"), F.col("least") - far), F.lit(0.0))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None

        def out() -> pa.RecordBatch:
            found = list(best.rows())
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["query_id", "vec_id", "key"])

        for b in batches:
            for r in b.to_pylist():
                if r["q_block"] != at:
                    if best is not None:
                        yield out()
                    at, ids = r["q_block"], np.frombuffer(r["q_ids"], "<i8")
                    q = np.frombuffer(r["q_vecs"], "<f8").reshape(len(ids), -1)
                    start = np.array(r["q_start"] if r.get("q_start") is not None else [np.inf] * len(ids))
                    away = np.linalg.norm(np.hstack([q, np.zeros((len(q), 1))])[:, None, :] - pivots[q.shape[1]][None], axis=2)
                    square, best = (q * q).sum(1) + most[q.shape[1]], V.Best(ids, k, np.int64)
                d = away[:, r["pivot"]]
                least = np.maximum(0, np.maximum(d - r["most"], r["least"] - d))
                # -key is the score; a better or equal one lies within this distance.
                worst = np.array([np.inf if (w := best.worst(i)) is None else float(w) for i in range(len(ids))])
                within = np.sqrt(np.maximum(square + 2 * np.minimum(worst, start) + 1e-12 * square, 0))
                todo = np.flatnonzero(~(least > within * (1 + 1e-9) + 1e-6))  # a distance that overflows excludes nothing
                if not len(todo):
                    continue
                cand = np.frombuffer(r["ids"], "<i8")
                scores = inner(q[todo], np.frombuffer(r["vecs"], "<f8").reshape(len(cand), -1))
                for row, i in enumerate(todo.tolist()):
                    other = cand != ids[i]
                    best.add(i, -scores[row][other], cand[other])
        if best is not None:
            yield out()

    schema = "query_id long, vec_id long, key long"
    slim = ["q_block", "q_ids", "q_vecs", "pivot", "least", "most", "ids", "vecs"]
    home = (F.col("pivot") == F.col("q_home")) & (bound <= 0)
    first = V.met(asking, blocks, home).select(*slim).mapInArrow(walk, schema)
    starts = V.ranked(first, k, F.col("key")).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("start"))
    # The k-th key of each query of a block, in the block's order.
    listed = _ids_of(asking).join(starts.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("start").cast("double"), F.lit(float("inf"))).alias("start")))).alias("starts"))
    begun = cut(asking.join(listed.select("block", F.col("starts.start").alias("start")), "block"))
    within = _widest(begun, most)
    second = V.met(within, blocks, bound <= F.col("q_within"), bound).select(*slim, "q_start").mapInArrow(walk, schema)
    return V.ranked(second, k, -F.col("key"))


def _ids_of(asking: DataFrame) -> DataFrame:
    """block, at, vec_id of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids)], names=["block", "at", "vec_id"])

    return asking.select("block", "ids").mapInArrow(run, "block long, at int, vec_id long")


def _widest(begun: DataFrame, most: dict[int, float]) -> DataFrame:
    """begun with within, the distance beyond which no query of the block can find a better vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, start in zip(b.column("vecs").to_pylist(), b.column("start").to_pylist(), strict=True):
                q = np.frombuffer(raw, "<f8").reshape(len(start), -1)
                reach = ((q * q).sum(1) + most[q.shape[1]]) * (1 + 1e-12) + 2 * np.array(start)
                out.append(float(np.sqrt(np.maximum(reach, 0)).max()) * (1 + 1e-9) + 1e-6)
            yield b.append_column("within", pa.array(out, pa.float64()))

    return begun.mapInArrow(run, StructType([*begun.schema.fields, StructField("within", DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 5 highest scores for each vec_id divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
