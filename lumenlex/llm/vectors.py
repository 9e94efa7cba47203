"""What the two vector searches share: usable vectors, blocks of them, and running lists of the best.

A block is one row with many vectors packed into bytes, so that a query block meets a candidate block in one row and
the pairs inside are computed as matrices. Query blocks are sent to each shard of candidate blocks; the best of a
query within a shard leave the task, and the best of all shards are ranked last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def usable(vectors: DataFrame, extra: Column | None = None) -> DataFrame:
    """vec_id, v (doubles), dim of the vectors that take part; rows that share a vec_id count once, the least stays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    if extra is not None:
        rows = rows.where(extra)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def sample(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each dimension, up to n vectors by the hash of the id: a bounded sample to fit an index on."""
    order = F.xxhash64("vec_id")
    # Hashes are uniform: about 4 n vectors of a dimension lie below its limit, and only these are ranked.
    near = F.lit(False)
    for dim, count in rows.groupBy("dim").count().collect():
        limit = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 4 * n / count) * (1 << 64)))
        near = near | ((F.col("dim") == dim) & (order <= limit))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(order, "vec_id"))
    picked = rows.where(near).withColumn("rank", rank).where(F.col("rank") <= n).orderBy("dim", "rank").select("dim", "v").collect()
    return {dim: np.array([r["v"] for r in picked if r["dim"] == dim]) for dim in {r["dim"] for r in picked}}


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(rows: DataFrame, keys: list[str], size: int, summary: Callable[[dict[str, np.ndarray], np.ndarray], dict], fields: str) -> DataFrame:
    """Blocks of at most size consecutive rows with equal keys, in the order of the sorted partitions of rows.

    rows must hold keys, vec_id and v. Each block has block, keys, ids, vecs and what summary(columns, matrix) adds.
    """
    names = rows.columns
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"block long, {key_types}, ids binary, vecs binary, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, None
        shape = pa.schema([(n, KINDS[kind]) for n, kind in map(str.split, schema.split(", "))])

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal made
            m = matrix(part.column("v").combine_chunks())
            columns = {n: part.column(n).to_numpy() for n in names if n != "v"}
            out = {"block": task << 32 | made, "ids": columns["vec_id"].astype("<i8").tobytes(), "vecs": m.astype("<f8").tobytes()}
            out |= {k: columns[k][0].item() for k in keys} | summary(columns, m)
            made += 1
            return pa.RecordBatch.from_pylist([{n: out[n] for n in shape.names}], schema=shape)

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            codes = np.zeros(t.num_rows, bool)
            for k in keys:
                c = t.column(k).to_numpy()
                codes[1:] |= c[1:] != c[:-1]
            starts = [*np.flatnonzero(codes), t.num_rows] if t.num_rows else [0]
            at = 0
            for end in starts:
                last = end == t.num_rows
                while end - at >= size or (not last and end > at):
                    yield block(t.slice(at, min(size, end - at)))
                    at = min(end, at + size)
            held = t.slice(at)
        if held is not None and held.num_rows:
            yield block(held)

    return rows.mapInArrow(run, schema)


def shards(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def met(queries: DataFrame, blocks: DataFrame, condition: Column | None = None, order: Column | None = None) -> DataFrame:
    """Rows of a query block and a candidate block of the same dimension, sorted within a task by query block and order."""
    n = shards(blocks)
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q_shard"))
    c = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
    on = (F.col("q_dim") == F.col("dim")) & (F.col("q_shard") == F.col("shard"))
    both = q.join(c, on if condition is None else on & condition)
    return both.sortWithinPartitions("q_block", *([order] if order is not None else []), "block")


class Best:
    """The k best of each query so far: keys ascending (least first), ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, kind):
        self.ids, self.k, self.kind = ids, k, kind
        self.found = [(np.empty(0, kind), np.empty(0, np.int64)) for _ in ids]

    def add(self, i: int, keys: np.ndarray, ids: np.ndarray) -> None:
        keys, ids = np.concatenate([self.found[i][0], keys]), np.concatenate([self.found[i][1], ids])
        if len(keys) > self.k:
            bound = np.partition(keys, self.k - 1)[self.k - 1]
            near = keys <= bound
            keys, ids = keys[near], ids[near]
        order = np.lexsort((ids, keys))[: self.k]
        self.found[i] = keys[order], ids[order]

    def worst(self, i: int):
        """The k-th key, or None while there are fewer."""
        return self.found[i][0][-1] if len(self.found[i][0]) == self.k else None

    def rows(self) -> Iterator[tuple]:
        for q, (keys, ids) in zip(self.ids.tolist(), self.found, strict=True):
            yield from ((q, v, s) for s, v in zip(keys.tolist(), ids.tolist(), strict=True))


def ranked(found: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score from query_id, vec_id, key: the k least keys."""
    order = Window.partitionBy("query_id").orderBy("key", "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
