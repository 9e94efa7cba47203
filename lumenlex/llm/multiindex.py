"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, rotated onto their principal directions and then by a learned rotation that brings them near the
corners of a cube; the signs are a binary code. A code is split into substrings of 8 bits, and each block of vectors
has an index by value for each substring. By the pigeonhole principle, codes within a Hamming radius r of a query's
agree with it to within r // m in at least one of m substrings, so probing the values that near, in every substring,
retrieves every code within the radius. These are checked against the radius and reranked by the float vectors.

The centre, directions and rotation are fitted on a bounded sample (``SAMPLE`` vectors of each dimension), and so is
the radius: the one that holds ``COVER`` of the true neighbours within the sample. Among more vectors neighbours only
come nearer. A query that finds fewer than k codes within the radius is run again with the full radius, so every query
gets k neighbours if there are as many.

Defined results: vectors that are NULL, empty, all zeros or hold NULL or non-finite components take no part, nor do
rows without vec_id. Rows that share a vec_id count once, the least vector stays. Vectors of other dimensions than
the query's are no candidates. Ties go to the smaller vec_id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm import vectors as V
from lumenlex.shared import cut

SAMPLE, COVER, MAX_BITS, ROUNDS, BLOCK, QUERY_BLOCK, K, SEED = 4096, 0.985, 64, 40, 4096, 256, 10, 11
BYTE = np.arange(256, dtype=np.uint8)
NEAR = np.bitwise_count(BYTE[:, None] ^ BYTE[None, :])


class Coder:
    """Learned codes of one dimension, as rows of bytes, and the radius to search."""

    def __init__(self, points: np.ndarray, k: int = K):
        random = np.random.default_rng(SEED)
        dim = points.shape[1]
        bits = min(MAX_BITS, max(8, dim // 8 * 8))
        self.centre = points.mean(0)
        centred = points - self.centre
        _, _, directions = np.linalg.svd(np.vstack([centred, np.zeros((1, dim))]), full_matrices=True)
        basis = directions[:bits].T if bits <= dim else np.hstack([directions.T, random.normal(size=(dim, bits - dim)) / np.sqrt(dim)])
        projected = centred @ basis
        turn, _ = np.linalg.qr(random.normal(size=(bits, bits)))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        self.matrix = basis @ turn
        self.radius = self._radius(points, k)

    def codes(self, m: np.ndarray) -> np.ndarray:
        return np.packbits((m - self.centre) @ self.matrix >= 0, axis=1)

    def _radius(self, points: np.ndarray, k: int) -> int:
        """The Hamming radius that holds COVER of the sample's true k nearest neighbours."""
        codes, square = self.codes(points), (points * points).sum(1)
        k, apart = min(k, len(points) - 1), []
        if k < 1:
            return 8 * codes.shape[1]
        for i in range(0, min(len(points), 512)):
            far = square - 2 * points @ points[i]
            far[i] = np.inf
            near = np.argpartition(far, k - 1)[:k]
            apart += np.bitwise_count(codes[near] ^ codes[i]).sum(1).tolist()
        return int(np.quantile(apart, COVER, method="higher"))


def probe(order: np.ndarray, counts: np.ndarray, codes: np.ndarray, code: np.ndarray, radius: int) -> np.ndarray:
    """The rows of a block whose codes lie within radius of code. order, counts: for each substring, the rows sorted by
    value and the number of rows of each value."""
    m = codes.shape[1]
    seen = np.zeros(len(codes), bool)
    for s in range(m):
        hit = NEAR[code[s]] <= radius // m
        seen[order[s][np.repeat(hit, counts[s])]] = True
    rows = np.flatnonzero(seen)
    return rows[np.bitwise_count(codes[rows] ^ code).sum(1) <= radius]


def indexed(columns: dict[str, np.ndarray], m: np.ndarray, coders: dict[int, Coder]) -> dict:
    codes = coders[m.shape[1]].codes(m)
    order = np.argsort(codes, axis=0, kind="stable").T.astype("<u2")
    counts = np.stack([np.bincount(codes[:, s], minlength=256) for s in range(codes.shape[1])]).astype("<u2")
    return {"codes": codes.tobytes(), "order": order.tobytes(), "counts": counts.tobytes()}


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where is_query holds, the k nearest other rows found."""
    rows = cut(V.usable(vectors).where(F.exists("v", lambda x: x != 0)))
    coders = {dim: Coder(points, k) for dim, points in V.sample(rows, SAMPLE).items()}
    shared = rows.sparkSession.sparkContext.broadcast(coders)  # a matrix of at most dim x 64 for each dimension
    n = V.shards(rows)
    in_order = lambda df: df.select("dim", "vec_id", "v").repartition(n, F.xxhash64("vec_id")).sortWithinPartitions("dim", "vec_id")
    blocks = cut(V.packed(in_order(rows), ["dim"], BLOCK, lambda c, m: indexed(c, m, shared.value), "codes binary, order binary, counts binary"))
    asking = cut(V.packed(in_order(rows.where(is_query)), ["dim"], QUERY_BLOCK, lambda c, m: {"some": 0}, "some int"))

    def walk(full: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, at = None, None

            def out() -> pa.RecordBatch:
                found = list(best.rows())
                return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "key"])

            for b in batches:
                for r in b.to_pylist():
                    if r["q_block"] != at:
                        if best is not None:
                            yield out()
                        at, ids = r["q_block"], np.frombuffer(r["q_ids"], "<i8")
                        q = np.frombuffer(r["q_vecs"], "<f8").reshape(len(ids), -1)
                        coder, best = shared.value[q.shape[1]], V.Best(ids, k, np.float64)
                        radius, asked = 8 * coder.codes(q[:1]).shape[1] if full else coder.radius, coder.codes(q)
                    cand = np.frombuffer(r["ids"], "<i8")
                    m = np.frombuffer(r["vecs"], "<f8").reshape(len(cand), -1)
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(len(cand), -1)
                    order = np.frombuffer(r["order"], "<u2").reshape(-1, len(cand))
                    counts = np.frombuffer(r["counts"], "<u2").reshape(-1, 256)
                    for i in range(len(ids)):
                        near = probe(order, counts, codes, asked[i], radius)
                        near = near[cand[near] != ids[i]]
                        if len(near):
                            apart = m[near] - q[i]
                            best.add(i, np.sqrt((apart * apart).sum(1)), cand[near])
            if best is not None:
                yield out()

        return run

    slim = ["q_block", "q_ids", "q_vecs", "ids", "vecs", "codes", "order", "counts"]
    met = lambda q, full: V.ranked(V.met(q, blocks).select(*slim).mapInArrow(walk(full), "query_id long, vec_id long, key double"), k, F.col("key"))
    first = cut(met(asking, False))
    enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    few = cut(rows.where(is_query).join(enough, "vec_id", "left_anti"))
    if few.isEmpty():
        return first
    again = V.packed(in_order(few), ["dim"], QUERY_BLOCK, lambda c, m: {"some": 0}, "some int")
    return first.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(met(again, True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the 10 nearest found for each vec_id divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
