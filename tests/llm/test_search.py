import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlex.llm import exactknn, multiindex
from lumenlex.llm import vectors as V


def points(n=700, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    return [(i, (centres[i % 6] + 0.3 * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


ODD = [
    (9000, None), (9050, [float("nan")] + [1.0] * 15), (9100, [float("inf")] + [0.0] * 15), (9150, [None] + [0.5] * 15), (9200, []), (9250, [1.0, 2.0]), (9300, [2.0, 1.0]), (9350, [0.0] * 16),
    (None, [1.0] * 16), (-50, [0.25] * 16), (-100, [0.5] * 16),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "dim", "block", "rank")})


def usable(rows, zero):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    return {i: v for i, v in ok.items() if zero or v.any()}


def test_components_beyond_53_bits(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=3) * 10.0 ** int(r.choice([0, 9, 16]))]) for i in range(80)] + [(900, [1e300, -1e308, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in exactknn.search(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    big = lambda x: math.floor(256 * x) if abs(x) < 1e300 else int(max(-sys.float_info.max, min(sys.float_info.max, 256 * x)))
    whole, want = {i: [big(x) for x in v] for i, v in rows}, []
    for q in (i for i, _ in rows if i % 50 == 0):
        held = lambda s: max(-exactknn.LONG, min(exactknn.LONG, s))
        scores = sorted((-held(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want


@pytest.mark.parametrize("copies", [0, 400])
def test_exact_topk(spark, copies):
    rows = points() + ODD + [(20_000 + i, points()[3][1]) for i in range(copies)]
    rows += [rows[0]]
    got = {}
    for r in exactknn.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.floor(256 * v).astype(int) for i, v in usable(rows, True).items()}
    want = {}
    for q in ok:
        if q % 50 == 0:
            scores = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            if scores:
                want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_exact_topk_small(spark):
    assert exactknn.search(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 50 == 0).collect() == []
    assert exactknn.search(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    huge = exactknn.search(frame(spark, [(0, [3e38, 1.0]), (1, [3e38, 2.0])]), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in huge] == [(0, 1)]


def test_multi_index_recall(spark):
    rows = points(1500) + ODD
    got = {}
    for r in multiindex.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = usable(rows, False)
    hits = total = 0
    for q in (i for i in ok if i % 50 == 0):
        near = sorted((float(np.sqrt(((v - ok[q]) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, min(10, len(near)) + 1))
        exact = {i: d for d, i in near}
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        assert [f[1] for f in found] == [i for _, i in sorted((s, i) for _, i, s in found)]
        hits += len({f[1] for f in found} & {i for _, i in near[:10]})
        total += min(10, len(near))
    assert hits >= 0.95 * total


def test_multi_index_small(spark):
    assert multiindex.search(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    rows = multiindex.search(frame(spark, [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (2, [9.0, 9.0, 9.0])]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 1), (2, 2)]


def test_probing_finds_every_code_within_the_radius():
    r = np.random.default_rng(3)
    codes = r.integers(0, 256, (500, 4), np.uint8)
    order = np.argsort(codes, axis=0, kind="stable").T
    counts = np.stack([np.bincount(codes[:, s], minlength=256) for s in range(4)])
    for radius in (0, 3, 9, 17, 32):
        for code in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1) <= radius)
            assert (multiindex.probe(order, counts, codes, code, radius) == want).all()


def test_best_keeps_ties_by_id():
    best = V.Best(np.array([1]), 3, np.int64)
    best.add(0, np.array([5, 5, 1]), np.array([9, 4, 8]))
    best.add(0, np.array([5, 5]), np.array([2, 7]))
    assert list(best.rows()) == [(1, 8, 1), (1, 2, 5), (1, 4, 5)]
