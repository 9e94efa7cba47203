import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlex.llm import mixing as M


def water(sizes):
    """Targets by plain resharing; sizes in source order."""
    total, weights = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    full = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(3 * sizes[i] for i in full)
        targets = [3 * sizes[i] if i in full else rest * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        over = {i for i in free if targets[i] > 3 * sizes[i]}
        if not over:
            return targets
        full |= over


def corpus(seed=4, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choices(["b", "a", "é", "B", None], weights=[60, 20, 10, 4, 3])[0]
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 30, 31, 200])), "en", source))
    return rows + [(n, None, "en", "b"), (n + 1, "\t \n", "en", "z"), (n + 2, "x " * 3000, "en", "b"), (5, rows[5][1], "en", rows[5][3])]


def test_targets_and_totals(docs_of):
    rows = corpus()
    out = M.mix(docs_of(rows)).select("source", "text", "__mix_size", "__mix_plan.*", "__mix_copies").collect()
    assert len(out) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["__mix_size"] == len((r["text"] or "").split())
        assert 0 <= r["__mix_copies"] <= 3
        size[r["source"]] += r["__mix_size"]
        taken[r["source"]] += r["__mix_size"] * r["__mix_copies"]
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, water([size[s] for s in order])))
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in order:
        assert abs(taken[s] - want[s]) <= 200  # no subset of a small source may come nearer than a document


def test_reruns_agree_and_rows_repeat(docs_of):
    docs = docs_of(corpus()).withColumns({c: F.lit(1) for c in ("size", "target", "epochs", "rank")})
    pick = lambda: sorted(((r["doc_id"], r["__mix_copies"]) for r in M.mix(docs).collect()), key=str)
    first = pick()
    assert first == pick()
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(c for _, c in first)


def test_edge_tables(docs_of):
    assert M.mix(docs_of([])).collect() == []
    silent = M.mix(docs_of([(1, None), (2, "")])).collect()
    assert [r["__mix_plan"]["target"] for r in silent] == [0.0, 0.0]
    one = M.mix(docs_of([(1, "a b c", "en", None)])).collect()
    assert (one[0]["__mix_plan"]["target"], one[0]["__mix_copies"]) == (3.0, 1)


def test_fit_is_bounded_and_close():
    random_ = np.random.default_rng(1)
    for _ in range(100):
        sizes = np.unique(random_.integers(0, 500, 40))
        counts = random_.integers(1, 9, len(sizes))
        budget = int(random_.integers(0, (sizes * counts).sum() + 1))
        taken = M.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert 0 <= budget - (sizes * taken).sum() <= 2


def test_the_fit_uses_every_length():
    for spot in (200, 201, 202):  # only one odd length makes an odd budget exact, wherever it stands
        sizes = np.sort(np.append(2 * np.arange(1, 601), 2 * spot + 1))
        taken = M.fit(sizes, np.ones(601, np.int64), 40_001)
        assert (sizes * taken).sum() == 40_001 and taken.max() == 1


def test_the_plan_does_not_hang_on_the_order_of_rows(spark):
    rows = [("a", False, 1 + i, 0, 3) for i in range(350)] + [("b", False, 50, 0, 4000)]
    schema = "__mix_source string, __mix_null boolean, __mix_size long, __mix_slice int, __mix_n long"
    take = lambda rs: {(r["__mix_source"], r["__mix_size"]): r["n_take"] for r in M.plans(spark.createDataFrame(rs, schema)).collect()}
    first = take(rows)
    sizes = np.arange(1, 351)
    budget = M.targets(spark.createDataFrame([("a", False, int(3 * sizes.sum())), ("b", False, 200_000)], "__mix_source string, __mix_null boolean, source_size long")).collect()
    target = next(r for r in budget if r["__mix_source"] == "a")
    left = round(target["target"] - target["target"] // target["source_size"] * target["source_size"])
    assert [first["a", s] for s in range(1, 351)] == M.fit(sizes, np.full(350, 3), left).tolist()
    assert take(rows[::-1]) == first
