import random

import numpy as np
from pyspark.sql import functions as F

from lumenlex.llm import neardup as N
from lumenlex.llm.components import components


def brute(rows, words, percent=80):
    sets = {}
    for doc, text in rows:
        parts = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        n = min(words, len(parts))
        sets[doc] = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if parts else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, copies):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for size in copies:
        base = r.choices(words, k=r.choice([3, 12, 60, 200]))
        for _ in range(size):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((doc, " ".join(text).upper() if r.random() < 0.1 else "  ".join(text)))
            doc += 1
    r.shuffle(rows)
    return rows


def test_against_brute_force(docs_of):
    rows = corpus(1, [1] * 20 + [2] * 15 + [6] * 5 + [60]) + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "ONE"), (9006, "a b")]
    for words in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.linked(docs_of(rows), words=words).collect()}
        assert got == brute(rows, words)


def test_small_blocks_lose_nothing(docs_of, monkeypatch):
    # One chain of drifting copies: neighbours are alike, the ends are not, and buckets span several blocks.
    for name, size in (("ASKING", 8), ("MEMBERS", 16), ("STAR", 4), ("TILE_SHINGLES", 500)):
        monkeypatch.setattr(N, name, size)
    r = random.Random(5)
    text, rows = [f"w{i}" for i in range(150)], []
    for doc in range(80):
        rows.append((doc, " ".join(text)))
        text[r.randrange(150)] = f"x{doc}"
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.linked(docs_of(rows), words=4).collect()}
    assert got == brute(rows, 4)


def test_null_ids_repeats_and_names(docs_of):
    same = "one two three four five six seven"
    docs = docs_of([(None, same), (5, same), (5, same), (8, same), (9, "other words entirely here now")]).withColumns({c: F.lit(1) for c in ("node", "band", "set_a", "u", "v", "n")})
    got = sorted((tuple(r) for r in N.linked(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, None), (5, 5), (5, 5), (8, 5), (9, 9)], key=str)
    twice = docs_of([(1, same), (1, "six other words that are here alone"), (2, "six other words that are here alone"), (3, same)])
    assert sorted(tuple(r) for r in N.linked(twice).select("doc_id", "component_id").collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    kept = N.dedup_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 5, 5, 9], key=str)
    assert N.linked(docs_of([])).collect() == []


def test_sketches_keep_what_is_alike():
    random_ = np.random.default_rng(0)
    signer = N.Signer(N.BANDS, N.ROWS, N.SKETCH_BITS, N.SEED)
    for n in (4, 30, 300, 3000):
        for _ in range(60):
            u = random_.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            m = int(np.ceil(0.8 * n))
            h = int(random_.integers(0, n - m + 1))
            a, b = np.unique(u[: m + h]), np.unique(np.r_[u[:m], u[m + h :]])
            (_, x, ca), (_, y, cb) = signer.sign(a), signer.sign(b)
            left = 1 - 2 * int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum()) / N.SKETCH_BITS
            common = (ca + cb + N.SKETCH_BITS / 2 * np.log(left)) / 2
            assert common >= N.least_common(ca + cb, len(a) + len(b), 0.8, N.SKETCH_BITS, np.sqrt, np.exp)


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}
