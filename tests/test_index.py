import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenlex.operators import evaluate, querysets, scoring, search
from lumenlex.operators import index as ix
from lumenlex.operators.dense import dense_ids

MERGE8 = [
    "alpha beta gamma", "alpha beta", "alpha delta delta epsilon", "alpha", "beta gamma", "alpha beta gamma", "zeta", "alpha gamma",
]
CATDOG = ["cat x1 x2", "dog x3", "cat cat dog x4", "bird", "cat x5"]


def build(spark, texts, **kw):
    return ix.build(spark.createDataFrame(list(enumerate(texts)), "raw_id long, text string"), **kw)


def test_block_bounds(spark):
    i = build(spark, MERGE8, block_size=2)
    got = defaultdict(list)
    for r in i.blocks.orderBy("term", "block_no").collect():
        got[r["term"]].append((r["start_doc"], r["block_ub"]))
    want = {
        "alpha": [(0, 0.301381), (2, 0.372295), (5, 0.301381)],
        "beta": [(0, 0.726154), (4, 0.726154)],
        "gamma": [(0, 0.726154), (5, 0.726154)],
        "delta": [(2, 2.346037)],
        "epsilon": [(2, 1.577507)],
        "zeta": [(6, 2.691042)],
    }
    assert set(got) == set(want)
    for term, blocks in want.items():
        assert [b[0] for b in got[term]] == [b[0] for b in blocks]
        assert [b[1] for b in got[term]] == pytest.approx([b[1] for b in blocks], abs=1e-3)
    assert {r["term"]: r["df"] for r in i.terms.collect()} == {"alpha": 6, "beta": 4, "gamma": 4, "delta": 1, "epsilon": 1, "zeta": 1}
    for r in i.terms.collect():
        assert r["term_ub"] == pytest.approx(max(b[1] for b in want[r["term"]]), abs=1e-3)


def test_cat_and_dog(spark):
    i = build(spark, CATDOG)
    rows = search.search(i, ["cat", "dog"], 10).collect()
    assert [(r["mapped_id"], r["score"]) for r in rows] == [(2, pytest.approx(1.311425, abs=1e-5)), (1, pytest.approx(0.983336, abs=1e-5)), (4, pytest.approx(0.548203, abs=1e-5)), (0, pytest.approx(0.463429, abs=1e-5))]
    assert [r["mapped_id"] for r in search.search(i, ["cat", "dog"], 2).collect()] == [2, 1]
    assert len(search.search(i, ["bird"], 5).collect()) == 1
    assert search.search(i, ["nothing"], 5).collect() == [] == search.search(i, [], 5).collect() == search.search(i, ["cat"], 0).collect()
    with pytest.raises(ValueError):
        search.search(i, ["cat"], -1)
    one, two = (search.search(i, t, 1).first()["score"] for t in (["cat"], ["cat", "cat"]))
    assert two == pytest.approx(2 * one, abs=2e-6)


def test_alternating_terms(spark):
    i = build(spark, ["xx pad1", "yy pad2"] * 3, block_size=1)
    for exhaustive in (True, False):
        assert [r["mapped_id"] for r in search.search(i, ["xx", "yy"], 6, exhaustive).collect()] == list(range(6))


def test_empty_documents_keep_their_ids(spark, tmp_path):
    i = build(spark, ["aa bb", None, "", "the of", "bb"])
    assert tuple(i.stats.select("n_docs", "total_docs", "total_tokens").first()) == (5, 2, 3)
    i.save(str(tmp_path / "index"))
    back = ix.Index.load(spark, str(tmp_path / "index"))
    assert [r["mapped_id"] for r in search.search(back, ["bb"], 5).collect()] == [4, 0]
    assert {tuple(r) for r in back.doc_len.collect()} == {(0, 2), (4, 1)}
    assert tuple(build(spark, []).stats.select("n_docs", "total_docs", "total_tokens").first()) == (0, 0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_pruned_equals_exhaustive(spark, seed, monkeypatch):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choices(words, weights=range(1, 13), k=r.choice([0, 1, 3, 8, 20]))) for _ in range(120)]
    i = build(spark, texts, block_size=r.choice([1, 3, 8]))
    i = ix.Index(**{t: getattr(i, t).cache() for t in ix.TABLES})
    monkeypatch.setattr(search, "WIDTH", r.choice([1, 5]))
    monkeypatch.setattr(search, "FEW_BLOCKS", r.choice([0, 2]))
    asked = [(q, r.choices(words, k=r.choice([1, 3, 10]))) for q in range(8)]
    queries = spark.createDataFrame(asked, "qid int, terms array<string>")
    for k in (1, 7):
        runs = [sorted(map(tuple, search.search_batch(i, queries, k, exhaustive).collect())) for exhaustive in (True, False)]
        assert runs[0] == runs[1]
    assert search.search(i, asked[0][1], 5).collect() == search.search(i, asked[0][1], 5, exhaustive=False).collect()


def test_batch_equals_singles(spark):
    i = build(spark, CATDOG)
    queries = spark.createDataFrame([(1, ["cat", "dog"], 1), (2, ["bird", "cat", "cat"], 9), (3, ["none"], 4)], "qid int, terms array<string>, k int")
    got = defaultdict(list)
    for r in search.search_batch(i, queries).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["mapped_id"], r["score"]))
    for q in queries.collect():
        assert got[q["qid"]] == [(r["mapped_id"], r["score"]) for r in search.search(i, q["terms"], q["k"]).collect()]


def test_stemmed_index(spark):
    i = build(spark, ["running dogs", "run", "a dog"], stem=True)
    assert {r["term"] for r in i.terms.collect()} == {"run", "dog"}


def test_dense_ids_with_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 4 else f"g{i}", i * 7 % 101) for i in range(101)], "g string, x int")
    rows = dense_ids(df, F.col("x"), within=("g",)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["g"]].append((r["x"], r["dense_id"]))
    for items in by.values():
        assert [n for _, n in sorted(items)] == list(range(len(items)))
    assert sorted(r["dense_id"] for r in dense_ids(df, F.col("x")).collect()) == list(range(101))


def test_bands_and_sets(spark):
    terms = spark.createDataFrame([(f"t{i:03}", 1 + i % 50) for i in range(1000)], "term string, df long")
    top = querysets.band(terms, 0.01).collect()
    assert len(top) == 10 and all(r["df"] == 50 for r in top) and sorted(r["term"] for r in top) == sorted(f"t{i:03}" for i in range(49, 549, 50))
    assert len(querysets.band(terms, 0.01, rare=None).collect()) == 20
    for weighted in (False, True):
        first, second = (sorted(map(tuple, querysets.sampled(terms, 30, weighted=weighted).collect())) for _ in range(2))
        assert first == second and len(first) == 30
        assert all(5 <= len(t.split()) <= 10 and len(set(t.split())) == len(t.split()) for _, t in first)
    totals = {r["position"]: r["upto"] for r in querysets.cumulative(terms).collect()}
    assert totals[999] == sum(1 + i % 50 for i in range(1000))


def test_rank_safety_and_effectiveness(spark):
    run = "qid int, rank int, score double, mapped_id long"
    a = spark.createDataFrame([(1, 1, 2.0, 7), (1, 2, 1.0, 8), (2, 1, 1.0, 9)], run)
    b = spark.createDataFrame([(1, 1, 2.0, 7), (1, 2, 1.0, 6), (3, 1, 1.0, 9)], run)
    rows = {r["qid"]: r for r in evaluate.rank_safety(a, b).collect()}
    assert (rows[1]["rank_match"], rows[1]["missing"], rows[1]["extra"]) == (False, 1, 1)
    assert rows[2]["b_min"] is None and rows[2]["extra"] == 1 and rows[3]["missing"] == 1
    assert tuple(evaluate.safety_summary(evaluate.rank_safety(a, a)).first()) == (2, 2, 0, 0, 2)
    found = evaluate.effectiveness(a.withColumnRenamed("mapped_id", "doc_id"), spark.createDataFrame([(1, 8), (2, 1)], "qid int, doc_id long"), 10, 10).first()
    assert tuple(found) == (2, 0.25, 0.5)


def test_counts_of_postings(spark):
    texts = ["omega", "omega omega", "x", None]
    got = Counter({(r["term"], r["mapped_id"]): r["tf"] for r in build(spark, texts).postings.collect()})
    assert got == Counter({("omega", 0): 1, ("omega", 1): 2, ("x", 2): 1})


def test_weighted_sets_draw_over_the_whole_vocabulary(spark):
    terms = spark.createDataFrame([("hot", 1_000_000), *((f"t{i:05}", 1 + i % 3) for i in range(20_000))], "term string, df long")
    sets = [r["text"].split() for r in querysets.sampled(terms, 60, weighted=True).collect()]
    assert len(sets) == 60 and all("hot" in t and 5 <= len(set(t)) == len(t) <= 10 for t in sets)
    few = spark.createDataFrame([("hot", 1_000_000_000), *((f"t{i}", 1) for i in range(5))], "term string, df long")
    assert all(sorted(r["text"].split()) == ["hot", *(f"t{i}" for i in range(5))] for r in querysets.sampled(few, 20, (6, 10), weighted=True).collect())


def moved(spark, run):
    """What run() returns, and the records that stages begun by it wrote to shuffles."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def stages():
        found = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(n for k, n in stages().items() if k not in before)


def test_a_posting_moves_once(spark):
    texts = [" ".join(["hot", *(f"w{(i * 7 + j) % 40}" for j in range(30))]) for i in range(900)]
    i, records = moved(spark, lambda: build(spark, texts))
    n = i.postings.count()
    assert n == 31 * 900 and n <= records < 1.5 * n


def test_numbers_and_gaps_across_ranges(spark):
    texts = ["hot" if i % 3 else f"hot w{i}" if i % 2 else "" for i in range(400)]
    i = build(spark, texts, block_size=8)
    assert i.parts["edges"].count() > 0
    rows = sorted((r["no"], r["mapped_id"], r["gap"]) for r in i.postings.where("term = 'hot'").collect())
    want = [d for d, t in enumerate(texts) if t]
    assert rows == [(no, d, d - before) for no, (d, before) in enumerate(zip(want, [0, *want]))]
    blocks = sorted((r["block_no"], r["start_doc"], r["end_doc"], r["n"]) for r in i.blocks.where("term = 'hot'").collect())
    assert blocks == [(k // 8, want[k], want[k : k + 8][-1], len(want[k : k + 8])) for k in range(0, len(want), 8)]


def test_terms_are_counted_in_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ix, "SLICE", 7)
    batch = pa.RecordBatch.from_pydict({"mapped_id": [3, 4, 9], "len": [3, 2, 1], "terms": ["b a b", "a cc", "dddddddddddd"]})
    got = sorted(tuple(r.values()) for b in ix._counted(iter([batch])) for r in b.to_pylist())
    assert got == [("a", 3, 1, 3), ("a", 4, 1, 2), ("b", 3, 2, 3), ("cc", 4, 1, 2), ("dddddddddddd", 9, 1, 1)]
    stems = pa.RecordBatch.from_pydict({"raw_id": [1, 2, 3], "terms": ["running dogs", "", "runs"]})
    out = [t for b in ix._stems(iter([stems])) for t in b.column("terms").to_pylist()]
    assert out == ["run dog", "", "run"]


def wordy(n, seed=5):
    r = random.Random(seed)
    words = [f"w{j}" for j in range(25)]
    return [" ".join(r.choices(words, weights=range(1, 26), k=r.choice([0, 2, 9, 30]))) for _ in range(n)]


def test_a_batch_moves_only_the_best(spark):
    i = build(spark, wordy(2000))
    queries = spark.createDataFrame([(q, [f"w{(q + j) % 25}" for j in range(8)]) for q in range(12)], "qid int, terms array<string>")
    for exhaustive in (True, False):
        rows, records = moved(spark, lambda exhaustive=exhaustive: search.search_batch(i, queries, 3, exhaustive).collect())
        assert len(rows) == 36 and records < 2000  # of some 18,000 pairs of a query and a document


def test_large_batches_are_shuffled_with_the_same_results(spark, monkeypatch):
    i = build(spark, wordy(300), block_size=4)
    queries = spark.createDataFrame([(None if q == 3 else f"q{q}", [f"w{q}", f"w{q + 2}", f"w{q}"], q % 4) for q in range(9)], "qid string, terms array<string>, k int")
    monkeypatch.setattr(search, "WIDTH", 16)
    monkeypatch.setattr(search, "FEW_BLOCKS", 2)
    found = []
    for batch, pairs in ((200_000, 1_000_000), (0, 1_000_000), (200_000, 0)):
        monkeypatch.setattr(search, "SMALL_BATCH", batch)
        monkeypatch.setattr(search, "SMALL_PAIRS", pairs)
        found += [sorted(map(str, search.search_batch(i, q, 6, exhaustive).collect())) for q in (queries, queries.drop("k").where("qid IS NOT NULL")) for exhaustive in (True, False)]
    for k, rows in enumerate(found):
        assert rows and rows == found[k % 4 // 2 * 2]


def test_scores_in_small_pieces(monkeypatch):
    import pyarrow as pa

    texts = [(7 * d, t.split()) for d, t in enumerate(wordy(200, 9)) if t]
    asked = [{"qid": q, "term": f"w{j}", "weight": 1.0 + j} for q in range(6) for j in range(q, 25, 3)]
    of = {"avgdl": 12.5, "k1": 1.2, "b": 0.75}
    want = defaultdict(list)
    for doc, terms in texts:
        for q in range(6):
            mine = {a["term"]: a["weight"] for a in asked if a["qid"] == q}
            hit = [w * 2.2 * terms.count(t) / (1.2 * (0.25 + 0.75 * len(terms) / 12.5) + terms.count(t)) for t, w in mine.items() if t in terms]
            if hit:
                want[q].append((-round(sum(hit), 6), doc))
    batches = [pa.RecordBatch.from_pydict({"mapped_id": [d for d, _ in part], "len": [len(t) for _, t in part], "terms": [" ".join(t) for _, t in part]}) for part in (texts[:50], texts[50:51], texts[51:])]
    for pairs, kept, size in ((2_000_000, 4_000_000, 8 << 20), (3, 10, 100), (50, 0, 8 << 20)):
        monkeypatch.setattr(scoring, "PAIRS", pairs)
        monkeypatch.setattr(scoring, "KEPT", kept)
        monkeypatch.setattr(ix, "SLICE", size)
        got = defaultdict(list)
        for q, score, doc in scoring._best(iter(batches), scoring.batch(asked), 4, of, 6):
            for a, b, c in zip(q.tolist(), score.tolist(), doc.tolist()):
                got[scoring.batch(asked).qids[a]].append((-b, c))
        for q in range(6):
            assert [(pytest.approx(s, abs=2e-6), d) for s, d in sorted(want[q])[:4]] == sorted(got[q])[:4]


def test_a_stemmed_posting_moves_once(spark):
    texts = [" ".join(["running", *(f"w{(i * 7 + j) % 40}s" for j in range(30))]) for i in range(900)]
    i, records = moved(spark, lambda: build(spark, texts, stem=True))
    assert {r["term"] for r in i.terms.collect()} == {"run", *(ix._stem(f"w{j}s") for j in range(40))}
    assert records < 1.5 * i.postings.count()


def test_a_block_moves_twice_at_most(spark):
    texts = [f"own{i} pad{i}" for i in range(600)]
    i, records = moved(spark, lambda: build(spark, texts))
    blocks = i.blocks.count()
    assert blocks == 1200 and records < 600 + i.postings.count() + 2.5 * blocks


def test_deltas_move_nothing(spark):
    from lumenlex.plans import retrieval

    retrieval.index_of(spark, "/root/testdata/sf0.001")
    rows, records = moved(spark, lambda: retrieval.posting_deltas(spark, "/root/testdata/sf0.001").collect())
    assert rows and not records
