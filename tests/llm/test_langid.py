import math
import random
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenlex.llm import langid as L

SYLLABLES = {"xx": ("ba", "ko", "tri", "mun"), "yy": ("esch", "ung", "ver", "lich"), "zz": ("oix", "eau", "tre", "çon")}


def corpus(n=240, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def test_held_out_accuracy(docs_of):
    docs = docs_of(corpus())
    found = L.identify(docs, L.learn(docs)).withColumn("held_out", L.held_out(F.col("doc_id"))).where("held_out").collect()
    assert len(found) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_inputs_of_a_prediction(docs_of):
    docs = docs_of(corpus())
    model = L.learn(docs)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    blind = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("other"))
    assert plain == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(blind, model).collect()}
    # Held-out labels change nothing.
    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "qq").otherwise(F.col("lang")))
    assert L.learn(lied).langs == model.langs and (L.learn(lied).keys == model.keys).all()


def test_edge_cases(docs_of):
    rows = [*corpus(), (900, None, "xx"), (901, "", None), (902, "12 34 !! ²", "xx"), (None, "bakotri mun", "qq"), (903, "ungver " * 50_000, None)]
    docs = docs_of(rows).withColumn("score", F.lit("mine")).withColumns({c: F.lit("mine") for c in ("lang_pred", "row", "found", "__found")})
    model = L.learn(docs)
    assert "qq" not in model.langs
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs.select("doc_id", "text"), model).collect()}
    assert found[900] == found[901] == found[902] == ("und", 0.0) and found[None][0] == "xx" and found[903][0] == "yy"
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"mine"}
    assert {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect())
    empty = docs_of([])
    assert L.identify(empty, L.learn(empty)).collect() == []


def test_backoff():
    known = [(0, "abc", 9, 1), (3, "abc", 5, 1), (2, "ab", 4, 2), (1, "a", 3, 3), (1, "q", 1, 8)]
    rows = [(L.key_of(kind, gram), kind, lang, n) for kind, gram, *counts in known for lang, n in enumerate(counts)]
    key, kind, lang, n = (np.array(c, np.uint64) for c in zip(*rows))
    model = L.Model(["x", "y"], key.view(np.int64), *(c.astype(np.int64) for c in (kind, lang, n)))
    names = {L.key_of(kind, gram): (kind, gram) for kind, gram, *_ in known}
    parts = lambda word: [names[int(model.keys[r : r + 1].view(np.uint64)[0])] for r in model.rows_of([word])[1]]
    assert parts("abc") == [(0, "abc")]
    assert parts("zabcz") == [(3, "abc")]
    assert parts("zabz") == [(2, "ab")]
    assert parts("zazq") == [(1, "a"), (1, "q")]
    assert parts("zzz") == []


def brute(rows, sample):
    """lang and score of each text, by plain dictionaries over the whole sample."""
    counts, totals = {}, {}
    for text, lang in sample:
        for word in L.WORD.findall(text.lower()):
            for kind in range(L.LONGEST + 1):
                for gram in L.grams(word, kind) if kind else [word]:
                    by_lang = counts.setdefault((kind, gram), {})
                    by_lang[lang] = by_lang.get(lang, 0) + 1
                    totals[kind, lang] = totals.get((kind, lang), 0) + 1
    langs = sorted({lang for _, lang in sample})
    size = {k: sum(kind == k for kind, _ in counts) for k in range(L.LONGEST + 1)}
    out = []
    for text in rows:
        scores = dict.fromkeys(langs, 0.0)
        for word in L.WORD.findall(text.lower()):
            found = [(0, word)] if (0, word) in counts else []
            for k in range(L.LONGEST, 0, -1):
                found = found or [(k, g) for g in L.grams(word, k) if (k, g) in counts]
            for kind, gram in found:
                for lang in langs:
                    n, total = counts[kind, gram].get(lang, 0), totals.get((kind, lang), 0)
                    scores[lang] += math.log((n + L.SMOOTHING) / (total + L.SMOOTHING * size[kind])) / max(1, kind)
        top = max(scores.values())
        best = min(lang for lang in langs if scores[lang] == top)
        out.append((best, 1 / sum(math.exp(s - top) for s in scores.values())))
    return out


def test_against_brute_force(docs_of):
    rows = corpus(120, seed=9)
    docs = docs_of(rows + [(500, "zzz qqq " * 3, None), (501, "bakoesch ungtre", None)])
    found = L.identify(docs, L.learn(docs)).orderBy("doc_id").collect()
    learned = {r["doc_id"] for r in docs.where(~L.held_out(F.col("doc_id"))).collect()}
    want = brute([r["text"] for r in found], [(text, lang) for doc, text, lang in rows if doc in learned])
    assert [r["lang_pred"] for r in found] == [w[0] for w in want]
    assert all(abs(r["score"] - w[1]) < 1e-4 for r, w in zip(found, want))


def test_nothing_of_the_sample_is_dropped(docs_of):
    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    model = L.learn(docs_of([(one, many, "xx"), (two, "solo", "yy")]))
    assert (model.kind == 0).sum() == 600 + 1


def test_held_words_are_bounded(docs_of):
    """A worker keeps what each word adds while later stages run; what it forgets it finds again."""
    model, r = L.learn(docs_of(corpus())), random.Random(4)
    every = [x for xs in SYLLABLES.values() for x in xs]
    texts = [" ".join("".join(r.choices(every, k=6)) for _ in range(500)) for _ in range(360)]
    found = [x for i in range(0, len(texts), 8) for x in model.predict(texts[i : i + 8])]
    assert sys.getsizeof(model.row) + sum(map(sys.getsizeof, model.row)) + model.vectors.nbytes < 14e6
    for i in (0, 100, 359):
        model.forget()
        (lang, score), = model.predict([texts[i]])
        assert lang == found[i][0] and math.isclose(score, found[i][1], rel_tol=1e-9)
