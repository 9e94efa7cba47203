import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lumenlex.llm import linededup as L

LONG = "this line is long enough to count"


def brute(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    least = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and doc != max(holders[key(x)], key=least))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    out = L.apply_bitmaps(docs, L.drop_bitmaps(docs))
    cols = out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256))
    return sorted((tuple(r) for r in cols.collect()), key=str)


def test_against_brute_force(docs_of):
    r = random.Random(3)
    pool = [LONG, f"  {LONG.upper()}\t", "short", "", *(f"{LONG} {i}" for i in range(12)), "É" * 20, "é" * 20, "x" * 19, "x" * 20]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 90)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, LONG + "\n" + LONG), (None, LONG), (7, LONG), (7, LONG)]
    assert run(docs_of(rows)) == brute(rows)


def test_hot_lines_go_the_other_way_to_the_same_result(docs_of, monkeypatch):
    r = random.Random(4)
    pool = [f"{LONG} {i}" for i in range(30)]
    rows = [(i, "\n".join([LONG] * r.randint(0, 3) + r.choices(pool, k=6))) for i in range(60)] + [(None, LONG), (3, LONG)]
    for hot in (1, 4, 1 << 30):  # nearly all hashes hot, some, none
        monkeypatch.setattr(L, "HOT", hot)
        assert run(docs_of(rows)) == brute(rows)


def test_a_very_long_document(docs_of):
    rows = [(1, "\n".join(f"{LONG} {i}" for i in range(5000))), (2, "\n".join(f"{LONG} {i}" for i in range(0, 5000, 7))), (3, "\n".join(f"{LONG} {i}" for i in range(0, 5000, 3)))]
    assert run(docs_of(rows)) == brute(rows)


def test_empty_and_clashing_columns(docs_of, spark):
    assert run(docs_of([])) == []
    docs = docs_of([(i, f"{LONG}\nown {i}") for i in range(4)]).withColumns({c: F.lit("x") for c in ("key", "pos", "h1", "t", "words", "n_dropped", "line", "row", "id", "__id", "__kept", "range", "kept", "lines")}).withColumn("n_chars", F.lit(0))
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {0: ("own 0", 5), 1: ("own 1", 5), 2: ("own 2", 5), 3: (f"{LONG}\nown 3", len(LONG) + 6)}


def test_plan_has_no_python(docs_of):
    docs = docs_of([(1, "a")])
    plan = L.dedup_lines(docs)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("shufflepartitionidpassthrough") == 1, "lines move once, by range"
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
