"""The registered queries and the pipeline on the smallest tables, against their SQL where there is some."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lumenlex.llm import catalog

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalog.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(catalog.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_pipeline(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.count() > 0
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < -1")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "lumenlex")):
        if os.path.basename(folder) != "llm":
            for f in (f for f in files if f.endswith(".py")):
                assert "lumenlex.llm" not in open(os.path.join(folder, f)).read(), f


def test_stages_in_sequence_on_odd_rows(spark, docs_of):
    """Nulls, empty and repeated rows, and columns named as the stages name theirs, through all stages but the last."""
    line, words = "one line that very many documents share here", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, f"{line}\n{words} own{i} {words[::-1]} number{i} of these", "en", "a") for i in range(4)]
    rows += [(10, words, "en", None), (10, words, "en", None), (11, words, None, "b"), (None, words, "en", "b"), (12, None, "en", "a"), (13, "", None, None), (14, "12 34", "en", "a")]
    rows += [(i, f"two documents {words[::-1]} with nearly the same {words} in them", "en", "a") for i in (20, 21)]
    clashing = ("row", "found", "lang_pred", "score", "range", "h1", "node", "band", "u", "v", "lost", "component_id", "kept", "n_lines")
    docs = docs_of(rows).selectExpr("*", *(f"'x' AS {c}" for c in clashing))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, SF)
        assert docs.columns == columns, name
        seen[name] = docs.collect()
        assert all(r[c] == "x" for r in seen[name] for c in clashing), name
    assert {r["doc_id"] for r in seen["language_id"]} == {0, 1, 2, 3, 10, 11, 20, 21, None}
    holders = [r["doc_id"] for r in seen["line_dedup"] if line in r["text"]]
    assert holders == [3] and len(seen["line_dedup"]) == len(seen["language_id"])
    # The words alone are a line of three documents, which the largest id keeps; the others stay, empty.
    left = [(r["doc_id"], r["text"]) for r in seen["near_dedup"]]
    assert left.count((10, "")) == 2 and left.count((11, words)) == left.count((None, "")) == 1
    assert 20 in dict(left) and 21 not in dict(left)
