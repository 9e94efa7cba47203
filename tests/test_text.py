import pytest
from pyspark.sql import functions as F

from lumenlex.functions import bm25, text
from lumenlex.functions.porter2 import stem, stem_counts

GOLDENS = {
    "The naïve Test": ["na", "ve", "test"],
    "don't": [],
    "well-being": ["well"],
    "foo_the bar": ["foo", "the", "bar"],
    "àt home": ["home"],
    "BM25 in 2024": ["bm25", "2024"],
    "the of and": [],
    "": [],
}


def test_terms(spark):
    rows = spark.createDataFrame([(k,) for k in GOLDENS], "t string").select("t", text.terms(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == GOLDENS
    assert spark.createDataFrame([(None,)], "t string").select(text.terms(F.col("t")).alias("x")).first()["x"] is None


def test_stopwords_are_distinct():
    assert len(text.STOPWORDS) == len(set(text.STOPWORDS)) == 127


@pytest.mark.parametrize(
    "args, want",
    [((1.0, 4.0, 2.0, 2.0, 1.0), 0.6), ((3.0, 7.0, 7.0, 1.2, 0.75), 2.2 * 3 / 4.2), ((2.0, 99.0, 5.0, 1.2, 0.0), 2.2 * 2 / 3.2)],
)
def test_saturation(spark, args, want):
    tf, length, avgdl, k1, b = args
    got = spark.range(1).select(bm25.saturation(F.lit(tf), F.lit(length), F.lit(avgdl), k1, b).alias("s")).first()["s"]
    assert got == pytest.approx(want, abs=1e-9)


def test_saturation_grows_with_tf_and_falls_with_length(spark):
    rows = spark.range(1, 9).select(bm25.saturation(F.col("id"), F.lit(5), F.lit(4.0)).alias("tf"), bm25.saturation(F.lit(2), F.col("id"), F.lit(4.0)).alias("len"), "id").orderBy("id").collect()
    tf, length = [r["tf"] for r in rows], [r["len"] for r in rows]
    steps = [b - a for a, b in zip(tf, tf[1:])]
    assert all(s > 0 for s in steps) and steps == sorted(steps, reverse=True)
    assert length == sorted(length, reverse=True)


def test_idf_of_a_term_in_all_documents_is_zero(spark):
    assert spark.range(1).select(bm25.score(F.lit(7), F.lit(7), F.lit(3), F.lit(2), F.lit(2.0)).alias("s")).first()["s"] == 0


@pytest.mark.parametrize("k1, b", [(0.05, 0.5), (5.1, 0.5), (1.2, -0.1), (1.2, 1.1)])
def test_parameters_are_checked(k1, b):
    with pytest.raises(ValueError):
        bm25.checked(k1, b)


def test_stems():
    # Pairs of the published sample vocabulary.
    pairs = (
        "consist consist consisted consist consistency consist consistently consist consolation consol consoling consol conspicuous conspicu "
        "knack knack knackeries knackeri knavish knavish kneaded knead kneel kneel knightly knight knots knot generate generat general general "
        "hopping hop hoped hope ties tie cries cri dying die sky sky happy happi sensational sensat relational relat running run"
    ).split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def test_stem_counts_adds_up(spark):
    counts = [("running", 1, 2, 5), ("run", 1, 1, 5), ("runs", 17, 1, 1), ("cats", 3, 1, 1)]
    df = spark.createDataFrame(counts, "term string, mapped_id long, tf long, len long")
    assert sorted(map(tuple, stem_counts(df).collect())) == [("cat", 3, 1, 1), ("run", 1, 3, 5), ("run", 17, 1, 1)]
