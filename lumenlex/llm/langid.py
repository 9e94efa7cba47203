"""Language ID by word-first backoff.

A word that the model knows adds its log frequency in each language. A word that it does not know falls back to its
character n-grams: the longest length of which the model knows any, from 5 down to 1. The model is counted on a
bounded sample of labelled documents (``sample_docs``, by the hash of the id) that are not held out, and keeps every
word and n-gram of the sample. Words and n-grams are known by 64-bit hashes, in sorted arrays with the languages that
each occurs in and what it adds there, so the model takes about 20 bytes an entry and can be broadcast. Every document
is scored over its whole text.

Defined results: a NULL text or one without letters is ``und`` with score 0; so is every text if nothing could be
learned. Ties go to the language that comes first by code point. A NULL doc_id is not held out and is not learned
from. lang, source and doc_id are no inputs of a prediction. Other columns are not looked at and may bear any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.shared import Tables, giving_back

SAMPLE_DOCS, LONGEST, SMOOTHING = 8_000, 5, 0.5
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN, MIN_SCORE = "und", 0.5
CACHED_WORDS, TEXTS = 50_000, 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def key_of(kind: int, gram: str) -> int:
    """The 64-bit name of a word (kind 0) or of an n-gram of that length."""
    return xxhash.xxh3_64_intdigest(f"{kind}{gram}".encode("utf-8", "surrogatepass"))  # a seed would not keep short ones apart


def counted(sample: DataFrame) -> DataFrame:
    """lang, word, n over the sample(lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found.setdefault(lang, Counter()).update(WORD.findall(text.as_py().lower()))
        for lang, words in found.items():
            columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    return sample.mapInArrow(giving_back(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def entries(words: DataFrame) -> DataFrame:
    """key, kind, lang, n of every word (kind 0) and n-gram (its length), from lang, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, str], int] = {}
        for b in batches:
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for kind in range(LONGEST + 1):
                    for gram in grams(word, kind) if kind else (word,):
                        at = key_of(kind, gram), kind, lang
                        found[at] = found.get(at, 0) + n
        if found:
            key, kind, lang = zip(*found, strict=True)
            columns = [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(kind, pa.int32()), pa.array(lang, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["key", "kind", "lang", "n"])

    made = words.mapInArrow(giving_back(run), "key long, kind int, lang string, n long")
    return made.groupBy("key", "kind", "lang").agg(F.sum("n").alias("n"))


class Model:
    """What each known word or n-gram adds to each language; what it adds where it never occurs is the same for all of a kind."""

    def __init__(self, langs: list[str], key: np.ndarray, kind: np.ndarray, lang: np.ndarray, n: np.ndarray):
        """Parallel arrays: one row for each key and language that it occurs in; lang is a position in langs."""
        order = np.lexsort((lang, key))
        key, kind, n = key[order], kind[order], n[order].astype(float)
        self.langs, self.lang = langs, lang[order].astype(np.int16)
        start = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        self.keys, self.kind = key[start], kind[start].astype(np.int8)
        self.start = np.r_[start, len(key)]
        # The n-grams of a word overlap; each counts as its share of a word.
        self.gain = (np.log((n + SMOOTHING) / SMOOTHING) / np.maximum(1, kind)).astype(np.float32)
        self.base = np.zeros((LONGEST + 1, len(langs)))
        for k in range(LONGEST + 1):
            total = np.bincount(lang[order][kind == k], n[kind == k], len(langs)) + SMOOTHING * (self.kind == k).sum()
            self.base[k] = (np.log(SMOOTHING) - np.log(np.maximum(total, SMOOTHING))) / max(1, k)
        self.forget()

    def __getstate__(self) -> dict:
        """The cache stays where it is."""
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "vectors")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(self.langs)))

    def found(self, kind: int, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the parts the model knows, and their rows there."""
        if not len(self.keys) or not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wanted = np.fromiter((key_of(kind, part) for part in parts), np.uint64, len(parts)).view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == wanted)
        return hit, at[hit]

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each known word its row, for others those of its longest known n-grams: positions of words, rows."""
        hit, rows = self.found(0, words)
        owners, found = [hit], [rows]
        left = np.setdiff1d(np.arange(len(words)), hit)
        for k in range(LONGEST, 0, -1):
            parts, owner = [], []
            for i in left.tolist():
                made = grams(words[i], k)
                parts += made
                owner += [i] * len(made)
            hit, rows = self.found(k, parts)
            known = np.array(owner, np.int64)[hit]
            owners.append(known)
            found.append(rows)
            left = np.setdiff1d(left, known)
        return np.concatenate(owners), np.concatenate(found)

    def add(self, words: list[str]) -> None:
        """Puts what each word adds to each language into the cache."""
        langs = len(self.langs)
        owner, row = self.rows_of(words)
        size = self.start[row + 1] - self.start[row]
        at = np.repeat(self.start[row] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        cells = np.repeat(owner, size) * langs + self.lang[at]
        vectors = np.bincount(cells, self.gain[at], len(words) * langs).reshape(-1, langs)
        for k in range(LONGEST + 1):
            vectors += np.bincount(owner[self.kind[row] == k], minlength=len(words))[:, None] * self.base[k]
        used = len(self.row)
        while used + len(words) > len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[used : used + len(words)] = vectors
        self.row.update(zip(words, range(used, used + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """The language and score of each text; words are looked up once for all these texts."""
        split = [WORD.findall(text.lower()) if text and self.langs else [] for text in texts]
        split = [ws if ws and (ws[0].isalpha() or any(map(str.isalpha, text))) else [] for ws, text in zip(split, texts, strict=True)]
        met = set().union(*split)
        unseen = met - self.row.keys()
        if len(self.row) + len(unseen) > CACHED_WORDS:
            self.forget()
            unseen = met
        if unseen:
            self.add(sorted(unseen))
        for words in split:
            if not words:
                yield UNKNOWN, 0.0
                continue
            scores = self.vectors[list(map(self.row.__getitem__, words))].sum(0)
            odds = np.exp(scores - scores.max())
            best = int(scores.argmax())
            yield self.langs[best], float(odds[best] / odds.sum())


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Counts the sample on the executors; only the model, bounded by the sample, comes to the driver."""
    tables = Tables(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    # Picked by id first, so that no text travels that is not in the sample.
    picked = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = usable.join(F.broadcast(picked), "doc_id", "left_semi").select("lang", "text")
    words = tables.write(counted(sample), "words")
    found = entries(words).toArrow()
    tables.drop(words)
    langs = sorted(set(found.column("lang").unique().to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    coded = found.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    return Model(langs, *(found.column(c).to_numpy() for c in ("key", "kind")), lang, found.column("n").to_numpy())


def predictor(spark: SparkSession, model: Model):
    """A function of a text column to lang_pred and score."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = []
            for i in range(0, len(batch), TEXTS):
                found += shared.value.predict(batch.slice(i, TEXTS).to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score"])

    return F.arrow_udf(giving_back(run), "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER)


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """row, the columns of docs, and found, lang_pred and score."""
    return docs.select(F.struct("*").alias("row"), predictor(docs.sparkSession, model)(F.col("text")).alias("found"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score after its own columns."""
    return tagged(docs, model).select("row.*", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is known well enough; ``und`` and unsure ones are rejected."""
    kept = (F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= min_score)
    return tagged(docs, learn(docs)).where(kept).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, held_out, lang_pred, score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
