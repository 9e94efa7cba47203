"""The Porter2 (English Snowball) stemmer, written from its published description.

Spark has no stemmer. ``stem_counts`` stems each distinct term once, in Arrow batches; row-at-a-time work over all
tokens never happens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# The exceptional forms of the published algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of steps 2, 3 and 4, longest match first.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", None), ("li", None),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
LI_AFTER = "cdeghkmnrt"


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _short_end(word: str) -> bool:
    """Whether word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            if not _has_vowel(rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if rest.endswith(DOUBLES):
                return rest[:-1]
            return rest + "e" if r1 >= len(rest) and _short_end(rest) else rest
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    # A y at the start or after a vowel is a consonant, written Y.
    word = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for suffix, to in STEP2:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    word = word[:-1] if word[at - 1 : at] == "l" else word
                elif suffix == "li":
                    word = word[:at] if word[at - 1 : at] and word[at - 1] in LI_AFTER else word
                else:
                    word = word[:at] + to
            break
    for suffix, to in STEP3:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                word = word[:at] + to if to is not None else word[:at] if at >= r2 else word
            break
    for suffix in STEP4:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(term: Column) -> Column:
    """term, stemmed in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t is None else stem(t) for t in b.to_pylist()], pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(term)


#: Copies of the stem of each distinct term, over which the rows of a very common term spread.
COPIES = 16


def stem_counts(counted: DataFrame) -> DataFrame:
    """term, mapped_id, tf, len by stem, from the same by term: counts are joined and added up, never single tokens.

    Only the distinct terms pass through Python.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("salt")
    known = counted.select("term").distinct().select("term", stemmed(F.col("term")).alias("stem")).select("term", "stem", salts)
    salted = counted.withColumn("salt", F.pmod("mapped_id", F.lit(COPIES)).cast("int"))
    joined = salted.join(known, ["term", "salt"])
    added = joined.groupBy(F.col("stem").alias("term"), "mapped_id", "len").agg(F.sum("tf").cast("long").alias("tf"))
    return added.select("term", "mapped_id", "tf", "len")
