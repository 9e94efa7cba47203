"""BM25 as Column expressions in double precision, and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def checked(k1: float, b: float) -> tuple[float, float]:
    """k1 within 0.1 to 5 and b within 0 to 1, or ValueError."""
    if not 0.1 <= k1 <= 5:
        raise ValueError(f"k1 must lie between 0.1 and 5: {k1}")
    if not 0 <= b <= 1:
        raise ValueError(f"b must lie between 0 and 1: {b}")
    return k1, b


def saturation(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """How much tf occurrences in a document of this length count; without idf."""
    return (k1 + 1) * tf / (k1 * ((1 - b) + b * length / avgdl) + tf)


def idf(n_docs: Column, df: Column) -> Column:
    """ln(N / df): 0 for a term that all documents hold."""
    return F.log(n_docs / df)


def score(n_docs: Column, df: Column, tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n_docs, df) * saturation(tf, length, avgdl, k1, b)


def saturation_sql(tf: str, length: str, avgdl: str, k1: float = K1, b: float = B) -> str:
    return f"(({k1} + 1.0) * {tf} / ({k1} * ((1.0 - {b}) + {b} * {length} / {avgdl}) + {tf}))"
