"""Tokenization as Column expressions.

Text is lower-cased, stop words are removed from the raw text as whole words (so ``don't`` vanishes and
``well-being`` keeps both halves), and what is left is split into runs of ``[a-z0-9]``. Any other character,
accented letters included, ends a run. The word boundary is the ASCII one: Java's own ``\\b`` would count
accented letters as word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that results depend on.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: The same removal as a pattern, for SQL engines whose word boundary is ASCII.
STOP_PATTERN_ASCII = r"\b(" + "|".join(STOPWORDS) + r")\b"
WORD_PATTERN, TERM_PATTERN = "[a-z0-9_]+", "[a-z0-9]+"


def terms(text: Column) -> Column:
    """The array of index terms of text, in order, repeats kept; NULL text gives NULL.

    A stop word stands alone exactly if it is a whole run of ``[a-z0-9_]``, so runs are extracted, looked up, and split
    at underscores where there are any; no alternation of all stop words is tried at every character.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    kept = F.filter(runs, lambda w: ~w.isin(*STOPWORDS))
    parts = F.filter(F.flatten(F.transform(kept, lambda w: F.split(w, "_"))), lambda w: w != "")
    return F.when(F.contains(text, F.lit("_")), parts).otherwise(kept)


def terms_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    return f"regexp_extract_all(regexp_replace(lower({text}), '{STOP_PATTERN_ASCII}', ' ', 'g'), '{TERM_PATTERN}')"
