"""Compact Works: the nested record of a scholarly work, flattened and shortened. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prefixes that ids carry upstream, and the columns of a compact record.
ID_PREFIX, DOI_PREFIX = "https://openalex.org/", "https://doi.org/"
RAW_COLUMNS = (
    "id doi title authorships type language primary_location publication_year publication_date referenced_works "
    "referenced_works_count cited_by_count topics keywords"
).split()
COMPACT_COLUMNS = [*RAW_COLUMNS[:4], "authorships_truncated", *RAW_COLUMNS[4:]]


def bare(column: Column, prefix: str = ID_PREFIX) -> Column:
    """column without the literal prefix; NULL stays NULL."""
    return F.replace(column, F.lit(prefix), F.lit(""))


def last_segment(column: Column) -> Column:
    return F.split_part(column, F.lit("/"), F.lit(-1))


def head_and_last(items: Column) -> Column:
    """A list of more than three as its first two and its last; NULL stays NULL."""
    return F.when(F.size(items) <= 3, items).when(F.size(items) > 3, F.concat(F.slice(items, 1, 2), F.array(F.try_element_at(items, F.lit(-1)))))


def is_truncated(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 3


def compact_works(raw: DataFrame, *extra: Column) -> DataFrame:
    """The compact record of each raw one, and extra columns; one narrow projection, no shuffle."""

    def author(a: Column) -> Column:
        return F.struct(bare(a["author"]["id"]).alias("id"), a["author"]["display_name"].alias("display_name"), a["raw_author_name"].alias("raw_author_name"))

    def topic(t: Column) -> Column:
        levels = [x for level in ("subfield", "field", "domain") for x in (last_segment(t[level]["id"]).alias(f"{level}_id"), t[level]["display_name"].alias(f"{level}_display_name"))]
        return F.struct(bare(t["id"]).alias("id"), t["display_name"].alias("display_name"), t["score"].alias("score"), *levels)

    def keyword(k: Column) -> Column:
        return F.struct(bare(k["id"]).alias("id"), k["display_name"].alias("display_name"), k["score"].alias("score"))

    source = F.col("primary_location.source")
    location = F.struct(bare(source["id"]).alias("id"), source["display_name"].alias("display_name"), source["type"].alias("type"), F.col("primary_location.is_oa").alias("is_oa"))
    return raw.select(
        bare(F.col("id")).alias("id"),
        bare(F.col("doi"), DOI_PREFIX).alias("doi"),
        "title",
        F.transform(head_and_last(F.col("authorships")), author).alias("authorships"),
        is_truncated(F.col("authorships")).alias("authorships_truncated"),
        "type",
        "language",
        F.when(source.isNotNull(), location).alias("primary_location"),
        "publication_year",
        "publication_date",
        F.transform("referenced_works", lambda r: bare(r)).alias("referenced_works"),
        "referenced_works_count",
        "cited_by_count",
        F.transform("topics", topic).alias("topics"),
        F.transform("keywords", keyword).alias("keywords"),
        *extra,
    )


def document_text(works: DataFrame) -> DataFrame:
    """raw_id, text: title, then names of topics, subfields, fields and domains, then keywords, as one bag of words."""
    fields = ("display_name", "subfield_display_name", "field_display_name", "domain_display_name")
    # A field of a list of structs is the list of that field.
    names = [F.array_join(F.col("topics")[f], " ") for f in fields]
    return works.select(raw_id("id").alias("raw_id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), *names, F.array_join(F.col("keywords")["display_name"], " ")).alias("text"))


def raw_id(column: str) -> Column:
    """The number in an id such as W123: the first W goes; NULL for what is no number then."""
    return F.regexp_replace(F.col(column), "^([^W]*)W", "$1").try_cast("long")


def subset(works: DataFrame, condition: str) -> DataFrame:
    """The works that a profile's SQL condition admits; lists are indexed from 1, see profile."""
    return works.where(F.expr(profile(condition)))


_NAME = r"(?:`[^`]*`|[A-Za-z_]\w*)"
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", re.DOTALL)
_PATH, _FIELD = re.compile(rf"{_NAME}(?:\.{_NAME})*"), re.compile(rf"(?:\.{_NAME})+")
_INDEX = re.compile(r"\[\s*(-?\d+)\s*\]")


def profile(condition: str) -> str:
    """A condition with ``path[n]`` counted from 1, from the end if n is negative, and NULL for 0 or beyond the list.

    Quoted strings stay as they are; a path may be dotted, and indexes and fields may follow each other.
    """
    out, at = [], 0
    while at < len(condition):
        if found := _QUOTED.match(condition, at):
            out.append(found[0])
        elif found := _PATH.match(condition, at):
            path, end = found[0], found.end()
            while index := _INDEX.match(condition, end):
                path = f"try_element_at({path}, {index[1] if int(index[1]) else 'CAST(NULL AS INT)'})"
                end = index.end()
                if field := _FIELD.match(condition, end):
                    path, end = path + field[0], field.end()
            out.append(path)
            at = end
            continue
        else:
            found = re.compile(r"\w+|.", re.DOTALL).match(condition, at)
            out.append(found[0])
        at = found.end()
    return "".join(out)
