"""Checks of compact records: schema, counts, duplicates, references, subsets. Aggregates, never row loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlex.operators.compact import COMPACT_COLUMNS, profile


def schema_errors(columns: list[str], expected: list[str] = COMPACT_COLUMNS) -> tuple[list[str], list[str]]:
    """(missing, redundant) column names, in their own order."""
    return [c for c in expected if c not in columns], [c for c in columns if c not in expected]


def link_mismatch() -> Column:
    """Whether the stated number of references differs from the list's length; a NULL on one side is a mismatch."""
    return ~F.col("referenced_works_count").eqNullSafe(F.size("referenced_works"))


def shard_counts(works: DataFrame) -> DataFrame:
    """path, bytes, record_count, link_mismatches for each file, in one pass over all shards."""
    counted = works.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return counted.agg(F.count(F.lit(1)).alias("record_count"), F.count_if(link_mismatch()).alias("link_mismatches"))


def duplicate_ids(works: DataFrame, id_column: str = "id") -> DataFrame:
    return works.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_references(works: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """work_id, referenced_work_id of references to no known work. A NULL reference is one."""
    links = works.select(F.col("id").alias("work_id"), F.explode("referenced_works").alias("referenced_work_id"))
    ids = (known if known is not None else works).select(F.col("id").alias("_id"))
    return links.join(ids, F.col("referenced_work_id") == F.col("_id"), "left_anti")


def duplicate_links(works: DataFrame) -> DataFrame:
    """work_id, referenced_work_id, occurrences of references that a work lists more than once.

    Lists without repeats are left out by their length first, so only few are exploded.
    """
    suspects = works.where(F.size("referenced_works") != F.size(F.array_distinct("referenced_works")))
    links = suspects.select(F.col("id").alias("work_id"), F.explode("referenced_works").alias("referenced_work_id"))
    return links.groupBy("work_id", "referenced_work_id").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1").orderBy("work_id", F.desc("occurrences"), "referenced_work_id")


def missing_entries(full: DataFrame, part: DataFrame, condition: str) -> DataFrame:
    """Ids that the condition admits from full but that part lacks."""
    return full.where(F.expr(profile(condition))).select("id").join(part.select("id"), "id", "left_anti")


def null_rates(df: DataFrame) -> DataFrame:
    """column, nulls, total, rate for every column, in one pass."""
    total = F.count(F.lit(1)).alias("total")
    row = df.agg(total, *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    rows = row.select("total", F.inline(each))
    return rows.select("column", "nulls", "total", (F.col("nulls") / F.col("total")).alias("rate"))


@dataclass(frozen=True)
class SubsetReport:
    total_nodes: int
    total_links: int
    filter_mismatches: int
    link_mismatches: int
    duplicate_ids: int
    missing_entries: int
    dangling_links: int

    @property
    def total_errors(self) -> int:
        """Dangling links are no error of a subset."""
        return self.filter_mismatches + self.link_mismatches + self.duplicate_ids + self.missing_entries


def subset_counts(part: DataFrame, condition: str) -> DataFrame:
    """total_nodes, total_links, filter_mismatches, link_mismatches. A condition that is NULL is no mismatch."""
    marked = part.withColumn("_matches", F.expr(profile(condition)))
    return marked.agg(
        F.count_distinct("id").alias("total_nodes"),
        F.coalesce(F.sum("referenced_works_count"), F.lit(0)).alias("total_links"),
        F.count_if(~F.col("_matches")).alias("filter_mismatches"),
        F.count_if(link_mismatch()).alias("link_mismatches"),
    )


def validate_subset(full: DataFrame, part: DataFrame, condition: str) -> SubsetReport:
    counts = subset_counts(part, condition).first().asDict()
    return SubsetReport(
        **counts,
        duplicate_ids=duplicate_ids(part).count(),
        missing_entries=missing_entries(full, part, condition).count(),
        dangling_links=dangling_references(part).count(),
    )
