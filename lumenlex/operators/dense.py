"""Dense numbers over an ordering, whole or within groups, without moving a group to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenlex.shared import cut


def dense_ids(df: DataFrame, *order: Column, within: tuple[str, ...] = (), name: str = "dense_id", partitions: int | None = None, then: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Numbers the rows 0, 1, ... by order, anew in each group of equal ``within`` columns.

    A range sort by group and order, a count for each range and group, and offsets added to the ranks inside a range:
    a group may spread over many ranges. The ranges are cut once and kept, as counts and ranks must see the same cut.
    What meets in one task is one count for each range (and group). Rows that tie in order are numbered in an
    unspecified order. ``then`` maps the rows, order and group columns kept, after they moved and before they are kept.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(then(df.repartitionByRange(n, *within, *order)).withColumn("_range", F.spark_partition_id()))
    counts = kept.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    if not within:
        offsets = F.broadcast(offsets)  # one row for each range: its size is the number of partitions, whatever the input
    ranked = kept.withColumn("_rank", local).join(offsets, ["_range", *within])
    return ranked.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).select(*(c for c in kept.columns if c != "_range"), name)
