"""Gapless numbers for the rows of each group in one global sort, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ranges of ``by`` and sorted within them, with ``at``: ascending numbers, each task's without gaps.

    Equal rows are dealt by their place in the input too, so that no number of copies meets in one task.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    return placed.repartitionByRange(*by, "_place").sortWithinPartitions(*by, "_place").drop("_place").withColumn("at", F.monotonically_increasing_id())


def part(at: Column | str = "at") -> Column:
    """The task that gave a number of ``in_order``."""
    return F.shiftrightunsigned(at, 33)


def starts(written_rows: DataFrame, group: str) -> DataFrame:
    """group, part, first_at and first: which number (from 0 in its group) the first row of each part of a group has, and rows.

    One row a part and group: as many as there were tasks, and groups, at most together.
    """
    runs = written_rows.groupBy(group, part().alias("part")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(group).orderBy("part")) - F.col("rows")
    return runs.withColumn("first", before)


def numbered(written_rows: DataFrame, first: DataFrame, group: str, name: str = "nth", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``in_order`` (written, so that ``at`` stays as it is) with their number in their group, which isn't null, and
    columns ``more`` of ``first``."""
    joined = written_rows.withColumn("part", part()).join(first.select(group, "part", "first_at", "first", *more), [group, "part"])
    return joined.withColumn(name, F.col("first") + F.col("at") - F.col("first_at")).drop("part", "first_at", "first", "at")
