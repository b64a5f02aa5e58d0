"""The place of each row in its group, for groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, group: list[str], leading: list[Column], rest: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the place, from 1 on, of each row in its group in the order of ``leading``, then ``rest``.

    A group is told apart by ``leading``, whatever its size: rows are counted
    by those, sums of the counts give where each part begins, and only parts
    are sorted in one task.  Choose ``leading`` so that parts are small.
    """
    parts = [f"_part{k}" for k in range(len(leading))]
    own = df.withColumns(dict(zip(parts, leading, strict=True)))
    before = Window.partitionBy(*group).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    begins = own.groupBy(*group, *parts).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*group, *parts).orderBy(*rest))
    return own.withColumn("_within", within).join(begins, [*group, *parts]).withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_within", "_before", *parts)


def with_group_size(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """``df`` with the number of rows of its group; counts are made before any shuffle, and joined."""
    return df.join(df.groupBy(*group).agg(F.count("*").alias(name)), group)
