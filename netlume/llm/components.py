"""Connected components of a table of links, by alternating stars.

Links never leave the executors.  In each round every node tells its larger
neighbours of its least one (large star), then all neighbours that are smaller
(small star); what is left at the end are stars around the least node of each
component.  The least neighbours come from a sum that is made before the
shuffle, so a node with very many links costs one row per task; the join that
follows is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("w"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) that isn't the least of its component."""
    spark = links.sparkSession
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:  # ends: each round that changes anything lowers the sum of roots
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "w").alias("v")).distinct()
        small = large.join(_least(large), "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        small = small.unionByName(_least(large).withColumnRenamed("w", "v")).distinct()
        after = written(small, "links")
        removed(spark, links)
        links = after
        now = links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38)))")).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
