"""Event-time intervals: which one a packet is in, which ones there are, and which are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = 60


def aligned(ts: Column, seconds: int = INTERVAL) -> Column:
    """The start of the interval of a second, counted from the epoch."""
    return ts - ts % F.lit(seconds)


def first_second(packets: DataFrame) -> int | None:
    """The second of the first packet; one row comes to the driver."""
    return packets.agg(F.min("ts_sec")).first()[0]


def assigned(packets: DataFrame, seconds: int = INTERVAL, first: int | None = None) -> DataFrame:
    """Packets with interval_ts.  With ``first``, the first packet's second, the interval that this is in begins there."""
    start = aligned(F.col("ts_sec"), seconds)
    return packets.withColumn("interval_ts", start if first is None else F.greatest(start, F.lit(first)))


def intervals(packets: DataFrame, seconds: int = INTERVAL) -> DataFrame:
    """All intervals from the first packet to the last: interval_ts, length, packets, complete.

    Empty intervals in between are rows too.  The first one begins with the
    first packet and the last one ends with the last, so these are complete
    only if that is their whole length; at the end a second is forgiven.
    """
    counts = packets.groupBy(aligned(F.col("ts_sec"), seconds).alias("start")).agg(F.count("*").alias("packets"), F.min("ts_sec").alias("low"), F.max("ts_sec").alias("high"))
    ends = counts.agg(F.min("low").alias("first"), F.max("high").alias("last"))
    every = F.sequence(aligned(F.col("first"), seconds), aligned(F.col("last"), seconds), F.lit(seconds))
    dense = ends.where("first is not null").select("first", "last", F.explode(every).alias("start"))
    out = dense.join(counts.select("start", "packets"), "start", "left")
    begin = F.greatest("start", "first")
    end = F.when(F.col("last") < F.col("start") + seconds - 1, F.col("last") + 1).otherwise(F.col("start") + seconds)
    reached = F.col("last") >= F.col("start") + seconds - 2
    return out.select(
        begin.alias("interval_ts"), (end - begin).cast("long").alias("length"), F.coalesce("packets", F.lit(0)).cast("long").alias("packets"),
        ((F.col("first") <= F.col("start")) & reached).alias("complete"),
    )


def rotation(ts: Column, seconds: int = INTERVAL, every: int = 0) -> Column:
    """The start of the file that an interval goes to; with ``every`` 0 files aren't rotated."""
    return ts - ts % F.lit(seconds * every) if every else F.lit(0).cast("long")


def late(packets: DataFrame, stream: str = "stream", arrival: str = "arrival", seconds: int = INTERVAL) -> DataFrame:
    """Packets with the flag late: at their arrival a packet of a later interval had come in the same stream."""
    seen = F.max(aligned(F.col("ts_sec"), seconds)).over(Window.partitionBy(stream).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return packets.withColumn("late", F.coalesce(F.col("ts_sec") < seen, F.lit(False)))


def counter(packets: DataFrame, seconds: int = INTERVAL, first: int | None = None) -> DataFrame:
    """Packets by interval, and nothing else."""
    return assigned(packets, seconds, first).groupBy("interval_ts").agg(F.count("*").alias("packet_cnt"))
