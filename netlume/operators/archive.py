"""Packets of several inputs in the order of time, in files that rotate, and capture counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import INTERVAL, aligned, rotation


def chronological(*inputs: DataFrame) -> DataFrame:
    """All packets by time; of packets with one time those of the first input come first.

    The sort is by ranges, so no task holds more than its share of the time.
    """
    parts = [df.withColumn("input_idx", F.lit(k)) for k, df in enumerate(inputs)]
    return reduce(DataFrame.unionByName, parts).orderBy("ts_sec", "ts_usec", "input_idx", "seq")


def merge_thread(packets: DataFrame, threads: int, seconds: int = INTERVAL) -> DataFrame:
    """Packets with the number of the merger that their interval belongs to."""
    return packets.withColumn("merger", (F.floor(aligned(F.col("ts_sec"), seconds) / seconds) % threads).cast("int"))


def rotated(packets: DataFrame, seconds: int = INTERVAL, every: int = 1) -> DataFrame:
    """Packets with rotate_ts, the start of the file that they go to; write them with ``partitionBy("rotate_ts")``."""
    return packets.withColumn("rotate_ts", rotation(F.col("ts_sec"), seconds, every))


def merged_counters(counters: DataFrame, names: list[str]) -> DataFrame:
    """Counters of all threads by interval: the sum of those that are there, null if none is."""
    return counters.groupBy("interval_ts").agg(*(F.sum(n).cast("long").alias(n) for n in names))
