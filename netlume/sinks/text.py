"""Text exports of flows and time series, and names of output files."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u32 import dotted
from ..operators.flows import ORDER
from ..operators.ordering import with_group_size

CATEGORIES = ("flowtuple_backscatter", "flowtuple_icmpreq", "flowtuple_other")
"""The format names three categories; all flows are in the last."""


def flow_line() -> Column:
    """A flow as ``src|dst|sport|dport|protocol|ttl|0xflags|length,packets``."""
    c = F.col
    flags = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("tcp_flags"), 2, "0")))
    fields = (dotted(c("src_ip")), dotted(c("dst_ip")), c("src_port"), c("dst_port"), c("protocol"), c("ttl"), flags, F.concat_ws(",", c("ip_len"), c("packet_cnt")))
    return F.concat_ws("|", *(x.cast("string") for x in fields))


def flow_text(flow_rows: DataFrame, tag: str = "TELESCOPE", counts: bool = True) -> DataFrame:
    """The lines of a text file of flows, in order: place, value.

    Each interval has a start and an end line (``# <tag>_INTERVAL_START number
    time``) and a header and an end for each category; without ``counts``
    headers say 0.  Lines are placed by interval, section and flow order, so
    ``orderBy`` and one sort by ranges write any number of them.
    """
    number = F.dense_rank().over(Window.orderBy("time")) - 1
    sections = flow_rows.groupBy("time").agg(F.count("*").alias("n")).withColumn("number", number).withColumn("n", F.col("n") if counts else F.lit(0))
    head = [F.format_string(f"# {tag}_INTERVAL_START %d %d", "number", "time")]
    for k, name in enumerate(CATEGORIES):
        head.append(F.format_string(f"START {name} %d", F.col("n") if k == len(CATEGORIES) - 1 else F.lit(0).cast("long")))
        head += [F.lit(f"END {name}")] if k < len(CATEGORIES) - 1 else []
    tail = [F.lit(f"END {CATEGORIES[-1]}"), F.format_string(f"# {tag}_INTERVAL_END %d %d", "number", "time")]
    frame = sections.select("time", F.posexplode(F.array(*head, *tail)).alias("k", "value")).withColumn("section", F.when(F.col("k") < len(head), 0).otherwise(2))
    nothing = [F.lit(None).cast("long").alias(f"_{n}") for n in ORDER]
    lines = flow_rows.select("time", F.lit(0).alias("k"), flow_line().alias("value"), F.lit(1).alias("section"), *(F.col(n).cast("long").alias(f"_{n}") for n in ORDER))
    return frame.select("time", "k", "value", "section", *nothing).unionByName(lines).orderBy("time", "section", "k", *(f"_{n}" for n in ORDER)).select("value")


def time_series_lines(points: DataFrame) -> DataFrame:
    """Points as lines ``key value time``."""
    return points.select(F.concat_ws(" ", "key", F.col("value").cast("string"), F.col("ts").cast("string")).alias("value"))


def file_name(template: str, plugin: str = "", monitor: str = "", ts: int = 0, thread: int | None = None, extension: str = "", compression: str = "") -> str:
    """An output name: ``%P`` plugin, ``%N`` monitor, ``%f`` format, ``%s`` seconds, the rest of strftime in UTC; then extension, compression and ``--thread``."""
    own = {"P": plugin, "N": monitor, "f": extension.lstrip("."), "s": str(ts)}
    name = re.sub(r"%([PNfs])", lambda m: own[m[1]].replace("%", "%%"), template)
    name = time.strftime(name, time.gmtime(ts)) if "%" in name else name
    if extension and "%f" not in template:
        name += f".{extension.lstrip('.')}"
    name += f".{compression}" if compression else ""
    return name if thread is None else f"{name}--{thread}"


def time_series_messages(points: DataFrame, prefix: str = "", batch: int = 1000) -> DataFrame:
    """Points as messages (topic, key, value): lines of one time, so many in a message at most, under a key that keeps a time together."""
    topic = f"{prefix}.timeseries" if prefix else "timeseries"
    part = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(F.col("_of_time") / batch)))
    line = F.concat_ws(" ", "key", F.col("value").cast("string"), F.col("ts").cast("string"))
    messages = with_group_size(points, ["ts"], "_of_time").withColumn("_part", part).groupBy("ts", "_part").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("value"))
    return messages.select(F.lit(topic).alias("topic"), F.col("ts").cast("string").alias("key"), "value")


def statistics_lines(counters: DataFrame) -> DataFrame:
    """Counters by interval and thread as lines ``time=.. accepted=.. dropped=..``; what isn't known is left out."""
    names = [c for c in counters.columns if c != "interval_ts"]
    parts = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names]
    return counters.select(F.concat_ws(" ", F.concat(F.lit("time="), F.col("interval_ts").cast("string")), *parts).alias("value"))
