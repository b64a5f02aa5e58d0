"""Likely victims of attacks with spoofed sources, from the backscatter that they send.

A vector is a (protocol, target).  It lives while each interval has a packet
of it, and everything that is said about it adds up over that episode.
Packets are summed by (vector, interval) and by (vector, 10-second bucket)
before anything else, so a target that a third of all packets come from costs
a row per task and bucket.  Numbers of distinct values add up from the
interval in which each was first seen; no set of values is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import is_backscatter
from .flows import NOWHERE
from .intervals import INTERVAL, aligned

QUOTING = (3, 4, 5, 11, 12)
"""ICMP types that quote the packet that caused them."""
ICMP_PORT_UNIT = 256
"""Type and code stand for ports in the upper byte."""
LARGEST_FIRST = 10_000
"""Larger captured packets can't begin a vector."""
KEY = ["target_protocol", "target_ip"]
OUTPUT = [
    "bin_timestamp", "initial_packet_len", "target_ip", "target_protocol", "attacker_slash16_cnt", "attack_port_cnt", "target_port_cnt", "packet_cnt", "icmp_mismatches", "byte_cnt",
    "max_ppm_interval", "start_time_sec", "start_time_usec", "latest_time_sec", "latest_time_usec", "first_attack_port", "first_target_port", "maxmind_continent", "maxmind_country",
    "initial_packet",
]


@dataclass(frozen=True)
class Thresholds:
    """When a vector is reported, and the window (seconds) of its rate and the step by which that slides."""

    packets: int = 25
    seconds: int = 60
    rate: int = 30
    window: int = 60
    slide: int = 10

    def __post_init__(self):
        object.__setattr__(self, "slide", min(self.slide, self.window))
        if self.window % self.slide:
            raise ValueError("the window has to be a multiple of the slide")


def vectors(packets: DataFrame) -> DataFrame:
    """Backscatter packets with the vector that they belong to: KEY, attack_port, target_port, mismatch, attacker_slash16."""
    c = F.col
    quoting = (c("protocol") == 1) & c("src_port").isin(*QUOTING)
    quoted = quoting & c("inner_dst_ip").isNotNull()
    pick = lambda tcp, inner, icmp: F.when(c("protocol") == 6, tcp).when(quoted, inner).when(~quoting, icmp)
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = packets.where(is_backscatter()).withColumns({
        "target_protocol": pick(F.lit(6), c("inner_protocol"), F.lit(1)), "target_ip": pick(c("src_ip"), c("inner_dst_ip"), c("src_ip")),
        "attack_port": pick(c("dst_port"), zero(c("inner_sport")), c("dst_port") * ICMP_PORT_UNIT), "target_port": pick(c("src_port"), zero(c("inner_dport")), c("src_port") * ICMP_PORT_UNIT),
        "mismatch": F.when(quoted & (c("inner_src_ip") != c("dst_ip")), 1).otherwise(0), "attacker_slash16": c("dst_ip").bitwiseAND(0xFFFF0000),
    })
    return out.where(F.col("target_protocol").isin(1, 6, 17))


def _with_episodes(by_interval: DataFrame, seconds: int) -> DataFrame:
    """Rows by vector and interval with the interval in which the episode began."""
    w = Window.partitionBy(*KEY).orderBy("interval_ts")
    fresh = F.coalesce(F.col("interval_ts") - F.lag("interval_ts").over(w) > seconds, F.lit(True))
    return by_interval.withColumn("_begin", F.when(fresh, F.col("interval_ts"))).withColumn("episode", F.last("_begin", ignorenulls=True).over(w)).drop("_begin")


def rates(vector_packets: DataFrame, thresholds: Thresholds = Thresholds(), seconds: int = INTERVAL, by_interval: DataFrame | None = None) -> DataFrame:
    """KEY, interval_ts, episode and interval_ppm: the most packets in a window that ends in the interval and lies in the episode."""
    buckets = vector_packets.groupBy(*KEY, "interval_ts", aligned(F.col("ts_sec"), thresholds.slide).alias("bucket")).agg(F.count("*").alias("n"))
    if by_interval is None:
        by_interval = _with_episodes(buckets.select(*KEY, "interval_ts").distinct(), seconds)
    buckets = buckets.join(by_interval.select(*KEY, "interval_ts", "episode"), [*KEY, "interval_ts"])
    w = Window.partitionBy(*KEY, "episode").orderBy("bucket").rangeBetween(thresholds.slide - thresholds.window, 0)
    return buckets.withColumn("rate", F.sum("n").over(w)).groupBy(*KEY, "interval_ts", "episode").agg(F.max("rate").alias("interval_ppm"))


def attack_rows(packets: DataFrame, thresholds: Thresholds = Thresholds(), seconds: int = INTERVAL, first: int | None = None) -> DataFrame:
    """All vectors, an OUTPUT row for each interval in which they have packets, whether they reach the thresholds or not.

    ``packets`` are tagged ones (column maxmind); counts are those of the
    episode up to the interval's end.  With ``first``, the first packet's
    second, the interval that this is in is called by it.
    """
    tags = {"continent": F.coalesce("maxmind.continent", F.lit(NOWHERE)), "country": F.coalesce("maxmind.country", F.lit(NOWHERE))}
    v = vectors(packets).withColumns({**tags, "interval_ts": aligned(F.col("ts_sec"), seconds), "_small": F.col("caplen") <= LARGEST_FIRST})
    earliest = F.struct("ts_sec", "ts_usec", "seq", "caplen", "attack_port", "target_port", "continent", "country", F.col("l2_bytes").alias("packet"))
    by_interval = v.groupBy(*KEY, "interval_ts").agg(
        F.count("*").alias("packets"), F.sum("mismatch").alias("mismatches"), F.sum(F.col("ip_len").cast("long")).alias("bytes"),
        F.min(F.when(F.col("_small"), earliest)).alias("first"), F.max(F.struct("ts_sec", "ts_usec")).alias("last"),
    )
    episodes = _with_episodes(by_interval, seconds)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(n).cast("long").alias("value")) for k, n in enumerate(("attacker_slash16", "attack_port", "target_port"))))
    values = v.select(*KEY, "interval_ts", F.inline(kinds)).distinct().join(episodes.select(*KEY, "interval_ts", "episode"), [*KEY, "interval_ts"])
    new = values.groupBy(*KEY, "episode", "kind", "value").agg(F.min("interval_ts").alias("interval_ts"))
    new = new.groupBy(*KEY, "episode", "interval_ts").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"new{k}") for k in range(3)))
    joined = episodes.join(rates(v, thresholds, seconds, episodes), [*KEY, "interval_ts", "episode"]).join(new, [*KEY, "interval_ts", "episode"], "left")
    w = Window.partitionBy(*KEY, "episode").orderBy("interval_ts").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda n: F.sum(F.coalesce(n, F.lit(0))).over(w).cast("long")
    begin = F.col("interval_ts") if first is None else F.greatest("interval_ts", F.lit(first))
    out = joined.select(
        begin.alias("bin_timestamp"), *KEY, so_far("new0").alias("attacker_slash16_cnt"), so_far("new1").alias("attack_port_cnt"), so_far("new2").alias("target_port_cnt"),
        so_far("packets").alias("packet_cnt"), so_far("mismatches").alias("icmp_mismatches"), so_far("bytes").alias("byte_cnt"), F.max("interval_ppm").over(w).alias("max_ppm_interval"),
        F.min("first").over(w).alias("f"), F.max("last").over(w).alias("l"),
    ).where("f is not null")
    return out.select(*(
        {
            "initial_packet_len": F.col("f.caplen"), "start_time_sec": F.col("f.ts_sec"), "start_time_usec": F.col("f.ts_usec"), "latest_time_sec": F.col("l.ts_sec"), "latest_time_usec": F.col("l.ts_usec"),
            "first_attack_port": F.col("f.attack_port"), "first_target_port": F.col("f.target_port"), "maxmind_continent": F.col("f.continent"), "maxmind_country": F.col("f.country"), "initial_packet": F.col("f.packet"),
        }.get(n, F.col(n)).alias(n)
        for n in OUTPUT
    ))


def reached(thresholds: Thresholds = Thresholds()) -> Column:
    lasted = (F.col("latest_time_sec") - F.col("start_time_sec")) * 1_000_000 + F.col("latest_time_usec") - F.col("start_time_usec")
    return (F.col("max_ppm_interval") >= thresholds.rate) & (F.col("packet_cnt") >= thresholds.packets) & (lasted >= thresholds.seconds * 1_000_000)


def attacks(packets: DataFrame, thresholds: Thresholds = Thresholds(), seconds: int = INTERVAL, first: int | None = None) -> DataFrame:
    """The rows of ``attack_rows`` that reach all thresholds."""
    return attack_rows(packets, thresholds, seconds, first).where(reached(thresholds))
