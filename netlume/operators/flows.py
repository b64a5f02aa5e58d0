"""Flows: packets counted by interval and 8-tuple, and merged counts of several runs.

Counts and first packets are both sums that Spark makes before it shuffles, so
a busy flow costs one row per task.  Sums are sorted, not hashed, as first
packets are structs; a number that few flows share stands before the fields
of the key, so that sorts seldom have to look at these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import has_bit, with_mask
from .intervals import INTERVAL, assigned
from .tagging import Ranges, with_origins

KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ttl", "tcp_flags", "ip_len"]
ORDER = ["protocol", "ttl", "tcp_flags", "src_ip", "dst_ip", "src_port", "dst_port", "ip_len"]
FIRST = ["tcp_synlen", "tcp_synwinlen", "is_spoofed", "is_masscan", "maxmind_continent", "maxmind_country", "netacq_continent", "netacq_country", "prefix2asn"]
FIELDS = ["time", *KEY, "tcp_synlen", "tcp_synwinlen", "packet_cnt", *FIRST[2:]]
NOWHERE = "??"
OWN = FIRST[:4]
"""What a flow has of its first packet alone; the rest is the source's."""
FILTERS = ("spoofed", "large_scale_scan")


def _own() -> dict[str, Column]:
    """The fields of a flow that are a packet's own; its mask has FILTERS."""
    c = F.col
    syn = c("protocol").eqNullSafe(6) & c("tcp_flags").eqNullSafe(2)
    zero = lambda x: F.coalesce(x, F.lit(0))
    return {
        "src_port": zero(c("src_port")), "dst_port": zero(c("dst_port")), "tcp_flags": zero(c("tcp_flags")),
        "tcp_synlen": F.when(syn, c("tcp_doff") * 4).otherwise(0), "tcp_synwinlen": F.when(syn, c("tcp_window")).otherwise(0),
        "is_spoofed": has_bit(c("filterbits"), FILTERS[0]).cast("int"), "is_masscan": has_bit(c("filterbits"), FILTERS[1]).cast("int"),
    }


def _origins() -> dict[str, Column]:
    """The fields of a flow that tags of its source give."""
    places = {f"{p}_{n}": F.coalesce(f"{p}.{n}", F.lit(NOWHERE)) for p in ("maxmind", "netacq") for n in ("continent", "country")}
    return places | {"prefix2asn": F.coalesce("prefix_asn", F.lit(0))}


def _attributes(tagged: DataFrame) -> DataFrame:
    """Tagged packets with the fields of a flow."""
    return tagged.where("src_ip is not null").withColumns(_own() | _origins())


def _counted(packets: DataFrame, names: list[str], seconds: int, first: int | None) -> DataFrame:
    """Packets by interval and key: packet_cnt, and the fields ``names`` of the first packet."""
    c = F.col
    lead = F.shiftleft("src_ip", 32).bitwiseXOR(c("dst_ip")).bitwiseXOR(F.shiftleft(c("src_port").cast("long"), 16)).alias("_lead")
    earliest = F.min(F.struct("ts_sec", "ts_usec", "seq", *names)).alias("_first")
    grouped = assigned(packets, seconds, first).groupBy(lead, c("interval_ts").alias("time"), *KEY).agg(F.count("*").alias("packet_cnt"), earliest)
    return grouped.select("time", *KEY, "packet_cnt", *(c(f"_first.{n}").alias(n) for n in names))


def flows(tagged: DataFrame, seconds: int = INTERVAL, first: int | None = None) -> DataFrame:
    """The 19 fields of each flow of an interval; what isn't part of the key comes from its first packet."""
    return _counted(_attributes(tagged), FIRST, seconds, first).select(*FIELDS)


def flows_of(packets: DataFrame, seconds: int = INTERVAL, first: int | None = None, **providers: Ranges) -> DataFrame:
    """``flows`` of packets without tags of their sources: ``providers`` (see ``tagging.with_origins``) are asked about flows, since their tags are the source's; packets that have no filterbits get those of FILTERS."""
    masked = packets if "filterbits" in packets.columns else with_mask(packets, names=FILTERS)
    counted = _counted(masked.where("src_ip is not null").withColumns(_own()), OWN, seconds, first)
    return with_origins(counted, **providers).withColumns(_origins()).select(*FIELDS)


def ordered(flow_rows: DataFrame) -> DataFrame:
    """Flows in the order in which files hold them."""
    return flow_rows.orderBy("time", *ORDER, "tcp_synlen", "tcp_synwinlen")


def merged(*inputs: DataFrame) -> DataFrame:
    """Flows of several inputs, equal ones (time, 8-tuple, SYN lengths) folded into one with the sum of packets and what else the last input says."""
    same = ["time", *KEY, "tcp_synlen", "tcp_synwinlen"]
    rest = FIRST[2:]
    union = None
    for k, df in enumerate(inputs):
        part = df.select(*FIELDS).withColumn("_input", F.lit(k))
        union = part if union is None else union.unionByName(part)
    grouped = union.groupBy(*same).agg(F.sum("packet_cnt").cast("long").alias("packet_cnt"), F.max(F.struct("_input", *rest)).alias("_last"))
    return grouped.select(*same, "packet_cnt", *(F.col(f"_last.{n}").alias(n) for n in rest))


def sampled(flow_rows: DataFrame, per_10000: int, seed: int | None = None) -> DataFrame:
    """So many of 10,000 flows: by chance, or, without a seed, always the same ones."""
    digest = F.substring(F.md5(F.concat_ws(",", "time", *KEY)), 1, 8)
    chosen = F.rand(seed) * 10000 if seed is not None else F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(10000))
    return flow_rows.where(chosen < per_10000)


def kafka_partition(flow_hash: Column, partitions: int) -> Column:
    """Where a flow goes, so that its parts meet."""
    return F.pmod(flow_hash, F.lit(partitions)).cast("int")


def packed_record(flow_rows: DataFrame, prefix: str = "") -> DataFrame:
    """Flows as messages (topic, value): all fields one after another, big-endian.

    time, src_ip, dst_ip 4 bytes; ports 2; protocol, ttl, flags 1; ip_len,
    tcp_synlen, tcp_synwinlen 2; packet_cnt 4; two flags 1; four codes of two
    letters (country before continent); ASN 4.
    """
    number = lambda name, size: F.unhex(F.lpad(F.hex(F.col(name).cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0"))
    sizes = (("time", 4), ("src_ip", 4), ("dst_ip", 4), ("src_port", 2), ("dst_port", 2), ("protocol", 1), ("ttl", 1), ("tcp_flags", 1), ("ip_len", 2), ("tcp_synlen", 2), ("tcp_synwinlen", 2), ("packet_cnt", 4), ("is_spoofed", 1), ("is_masscan", 1))
    codes = ("maxmind_country", "maxmind_continent", "netacq_country", "netacq_continent")
    parts = [*(number(n, s) for n, s in sizes), *(F.encode(F.rpad(n, 2, "?"), "UTF-8") for n in codes), number("prefix2asn", 4)]
    topic = f"{prefix}.flows" if prefix else "flows"
    return flow_rows.select(F.lit(topic).alias("topic"), F.concat(*parts).alias("value"))


RECORD_BYTES = 43
BATCH_BYTES = 512 * 1024


def batched_records(flow_rows: DataFrame, prefix: str = "", most: int = BATCH_BYTES) -> DataFrame:
    """Flows as messages (topic, time, value) that hold the records of many flows of one interval, of about ``most`` bytes each; no interval goes to one task."""
    records = packed_record(flow_rows, prefix).withColumn("time", F.conv(F.hex(F.substring("value", 1, 4)), 16, 10).cast("long"))
    sizes = records.groupBy("time").agg(F.ceil(F.count("*") * F.lit(RECORD_BYTES) / F.lit(most)).alias("_batches"))
    dealt = records.join(sizes, "time").withColumn("_batch", F.pmod(F.xxhash64("value"), F.col("_batches")))
    return dealt.groupBy("topic", "time", "_batch").agg(F.unhex(F.array_join(F.sort_array(F.collect_list(F.hex("value"))), "")).alias("value")).drop("_batch")
