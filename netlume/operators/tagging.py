"""Tags: ports, flow hash, filter mask, and what the source address belongs to.

The address lookup is a longest-prefix match.  Nested prefixes are flattened
to disjoint ranges where the longest prefix wins, the ranges are cut at
multiples of 65536, and packets join them on that part of the address with the
range as a residual predicate.  That is an equi-join, so Spark hashes it; it
is broadcast only if the flattened table is small enough, and shuffled if not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.u32 import with_flow_hash
from .filters import with_mask

BASIC, MAXMIND, NETACQ, PFX2AS = 1, 2, 4, 8
"""Bits of providers_used."""
BROADCAST_RANGES = 500_000
"""Ranges that may be broadcast; larger tables are joined by a shuffle."""
BLOCK = 65536


def basic_tags(packets: DataFrame) -> DataFrame:
    """``packets`` with tag_src_port, tag_dst_port, tag_protocol, ft_hash and has_basic; zeros where the transport header is missing or the packet is a later fragment."""
    c = F.col
    first = F.coalesce(c("ip_off").bitwiseAND(0x1FFF) == 0, F.lit(False))
    ok = F.coalesce(c("src_ip").isNotNull() & first & F.when(c("protocol") == 1, c("l4_len") >= 2).otherwise(c("l4_len") >= 4), F.lit(False))
    zero = lambda x: F.when(ok, F.coalesce(x, F.lit(0))).otherwise(0)
    fields = (c("src_ip"), c("dst_ip"), F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0)), c("ttl"), F.coalesce("tcp_flags", F.lit(0)), c("protocol"), c("ip_len"))
    hashed = with_flow_hash(packets, "ft_hash", *fields)
    return hashed.withColumns({"tag_protocol": zero(c("protocol")), "tag_src_port": zero(c("src_port")), "tag_dst_port": zero(c("dst_port")), "ft_hash": F.when(ok, c("ft_hash")).otherwise(F.lit(0).cast("long")), "has_basic": ok})


def flatten_prefixes(prefixes: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
    """Disjoint (low, high, value) of (address, bits, value): the longest prefix wins, and of equal ones the last."""
    last = {(a & (0xFFFFFFFF << (32 - b)) & 0xFFFFFFFF, b): v for a, b, v in prefixes}
    out, stack, at = [], [], 0  # open prefixes as (high, value); at: what is written up to

    def write(high: int) -> None:
        nonlocal at
        if stack and high >= at:
            out.append((at, high, stack[-1][1]))
        at = max(at, high + 1)

    for (low, bits), value in sorted(last.items()):
        while stack and stack[-1][0] < low:
            high = stack[-1][0]
            write(high)
            stack.pop()
        if stack and low > at:
            write(low - 1)
        at = max(at, low)
        stack.append((low + (1 << (32 - bits)) - 1, value))
    while stack:
        write(stack[-1][0])
        stack.pop()
    return out


@dataclass(frozen=True)
class Ranges:
    """Disjoint ranges as a table (block, low, high, value), and how many rows it has."""

    table: DataFrame
    size: int


def range_table(spark: SparkSession, ranges: list[tuple[int, int, object]], value: T.DataType) -> Ranges:
    """Ranges of addresses, cut at multiples of BLOCK by Spark."""
    schema = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("value", value)])
    blocks = F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))
    return Ranges(spark.createDataFrame(ranges, schema).withColumn("block", F.explode(blocks)), sum((r[1] >> 16) - (r[0] >> 16) + 1 for r in ranges))


def ranges_from(rows: DataFrame) -> Ranges:
    """Ranges (low, high, value) that a table says are disjoint already; they stay on the executors, and are counted."""
    blocks = F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))
    return Ranges(rows.select("low", "high", "value", F.explode(blocks).alias("block")), rows.agg(F.sum(F.size(blocks))).first()[0] or 0)


def lookup(packets: DataFrame, ranges: Ranges, column: str, ip: str = "src_ip") -> DataFrame:
    """``packets`` with the value of the range that holds ``ip``, or null.

    The ranges are disjoint, so no packet is doubled.  They are broadcast if
    they have BROADCAST_RANGES rows at most, and joined by a shuffle if more.
    """
    right = ranges.table.select(F.col("block").alias("_block"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("value").alias(column))
    if ranges.size <= BROADCAST_RANGES:
        right = F.broadcast(right)
    match = (F.shiftright(F.col(ip), 16) == F.col("_block")) & F.col(ip).between(F.col("_low"), F.col("_high"))
    return packets.join(right, match, "left").drop("_block", "_low", "_high")


GEO = T.StructType([T.StructField("continent", T.StringType()), T.StructField("country", T.StringType())])
NETACQ_GEO = T.StructType([*GEO.fields, T.StructField("region", T.IntegerType()), T.StructField("polygons", T.ArrayType(T.LongType()))])
MOST_POLYGONS = 8


def single_origin(asns: Column) -> Column:
    """The ASN of a prefix; none if it has several origins."""
    return F.when(F.size(asns) == 1, asns[0])


def polygon_ids(polygons: Column) -> Column:
    """At most 8 polygons (table number in the top 8 bits), without those whose id is 0."""
    return F.filter(F.slice(polygons, 1, MOST_POLYGONS), lambda p: p.bitwiseAND(0xFFFFFF) != 0)


def with_origins(rows: DataFrame, maxmind: Ranges | None = None, netacq: Ranges | None = None, pfx2as: Ranges | None = None) -> DataFrame:
    """``rows`` with what the providers say of their source address: maxmind and netacq (structs) and prefix_asn, null without an answer."""
    out = lookup(rows, maxmind, "maxmind") if maxmind is not None else rows.withColumn("maxmind", F.lit(None).cast(GEO))
    out = lookup(out, netacq, "netacq") if netacq is not None else out.withColumn("netacq", F.lit(None).cast(NETACQ_GEO))
    if pfx2as is not None:
        return lookup(out, pfx2as, "_asns").withColumn("prefix_asn", single_origin(F.col("_asns"))).drop("_asns")
    return out.withColumn("prefix_asn", F.lit(None).cast("long"))


def tag(packets: DataFrame, maxmind: Ranges | None = None, netacq: Ranges | None = None, pfx2as: Ranges | None = None, filterbits: bool = True) -> DataFrame:
    """Packets with all tags: basic ones, filterbits, maxmind and netacq (structs), prefix_asn, providers_used.

    The providers are range tables (see ``range_table``); their tags are those
    of the source address, and null without an answer.
    """
    out = basic_tags(packets)
    if filterbits:
        out = with_mask(out)
    out = with_origins(out, maxmind, netacq, pfx2as)
    used = {BASIC: F.col("has_basic"), MAXMIND: F.col("maxmind").isNotNull(), NETACQ: F.col("netacq").isNotNull(), PFX2AS: F.col("prefix_asn").isNotNull()}
    return out.withColumn("providers_used", sum((F.when(test, bit).otherwise(0) for bit, test in used.items()), F.lit(0)))


def with_labels(metrics: DataFrame, labels: DataFrame, key: str, small: bool = False) -> DataFrame:
    """Rows with the fully qualified label of their id; "unknown" where there is none.

    Spark broadcasts labels that its statistics tell are few; ``small`` says so of others.
    """
    right = labels.select(F.col("id").alias(key), F.col("label"))
    return metrics.join(F.broadcast(right) if small else right, key, "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def losses(packets: DataFrame, stream: str = "stream", tagger: str = "tagger_id", seqno: str = "seqno", arrival: str = "arrival") -> DataFrame:
    """What got lost on the way: for each stream and tagger the numbers of packets received and lost, and of gaps.

    Sequence numbers (64 bits, unsigned) count up and skip 0; a jump forward loses what is in
    between, a jump back counts as one loss, and a tagger that wasn't heard
    before starts anew.
    """
    w = Window.partitionBy(stream, tagger).orderBy(arrival)
    exact = F.col(seqno).cast("decimal(21,0)")
    number = F.when(F.col(seqno) < 0, exact + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(exact)  # numbers are unsigned
    before = F.lag(number).over(w)
    expected = F.when(before == F.lit(str((1 << 64) - 1)).cast("decimal(21,0)"), F.lit(1)).otherwise(before + 1)
    lost = F.when(before.isNull() | (number == expected), 0).when(number > expected, number - expected).otherwise(1)
    return packets.withColumn("_lost", lost).groupBy(stream, tagger).agg(
        F.count("*").alias("received"), F.sum("_lost").cast("long").alias("lost"), F.sum(F.when(F.col("_lost") > 0, 1).otherwise(0)).cast("long").alias("gaps")
    )


def numbered(packets: DataFrame) -> DataFrame:
    """Packets with tagger_id and seqno, which counts from 1 on within each task; for sources that bring none."""
    place = F.monotonically_increasing_id()
    return packets.withColumn("tagger_id", F.shiftright(place, 33).cast("int") + 1).withColumn("seqno", place.bitwiseAND(F.lit((1 << 33) - 1)) + 1)
