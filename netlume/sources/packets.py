"""The packet relation that all operators read, and one made of ``lineitem``.

A packet is a row; what a header lacks is null.  ``src_port`` and ``dst_port``
hold type and code of ICMP.  Addresses are longs (see ``functions.u32``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = (
    "ts_sec long, ts_usec int, seq long, caplen int, wirelen int, ethertype int, src_ip long, dst_ip long, protocol int, ttl int, ip_len int, ip_off int, l4_len int, "
    "src_port int, dst_port int, tcp_flags int, tcp_window int, tcp_doff int, udp_len int, payload binary, payload_len int, "
    "inner_src_ip long, inner_dst_ip long, inner_protocol int, inner_sport int, inner_dport int, l2_bytes binary"
)
SCHEMA = T.StructType([
    T.StructField(name, {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType()}[kind]) for name, kind in (f.split() for f in _FIELDS.split(", "))
])

#: How each column is made, in terms of those before it; SQL that Spark and DuckDB both read.
SYNTHETIC = (
    ("n", "l_orderkey * 8 + l_linenumber"),
    ("m", "n % 10"),
    ("h", "(16777216 + l_suppkey * 2654435761) % 3758096384"),
    ("ts_sec", "1704067200 + (n * 7919) % 3600"),
    ("ts_usec", "(n * 104729) % 1000000"),
    ("dst_ip", "738197504 + (l_partkey * 40503) % 16777216"),
    (
        "src_ip",
        "CASE WHEN n % 53 = 0 THEN 167772160 + (l_suppkey * 257) % 16777216 WHEN n % 59 = 0 THEN 3221225984 + l_suppkey % 256 WHEN n % 61 = 0 THEN (h >> 8) * 256 "
        "WHEN n % 67 = 0 THEN (h >> 8) * 256 + 255 WHEN n % 71 = 0 THEN dst_ip ELSE h END",
    ),
    ("protocol", "CASE WHEN n % 97 = 0 THEN 47 WHEN m < 6 THEN 6 WHEN m < 9 THEN 17 ELSE 1 END"),
    (
        "src_port",
        "CASE WHEN m = 9 THEN (n >> 3) % 19 WHEN n % 29 = 0 THEN 0 WHEN n % 23 = 0 THEN 53 WHEN m >= 6 AND n % 31 < 2 THEN 5060 - (n % 31) * 4923 ELSE (n * 31) % 65536 END",
    ),
    (
        "dst_port",
        "CASE WHEN m = 9 THEN n % 4 WHEN m >= 6 AND n % 31 < 2 THEN 5060 - (n % 31) * 4923 WHEN n % 7 = 0 THEN 23 WHEN n % 7 = 1 THEN 80 WHEN n % 7 = 2 THEN 53 WHEN n % 7 = 3 THEN 5000 "
        "ELSE (l_partkey * 13) % 65536 END",
    ),
    ("ttl", "32 + (n * 11) % 224"),
    (
        "tcp_flags",
        "CASE WHEN n % 97 = 0 OR m >= 6 THEN 0 WHEN n % 13 < 6 THEN 2 WHEN n % 13 < 8 THEN 18 WHEN n % 13 = 8 THEN 4 WHEN n % 13 = 9 THEN 16 WHEN n % 13 = 10 THEN 20 WHEN n % 13 = 11 THEN 24 ELSE 63 END",
    ),
    ("tcp_window", "CASE WHEN n % 3 = 0 THEN 1024 ELSE 29200 END"),
    ("tcp_doff", "CASE WHEN n % 2 = 0 THEN 5 ELSE 10 END"),
    (
        "ip_len",
        "CASE WHEN m >= 6 AND n % 17 = 0 THEN 96 WHEN m >= 6 AND n % 19 = 0 THEN 1500 WHEN n % 37 = 0 THEN 58 WHEN n % 41 = 0 THEN 48 WHEN n % 43 = 0 THEN 61 ELSE 60 + (n * 17) % 1400 END",
    ),
    ("ip_off", "CASE WHEN n % 47 = 0 THEN 8192 WHEN n % 73 = 0 THEN 32768 WHEN n % 3 = 0 THEN 16384 ELSE 0 END"),
    ("quoted", "CASE WHEN protocol = 1 AND (src_port = 3 OR src_port = 4 OR src_port = 5 OR src_port = 11 OR src_port = 12) THEN 1 ELSE 0 END"),
    ("inner_dst_ip", "CASE WHEN quoted = 1 THEN 50331648 + (n * 7919) % 256 END"),
    ("inner_src_ip", "CASE WHEN quoted = 1 THEN CASE WHEN n % 7 = 0 THEN dst_ip + 1 ELSE dst_ip END END"),
    ("inner_protocol", "CASE WHEN quoted = 1 THEN CASE WHEN n % 5 = 0 THEN 17 WHEN n % 5 = 1 THEN 1 WHEN n % 5 = 2 THEN 47 ELSE 6 END END"),
    ("inner_sport", "CASE WHEN quoted = 1 THEN (n * 17) % 65536 END"),
    ("inner_dport", "CASE WHEN quoted = 1 THEN (n * 19) % 65536 END"),
    (
        "payload_hex",
        "CASE WHEN protocol <> 17 THEN '' WHEN src_port = 5060 THEN '5349502f322e3020323030204f4b' WHEN src_port = 137 THEN '00001111222233334444555520434b4141414141' "
        "WHEN ip_len = 58 THEN '00000000000000003100ffff' WHEN n % 11 = 0 THEN '1234818000010001000000000377' WHEN n % 11 = 1 THEN '64313a6164323a696432303a' "
        "WHEN ip_len = 48 THEN '4100aaaa' WHEN ip_len = 61 THEN 'aaaaaaaaaaaaaaaaaaaaaaaa7fffffffab020400010000000800000000000000' ELSE 'ffffffffffffffffffffffff' END",
    ),
    ("payload_len", "length(payload_hex) / 2"),
)


def _big_endian(value, size: int):
    """A number as so many bytes in hexadecimal."""
    return F.lpad(F.hex(F.coalesce(value, F.lit(0)).cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0")


def with_frames(packets: DataFrame) -> DataFrame:
    """``packets`` with l2_bytes: Ethernet frames with the headers and the payload that the columns tell of; caplen is what that makes."""
    c, n = F.col, _big_endian
    zeros = lambda count: F.lit("00" * count)
    payload = F.coalesce(F.hex("payload"), F.lit(""))
    tcp = F.concat(n(c("src_port"), 2), n(c("dst_port"), 2), zeros(8), n(F.shiftleft("tcp_doff", 4), 1), n(c("tcp_flags"), 1), n(c("tcp_window"), 2), zeros(4), F.expr("repeat('00', greatest(4 * tcp_doff - 20, 0))"), payload)
    udp = F.concat(n(c("src_port"), 2), n(c("dst_port"), 2), n(c("udp_len"), 2), zeros(2), payload)
    inner = F.concat(F.lit("45"), zeros(8), n(c("inner_protocol"), 1), zeros(2), n(c("inner_src_ip"), 4), n(c("inner_dst_ip"), 4), n(c("inner_sport"), 2), n(c("inner_dport"), 2))
    icmp = F.concat(n(c("src_port"), 1), n(c("dst_port"), 1), zeros(6), F.when(c("inner_dst_ip").isNotNull(), inner).otherwise(F.lit("")))
    body = F.when(c("protocol") == 6, tcp).when(c("protocol") == 17, udp).when(c("protocol") == 1, icmp).otherwise(F.lit(""))
    ip = F.concat(F.lit("4500"), n(c("ip_len"), 2), zeros(2), n(c("ip_off"), 2), n(c("ttl"), 1), n(c("protocol"), 1), zeros(2), n(c("src_ip"), 4), n(c("dst_ip"), 4), body)
    frame = F.unhex(F.concat(F.lit("02" * 12), n(c("ethertype"), 2), F.when(c("src_ip").isNotNull(), ip).otherwise(F.lit("00" * 28))))
    return packets.withColumn("l2_bytes", frame).withColumn("caplen", F.length("l2_bytes"))


def with_others(packets: DataFrame) -> DataFrame:
    """``packets`` and some that aren't IP: of every 101 one more, that has nothing of a header."""
    common = {"ts_sec", "ts_usec", "seq", "caplen", "wirelen"}
    others = packets.where("seq % 101 = 0").select(*(F.col(f.name) if f.name in common else F.lit(0x0806 if f.name == "ethertype" else None).cast(f.dataType).alias(f.name) for f in SCHEMA))
    return packets.select(*SCHEMA.names).unionByName(others)


def synthetic_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each row of ``lineitem``."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    if df.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        df = df.repartition(cores)  # a file of one row group is one task; four narrow columns are cheap to deal out
    for name, how in SYNTHETIC:
        df = df.withColumn(name, F.expr(how))
    made = {
        "seq": F.col("n"), "ethertype": F.lit(2048), "payload": F.unhex("payload_hex"), "caplen": F.col("ip_len") + 14, "wirelen": F.col("ip_len") + 18, "l4_len": F.col("ip_len") - 20,
        "udp_len": F.when(F.col("protocol") == 17, F.col("payload_len") + 8), "l2_bytes": F.lit(None),
    }
    packets = df.select(*(made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SCHEMA))
    # A sample of everything: predicates aren't pushed through it, and so read columns, as of a file, not the definitions above again and again.
    return packets.sample(fraction=1.0, seed=0)


def synthetic_sql() -> str:
    """The same relation as DuckDB SQL, to stand after WITH: ``packets``."""
    steps = []
    for k, (name, how) in enumerate(SYNTHETIC):
        how = how.replace("length(payload_hex) / 2", "length(payload_hex) // 2")
        steps.append(f"p{k} AS (SELECT *, {how} AS {name} FROM {'lineitem' if not k else f'p{k - 1}'})")
    last = len(SYNTHETIC) - 1
    extra = "n AS seq, 2048 AS ethertype, ip_len + 14 AS caplen, ip_len + 18 AS wirelen, ip_len - 20 AS l4_len, CASE WHEN protocol = 17 THEN payload_len + 8 END AS udp_len"
    return ", ".join(steps) + f", packets AS (SELECT *, {extra} FROM p{last})"
