"""The engine's queries over the driver's tables, and the same in DuckDB SQL.

``lineitem`` becomes packets (see ``sources.packets``), ``nation`` becomes the
prefix tables.  The SQL shares only the definition of the packets with the
DataFrame code; filters, lookups, episodes and all the rest are written anew.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.bpf import compile_filter
from .functions.u32 import dotted, network
from .operators import archive, dos, filters, flows, intervals, report, tagging
from .operators.ordering import placed, with_group_size
from .sinks import text as text_sink
from .sources.packets import synthetic_packets, synthetic_sql, with_frames, with_others

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
REGIONS = ("AF", "NA", "AS", "EU", "OC")


METHOD_BYTES = 8000
"""Larger methods are refused by the JVM's compiler; Spark's own limit lets eight times that through, to be interpreted."""


def small_methods(spark: SparkSession) -> None:
    """Have Spark leave stages unfused whose code would make methods that aren't compiled; it does so where plans are run, so the session keeps the setting."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > METHOD_BYTES:
        spark.conf.set(limit, METHOD_BYTES)


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_methods(spark)
            return f(spark, sf_dir)

        key = name or f.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql.strip()
        return f

    return put


# ---------------------------------------------------------------- providers


def providers(spark: SparkSession, sf_dir: str) -> dict[str, tagging.Ranges]:
    """Range tables from ``nation``: a /5 for each, and a /8 inside of it."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    geo, netacq, asns = [], [], []
    for r in nations:
        k = r["n_nationkey"]
        for address, bits, inner in ((k * 8 << 24, 5, 0), ((k * 8 + 3) << 24, 8, 1)):
            place = (REGIONS[r["n_regionkey"]], r["n_name"][inner : inner + 2])
            geo.append((address, bits, place))
            netacq.append((address, bits, (*place, (k + 1) * inner, [k + 1, 1 << 24, (1 << 24) + 2 * k + 1])))
            asns.append((address, bits, [64512 + k] if k % 5 else [64512 + k, 65000]))
    made = ((geo, tagging.GEO), (netacq, tagging.NETACQ_GEO), (asns, T.ArrayType(T.LongType())))
    return {n: tagging.range_table(spark, tagging.flatten_prefixes(p), t) for n, (p, t) in zip(("maxmind", "netacq", "pfx2as"), made, strict=True)}


def tagged(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    own = providers(spark, sf_dir) if names else {}
    return tagging.tag(synthetic_packets(spark, sf_dir), **{n: own[n] for n in names})


# ---------------------------------------------------------------- SQL pieces

_PAYLOAD = "substr(payload_hex, {}, {})"


def _hex(at: int, value: str) -> str:
    return f"substr(payload_hex, {2 * at + 1}, {len(value)}) = '{value}'"


def _word(at: int) -> str:
    return f"('0x' || substr(payload_hex, {2 * at + 1}, 4))::INTEGER"


_DNS = (
    f"protocol = 17 AND ip_len > 42 AND payload_len >= 12 AND CASE WHEN payload_len >= 12 THEN ({_word(2)} & 65520) = 33152 AND {_word(4)} < 10 AND {_word(6)} < 10 "
    f"AND {_word(8)} < 10 AND {_word(10)} < 10 ELSE false END"
)
_TORRENT = (
    f"protocol = 17 AND ((udp_len >= 20 AND payload_len >= 12 AND ({_hex(0, '64313a61')} OR {_hex(0, '64313a72')}) AND {_hex(4, '64323a69')} AND {_hex(8, '6432303a')}) "
    f"OR (udp_len >= 48 AND payload_len >= 40 AND {_hex(20, '13426974546f7272656e742070726f746f636f6c')}) "
    "OR (ip_len >= 58 AND payload_len >= 10 AND payload_len >= udp_len - 8 AND substr(payload_hex, 1, 4) IN ('4102', '2102', '3102', '1102') AND right(payload_hex, 20) = '00080000000000000000') "
    "OR (ip_len = 48 AND substr(payload_hex, 1, 4) IN ('4100', '2100', '3102', '1100')) "
    f"OR (ip_len = 61 AND {_hex(12, '7fffffffab020400010000000800000000000000')}))"
)
#: Networks that aren't routed.
_NETWORKS = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"


def _in_network(net: str) -> str:
    address, bits = net.split("/")
    low = int.from_bytes(bytes(map(int, address.split("."))))
    return f"src_ip BETWEEN {low} AND {low + (1 << 32 - int(bits)) - 1}"


_SPECIAL = " OR ".join(map(_in_network, _NETWORKS.split()))
_SYN = "protocol = 6 AND (tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0"
_NARROW = {
    4: "protocol NOT IN (1, 17, 41) AND (protocol <> 6 OR ((tcp_flags & 63) <> 0 AND (tcp_flags & 63) NOT IN (2, 16, 4, 1, 3, 18, 17, 24, 25)))",
    5: "protocol <> 1 AND ttl >= 200", 6: f"{_SYN} AND tcp_doff = 5", 7: f"{_SYN} AND tcp_window = 1024", 8: "(ip_off & 40959) <> 0", 9: "(src_ip & 255) = 0", 10: "(src_ip & 255) = 255",
    11: "src_ip = dst_ip", 12: "protocol = 17 AND (src_port = 0 OR dst_port = 0)", 13: "protocol = 6 AND (src_port = 0 OR dst_port = 0)", 14: "protocol = 17 AND dst_port = 80", 15: _SPECIAL,
    16: "(protocol = 17 AND src_port = 53) OR (protocol = 1 AND src_port IN (0, 3, 4, 5, 11, 12, 14, 16, 18)) OR (protocol = 6 AND ((tcp_flags & 18) = 18 OR (tcp_flags & 4) <> 0))",
    17: _TORRENT, 18: f"protocol = 17 AND payload_len >= 10 AND ip_len = 58 AND {_hex(0, '00000000000000003100')}",
    19: f"protocol = 17 AND payload_len >= 7 AND src_port = 5060 AND dst_port = 5060 AND {_hex(0, '5349502f322e30')}", 20: "protocol = 17 AND ip_len = 96", 21: "protocol = 17 AND ip_len = 1500",
    22: "src_port = 53 OR dst_port = 53", 23: "protocol = 6 AND (src_port = 23 OR dst_port = 23)", 24: "protocol = 6 AND (src_port = 80 OR dst_port = 80)",
    25: "protocol = 6 AND (src_port = 5000 OR dst_port = 5000)", 26: _DNS,
    27: f"protocol = 17 AND src_port = 137 AND dst_port = 137 AND ip_len > 48 AND payload_len >= 20 AND {_hex(12, '20434b4141414141')}", 28: "false",
}
_WIDE = {
    29: "f5 AND NOT (f7 AND f6)", 0: "f4 OR (f5 AND NOT (f7 AND f6)) OR f8 OR f9 OR f10 OR f11 OR f12 OR f13 OR f14", 2: "f15", 3: "f6 AND f5 AND f7",
    1: "f4 OR (f5 AND NOT (f7 AND f6)) OR f8 OR f9 OR f10 OR f11 OR f12 OR f13 OR f14 OR f5 OR f18 OR f19 OR f20 OR f21 OR f22 OR f23 OR f24 OR f25 OR f26 OR f27 OR f16 OR f17",
}
PACKETS = "WITH " + synthetic_sql()
_MASK = " + ".join(f"CASE WHEN f{i} THEN {1 << i} ELSE 0 END" for i in range(30))
FILTERED = (
    PACKETS + ", narrow AS (SELECT *, " + ", ".join(f"({sql}) AS f{i}" for i, sql in _NARROW.items()) + " FROM packets), wide AS (SELECT *, "
    + ", ".join(f"({sql}) AS f{i}" for i, sql in _WIDE.items()) + f" FROM narrow), filtered AS (SELECT *, ({_MASK})::BIGINT AS filterbits FROM wide)"
)
_HAS = "src_ip >> 27 < 25"
_IN = "(src_ip >> 24) % 8 = 3"
_CODE = f"CASE WHEN {_HAS} THEN substr(n_name, CASE WHEN {_IN} THEN 2 ELSE 1 END, 2) ELSE '??' END"
_CONT = "CASE n_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'NA' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' WHEN 4 THEN 'OC' ELSE '??' END"
TAGGED = (
    FILTERED + f", tagged AS (SELECT *, {_CONT} AS continent, {_CODE} AS country, CASE WHEN {_HAS} AND n_nationkey % 5 <> 0 THEN 64512 + n_nationkey END AS asn, "
    f"CASE WHEN {_HAS} AND {_IN} THEN n_nationkey + 1 ELSE 0 END AS region, ts_sec - ts_sec % 60 AS minute FROM filtered LEFT JOIN nation ON n_nationkey = src_ip >> 27)"
)
_M32 = 4294967295


def _hash_sql(source: str) -> str:
    words = ("dst_ip", "src_port * 65536", "dst_port", "ttl * 16777216 + tcp_flags * 65536", "(protocol * 256) | ip_len")
    out, before = f", h0 AS (SELECT *, (src_ip * 59) & {_M32} AS hash FROM {source})", "h0"
    for k, w in enumerate(words, 1):
        out += f", h{k} AS (SELECT * EXCLUDE (hash), xor(hash, (((hash << 5) & {_M32}) + (hash >> 27) + ({w})) & {_M32}) AS hash FROM {before})"
        before = f"h{k}"
    return out


# ---------------------------------------------------------------- filters


def _filter_query(name: str, number: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hit = with_others(synthetic_packets(spark, sf_dir)).where(filters.filter_by(name))
        return hit.groupBy(intervals.aligned(F.col("ts_sec"), 600).alias("interval_ts")).agg(F.count("*").alias("packet_cnt"), F.sum("ip_len").alias("byte_cnt"), F.countDistinct("src_ip").alias("src_ip_cnt"))

    run.__name__ = f"filter_{name}"
    if name == "not_ip":
        query(f"{PACKETS} SELECT ts_sec - ts_sec % 600 AS interval_ts, count(*) AS packet_cnt, NULL::BIGINT AS byte_cnt, 0::BIGINT AS src_ip_cnt FROM packets WHERE n % 101 = 0 GROUP BY 1")(run)
        return
    query(
        f"{FILTERED} SELECT ts_sec - ts_sec % 600 AS interval_ts, count(*) AS packet_cnt, sum(ip_len)::BIGINT AS byte_cnt, count(DISTINCT src_ip) AS src_ip_cnt FROM filtered WHERE f{number} GROUP BY 1"
    )(run)


for _number, _name in enumerate(filters.NAMES):
    _filter_query(_name, _number)


@query(f"{FILTERED} SELECT filterbits, count(*) AS packet_cnt FROM filtered GROUP BY 1")
def filter_bitmask(spark, sf_dir):
    return filters.with_mask(synthetic_packets(spark, sf_dir)).groupBy("filterbits").agg(F.count("*").alias("packet_cnt"))


@query(f"{FILTERED} SELECT filterbits & 15 AS short_bits, count(*) AS packet_cnt FROM filtered GROUP BY 1")
def filter_short_bits(spark, sf_dir):
    return filters.with_mask(synthetic_packets(spark, sf_dir)).groupBy(F.col("filterbits").bitwiseAND(15).alias("short_bits")).agg(F.count("*").alias("packet_cnt"))


@query(f"""{FILTERED} SELECT 'spoofed' AS removed, count(*) AS packet_cnt FROM filtered WHERE NOT f0 UNION ALL SELECT 'erratic', count(*) FROM filtered WHERE NOT f1
UNION ALL SELECT 'routed', count(*) FROM filtered WHERE f2 UNION ALL SELECT 'not_scan', count(*) FROM filtered WHERE f3 UNION ALL SELECT 'both', count(*) FROM filtered WHERE NOT f0 AND NOT f1""")
def filter_removal(spark, sf_dir):
    packets = synthetic_packets(spark, sf_dir)
    ways = {"spoofed": {"spoofed": True}, "erratic": {"erratic": True}, "routed": {"routed": True}, "not_scan": {"not_scan": True}, "both": {"spoofed": True, "erratic": True}}
    tests = F.array(*(F.when(filters.removal(**how), F.lit(name)) for name, how in ways.items()))
    return packets.select(F.explode(F.array_compact(tests)).alias("removed")).groupBy("removed").agg(F.count("*").alias("packet_cnt"))


@query(f"""{PACKETS} SELECT protocol, count(*) AS packet_cnt, sum(ip_len)::BIGINT AS byte_cnt FROM packets
WHERE ((protocol = 17 AND dst_port = 53) OR (protocol = 6 AND (src_port BETWEEN 20 AND 1023 OR dst_port BETWEEN 20 AND 1023))) AND NOT (src_ip >> 24 = 10) AND wirelen >= 100 GROUP BY 1""")
def filter_bpf(spark, sf_dir):
    test = compile_filter("(udp dst port 53 or tcp portrange 20-1023) and not src net 10.0.0.0/8 and greater 100")
    return synthetic_packets(spark, sf_dir).where(test).groupBy("protocol").agg(F.count("*").alias("packet_cnt"), F.sum("ip_len").alias("byte_cnt"))


@query(f"""{PACKETS} SELECT 'all' AS combined, count(*) AS packet_cnt FROM packets WHERE protocol = 6 AND dst_port = 23 UNION ALL SELECT 'any', count(*) FROM packets WHERE protocol = 6 OR (protocol IN (6, 17) AND dst_port = 23)""")
def filter_custom(spark, sf_dir):
    packets = synthetic_packets(spark, sf_dir)
    both = F.array(F.when(filters.all_of("tcp", "dst port 23"), "all"), F.when(filters.any_of("tcp", "dst port 23"), "any"))
    return packets.select(F.explode(F.array_compact(both)).alias("combined")).groupBy("combined").agg(F.count("*").alias("packet_cnt"))


@query(f"{PACKETS} SELECT count(*) AS packet_cnt, min(ts_sec) AS low, max(ts_sec) AS high FROM packets WHERE ts_sec >= 1704067800 AND ts_sec < 1704069000")
def filter_time(spark, sf_dir):
    kept = synthetic_packets(spark, sf_dir).where(filters.within_time(1704067800, 1704069000))
    return kept.agg(F.count("*").alias("packet_cnt"), F.min("ts_sec").alias("low"), F.max("ts_sec").alias("high"))


@query(f"""{PACKETS} SELECT protocol, count(*) AS packet_cnt FROM packets WHERE (protocol = 6 AND ((tcp_flags & 18) = 18 OR (tcp_flags & 4) <> 0)) OR (protocol = 1 AND src_port IN (0, 3, 4, 5, 11, 12, 14, 16, 18)) GROUP BY 1""")
def filter_dos_gate(spark, sf_dir):
    return synthetic_packets(spark, sf_dir).where(filters.is_backscatter()).groupBy("protocol").agg(F.count("*").alias("packet_cnt"))


# ---------------------------------------------------------------- tags


@query(f"{PACKETS}{_hash_sql('packets')} SELECT hash AS ft_hash, count(*) AS packet_cnt FROM (SELECT * REPLACE (CASE WHEN (ip_off & 8191) = 0 THEN hash ELSE 0 END AS hash) FROM h5) GROUP BY 1")
def flow_hash(spark, sf_dir):
    return tagging.basic_tags(synthetic_packets(spark, sf_dir)).groupBy("ft_hash").agg(F.count("*").alias("packet_cnt"))


@query(f"{PACKETS} SELECT protocol AS tag_protocol, src_port AS tag_src_port, count(*) AS packet_cnt, sum(dst_port)::BIGINT AS dst_ports FROM packets GROUP BY 1, 2")
def tag_basic(spark, sf_dir):
    return tagging.basic_tags(synthetic_packets(spark, sf_dir)).groupBy("tag_protocol", "tag_src_port").agg(F.count("*").alias("packet_cnt"), F.sum("tag_dst_port").alias("dst_ports"))


@query(f"{TAGGED} SELECT continent, country, count(*) AS packet_cnt, count(DISTINCT src_ip) AS src_ip_cnt FROM tagged GROUP BY 1, 2")
def tag_geo(spark, sf_dir):
    out = tagging.lookup(synthetic_packets(spark, sf_dir), providers(spark, sf_dir)["maxmind"], "maxmind")
    place = [F.coalesce(f"maxmind.{n}", F.lit("??")).alias(n) for n in ("continent", "country")]
    return out.groupBy(*place).agg(F.count("*").alias("packet_cnt"), F.countDistinct("src_ip").alias("src_ip_cnt"))


@query(f"""{TAGGED} SELECT region, CASE WHEN {_HAS} THEN (n_nationkey + 1) || ',' || (16777216 + 2 * n_nationkey + 1) ELSE '' END AS polygons, count(*) AS packet_cnt FROM tagged GROUP BY 1, 2""")
def tag_netacq(spark, sf_dir):
    out = tagging.lookup(synthetic_packets(spark, sf_dir), providers(spark, sf_dir)["netacq"], "netacq")
    polygons = F.concat_ws(",", tagging.polygon_ids(F.col("netacq.polygons")).cast("array<string>"))
    return out.groupBy(F.coalesce("netacq.region", F.lit(0)).alias("region"), polygons.alias("polygons")).agg(F.count("*").alias("packet_cnt"))


@query(f"{TAGGED} SELECT asn AS prefix_asn, count(*) AS packet_cnt FROM tagged GROUP BY 1")
def tag_asn(spark, sf_dir):
    return tagged(spark, sf_dir, "pfx2as").groupBy("prefix_asn").agg(F.count("*").alias("packet_cnt"))


@query(f"{TAGGED} SELECT 1 + CASE WHEN {_HAS} THEN 6 ELSE 0 END + CASE WHEN asn IS NOT NULL THEN 8 ELSE 0 END AS providers_used, count(*) AS packet_cnt FROM tagged GROUP BY 1")
def tag_providers(spark, sf_dir):
    return tagged(spark, sf_dir, "maxmind", "netacq", "pfx2as").groupBy("providers_used").agg(F.count("*").alias("packet_cnt"))


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'unknown' END AS label FROM nation""")
def tag_labels(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    labels = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return tagging.with_labels(nation.select(F.col("n_nationkey").alias("id")), labels, "id")


@query("""WITH e AS (SELECT event_id, 1 + event_id // 5000 AS tagger_id, event_id % 5000 + 1 + (event_id % 5000) // 97 AS seqno FROM events),
l AS (SELECT *, lag(seqno) OVER (PARTITION BY tagger_id ORDER BY event_id) AS before FROM e)
SELECT 1 AS stream, tagger_id, count(*) AS received, sum(CASE WHEN before IS NULL THEN 0 ELSE seqno - before - 1 END)::BIGINT AS lost,
sum(CASE WHEN seqno - before > 1 THEN 1 ELSE 0 END)::BIGINT AS gaps FROM l GROUP BY 2""")
def tag_losses(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.selectExpr("1 AS stream", "1 + event_id div 5000 AS tagger_id", "event_id % 5000 + 1 + (event_id % 5000) div 97 AS seqno", "event_id AS arrival")
    return tagging.losses(e)


# ---------------------------------------------------------------- intervals


@query(f"{PACKETS} SELECT greatest(ts_sec - ts_sec % 300, (SELECT min(ts_sec) FROM packets)) AS interval_ts, count(*) AS packet_cnt FROM packets GROUP BY 1")
def interval_assignment(spark, sf_dir):
    packets = synthetic_packets(spark, sf_dir)
    return intervals.assigned(packets, 300, intervals.first_second(packets)).groupBy("interval_ts").agg(F.count("*").alias("packet_cnt"))


@query("""WITH q AS (SELECT epoch_us(ts) // 1000000 AS ts_sec FROM events), e AS (SELECT min(ts_sec) AS a, max(ts_sec) AS b FROM q),
s AS (SELECT unnest(generate_series(a - a % 300, b - b % 300, 300)) AS start, a, b FROM e), n AS (SELECT ts_sec - ts_sec % 300 AS start, count(*) AS packets FROM q GROUP BY 1)
SELECT greatest(s.start, a) AS interval_ts, (CASE WHEN b < s.start + 299 THEN b + 1 ELSE s.start + 300 END) - greatest(s.start, a) AS length, coalesce(packets, 0) AS packets,
a <= s.start AND b >= s.start + 298 AS complete FROM s LEFT JOIN n USING (start)""")
def interval_gaps(spark, sf_dir):
    return intervals.intervals(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_timestamp("ts").alias("ts_sec")), 300)


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 - (event_id * 7919) % 7200 AS ts_sec, user_id AS stream FROM events),
l AS (SELECT *, max(ts_sec - ts_sec % 3600) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
SELECT stream, count(*) AS packets, sum(CASE WHEN ts_sec < seen THEN 1 ELSE 0 END)::BIGINT AS late FROM l GROUP BY 1""")
def interval_late(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.unix_timestamp("ts") - (F.col("event_id") * 7919) % 7200).alias("ts_sec"), F.col("user_id").alias("stream"))
    out = intervals.late(e, arrival="event_id", seconds=3600)
    return out.groupBy("stream").agg(F.count("*").alias("packets"), F.sum(F.col("late").cast("long")).alias("late"))


@query(f"{PACKETS} SELECT ts_sec - ts_sec % 60 AS interval_ts, count(*) AS packet_cnt FROM packets GROUP BY 1")
def interval_counter(spark, sf_dir):
    return intervals.counter(synthetic_packets(spark, sf_dir))


@query(f"{PACKETS} SELECT ts_sec - ts_sec % 240 AS rotate_ts, (ts_sec // 60) % 3 AS merger, count(*) AS packet_cnt FROM packets GROUP BY 1, 2")
def interval_rotation(spark, sf_dir):
    packets = archive.merge_thread(archive.rotated(synthetic_packets(spark, sf_dir), 60, 4), 3)
    return packets.groupBy("rotate_ts", F.col("merger").cast("long").alias("merger")).agg(F.count("*").alias("packet_cnt"))


# ---------------------------------------------------------------- flows

_FLOW_KEY = "src_ip, dst_ip, src_port, dst_port, protocol, ttl, tcp_flags, ip_len"
_FLOWS = f""", kept AS (SELECT *, CASE WHEN protocol = 6 AND tcp_flags = 2 THEN tcp_doff * 4 ELSE 0 END AS tcp_synlen, CASE WHEN protocol = 6 AND tcp_flags = 2 THEN tcp_window ELSE 0 END AS tcp_synwinlen,
f0::INTEGER AS is_spoofed, f3::INTEGER AS is_masscan, coalesce(asn, 0) AS prefix2asn FROM tagged),
flows AS (SELECT minute AS time, {_FLOW_KEY}, tcp_synlen, tcp_synwinlen, n_packets AS packet_cnt, is_spoofed, is_masscan, continent AS maxmind_continent, country AS maxmind_country,
continent AS netacq_continent, country AS netacq_country, prefix2asn FROM (SELECT *, count(*) OVER (PARTITION BY minute, {_FLOW_KEY}) AS n_packets,
row_number() OVER (PARTITION BY minute, {_FLOW_KEY} ORDER BY ts_sec, ts_usec, seq, tcp_synlen, tcp_synwinlen, is_spoofed, is_masscan) AS place FROM kept) WHERE place = 1)"""


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flows_of(synthetic_packets(spark, sf_dir), **providers(spark, sf_dir))


@query(f"{TAGGED}{_FLOWS} SELECT * FROM flows", name="flows")
def flow_rows(spark, sf_dir):
    return _flows(spark, sf_dir)


@query(f"""{TAGGED}{_FLOWS}, twice AS (SELECT *, 0 AS i FROM flows UNION ALL SELECT * REPLACE (1 - is_spoofed AS is_spoofed, CASE WHEN dst_port = 23 THEN 99 ELSE tcp_synlen END AS tcp_synlen), 1 FROM flows)
SELECT time, {_FLOW_KEY}, tcp_synlen, tcp_synwinlen, sum(packet_cnt)::BIGINT AS packet_cnt, arg_max(is_spoofed, i) AS is_spoofed, arg_max(is_masscan, i) AS is_masscan,
arg_max(maxmind_continent, i) AS maxmind_continent, arg_max(maxmind_country, i) AS maxmind_country, arg_max(netacq_continent, i) AS netacq_continent, arg_max(netacq_country, i) AS netacq_country,
arg_max(prefix2asn, i) AS prefix2asn FROM twice GROUP BY time, {_FLOW_KEY}, tcp_synlen, tcp_synwinlen""")
def flows_merged(spark, sf_dir):
    rows = _flows(spark, sf_dir)
    other = rows.withColumns({"is_spoofed": 1 - F.col("is_spoofed"), "tcp_synlen": F.when(F.col("dst_port") == 23, 99).otherwise(F.col("tcp_synlen"))})
    return flows.merged(rows, other)


@query(f"""{TAGGED}{_FLOWS} SELECT time, place, protocol, src_ip, dst_ip FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY protocol, ttl, tcp_flags, src_ip, dst_ip, src_port, dst_port, ip_len, tcp_synlen, tcp_synwinlen) AS place FROM flows)""")
def flows_ordered(spark, sf_dir):
    leading = [F.col("protocol"), F.col("ttl"), F.col("tcp_flags"), F.shiftright("src_ip", 24)]
    return placed(_flows(spark, sf_dir), ["time"], leading, [*flows.ORDER[3:], "tcp_synlen", "tcp_synwinlen"]).select("time", "place", "protocol", "src_ip", "dst_ip")


@query(f"{PACKETS}{_hash_sql('packets')} SELECT (CASE WHEN (ip_off & 8191) = 0 THEN hash ELSE 0 END) % 16 AS kafka_partition, count(*) AS packet_cnt FROM h5 GROUP BY 1")
def flows_partition(spark, sf_dir):
    hashed = tagging.basic_tags(synthetic_packets(spark, sf_dir))
    return hashed.groupBy(flows.kafka_partition(F.col("ft_hash"), 16).alias("kafka_partition")).agg(F.count("*").alias("packet_cnt"))


@query(f"""{TAGGED}{_FLOWS} SELECT 'telescope.flows' AS topic, upper(printf('%08x%08x%08x', time, src_ip, dst_ip) || printf('%04x%04x%02x%02x%02x', src_port, dst_port, protocol, ttl, tcp_flags)
|| printf('%04x%04x%04x%08x%02x%02x', ip_len, tcp_synlen, tcp_synwinlen, packet_cnt, is_spoofed, is_masscan) || hex(encode(maxmind_country)) || hex(encode(maxmind_continent))
|| hex(encode(netacq_country)) || hex(encode(netacq_continent)) || printf('%08x', prefix2asn)) AS value_hex FROM flows""")
def flows_messages(spark, sf_dir):
    return flows.packed_record(_flows(spark, sf_dir), "telescope").select("topic", F.hex("value").alias("value_hex"))


_MESSAGE = """upper(printf('%08x%08x%08x', time, src_ip, dst_ip) || printf('%04x%04x%02x%02x%02x', src_port, dst_port, protocol, ttl, tcp_flags)
|| printf('%04x%04x%04x%08x%02x%02x', ip_len, tcp_synlen, tcp_synwinlen, packet_cnt, is_spoofed, is_masscan) || hex(encode(maxmind_country)) || hex(encode(maxmind_continent))
|| hex(encode(netacq_country)) || hex(encode(netacq_continent)) || printf('%08x', prefix2asn))"""
@query(f"{TAGGED}{_FLOWS} SELECT time, {_MESSAGE} AS value_hex, true AS small FROM flows")
def flows_batches(spark, sf_dir):
    """The records of all batches, none of which is much larger than asked for."""
    size = flows.RECORD_BYTES
    batches = flows.batched_records(_flows(spark, sf_dir), "telescope", 100 * size).withColumn("text", F.hex("value"))
    record = F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"length(value) div {size} - 1")), lambda k: F.substring(F.col("text"), k * (2 * size) + 1, F.lit(2 * size))))
    return batches.select("time", record.alias("value_hex"), (F.length("value") <= 200 * size).alias("small"))


_SAMPLE_KEY = " || ',' || ".join(n.strip() for n in f"time, {_FLOW_KEY}".split(","))
@query(f"""{TAGGED}{_FLOWS} SELECT * FROM flows WHERE ('0x' || substr(md5({_SAMPLE_KEY}), 1, 8))::BIGINT % 10000 < 2500""")
def flows_sampled(spark, sf_dir):
    return flows.sampled(_flows(spark, sf_dir), 2500)


_DOT = "((({0}) >> 24) || '.' || ((({0}) >> 16) & 255) || '.' || ((({0}) >> 8) & 255) || '.' || (({0}) & 255))"
@query(f"""{TAGGED}{_FLOWS} SELECT time, {_DOT.format('src_ip')} || '|' || {_DOT.format('dst_ip')} || '|' || src_port || '|' || dst_port || '|' || protocol || '|' || ttl || '|0x' || printf('%02x', tcp_flags)
|| '|' || ip_len || ',' || packet_cnt AS line, count(*) OVER (PARTITION BY time) AS flow_cnt FROM flows""")
def flows_ascii(spark, sf_dir):
    return with_group_size(_flows(spark, sf_dir), ["time"], "flow_cnt").select("time", text_sink.flow_line().alias("line"), "flow_cnt")


# ---------------------------------------------------------------- reports

_COUNTS = "count(DISTINCT src_ip) AS src_ip_cnt, count(DISTINCT dst_ip) AS dest_ip_cnt, count(*) AS pkt_cnt, sum(ip_len)::BIGINT AS byte_cnt, count(DISTINCT asn) AS src_asn_cnt"
_LABEL = "'unlabeled' AS source_label"
_EMPTY = "0::BIGINT AS src_ip_cnt, 0::BIGINT AS dest_ip_cnt, 0::BIGINT AS pkt_cnt, 0::BIGINT AS byte_cnt, 0::BIGINT AS src_asn_cnt"


def _metric_sql(name: str, value: str, where: str = "true", source: str = "tagged", seconds: int = 60) -> str:
    return f"SELECT ts_sec - ts_sec % {seconds} AS bin_timestamp, {_LABEL}, {name} AS metric_name, ({value})::VARCHAR AS metric_value, {_COUNTS} FROM {source} WHERE {where} GROUP BY ALL"


def _report(spark: SparkSession, sf_dir: str, *limit: str, **how) -> DataFrame:
    asked = [p for p in ("maxmind", "netacq") if any(metric.startswith(p) for metric in limit)]  # a lookup that nothing reads is done all the same
    return report.report(tagged(spark, sf_dir, *asked, "pfx2as"), limit=set(limit), **how).select(*report.OUTPUT)


@query(f"{TAGGED} {_metric_sql(repr('overall'), repr(''))}")
def report_combined(spark, sf_dir):
    return _report(spark, sf_dir, "combined")


@query(f"""{TAGGED}, r AS ({_metric_sql("'traffic.protocol'", 'protocol')}) SELECT * FROM r UNION ALL SELECT b.bin_timestamp, {_LABEL}, 'traffic.protocol', v::VARCHAR, {_EMPTY}
FROM (SELECT DISTINCT bin_timestamp FROM r) b CROSS JOIN (SELECT unnest(range(256)) AS v) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.bin_timestamp = b.bin_timestamp AND r.metric_value = v::VARCHAR)""")
def report_protocol(spark, sf_dir):
    rows = report.report(tagged(spark, sf_dir, "pfx2as"), limit={"protocol"})
    return report.zero_filled(rows, report.expected(spark, ["protocol"])).select(*report.OUTPUT)


@query(f"{TAGGED} {_metric_sql(repr('traffic.icmp'), "'type.' || src_port || '.code.' || dst_port", 'protocol = 1')}")
def report_icmp(spark, sf_dir):
    return _report(spark, sf_dir, "icmp")


def _port_query(protocol: str, number: int) -> None:
    def run(spark, sf_dir):
        return _report(spark, sf_dir, f"{protocol}_src_port", f"{protocol}_dst_port", ports={f"{protocol}_src_port": "0-1023,5060"}, seconds=600)

    src = _metric_sql(f"'traffic.port.{protocol}.src_port'", "src_port", f"protocol = {number} AND (src_port < 1024 OR src_port = 5060)", seconds=600)
    query(f"{TAGGED} {src} UNION ALL {_metric_sql(f"'traffic.port.{protocol}.dst_port'", 'dst_port', f'protocol = {number}', seconds=600)}", name=f"report_{protocol}_ports")(run)


_port_query("tcp", 6)
_port_query("udp", 17)


@query(f"{TAGGED} " + " UNION ALL ".join(_metric_sql("'filter-criteria'", f"'{label}'", f"f{filters.NAMES.index(n)}", seconds=600) for n, label in report.FILTER_LABELS.items()))
def report_filters(spark, sf_dir):
    return _report(spark, sf_dir, "filter", seconds=600)


@query(f"{TAGGED} {_metric_sql("'geo.maxmind'", 'continent', _HAS)} UNION ALL {_metric_sql("'geo.maxmind.' || continent", 'country', _HAS)}")
def report_geo(spark, sf_dir):
    return _report(spark, sf_dir, "maxmind_continent", "maxmind_country")


_POLY = "SELECT *, unnest([n_nationkey + 1, 16777216 + 2 * n_nationkey + 1]) AS polygon FROM tagged WHERE src_ip >> 27 < 25"
@query(f"""{TAGGED}, poly AS ({_POLY}) {_metric_sql("'geo.netacuity'", 'continent', _HAS)} UNION ALL {_metric_sql("'geo.netacuity.' || continent", 'country', _HAS)}
UNION ALL {_metric_sql("'geo.netacuity.EU.' || n_nationkey", 'region', f'{_HAS} AND region > 0')}
UNION ALL {_metric_sql("'geo.netacuity.' || CASE WHEN polygon < 16777216 THEN 'EU' ELSE 'unknown' END", "CASE WHEN polygon < 16777216 THEN 'p' || polygon ELSE polygon::VARCHAR END", source='poly')}""")
def report_netacq(spark, sf_dir):
    rows = report.report(tagged(spark, sf_dir, "netacq", "pfx2as"), limit={"netacq_continent", "netacq_country", "netacq_region", "netacq_polygon"})
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = nations.selectExpr("n_nationkey + 1 AS id", "concat('EU.', n_nationkey, '.', n_nationkey + 1) AS label")
    polygons = nations.selectExpr("n_nationkey + 1 AS id", "concat('EU.p', n_nationkey + 1) AS label")
    return report.labelled(rows, regions, polygons).select(*report.OUTPUT)


@query(f"{TAGGED} {_metric_sql(repr('routing.asn'), 'asn', 'asn IS NOT NULL')}")
def report_asn(spark, sf_dir):
    return _report(spark, sf_dir, "asn")


@query(f"""{TAGGED} SELECT minute AS bin_timestamp, {_LABEL}, 'traffic.protocol' AS metric_name, protocol::VARCHAR AS metric_value, count(DISTINCT src_ip >> 4) AS src_ip_cnt,
count(DISTINCT dst_ip >> 16) AS dest_ip_cnt, count(*) AS pkt_cnt, sum(ip_len)::BIGINT AS byte_cnt, count(DISTINCT asn) AS src_asn_cnt FROM tagged GROUP BY ALL""")
def report_prefixes(spark, sf_dir):
    return _report(spark, sf_dir, "protocol", src_method="prefixagg", src_bits=28, dst_method="prefixagg", dst_bits=16)


@query(f"""{TAGGED} SELECT minute AS bin_timestamp, {_LABEL}, 'overall' AS metric_name, '' AS metric_value, count(DISTINCT CASE WHEN (src_ip & 3) = (minute // 60) % 4 THEN src_ip END) AS src_ip_cnt,
count(DISTINCT dst_ip) AS dest_ip_cnt, count(*) AS pkt_cnt, sum(ip_len)::BIGINT AS byte_cnt, count(DISTINCT asn) AS src_asn_cnt FROM tagged GROUP BY ALL""")
def report_sampled(spark, sf_dir):
    return _report(spark, sf_dir, "combined", src_method="sample", src_bits=30)


_ASN_ROWS = _metric_sql(repr("routing.asn"), "asn", "asn IS NOT NULL", seconds=600)
@query(f"""{TAGGED}, r AS ({_metric_sql(repr('overall'), repr(''), seconds=600)} UNION ALL {_ASN_ROWS}), k AS (SELECT *, 'unlabeled.' || metric_name || CASE WHEN metric_value = '' THEN '' ELSE '.' || metric_value END || '.' AS base FROM r)
SELECT base || 'uniq_src_ip' AS key, src_ip_cnt AS value, bin_timestamp AS ts FROM k UNION ALL SELECT base || 'uniq_dst_ip', dest_ip_cnt, bin_timestamp FROM k
UNION ALL SELECT base || 'uniq_src_asn', src_asn_cnt, bin_timestamp FROM k WHERE metric_name <> 'routing.asn' UNION ALL SELECT base || 'pkt_cnt', pkt_cnt, bin_timestamp FROM k
UNION ALL SELECT base || 'ip_len', byte_cnt, bin_timestamp FROM k""")
def report_time_series(spark, sf_dir):
    return report.time_series(report.report(tagged(spark, sf_dir, "pfx2as"), limit={"combined", "asn"}, seconds=600))


@query(f"""{TAGGED}, r AS ({_metric_sql(repr('overall'), repr(''), seconds=420)}), e AS (SELECT min(ts_sec) AS a, max(ts_sec) AS b FROM tagged)
SELECT r.* FROM r, e WHERE a <= bin_timestamp AND b >= bin_timestamp + 418""")
def report_complete(spark, sf_dir):
    packets = tagged(spark, sf_dir, "pfx2as")
    return report.complete_only(report.report(packets, 420, {"combined"}), intervals.intervals(packets, 420)).select(*report.OUTPUT)


# ---------------------------------------------------------------- attacks

_VECTORS = f""", v AS (SELECT *, ts_sec - ts_sec % 600 AS interval_ts, ts_sec - ts_sec % 10 AS bucket, CASE WHEN protocol = 6 THEN 6 WHEN quoted = 1 THEN inner_protocol ELSE 1 END AS target_protocol,
CASE WHEN protocol = 6 THEN src_ip WHEN quoted = 1 THEN inner_dst_ip ELSE src_ip END AS target_ip, CASE WHEN protocol = 6 THEN dst_port WHEN quoted = 1 THEN inner_sport ELSE dst_port * 256 END AS attack_port,
CASE WHEN protocol = 6 THEN src_port WHEN quoted = 1 THEN inner_dport ELSE src_port * 256 END AS target_port, CASE WHEN quoted = 1 AND inner_src_ip <> dst_ip THEN 1 ELSE 0 END AS mismatch FROM tagged
WHERE (protocol = 6 AND ((tcp_flags & 18) = 18 OR (tcp_flags & 4) <> 0)) OR (protocol = 1 AND src_port IN (0, 3, 4, 5, 11, 12, 14, 16, 18))),
w AS (SELECT * FROM v WHERE target_protocol IN (1, 6, 17)),
i AS (SELECT DISTINCT target_protocol, target_ip, interval_ts FROM w),
j AS (SELECT *, interval_ts - 600 * row_number() OVER (PARTITION BY target_protocol, target_ip ORDER BY interval_ts) AS island FROM i),
x AS (SELECT w.*, island FROM w JOIN j USING (target_protocol, target_ip, interval_ts)),
b AS (SELECT target_protocol, target_ip, island, interval_ts, bucket, count(*) AS n FROM x GROUP BY ALL),
r AS (SELECT target_protocol, target_ip, island, interval_ts, max(rate) AS ppm FROM (SELECT *, sum(n) OVER (PARTITION BY target_protocol, target_ip, island ORDER BY bucket RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS rate FROM b) GROUP BY ALL)"""
_FRAME = """'02020202020202020202020208004500' || printf('%04x0000%04x%02x%02x0000', ip_len, ip_off, ttl, protocol) || printf('%08x%08x', src_ip, dst_ip)
|| CASE WHEN protocol = 6 THEN printf('%04x%04x0000000000000000', src_port, dst_port) || printf('%02x%02x%04x00000000', tcp_doff * 16, tcp_flags, tcp_window) || repeat('00', 4 * tcp_doff - 20)
ELSE printf('%02x%02x000000000000', src_port, dst_port) || CASE WHEN inner_dst_ip IS NULL THEN '' ELSE '450000000000000000' || printf('%02x0000%08x%08x', inner_protocol, inner_src_ip, inner_dst_ip) || printf('%04x%04x', inner_sport, inner_dport) END END"""
_FIRST = "(ts_sec, ts_usec, seq, caplen, attack_port, target_port, continent, country)"
_ATTACKS = f"""{_VECTORS}, a AS (SELECT j.interval_ts AS bin_timestamp, j.target_protocol, j.target_ip, count(DISTINCT x.dst_ip >> 16) AS attacker_slash16_cnt, count(DISTINCT attack_port) AS attack_port_cnt,
count(DISTINCT target_port) AS target_port_cnt, count(*) AS packet_cnt, sum(mismatch)::BIGINT AS icmp_mismatches, sum(ip_len)::BIGINT AS byte_cnt,
min(ts_sec * 1000000 + ts_usec) AS start, max(ts_sec * 1000000 + ts_usec) AS latest, arg_min(attack_port, (ts_sec, ts_usec, seq, caplen, attack_port, target_port)) AS first_attack_port,
arg_min(target_port, (ts_sec, ts_usec, seq, caplen, attack_port, target_port)) AS first_target_port, arg_min(caplen, (ts_sec, ts_usec, seq, caplen)) AS initial_packet_len, arg_min({_FRAME}, {_FIRST[:-1]}, {_FRAME})) AS initial_packet,
arg_min(continent, (ts_sec, ts_usec, seq, caplen, attack_port, target_port, continent, country)) AS maxmind_continent, arg_min(country, (ts_sec, ts_usec, seq, caplen, attack_port, target_port, continent, country)) AS maxmind_country
FROM j JOIN x ON x.target_protocol = j.target_protocol AND x.target_ip = j.target_ip AND x.island = j.island AND x.interval_ts <= j.interval_ts GROUP BY ALL),
m AS (SELECT r.*, max(ppm) OVER (PARTITION BY target_protocol, target_ip, island ORDER BY interval_ts) AS max_ppm_interval FROM r)"""
_ATTACK_ROWS = """SELECT bin_timestamp, initial_packet_len, a.target_ip, a.target_protocol, attacker_slash16_cnt, attack_port_cnt, target_port_cnt, packet_cnt, icmp_mismatches, byte_cnt,
max_ppm_interval::BIGINT AS max_ppm_interval, start // 1000000 AS start_time_sec, start % 1000000 AS start_time_usec, latest // 1000000 AS latest_time_sec, latest % 1000000 AS latest_time_usec,
first_attack_port, first_target_port, maxmind_continent, maxmind_country, initial_packet FROM a JOIN m ON a.bin_timestamp = m.interval_ts AND a.target_protocol = m.target_protocol AND a.target_ip = m.target_ip"""


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged packets with frames; what was captured of them counts as without."""
    packets = with_frames(synthetic_packets(spark, sf_dir)).withColumn("caplen", F.col("ip_len") + 14)
    return tagging.tag(packets, maxmind=providers(spark, sf_dir)["maxmind"])


def _spelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("initial_packet", F.lower(F.hex("initial_packet")))


@query(f"{TAGGED}{_ATTACKS} {_ATTACK_ROWS}")
def dos_vectors(spark, sf_dir):
    return _spelled(dos.attack_rows(_framed(spark, sf_dir), seconds=600))


@query(f"{TAGGED}{_VECTORS} SELECT target_protocol, target_ip, interval_ts, ppm::BIGINT AS interval_ppm FROM r")
def dos_rates(spark, sf_dir):
    v = dos.vectors(synthetic_packets(spark, sf_dir)).withColumn("interval_ts", intervals.aligned(F.col("ts_sec"), 600))
    return dos.rates(v, seconds=600).drop("episode")


@query(f"{TAGGED}{_ATTACKS} {_ATTACK_ROWS} WHERE max_ppm_interval >= 4 AND packet_cnt >= 10 AND latest - start >= 60000000")
def dos_attacks(spark, sf_dir):
    return _spelled(dos.attacks(_framed(spark, sf_dir), dos.Thresholds(packets=10, rate=4), seconds=600))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3600 AS h FROM events), d AS (SELECT user_id, h, count(*) AS n FROM e GROUP BY 1, 2),
i AS (SELECT *, h - 3600 * row_number() OVER (PARTITION BY user_id ORDER BY h) AS island FROM d)
SELECT user_id, min(h) AS first_hour, max(h) AS last_hour, sum(n)::BIGINT AS events FROM i GROUP BY user_id, island""")
def episodes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).alias("target_protocol"), F.col("user_id").alias("target_ip"), intervals.aligned(F.unix_timestamp("ts"), 3600).alias("interval_ts"))
    by_hour = dos._with_episodes(e.groupBy("target_protocol", "target_ip", "interval_ts").agg(F.count("*").alias("n")), 3600)
    return by_hour.groupBy(F.col("target_ip").alias("user_id"), F.col("episode").alias("first_hour")).agg(F.max("interval_ts").alias("last_hour"), F.sum("n").alias("events"))


# ---------------------------------------------------------------- archive


@query(f"""{PACKETS}, two AS (SELECT ts_sec, ts_usec, seq, 0 AS input_idx FROM packets UNION ALL SELECT ts_sec + 30, ts_usec, seq, 1 FROM packets)
SELECT *, row_number() OVER (PARTITION BY ts_sec - ts_sec % 60 ORDER BY ts_sec, ts_usec, input_idx, seq) AS place FROM two""")
def archive_order(spark, sf_dir):
    packets = synthetic_packets(spark, sf_dir).select("ts_sec", "ts_usec", "seq")
    merged = archive.chronological(packets, packets.withColumn("ts_sec", F.col("ts_sec") + 30)).withColumn("minute", intervals.aligned(F.col("ts_sec")))
    return placed(merged, ["minute"], [F.col("ts_sec"), F.floor(F.col("ts_usec") / 1000)], ["ts_usec", "input_idx", "seq"]).drop("minute")


@query("""SELECT epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 AS interval_ts, sum(user_id)::BIGINT AS accepted, sum(CASE WHEN event_type <> 'click' THEN event_id END)::BIGINT AS dropped FROM events GROUP BY 1""")
def archive_counters(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        intervals.aligned(F.unix_timestamp("ts"), 86400).alias("interval_ts"), F.col("user_id").alias("accepted"), F.when(F.col("event_type") != "click", F.col("event_id")).alias("dropped")
    )
    return archive.merged_counters(e, ["accepted", "dropped"])


@query(f"{PACKETS} SELECT {_DOT.format('src_ip')} AS source, (src_ip >> 8) * 256 AS net, count(*) AS packet_cnt FROM packets GROUP BY 1, 2")
def addresses(spark, sf_dir):
    return synthetic_packets(spark, sf_dir).groupBy(dotted(F.col("src_ip")).alias("source"), network(F.col("src_ip"), 24).alias("net")).agg(F.count("*").alias("packet_cnt"))


from . import files_queries  # noqa: E402,F401  it adds its queries to those above
