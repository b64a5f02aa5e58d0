"""Queries that write files and read them back, run configurations, and stream; with the same in DuckDB SQL.

Each writes to a folder of its own under ``spark.checkpoint.dir``; only local
sessions without that setting get a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import archive, dos, flows, intervals, report, tagging
from .plans import pipeline
from .queries import _ATTACK_ROWS, _ATTACKS, _CODE, _CONT, _DOT, _FLOWS, _HAS, _LABEL, _COUNTS, _EMPTY, _flows, FILTERED, PACKETS, REGIONS, TAGGED, providers, query, tagged
from .sinks import text as text_sink
from .sources import attack_text, dimensions, ocf, pcap
from .sources.packets import SCHEMA, synthetic_packets, with_frames
from .streaming import packets as streams

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            _OWN[app] = tempfile.mkdtemp(prefix="netlume-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        at = _OWN[app]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- captures

_SUMS = {
    "usecs": "ts_usec", "src_ips": "src_ip", "dst_ips": "dst_ip", "ttls": "ttl", "lengths": "ip_len", "offsets": "ip_off", "wirelens": "wirelen", "ethertypes": "ethertype",
    "src_ports": "CASE WHEN protocol IN (1, 6, 17) THEN src_port END", "dst_ports": "CASE WHEN protocol IN (1, 6, 17) THEN dst_port END", "flags": "CASE WHEN protocol = 6 THEN tcp_flags END",
    "windows": "CASE WHEN protocol = 6 THEN tcp_window END", "data_offsets": "CASE WHEN protocol = 6 THEN tcp_doff END", "udp_lens": "CASE WHEN protocol = 17 THEN udp_len END",
    "payloads": "CASE WHEN protocol = 17 THEN payload_len END", "inner_dst_ips": "inner_dst_ip", "inner_protocols": "inner_protocol", "inner_ports": "CASE WHEN ip_len >= 52 THEN inner_sport END",
}
_READ = "SELECT ts_sec - ts_sec % 600 AS interval_ts, protocol, count(*) AS packet_cnt, " + ", ".join(f"sum({sql})::BIGINT AS {name}" for name, sql in _SUMS.items()) + " FROM {} GROUP BY 1, 2"


def _read_back(packets: DataFrame) -> DataFrame:
    return packets.groupBy(intervals.aligned(F.col("ts_sec"), 600).alias("interval_ts"), "protocol").agg(F.count("*").alias("packet_cnt"), *(F.sum(F.expr(sql)).cast("long").alias(name) for name, sql in _SUMS.items()))


def _captured(spark: SparkSession, packets: DataFrame, **options) -> str:
    pcap.register(spark)
    at = folder(spark, "captures")
    packets.write.format("pcap").options(**options).mode("append").save(at)
    return at


@query(f"{PACKETS} {_READ.format('packets')}")
def source_pcap(spark, sf_dir):
    return _read_back(spark.read.format("pcap").load(_captured(spark, with_frames(synthetic_packets(spark, sf_dir)))))


@query(f"{PACKETS} {_READ.format('(SELECT * FROM packets UNION ALL SELECT * FROM packets WHERE protocol = 6)')}")
def source_packed_and_many(spark, sf_dir):
    """Two folders, one of packed files, in one read."""
    packets = with_frames(synthetic_packets(spark, sf_dir))
    paths = [_captured(spark, packets, compression="gz"), _captured(spark, packets.where("protocol = 6"))]
    return _read_back(spark.read.format("pcap").option("paths", "\n".join(paths)).load())


@query(f"{PACKETS} SELECT protocol, count(*) AS packet_cnt, min(ts_sec) AS low, max(ts_sec) AS high FROM packets WHERE ts_sec >= 1704067800 AND ts_sec < 1704069000 GROUP BY 1")
def source_pushdown(spark, sf_dir):
    """Packets as Parquet: the time and the columns that are used reach the scan (tests/test_files.py looks at its plan)."""
    at = folder(spark, "packets")
    synthetic_packets(spark, sf_dir).write.parquet(at)
    return spark.read.parquet(at).where("ts_sec >= 1704067800 and ts_sec < 1704069000").groupBy("protocol").agg(F.count("*").alias("packet_cnt"), F.min("ts_sec").alias("low"), F.max("ts_sec").alias("high"))


@query(f"{PACKETS} SELECT protocol, count(*) AS packet_cnt, sum(length)::BIGINT AS frame_bytes FROM (SELECT protocol, CASE WHEN protocol = 6 THEN 34 + 4 * tcp_doff WHEN protocol = 17 THEN 42 + payload_len "
       "WHEN protocol = 1 THEN 42 + CASE WHEN quoted = 1 THEN 24 ELSE 0 END ELSE 34 END AS length FROM packets WHERE m < 8) GROUP BY 1")
def sink_pcap_overwrite(spark, sf_dir):
    """The second of two overwrites is what is there."""
    packets = with_frames(synthetic_packets(spark, sf_dir))
    at = _captured(spark, packets.limit(100))
    packets.where("seq % 10 < 8").write.format("pcap").mode("overwrite").save(at)
    return spark.read.format("pcap").load(at).groupBy("protocol").agg(F.count("*").alias("packet_cnt"), F.sum("caplen").alias("frame_bytes"))


# ---------------------------------------------------------------- containers


def _stored(spark: SparkSession, rows: DataFrame, **options) -> str:
    ocf.register(spark)
    at = folder(spark, "containers")
    for _ in range(2):  # the second one replaces the first
        rows.write.format("ocf").options(**options).mode("overwrite").save(at)
    return at


@query(f"{TAGGED}{_FLOWS} SELECT * FROM flows")
def sink_ocf(spark, sf_dir):
    return ocf.read_flows(spark, _stored(spark, _flows(spark, sf_dir), done="true"))


@query(f"{TAGGED}{_FLOWS} SELECT protocol, count(*) AS flow_cnt, sum(packet_cnt)::BIGINT AS packet_cnt, sum(src_ip)::BIGINT AS src_ips, min(maxmind_country) AS least FROM flows GROUP BY 1")
def sink_ocf_snappy(spark, sf_dir):
    rows = ocf.read_flows(spark, _stored(spark, _flows(spark, sf_dir), codec="snappy"))
    return rows.groupBy("protocol").agg(F.count("*").alias("flow_cnt"), F.sum("packet_cnt").alias("packet_cnt"), F.sum("src_ip").alias("src_ips"), F.min("maxmind_country").alias("least"))


# ---------------------------------------------------------------- text and messages


@query(f"""{TAGGED}{_FLOWS}, n AS (SELECT time, count(*) AS n, row_number() OVER (ORDER BY time) - 1 AS k FROM flows GROUP BY 1)
SELECT '# TELESCOPE_INTERVAL_START ' || k || ' ' || time AS value FROM n UNION ALL SELECT 'START flowtuple_backscatter 0' FROM n UNION ALL SELECT 'END flowtuple_backscatter' FROM n
UNION ALL SELECT 'START flowtuple_icmpreq 0' FROM n UNION ALL SELECT 'END flowtuple_icmpreq' FROM n UNION ALL SELECT 'START flowtuple_other ' || n FROM n UNION ALL SELECT 'END flowtuple_other' FROM n
UNION ALL SELECT '# TELESCOPE_INTERVAL_END ' || k || ' ' || time FROM n
UNION ALL SELECT {_DOT.format('src_ip')} || '|' || {_DOT.format('dst_ip')} || '|' || src_port || '|' || dst_port || '|' || protocol || '|' || ttl || '|0x' || printf('%02x', tcp_flags) || '|' || ip_len || ',' || packet_cnt FROM flows""")
def sink_flow_text(spark, sf_dir):
    at = folder(spark, "text")
    text_sink.flow_text(_flows(spark, sf_dir)).write.text(at)
    return spark.read.text(at)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.time_series(report.report(tagged(spark, sf_dir, "pfx2as"), limit={"protocol"}, seconds=600))


_POINTS = f"""r AS (SELECT ts_sec - ts_sec % 600 AS ts, 'unlabeled.traffic.protocol.' || protocol || '.' AS base, {_COUNTS} FROM tagged GROUP BY ALL), p AS (SELECT base || 'uniq_src_ip' AS key, src_ip_cnt AS value, ts FROM r
UNION ALL SELECT base || 'uniq_dst_ip', dest_ip_cnt, ts FROM r UNION ALL SELECT base || 'uniq_src_asn', src_asn_cnt, ts FROM r UNION ALL SELECT base || 'pkt_cnt', pkt_cnt, ts FROM r UNION ALL SELECT base || 'ip_len', byte_cnt, ts FROM r)"""


@query(f"{TAGGED}, {_POINTS} SELECT key || ' ' || value || ' ' || ts AS value FROM p")
def sink_time_series(spark, sf_dir):
    at = folder(spark, "series")
    text_sink.time_series_lines(_points(spark, sf_dir)).write.text(at)
    return spark.read.text(at)


@query(f"{TAGGED}, {_POINTS} SELECT 'telescope.timeseries' AS topic, ts::VARCHAR AS key, key || ' ' || value || ' ' || ts AS line, true AS small FROM p")
def sink_messages(spark, sf_dir):
    """The lines of all messages, none of which has many more lines than asked for."""
    lines = F.split("value", "\n")
    return text_sink.time_series_messages(_points(spark, sf_dir), "telescope", 50).select("topic", "key", F.explode(lines).alias("line"), (F.size(lines) <= 100).alias("small"))


@query("""SELECT 'time=' || d || ' accepted=' || sum(user_id)::BIGINT || coalesce(' dropped=' || sum(CASE WHEN event_type <> 'click' THEN event_id END)::BIGINT, '') AS value
FROM (SELECT *, epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 AS d FROM events) GROUP BY d""")
def sink_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        intervals.aligned(F.unix_timestamp("ts"), 86400).alias("interval_ts"), F.col("user_id").alias("accepted"), F.when(F.col("event_type") != "click", F.col("event_id")).alias("dropped")
    )
    return text_sink.statistics_lines(archive.merged_counters(e, ["accepted", "dropped"]))


@query("""SELECT n_nationkey, '/x/' || n_name || '-' || strftime(make_timestamp((1704067200 + n_nationkey * 86461)::BIGINT * 1000000), '%y%m%d-%H%M%S') || '-' || (1704067200 + n_nationkey * 86461) || '.dos.avro--' || n_regionkey AS name FROM nation""")
def sink_names(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows
    named = [(r["n_nationkey"], text_sink.file_name("/x/%N-%y%m%d-%H%M%S-%s.%P", "dos", r["n_name"], 1704067200 + r["n_nationkey"] * 86461, r["n_regionkey"], "avro")) for r in nations]
    return spark.createDataFrame(named, "n_nationkey int, name string").withColumn("n_nationkey", F.col("n_nationkey").cast(spark.read.parquet(f"{sf_dir}/nation.parquet").schema["n_nationkey"].dataType))


# ---------------------------------------------------------------- dimensions and old text


@query(f"""{TAGGED} SELECT continent, country, CASE WHEN {_HAS} THEN region ELSE 0 END AS region, asn AS prefix_asn, count(*) AS packet_cnt FROM tagged GROUP BY ALL""")
def source_dimensions(spark, sf_dir):
    """Prefix tables and places from files, as lines and CSV."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("inner", F.explode(F.array(F.lit(0), F.lit(1))))
    k, inner = F.col("n_nationkey").cast("long"), F.col("inner")
    network = F.concat((k * 8 + inner * 3).cast("string"), F.lit(".0.0.0"))
    bits, ident = F.when(inner == 1, 8).otherwise(5), k * 2 + inner + 1
    continent = F.element_at(F.array(*map(F.lit, REGIONS)), F.col("n_regionkey").cast("int") + 1)
    at = folder(spark, "dimensions")
    nations.select(F.concat_ws("\t", network, bits, F.when(k % 5 == 0, F.concat_ws("_", k + 64512, F.lit(65000))).otherwise((k + 64512).cast("string")))).write.text(f"{at}/as")
    nations.select(F.concat_ws("/", network, bits).alias("network"), ident.alias("id")).write.csv(f"{at}/blocks", header=True)
    nations.select(ident.alias("id"), continent.alias("continent"), F.substring("n_name", inner + 1, F.lit(2)).alias("country"), ((k + 1) * inner).alias("region")).write.csv(f"{at}/places", header=True)
    own = {"maxmind": dimensions.maxmind(spark, f"{at}/blocks", f"{at}/places"), "netacq": dimensions.netacuity(spark, f"{at}/blocks", f"{at}/places"), "pfx2as": dimensions.pfx2as(spark, f"{at}/as")}
    place = [F.coalesce(f"maxmind.{n}", F.lit("??")).alias(n) for n in ("continent", "country")]
    return tagging.tag(synthetic_packets(spark, sf_dir), **own, filterbits=False).groupBy(*place, F.coalesce("netacq.region", F.lit(0)).alias("region"), "prefix_asn").agg(F.count("*").alias("packet_cnt"))


@query("SELECT n_nationkey AS id, 'EU.' || n_name AS label FROM nation")
def source_labels(spark, sf_dir):
    at = folder(spark, "labels")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("EU."), "n_name").alias("label")).write.csv(at, header=True)
    return dimensions.labels(spark, at)


@query("SELECT '10.0.0.' || n_nationkey AS target_ip, n_nationkey * 3 AS packets, n_nationkey + 0.5 AS start, 7 + n_regionkey AS interval_number, 1200 + 60 * n_regionkey AS interval_ts FROM nation WHERE n_nationkey <> 13")
def source_attack_text(spark, sf_dir):
    """Old attack text: one file, with the bodies of packets in it."""
    at, lines = folder(spark, "attacks"), []
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    for region in range(5):
        rows = [int(r["n_nationkey"]) for r in nations if r["n_regionkey"] == region and r["n_nationkey"] != 13]
        lines += [f"# X_INTERVAL_START {7 + region} {1200 + 60 * region}", str(len(rows))]
        for k in rows:
            lines += [f"10.0.0.{k},2,1,3,4,{k * 3},6,7,8,9,{k + 0.5},2.5", "START PACKET", "10.0.0.99,anything", "END PACKET"]
        lines.append(f"# X_INTERVAL_END {7 + region} {1260 + 60 * region}")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(at)
    return attack_text.typed(attack_text.read_attacks(spark, at)).select("target_ip", F.col("packets").cast("long").alias("packets"), F.col("start").cast("double").alias("start"), F.col("interval_number").cast("long").alias("interval_number"), F.col("interval_ts").cast("long").alias("interval_ts"))


# ---------------------------------------------------------------- runs

_RUN = """
interval: {interval}
startboundaryts: {start}
endboundaryts: 1704070000
basicfilter: "{capture}"
{remove}: yes
plugins:
  - {plugin}
"""


def _run(spark: SparkSession, sf_dir: str, plugin: str, interval: int, start: int, capture: str, remove: str, **more) -> DataFrame:
    run = pipeline.config(_RUN.format(interval=interval, start=start, capture=capture, remove=remove, plugin=plugin), providers=providers(spark, sf_dir), **more)
    return next(iter(pipeline.results(spark, run, synthetic_packets(spark, sf_dir)).values()))


def _cut(where: str, removed: str, interval: int) -> str:
    """Packets that are captured, and those of them that aren't removed, with the interval that each is in."""
    return f", cut AS (SELECT * FROM tagged WHERE ts_sec >= 1704067211 AND ts_sec < 1704070000 AND {where}), ends AS (SELECT min(ts_sec) AS a, max(ts_sec) AS b FROM cut), run AS (SELECT * REPLACE (greatest(ts_sec - ts_sec % {interval}, a) AS minute) FROM cut, ends WHERE NOT {removed})"


_EVERY = """SELECT 'overall' AS metric_name, '' AS metric_value UNION ALL SELECT 'traffic.protocol', unnest(range(256))::VARCHAR UNION ALL SELECT 'geo.netacuity', unnest(['??', 'AF', 'AN', 'AS', 'EU', 'NA', 'OC', 'SA'])
UNION ALL SELECT 'geo.netacuity.' || CASE n_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'NA' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' ELSE 'OC' END, substr(n_name, 1, 2) FROM nation"""


@query(f"""{TAGGED}{_cut('ttl < 250', 'f1', 420)}, r AS (SELECT minute AS bin_timestamp, 'tele' AS source_label, 'overall' AS metric_name, '' AS metric_value, {_COUNTS} FROM run GROUP BY ALL
UNION ALL SELECT minute, 'tele', 'traffic.protocol', protocol::VARCHAR, {_COUNTS} FROM run GROUP BY ALL
UNION ALL SELECT minute, 'tele', 'geo.netacuity', continent, {_COUNTS} FROM run WHERE {_HAS} GROUP BY ALL
UNION ALL SELECT minute, 'tele', 'geo.netacuity.' || continent, country, {_COUNTS} FROM run WHERE {_HAS} GROUP BY ALL
UNION ALL SELECT minute, 'tele', 'geo.netacuity.EU.' || n_nationkey, region::VARCHAR, {_COUNTS} FROM run WHERE {_HAS} AND region > 0 GROUP BY ALL
UNION ALL SELECT minute, 'tele', 'geo.netacuity.unknown', polygon::VARCHAR, {_COUNTS} FROM (SELECT *, unnest([n_nationkey + 1, 16777216 + 2 * n_nationkey + 1]) AS polygon FROM run WHERE {_HAS}) GROUP BY ALL),
c AS (SELECT r.* FROM r, ends WHERE a <= bin_timestamp - bin_timestamp % 420 AND b >= bin_timestamp - bin_timestamp % 420 + 418)
SELECT * FROM c UNION ALL SELECT d.bin_timestamp, 'tele', e.metric_name, e.metric_value, {_EMPTY} FROM (SELECT DISTINCT bin_timestamp FROM c) d CROSS JOIN (SELECT DISTINCT * FROM ({_EVERY})) e
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.bin_timestamp = d.bin_timestamp AND c.metric_name = e.metric_name AND c.metric_value = e.metric_value)""")
def run_report(spark, sf_dir):
    """A report from a configuration: intervals from all captured packets, removal, labels, and rows of zeros."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    continent = F.element_at(F.array(*map(F.lit, REGIONS)), F.col("n_regionkey").cast("int") + 1)
    labels = {
        "regions": nations.selectExpr("n_nationkey + 1 AS id", "concat('EU.', n_nationkey, '.', n_nationkey + 1) AS label"), "polygons": nations.selectExpr("-1 AS id", "n_name AS label").limit(0),
        "countries": nations.select(continent.alias("continent"), F.substring("n_name", 1, 2).alias("country")).distinct(),
    }
    return _run(spark, sf_dir, "report: {output_row_label: tele, limitmetrics: [basic, netacq]}", 420, 1704067211, "ip[8] < 250", "removeerratic", labels=labels)


@query(f"{TAGGED}{_cut('protocol IN (6, 17)', 'f0', 60)}{_FLOWS.replace('FROM tagged)', 'FROM run)')} SELECT * FROM flows")
def run_flows(spark, sf_dir):
    """Flows from a configuration: the first interval begins with the first captured packet, also where that is removed."""
    return _run(spark, sf_dir, "flowtuple", 60, 1704067211, "tcp or udp", "removespoofed")


@query(f"{FILTERED}, cut AS (SELECT * FROM filtered WHERE ts_sec >= 1704067211 AND ts_sec < 1704070000 AND protocol <> 47) SELECT ts_sec - ts_sec % 1200 AS rotate_ts, count(*) AS packet_cnt, sum(seq)::BIGINT AS numbers FROM cut WHERE NOT f0 GROUP BY 1")
def run_archive(spark, sf_dir):
    """Packets written by a run to folders that rotate, and read back."""
    rows = _run(spark, sf_dir, "archive", 600, 1704067211, "not proto 47", "removespoofed", rotate=2)
    run = pipeline.config({"interval": 600, "rotatefreq": 2}, template=f"{folder(spark, 'archive')}/%P")
    return spark.read.parquet(pipeline.write(rows, run, "archive", "ts_sec")).groupBy(F.col("rotate_ts").cast("long").alias("rotate_ts")).agg(F.count("*").alias("packet_cnt"), F.sum("seq").alias("numbers"))


@query(f"{TAGGED} SELECT minute AS bin_timestamp, {_LABEL}, 'geo.netacuity' AS metric_name, continent AS metric_value, {_COUNTS} FROM tagged WHERE {_HAS} GROUP BY ALL "
       f"UNION ALL SELECT minute, {_LABEL}, 'geo.netacuity.' || continent, country, {_COUNTS} FROM tagged WHERE {_HAS} GROUP BY ALL")
def report_geo_lite(spark, sf_dir):
    rows = report.report(tagged(spark, sf_dir, "netacq", "pfx2as"), limit={"netacq_continent", "netacq_country", "netacq_region", "netacq_polygon"}, geo_lite=True)
    return rows.select(*report.OUTPUT)


@query(f"{PACKETS} SELECT count(*) AS packet_cnt, count(*) AS distinct_cnt, true AS dense FROM packets")
def tag_numbering(spark, sf_dir):
    """Numbers of a tagger count up from 1 without gaps."""
    own = tagging.numbered(synthetic_packets(spark, sf_dir)).groupBy("tagger_id").agg(F.count("*").alias("n"), F.countDistinct("seqno").alias("d"), F.min("seqno").alias("low"), F.max("seqno").alias("high"))
    return own.agg(F.sum("n").alias("packet_cnt"), F.sum("d").alias("distinct_cnt"), F.every((F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("dense"))


# ---------------------------------------------------------------- streams

_END = 1704153600
"""The packet that ends all intervals is in this second."""


def _played(spark: SparkSession, at: str, packets: DataFrame, number: Column, batches: int, start, last: DataFrame | None = None) -> None:
    """Run a stream of ``packets`` that come in batches by ``number``, each as a whole once the one before is done; ``last`` comes at the end.

    All batches are written in one pass by all tasks, to as many files as
    there are, and moved to where the stream looks; ``start`` starts it.
    """
    writers = "spark.sql.maxConcurrentOutputFileWriters"  # without a sort by batch
    before = spark.conf.get(writers)
    spark.conf.set(writers, batches)
    try:
        packets.select(*SCHEMA.names, number.alias("batch")).write.partitionBy("batch").parquet(f"{at}/made")
    finally:
        spark.conf.set(writers, before)
    if last is not None:
        last.coalesce(1).write.parquet(f"{at}/made/batch={batches}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{at}/in"))
    running = start(streams.packet_stream(spark, f"{at}/in/*"))
    try:
        for k in range(batches + (last is not None)):
            if system.exists(path(f"{at}/made/batch={k}")) and not system.rename(path(f"{at}/made/batch={k}"), path(f"{at}/in/{k}")):
                raise OSError(f"can't move batch {k} of {at}")
            running.processAllAvailable()
    finally:
        running.stop()


def _streamed(spark: SparkSession, sf_dir: str, make, batches: int = 4, shuffled: bool = False, frames: bool = False) -> DataFrame:
    """What a stream of the packets gives, written as Parquet; ``shuffled`` batches hold packets of all times."""
    at = folder(spark, "stream")
    packets = synthetic_packets(spark, sf_dir)
    if frames:
        packets = with_frames(packets).withColumn("caplen", F.col("ip_len") + 14)
    part = F.pmod("seq", F.lit(batches)) if shuffled else F.floor((F.col("ts_sec") - 1704067200) / 900)
    last = packets.limit(1).withColumns({"ts_sec": F.lit(_END).cast("long"), "protocol": F.lit(6), "tcp_flags": F.lit(18), "src_ip": F.lit(1).cast("long"), "l4_len": F.lit(40)}).select(*SCHEMA.names)
    out = []

    def start(packets: DataFrame):
        out.append(make(packets))
        return out[0].writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").start()

    _played(spark, at, packets, part, batches, start, last)
    return spark.read.schema(out[0].schema).parquet(f"{at}/out")


@query(f"{PACKETS} SELECT ts_sec - ts_sec % 60 AS interval_ts, count(*) AS packet_cnt FROM packets GROUP BY 1")
def stream_counter(spark, sf_dir):
    return _streamed(spark, sf_dir, streams.stream_counter)


@query(f"{TAGGED}{_FLOWS} SELECT time, src_ip, dst_ip, src_port, dst_port, protocol, packet_cnt, is_spoofed, is_masscan, tcp_synlen FROM flows")
def stream_flows(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda p: streams.stream_flows(tagging.tag(p)))
    return out.select("time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_cnt", "is_spoofed", "is_masscan", "tcp_synlen")


@query(f"{TAGGED}{_ATTACKS} {_ATTACK_ROWS.replace('maxmind_continent, maxmind_country', repr('??') + ' AS maxmind_continent, ' + repr('??') + ' AS maxmind_country')} WHERE max_ppm_interval >= 4 AND packet_cnt >= 10 AND latest - start >= 60000000")
def stream_attacks(spark, sf_dir):
    """Attacks of a stream whose batches hold packets of all times, within the watermark.

    Places are no part of the rows, but the first of packets that tie is that of the first place, so packets are tagged.
    """
    limits, maxmind = dos.Thresholds(packets=10, rate=4), providers(spark, sf_dir)["maxmind"]
    out = _streamed(spark, sf_dir, lambda p: streams.stream_attacks(tagging.tag(p, maxmind=maxmind, filterbits=False), limits, 600, "2 hours"), shuffled=True, frames=True)
    return out.withColumns({"maxmind_continent": F.lit(flows.NOWHERE), "maxmind_country": F.lit(flows.NOWHERE), "initial_packet": F.lower(F.hex("initial_packet"))})


@query(f"{TAGGED} SELECT country, protocol, count(*) AS packet_cnt, sum(ip_len)::BIGINT AS byte_cnt FROM tagged GROUP BY 1, 2")
def stream_reloaded(spark, sf_dir):
    """Batches that are tagged with tables read anew for each, and written under their numbers."""
    at = folder(spark, "batches")
    make = lambda t: t.groupBy(F.coalesce("maxmind.country", F.lit("??")).alias("country"), "protocol").agg(F.count("*").alias("packet_cnt"), F.sum("ip_len").alias("byte_cnt"))
    write = streams.by_batch(lambda batch: tagging.tag(batch, maxmind=providers(spark, sf_dir)["maxmind"], filterbits=False), make, f"{at}/out")
    start = lambda packets: packets.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").start()
    _played(spark, at, synthetic_packets(spark, sf_dir), F.pmod("seq", F.lit(3)), 3, start)
    return spark.read.parquet(f"{at}/out").groupBy("country", "protocol").agg(F.sum("packet_cnt").alias("packet_cnt"), F.sum("byte_cnt").alias("byte_cnt"))


@query(f"{TAGGED}, twice AS (SELECT * FROM tagged UNION ALL SELECT * FROM tagged WHERE protocol = 6) SELECT minute AS interval_ts, count(*) AS packet_cnt FROM twice GROUP BY 1")
def run_merged(spark, sf_dir):
    """Results of two runs as one."""
    packets = synthetic_packets(spark, sf_dir)
    run = pipeline.config({"plugins": ["null"]})
    return pipeline.merged("null", *(pipeline.results(spark, run, p)["null"] for p in (packets, packets.where("protocol = 6")))).withColumn("interval_ts", intervals.aligned(F.col("interval_ts"))).groupBy("interval_ts").agg(F.sum("packet_cnt").alias("packet_cnt"))
