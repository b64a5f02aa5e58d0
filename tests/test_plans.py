"""Configurations, plugins and streams."""

import shutil
from collections import defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from netlume import files_queries
from netlume.operators import dos, flows, tagging
from netlume.plans import pipeline
from netlume.queries import ORACLES, QUERIES
from netlume.sources.packets import synthetic_packets
from netlume.streaming import packets as streams

from .oracle import compare, connect
from .packets_of import packets

SF = "/root/testdata/sf0.001"
YAML = """
outtemplate: "%N-%P"
monitorid: tele
interval: 600
rotatefreq: 2
startboundaryts: 1704067200
removespoofed: yes
basicfilter: "tcp or icmp"
packetsource: none
logfilename: ignored
plugins:
  - flowtuple: {sorttuples: yes}
  - dos: {min_attack_packets: 3, min_attack_packet_rate: 1, min_attack_duration: 60}
  - report: {output_row_label: here, limitmetrics: [basic, tcpports], tcp_dest_ports: [0-1023], src_ip_counting: prefixagg/24}
  - null:
"""


def test_configuration(spark, tmp_path):
    run = pipeline.config(YAML.replace("- null:", "- 'null':"), template=f"{tmp_path}/%N-%P")
    assert (run.interval, run.rotate, run.monitor, run.remove, run.sources, [n for n, _ in run.plugins]) == (600, 2, "tele", {"spoofed": True}, ["none"], ["flowtuple", "dos", "report", "null"])
    out = pipeline.results(spark, run, synthetic_packets(spark, SF))
    assert out["flowtuple"].where("is_spoofed = 1 or protocol = 17").count() == 0 < out["flowtuple"].count()
    assert out["dos"].count() > 0 and {r.source_label for r in out["report"].collect()} == {"here"}
    assert out["report"].where("metric_name = 'traffic.port.tcp.dst_port' and cast(metric_value as int) > 1023").count() == 0
    assert out["null"].agg(F.sum("packet_cnt")).first()[0] == out["flowtuple"].agg(F.sum("packet_cnt")).first()[0]
    path = pipeline.write(out["null"], run, "null", "interval_ts")
    assert path == f"{tmp_path}/tele-null" and len(list(tmp_path.glob("tele-null/rotate_ts=*"))) == 3


def test_own_plugins(spark):
    @pipeline.plugin("Ports")
    def ports(tagged, run, options):
        return tagged.groupBy("dst_port").count()

    out = pipeline.results(spark, pipeline.config({"plugins": ["ports", "archive", {"report": {"output_format": "libtimeseries", "limitmetrics": ["combined"]}}]}), packets(spark, *({"ts_sec": t} for t in (60, 61, 119, 120))))
    assert out["ports"].first()["count"] == 4 and [r.ts_sec for r in out["archive"].collect()] == [60, 61, 119, 120]
    assert {r.key for r in out["report"].collect()} == {f"unlabeled.overall.{x}" for x in ("uniq_src_ip", "uniq_dst_ip", "uniq_src_asn", "pkt_cnt", "ip_len")}
    with pytest.raises(ValueError):
        pipeline.results(spark, pipeline.config({"plugins": ["nothing"]}), packets(spark, {}))


@pytest.mark.parametrize("bad", [{"interval": 0}, {"removespoofed": "maybe"}, {"startboundaryts": 9, "endboundaryts": 5}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        pipeline.config(bad)


def streamed(spark, tmp_path, make, last=None):
    """What a stream of the packets gives, in the order of time, a tenth in each batch."""
    rows = synthetic_packets(spark, SF).where("ts_sec < 1704068400")
    (tmp_path / "in").mkdir()
    for k in range(4):
        part = rows.where(f"ts_sec >= {1704067200 + 300 * k} and ts_sec < {1704067500 + 300 * k}").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    packets(spark, {"ts_sec": 1704090000, "tcp_flags": 18}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # ends all intervals
    q = make(streams.packet_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("out").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return rows, spark.table("out")


def test_streamed_flows_are_those_of_a_batch(spark, tmp_path):
    rows, out = streamed(spark, tmp_path, lambda p: streams.stream_flows(tagging.tag(p)))
    want = flows.flows(tagging.tag(rows))
    assert sorted(map(str, out.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_streamed_attacks_are_those_of_a_batch(spark, tmp_path):
    limits = dos.Thresholds(packets=2, seconds=0, rate=1)
    rows, out = streamed(spark, tmp_path, lambda p: streams.stream_attacks(p, limits, 300))
    want = dos.attacks(tagging.tag(rows), limits, 300)
    keys = ["bin_timestamp", "target_protocol", "target_ip", "packet_cnt", "byte_cnt", "icmp_mismatches", "max_ppm_interval"]
    assert sorted(map(tuple, out.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect())) and out.count() > 10


def test_streamed_first_packets_that_tie(spark, tmp_path):
    """The frame decides, in whatever order packets and batches come; no frame is first, as in a batch."""
    batches = [[(1, b"b"), (1, b"a"), (2, b"b"), (2, None), (3, b"b"), (4, b"a"), (5, None), (6, b"b")], [(3, b"a"), (4, b"b"), (5, b"a"), (6, None)]]
    made = [packets(spark, *({"ts_sec": 60, "tcp_flags": 18, "src_ip": ip, "l2_bytes": frame} for ip, frame in b)).withColumn("seq", F.lit(1).cast("long")) for b in batches]
    for part in (*made, packets(spark, {"ts_sec": 6000, "tcp_flags": 18})):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    limits = dos.Thresholds(packets=1, seconds=0, rate=1)
    out = streams.stream_attacks(streams.packet_stream(spark, str(tmp_path / "in"), 1), limits, 60)
    q = out.writeStream.format("memory").queryName("ties").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = dos.attacks(tagging.tag(made[0].union(made[1])), limits, 60)
    got = {r.target_ip: r.initial_packet and bytes(r.initial_packet) for r in spark.table("ties").collect()}
    assert got == {1: b"a", 2: None, 3: b"a", 4: b"a", 5: None, 6: None}
    assert sorted(map(str, spark.table("ties").collect())) == sorted(map(str, want.select(*out.columns).collect()))


def test_streamed_attacks_of_ties_are_those_of_sql(spark, tmp_path):
    """Vectors whose nine first packets differ by no more than source, place and frame."""
    vectors = defaultdict(list)
    for n in range(9, 100_000, 10):
        if n % 97 and (n >> 3) % 19 in dos.QUOTING:
            vectors[n % 256].append((n * 7919 % 3600, n))
    spans = [(a[1], b[1]) for v in vectors.values() for a, b in pairwise(sorted(v)) if a[0] // 600 == b[0] // 600 and b[0] >= a[0] + 60 and a == min(v)]
    rows = [(n // 8, 100 + 37 * k, 10 + 101 * k, n % 8) for span in spans[:20] for n in span for k in range(9)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    shutil.copy(f"{SF}/nation.parquet", tmp_path)
    df = QUERIES["stream_attacks"](spark, str(tmp_path))
    assert df.count() >= 10
    assert compare(df, connect(str(tmp_path)), ORACLES["stream_attacks"]) is None


def test_batches(spark, tmp_path):
    write = streams.by_batch(tagging.tag, lambda t: t.groupBy("protocol").count(), str(tmp_path))
    for _ in range(2):
        write(packets(spark, {}, {}), 7)
    assert spark.read.parquet(str(tmp_path)).first()["count"] == 2


def test_hooks_of_plugins(spark, tmp_path):
    said = []

    @pipeline.plugin("hooked", rotated=lambda path, ts: said.append((path.rpartition("/")[2], ts)), halted=lambda run: said.append("end"))
    def hooked(tagged, run, options):
        return tagged.select("ts_sec")

    run = pipeline.config({"plugins": ["hooked"], "rotatefreq": 1}, template=f"{tmp_path}/%P")
    out = pipeline.results(spark, run, packets(spark, {"ts_sec": 60}, {"ts_sec": 130}))
    pipeline.write(out["hooked"], run, "hooked", "ts_sec")
    pipeline.halt(run)
    assert said == [("rotate_ts=60", 60), ("rotate_ts=120", 120), "end"]
    one = flows.flows(tagging.tag(packets(spark, {})))
    assert pipeline.merged("flowtuple", one, one).first().packet_cnt == 2 and pipeline.merged("hooked", one, one).count() == 2


def test_intervals_that_removal_empties_are_complete(spark):
    """Removal neither takes intervals away nor moves the first one."""
    rows = [{"ts_sec": t, "ttl": 64, "ip_off": off} for t, off in ((61, 5), (120, 0), (179, 0), (180, 5), (239, 5), (240, 0), (299, 0))]
    run = pipeline.config({"plugins": [{"report": {"limitmetrics": ["combined"]}}, "null", "flowtuple"], "removespoofed": "yes"})
    out = pipeline.results(spark, run, packets(spark, *rows))
    assert {r.bin_timestamp: r.pkt_cnt for r in out["report"].collect()} == {120: 2, 240: 2}
    assert {r.interval_ts: r.packet_cnt for r in out["null"].collect()} == {120: 2, 240: 2} and {r.time for r in out["flowtuple"].collect()} == {120, 240}
    first = pipeline.results(spark, pipeline.config({"plugins": ["flowtuple"]}), packets(spark, *rows))["flowtuple"]
    assert min(r.time for r in first.collect()) == 61


def test_quiet_intervals_end_by_the_clock(spark, tmp_path):
    packets(spark, {"ts_sec": 60}, {"ts_sec": 61}, {"ts_sec": 125}).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.stream_quiet_intervals(streams.packet_stream(spark, str(tmp_path / "in")), 60, 1)
    q = out.writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("quiet").count() == 2 or q.awaitTermination(1):
                break
    finally:
        q.stop()
    assert {(r.interval_ts, r.packet_cnt) for r in spark.table("quiet").collect()} == {(60, 2), (120, 1)}


def test_columns_of_streamed_attacks(spark, tmp_path):
    """Each column costs each vector of a batch a conversion in Python: the numbers of a packet go as one."""
    out = streams.stream_attacks(streams.packet_stream(spark, str(tmp_path)))
    plan = out._jdf.queryExecution().analyzed()
    while "FlatMapGroupsInPandasWithState" not in plan.nodeName():
        plan = plan.children().head()
    assert plan.children().head().output().size() <= 9  # of these, two are keys that pass twice


def test_batches_of_a_played_stream(spark, tmp_path):
    """A batch comes as a whole, from as many files as there are tasks, also where none has a row of the one before."""
    rows = [{"ts_sec": 60 * (k % 4)} for k in range(400) if k % 4 != 1]
    seen = []
    start = lambda p: p.writeStream.foreachBatch(lambda b, _: seen.append(({r[0] for r in b.select("ts_sec").distinct().collect()}, b.count()))).option("checkpointLocation", f"{tmp_path}/c").start()
    last = packets(spark, {"ts_sec": 999})
    files_queries._played(spark, f"{tmp_path}/at", packets(spark, *rows).repartition(8), (F.col("ts_sec") / 60).cast("int"), 4, start, last)
    assert seen == [({0}, 100), ({120}, 100), ({180}, 100), ({999}, 1)]
    assert [len(list((tmp_path / "at" / "in" / k).glob("*.parquet"))) for k in "023"] == [8, 8, 8]
