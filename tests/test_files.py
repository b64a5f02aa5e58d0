"""Capture formats, packed files, overwriting, pushdown, logging, and comparisons of header fields."""

import logging
import struct

import pytest
from pyspark.sql import functions as F

from netlume.functions.bpf import compile_filter
from netlume.operators import flows, tagging
from netlume.operators.ordering import placed, with_group_size
from netlume.plans import logs
from netlume.sources import dimensions, files, ocf, pcap
from netlume.sources.packets import synthetic_packets, with_frames, with_others

from .packets_of import packets
from .test_sources import DST, SRC, TCP, UDP

SF = "/root/testdata/sf0.001"


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)


@pytest.mark.parametrize("order", ["<", ">"])
def test_pcapng(spark, tmp_path, order):
    pcap.register(spark)
    frame = pcap.frame(SRC, DST, 6, TCP)
    section = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    micro = block(1, struct.pack(f"{order}HHI", 1, 0, 65535), order)
    nano = block(1, struct.pack(f"{order}HHI", 1, 0, 65535) + struct.pack(f"{order}HHBxxx", 9, 1, 9), order)

    def enhanced(port, time):
        return block(6, struct.pack(f"{order}IIIII", port, time >> 32, time & 0xFFFFFFFF, len(frame), len(frame) + 9) + frame, order)

    data = section + micro + nano + enhanced(0, 1704067200_000007) + block(5, b"statistics", order) + enhanced(1, 1704067201_000009000)
    data += block(3, struct.pack(f"{order}I", len(frame)) + frame, order) + section + micro + enhanced(0, 5_000_001)
    (tmp_path / "a.pcapng").write_bytes(data + enhanced(0, 6)[:-9])
    rows = spark.read.format("pcap").load(str(tmp_path)).orderBy("seq").collect()
    assert [(r.ts_sec, r.ts_usec) for r in rows] == [(1704067200, 7), (1704067201, 9), (0, 0), (5, 1)]
    assert {(r.src_ip, r.dst_port) for r in rows} == {(SRC, 443)} and rows[0].wirelen == len(frame) + 9


def test_erf(spark, tmp_path):
    pcap.register(spark)
    frame = pcap.frame(SRC, DST, 17, UDP)

    def record(sec, half, kind=2, extra=b""):
        body = extra + (b"\0\0" if kind & 127 == 2 else b"") + frame
        return struct.pack("<Q", sec << 32 | half) + struct.pack(">BBHHH", kind, 4, 16 + len(body), 0, len(frame) + 4) + body

    data = record(10, 1 << 31) + record(11, 0, 2 | 128, b"\x80" + b"\1" * 7 + b"\0" * 8) + record(12, 0, 5) + record(13, 0)
    (tmp_path / "a.erf").write_bytes(data[:-3])
    rows = spark.read.format("pcap").load(str(tmp_path)).orderBy("ts_sec").collect()
    assert [(r.ts_sec, r.ts_usec, r.dst_port, r.wirelen) for r in rows] == [(10, 500000, 5353, len(frame)), (11, 0, 5353, len(frame))]
    (tmp_path / "b.x").write_bytes(record(20, 0))
    assert spark.read.format("pcap").option("kind", "erf").load(str(tmp_path / "b.x")).first().ts_sec == 20


def test_packed_files_patterns_and_failed_attempts(spark, tmp_path):
    pcap.register(spark)
    df = with_frames(packets(spark, *({"ts_sec": 60 + k} for k in range(6))))
    out = tmp_path / "out"
    df.write.format("pcap").option("compression", "gz").mode("append").save(str(out))
    assert all(p.read_bytes()[:2] == b"\x1f\x8b" for p in out.glob("*.pcap.gz"))
    assert spark.read.format("pcap").load(f"file://{out}/*.gz").count() == 6 == spark.read.format("pcap").load(str(out)).count()
    assert not list(out.glob("_temporary*")) and (out / "_SUCCESS").exists()

    def fails(batches):
        yield from batches
        raise RuntimeError("on purpose")

    with pytest.raises(Exception, match="on purpose"):
        df.coalesce(1).mapInArrow(fails, df.schema).write.format("pcap").mode("append").save(str(out))
    assert not list(out.glob("_temporary*")) and spark.read.format("pcap").load(str(out)).count() == 6
    df.limit(2).write.format("pcap").mode("overwrite").save(str(out))
    assert spark.read.format("pcap").load(str(out)).count() == 2
    assert files.listed({"path": str(tmp_path / "nothing-*.pcap")}) == []


@pytest.mark.parametrize("codec", ocf.CODECS)
def test_overwritten_containers(spark, tmp_path, codec):
    ocf.register(spark)
    at = str(tmp_path / "x")
    for n in (10, 7):
        spark.range(n).selectExpr("id", "repeat('ab', 300) as s").write.format("ocf").option("codec", codec).mode("overwrite").save(at)
    assert sorted(r.id for r in spark.read.format("ocf").load(at).collect()) == list(range(7))
    block_of = ocf.packed(codec, b"hello" * 50)
    assert ocf.unpacked(codec, block_of) == b"hello" * 50
    if codec == "snappy":
        with pytest.raises(ValueError, match="damaged"):
            ocf.unpacked(codec, block_of[:-1] + b"\0")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    synthetic_packets(spark, SF).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = spark.read.parquet(str(tmp_path / "p")).where("ts_sec >= 1704067800").where(compile_filter("udp dst port 53", known=False)).groupBy("protocol").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts_sec,1704067800)" in plan and "EqualTo(protocol,17)" in plan.split("PushedFilters")[1]
    assert "tcp_window" not in plan.split("ReadSchema")[1] and "payload" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(("text", "ports"), [
    ("tcp[13] & 2 != 0", {1, 2}), ("tcp[tcpflags] & (tcp-syn|tcp-ack) == tcp-syn", {1}), ("tcp[tcpflags] == tcp-rst", {3}), ("ip[8] < 50", {2}), ("ip[2:2] >= 0x100 and tcp", {3}),
    ("ip proto 17", {4}), ("ether proto 0x0800 and not tcp", {4}), ("src net 10.0.0.0 mask 255.0.0.0", {4}), ("ip6", set()), ("udp[4:2] > 5", {4}),
])
def test_header_comparisons(spark, text, ports):
    df = packets(
        spark, {"dst_port": 1, "tcp_flags": 2, "ttl": 64}, {"dst_port": 2, "tcp_flags": 18, "ttl": 40}, {"dst_port": 3, "tcp_flags": 4, "ttl": 64, "ip_len": 300},
        {"dst_port": 4, "protocol": 17, "tcp_flags": None, "udp_len": 12, "ttl": 64, "src_ip": 10 << 24},
    )
    assert {r.dst_port for r in df.where(compile_filter(text)).collect()} == ports


@pytest.mark.parametrize("text", ["tcp[99] = 1", "ip[8]", "ip[8 < 3", "tcp[13] & (tcp-syn != 0", "ip[8] << 3"])
def test_bad_comparisons(text):
    with pytest.raises((ValueError, KeyError)):
        compile_filter(text)


def test_what_is_not_ip_has_no_part(spark):
    df = with_others(synthetic_packets(spark, SF))
    others = df.where("src_ip is null")
    assert others.count() > 10 and flows.flows(tagging.tag(others)).count() == 0
    assert tagging.tag(others).select("filterbits").distinct().collect()[0][0] == 1 << 28


def test_places_in_groups_that_are_dealt_out(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "(id * 7919) % 101 AS a", "id AS b")
    got = placed(df, ["g"], [F.col("a")], ["b"]).collect()
    for g in range(3):
        rows = sorted(((r.a, r.b, r.place) for r in got if r.g == g))
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))
    assert {(r.g, r.n) for r in with_group_size(df, ["g"], "n").collect()} == {(0, 1667), (1, 1667), (2, 1666)}


def test_batches_of_records(spark):
    rows = flows.flows(tagging.tag(synthetic_packets(spark, SF)))
    whole = flows.batched_records(rows, "x", 20 * flows.RECORD_BYTES).collect()
    assert sum(len(r.value) for r in whole) == rows.count() * flows.RECORD_BYTES and len(whole) > 100
    assert all(len(r.value) % flows.RECORD_BYTES == 0 and int.from_bytes(r.value[:4]) == r.time for r in whole)


def test_logging(tmp_path, capsys):
    logs.logger("file", path=str(tmp_path / "log")).info("to the file")
    assert "to the file" in (tmp_path / "log").read_text()
    logs.logger("disabled").error("to nowhere")
    own = logs.logger("terminal")
    own.info("to the terminal")
    assert len(own.handlers) == 1 and isinstance(own.handlers[0], logging.StreamHandler)
    with pytest.raises(ValueError):
        logs.logger("pigeon")
    logs.logger("disabled")


def test_published_databases(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "blocks2.csv").write_text("network,geoname_id,registered_country_geoname_id,represented_country_geoname_id,is_anonymous_proxy\n1.2.0.0/16,7,7,,0\n1.9.0.0/16,8,8,,0\n")
    (tmp_path / "places2.csv").write_text("geoname_id,locale_code,continent_code,continent_name,country_iso_code,country_name\n7,en,EU,Europe,DE,Germany\n8,en,NA,North America,US,United States\n")
    (tmp_path / "blocks1.csv").write_text("startIpNum,endIpNum,locId\n16908288,16973823,7\n17367040,17432575,8\n")
    (tmp_path / "places1.csv").write_text("locId,country,region,city\n7,DE,1,x\n8,US,2,y\n")
    (tmp_path / "continents.csv").write_text("country,continent\nDE,EU\nUS,NA\n")
    (tmp_path / "places3.csv").write_text("id,continent,country,region\n7,EU,DE,BY\n8,NA,US,CA\n")
    (tmp_path / "regions.csv").write_text("country,region,number\nDE,BY,5\nUS,CA,6\n")
    df = packets(spark, {"src_ip": SRC}, {"src_ip": SRC + (7 << 16)}, {"src_ip": SRC - (1 << 16)})
    for own in (dimensions.maxmind(spark, p("blocks2.csv"), p("places2.csv")), dimensions.maxmind(spark, p("blocks1.csv"), p("places1.csv"), p("continents.csv"))):
        rows = tagging.tag(df, maxmind=own).orderBy("seq").collect()
        assert [r.maxmind and tuple(r.maxmind) for r in rows] == [("EU", "DE"), ("NA", "US"), None]
    own = dimensions.netacuity(spark, p("blocks1.csv"), p("places3.csv"), regions=p("regions.csv"))
    assert [r.netacq and r.netacq.region for r in tagging.tag(df, netacq=own).orderBy("seq").collect()] == [5, 6, None]


def test_containers_and_captures_go_in_arrow_batches(tmp_path):
    """Rows cross between the JVM and Python by the batch; small, large and negative numbers, nulls and empty texts stay what they are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from netlume.sources import ocf, pcap

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType()), T.StructField("b", T.BooleanType(), False), T.StructField("d", T.DoubleType(), False)])
    numbers = [0, 1, -1, 63, 64, -65, 65535, 65536, 2**63 - 1, -(2**63), None]
    columns = [numbers, ["", "ü", None, "x" * 20_000, *"abcdefg"], [k % 2 == 0 for k in range(11)], [k / 7 for k in range(11)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)
    for codec in ocf.CODECS:
        at = str(tmp_path / codec)
        writer = ocf.OcfWriter(schema, {"path": at, "codec": codec}, True)
        writer.commit([writer.write(iter([batch, batch]))])
        reader = ocf.OcfReader([str(p) for p in (tmp_path / codec).glob("*.avro")], schema)
        read = [b for p in reader.partitions() for b in reader.read(p)]
        assert all(isinstance(b, pa.RecordBatch) for b in read) and pa.Table.from_batches(read).to_pydict() == {n: 2 * c for n, c in zip(schema.names, columns, strict=True)}
    frames = pa.RecordBatch.from_arrays([pa.array(c) for c in ([5, 6], [1, 2], [60, 61], [b"ab", None])], names=["ts_sec", "ts_usec", "wirelen", "l2_bytes"])
    writer = pcap.PcapWriter({"path": str(tmp_path / "p")}, True)
    writer.commit([writer.write(iter([frames]))])
    (path,) = (tmp_path / "p").glob("*.pcap")
    with open(path, "rb") as f:
        assert list(pcap.records(f, str(path))) == [(5, 1, 60, b"ab", 1), (6, 2, 61, b"", 1)]
