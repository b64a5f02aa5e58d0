"""Captures, container files, text files and dimension tables."""

import struct

import pytest
from pyspark.sql import functions as F

from netlume.operators import flows, tagging
from netlume.sinks.text import file_name, flow_text, statistics_lines, time_series_lines, time_series_messages
from netlume.sources import attack_text, dimensions, ocf, pcap

from .packets_of import address, packets

SRC, DST = address("1.2.3.4"), address("44.0.0.1")
TCP = struct.pack(">HHIIBBHHH", 80, 443, 1, 2, 5 << 4, 18, 1024, 0, 0) + b"hello"
UDP = struct.pack(">HHHH", 53, 5353, 12, 0) + b"data"


def parse(frame, link=pcap.ETHERNET):
    return dict(zip(pcap.SCHEMA.names, pcap.packet(1, 2, 3, 99, frame, link), strict=True))


def test_headers():
    p = parse(pcap.frame(SRC, DST, 6, TCP, ttl=9))
    assert (p["src_ip"], p["dst_ip"], p["protocol"], p["ttl"], p["src_port"], p["dst_port"], p["tcp_flags"], p["tcp_window"], p["tcp_doff"], p["payload"]) == (SRC, DST, 6, 9, 80, 443, 18, 1024, 5, b"hello")
    u = parse(pcap.frame(SRC, DST, 17, UDP) + b"padding")
    assert (u["src_port"], u["dst_port"], u["udp_len"], u["payload"], u["l4_len"]) == (53, 5353, 12, b"data", 12)


@pytest.mark.parametrize(("tags", "kind"), [
    (b"\x81\x00\x00\x01", 0x0800), (b"\x88\xa8\x00\x01\x81\x00\x00\x02", 0x0800), (b"\x88\x47" + b"\x00\x00\x10\x40" + b"\x00\x00\x11\x40", None), (b"\x88\x64\x11\x00\x00\x01\x00\x20", 0x0021),
])
def test_tags_labels_and_sessions(tags, kind):
    if kind is None:  # after the last label the header follows at once
        tags = tags[:-4] + b"\x00\x00\x11\x40"
        frame = b"\x02" * 12 + tags + pcap.frame(SRC, DST, 17, UDP)[14:]
    else:
        frame = pcap.frame(SRC, DST, 17, UDP, tags=tags, ethertype=kind)
    p = parse(frame)
    assert (p["ethertype"], p["src_ip"], p["dst_port"]) == (0x0800, SRC, 5353)


@pytest.mark.parametrize("n", range(5))
def test_short_transport(n):
    p = parse(pcap.frame(SRC, DST, 6, TCP[:n]))
    assert p["l4_len"] == n and (p["src_port"] is None) == (n < 4) and p["tcp_flags"] is None
    i = parse(pcap.frame(SRC, DST, 1, b"\x08\x00"[:n]))
    assert (i["src_port"] is None) == (n < 2)


def test_others():
    arp, six, fragment = parse(b"\x02" * 12 + b"\x08\x06" + b"x" * 30), parse(b"\x02" * 12 + b"\x86\xdd" + b"\x60" + b"x" * 60), parse(pcap.frame(SRC, DST, 17, UDP, ip_off=7))
    assert arp["src_ip"] is six["src_ip"] is None and (arp["ethertype"], six["ethertype"]) == (0x0806, 0x86DD)
    assert fragment["src_ip"] == SRC and fragment["src_port"] is None and parse(b"")["ethertype"] is None
    assert parse(pcap.frame(SRC, DST, 17, UDP)[14:], pcap.RAW)["dst_port"] == 5353


def test_quoted_headers():
    inner = pcap.frame(5, 6, 6, TCP)[14:]
    quoted = lambda data: parse(pcap.frame(SRC, DST, 1, b"\x03\x01" + b"\0" * 6 + data))
    p = quoted(inner)
    assert (p["src_port"], p["dst_port"], p["inner_src_ip"], p["inner_dst_ip"], p["inner_protocol"], p["inner_sport"], p["inner_dport"]) == (3, 1, 5, 6, 6, 80, 443)
    assert quoted(inner[:19])["inner_dst_ip"] is None and quoted(inner[:20])["inner_sport"] == 0 and quoted(b"\x60" + inner[1:])["inner_dst_ip"] is None


def capture(path, frames, order="<", magic=0xA1B2C3D4, cut=0):
    data = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65536, 1)
    for ts, part, frame in frames:
        data += struct.pack(f"{order}IIII", ts, part, len(frame), len(frame) + 4) + frame
    path.write_bytes(data[: len(data) - cut])


def test_captures(spark, tmp_path):
    pcap.register(spark)
    frame = pcap.frame(SRC, DST, 6, TCP)
    capture(tmp_path / "a.pcap", [(10, 5, frame), (20, 6, frame), (30, 7, frame)])
    capture(tmp_path / "b.pcap", [(40, 8000, frame)], ">", 0xA1B23C4D)
    capture(tmp_path / "c.pcap", [(50, 1, frame), (60, 1, frame)], cut=3)
    df = spark.read.format("pcap").load(str(tmp_path))
    assert sorted((r.ts_sec, r.ts_usec) for r in df.collect()) == [(10, 5), (20, 6), (30, 7), (40, 8), (50, 1)]
    assert sorted(r.ts_sec for r in df.where("ts_sec > 10 and ts_sec <= 40").collect()) == [20, 30, 40]
    df.write.format("pcap").mode("append").save(str(tmp_path / "out"))
    again = spark.read.format("pcap").load(str(tmp_path / "out"))
    keep = [c for c in pcap.SCHEMA.names if c != "seq"]
    assert sorted(map(str, again.select(*keep).collect())) == sorted(map(str, df.select(*keep).collect()))
    (tmp_path / "d.pcap").write_bytes(b"x" * 40)
    with pytest.raises(Exception, match="capture"):
        spark.read.format("pcap").load(str(tmp_path / "d.pcap")).collect()


@pytest.mark.parametrize("codec", ["deflate", "null"])
def test_container_files(spark, tmp_path, codec):
    ocf.register(spark)
    rows = [(i, f"ü{i}" if i % 3 else None, i / 7, [i, None], i % 2 == 0, bytes([i % 256]), -i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b string, c double, d array<long>, e boolean, f binary, g int").repartition(3)
    df.write.format("ocf").option("codec", codec).option("done", "true").mode("append").save(str(tmp_path / "x"))
    again = spark.read.format("ocf").load(str(tmp_path / "x"))
    assert again.dtypes == df.dtypes and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    assert len(list((tmp_path / "x").glob("*.done"))) == len(list((tmp_path / "x").glob("*.avro"))) == 3


def test_flows_round_trip_and_merge(spark, tmp_path):
    ocf.register(spark)
    df = flows.flows(tagging.tag(packets(spark, {}, {}, {"dst_port": 9}, {"tcp_flags": 18}, {"ts_sec": 1060}, {"src_ip": None})))
    df.write.format("ocf").mode("append").save(str(tmp_path / "f"))
    again = ocf.read_flows(spark, str(tmp_path / "f"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect())) and df.agg(F.sum("packet_cnt")).first()[0] == 5
    both = flows.merged(df, again, df.limit(0))
    assert both.count() == df.count() == 4 and both.agg(F.sum("packet_cnt")).first()[0] == 10
    other = flows.merged(df, df.withColumn("tcp_synlen", F.lit(99)))
    assert other.count() == 8


def test_flow_text(spark):
    df = flows.flows(tagging.tag(packets(spark, {"src_ip": SRC, "dst_ip": DST}, {"ts_sec": 1100, "protocol": 17, "tcp_flags": None})))
    lines = [r.value for r in flow_text(df, "T").collect()]
    assert lines[:6] == ["# T_INTERVAL_START 0 960", "START flowtuple_backscatter 0", "END flowtuple_backscatter", "START flowtuple_icmpreq 0", "END flowtuple_icmpreq", "START flowtuple_other 1"]
    assert lines[6:9] == ["1.2.3.4|44.0.0.1|1234|4321|6|64|0x02|100,1", "END flowtuple_other", "# T_INTERVAL_END 0 960"] and lines[9] == "# T_INTERVAL_START 1 1080" and len(lines) == 18
    assert "START flowtuple_other 0" in [r.value for r in flow_text(df, counts=False).collect()]
    assert time_series_lines(spark.createDataFrame([("a.b", 3, 60)], "key string, value long, ts long")).first()[0] == "a.b 3 60"


def test_messages_and_statistics(spark):
    points = spark.createDataFrame([(f"k{j}", j, 60 * (j % 2)) for j in range(10)], "key string, value long, ts long")
    rows = time_series_messages(points, "x", 2).collect()
    assert sum(len(r.value.splitlines()) for r in rows) == 10 and {r.topic for r in rows} == {"x.timeseries"} and len(rows) > 2
    lines = statistics_lines(spark.createDataFrame([(60, 5, None)], "interval_ts long, accepted long, dropped long")).collect()
    assert lines[0].value == "time=60 accepted=5"


def test_file_names():
    assert file_name("/x/%N-%y%m%d-%H%M%S.%P", "dos", "mon", 0, 2, "avro") == "/x/mon-700101-000000.dos.avro--2"
    assert file_name("%s.%f", ts=60, extension="pcap", compression="gz") == "60.pcap.gz"


TEXT = """# X_INTERVAL_START 3 1200
2
1.1.1.1,2,1,3,4,5,6,7,8,9,1.5,2.5
START PACKET
anything
END PACKET
2.2.2.2,1,1,1,1,1,1,1,1,1,1.0,2.0
# X_INTERVAL_END 3 1260
# X_INTERVAL_START 4 1260
0
# X_INTERVAL_END 4 1320
"""


def test_attack_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    rows = attack_text.typed(attack_text.read_attacks(spark, str(tmp_path / "a.txt"))).orderBy("target_ip").collect()
    assert [(r.target_ip, r.packets, r.start, r.interval_number, r.interval_ts) for r in rows] == [("1.1.1.1", 5, 1.5, 3, 1200), ("2.2.2.2", 1, 1.0, 3, 1200)]


def test_dimensions(spark, tmp_path):
    (tmp_path / "as.txt").write_text("1.0.0.0\t8\t13335\n1.2.0.0 16 1_2\n# note\n")
    (tmp_path / "blocks.csv").write_text("network,id\n1.0.0.0/8,7\n1.2.0.0/16,8\n")
    (tmp_path / "loc.csv").write_text("id,continent,country,region\n7,EU,DE,3\n8,NA,US,0\n")
    (tmp_path / "poly.csv").write_text("id,table,polygon\n7,0,5\n7,1,6\n")
    (tmp_path / "labels.csv").write_text("id,label\n5,EU.DE.x\n")
    p = lambda n: str(tmp_path / n)
    df = packets(spark, {"src_ip": SRC}, {"src_ip": address("1.9.9.9")}, {"src_ip": 1})
    out = tagging.tag(df, dimensions.maxmind(spark, p("blocks.csv"), p("loc.csv")), dimensions.netacuity(spark, p("blocks.csv"), p("loc.csv"), p("poly.csv")), dimensions.pfx2as(spark, p("as.txt")))
    rows = out.orderBy("seq").collect()
    assert [r.maxmind and r.maxmind.country for r in rows] == ["US", "DE", None] and [r.prefix_asn for r in rows] == [None, 13335, None] and [r.providers_used for r in rows] == [7, 15, 1]
    assert rows[1].netacq.polygons == [5, (1 << 24) + 6] and rows[1].netacq.region == 3
    assert tuple(dimensions.labels(spark, p("labels.csv")).first()) == (5, "EU.DE.x")
