"""Packet captures as a data source and a sink: format "pcap".

Reading: one partition for each file, in batches of Arrow rows.  Files are
pcap with microseconds or nanoseconds in either byte order, pcapng, or ERF
(option ``kind`` "erf", or a name that says so), packed or not (see ``files``),
with Ethernet, raw IP or Linux cooked frames.  802.1Q tags, MPLS labels and
PPPoE headers are taken off until an IP header is found.  Predicates on ts_sec
are used while reading.  A file that ends in the middle of a packet gives the
packets before it.

Writing: one file for each task, of rows with ts_sec, ts_usec, wirelen,
l2_bytes; ``compression`` "gz" packs files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .files import Output, listed, opened
from .packets import SCHEMA

ETHERNET, RAW, COOKED = 1, 101, 113
IPV4 = 0x0800
_TAGS, _MPLS, _PPPOE = (0x8100, 0x88A8, 0x9100), (0x8847, 0x8848), 0x8864
_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}


def network_header(frame: bytes, link: int) -> tuple[int | None, int]:
    """Ethertype and where the header of that protocol begins; (None, 0) if there is none."""
    if link == RAW:
        return (IPV4 if frame[:1] and frame[0] >> 4 == 4 else 0x86DD if frame[:1] else None), 0
    at, place = (14, 12) if link == ETHERNET else (16, 14)
    if len(frame) < at:
        return None, 0
    kind = int.from_bytes(frame[place : place + 2])
    while True:
        if kind in _TAGS:
            if len(frame) < at + 4:
                return None, 0
            kind, at = int.from_bytes(frame[at + 2 : at + 4]), at + 4
        elif kind in _MPLS:
            while len(frame) >= at + 4:
                at += 4
                if frame[at - 2] & 1:
                    break
            else:
                return None, 0
            kind = IPV4 if frame[at : at + 1] and frame[at] >> 4 == 4 else 0x86DD
        elif kind == _PPPOE:
            if len(frame) < at + 8:
                return None, 0
            kind, at = {0x0021: IPV4, 0x0057: 0x86DD}.get(int.from_bytes(frame[at + 6 : at + 8]), 0), at + 8
        else:
            return kind, at


def packet(ts_sec: int, ts_usec: int, seq: int, wirelen: int, frame: bytes, link: int = ETHERNET) -> tuple:
    """A row of the packet relation."""
    row: dict = dict.fromkeys(SCHEMA.names)
    row |= {"ts_sec": ts_sec, "ts_usec": ts_usec, "seq": seq, "caplen": len(frame), "wirelen": wirelen, "l2_bytes": frame}
    kind, at = network_header(frame, link)
    row["ethertype"] = kind
    ip = frame[at:]
    if kind == IPV4 and len(ip) >= 20:
        words = struct.unpack_from(">BBHHHBBHII", ip)
        size = 4 * (words[0] & 15)
        row |= {"ip_len": words[2], "ip_off": words[4], "ttl": words[5], "protocol": words[6], "src_ip": words[8], "dst_ip": words[9]}
        # bytes of the frame's padding aren't part of the packet
        rest = ip[size : max(size, words[2])] if words[2] >= size else ip[size:]
        if not words[4] & 0x1FFF:
            row |= _transport(words[6], rest)
    return tuple(row.values())


def _ports(protocol: int, data: bytes) -> tuple[int | None, int | None]:
    if protocol == 1:
        return (data[0], data[1]) if len(data) >= 2 else (None, None)
    return struct.unpack_from(">HH", data) if protocol in (6, 17) and len(data) >= 4 else (None, None)


def _transport(protocol: int, data: bytes) -> dict:
    src, dst = _ports(protocol, data)
    row: dict = {"l4_len": len(data), "src_port": src, "dst_port": dst}
    body = None
    if protocol == 6 and len(data) >= 20:
        row |= {"tcp_doff": data[12] >> 4, "tcp_flags": data[13], "tcp_window": int.from_bytes(data[14:16])}
        body = data[4 * row["tcp_doff"] :]
    elif protocol == 17 and len(data) >= 8:
        row["udp_len"] = int.from_bytes(data[4:6])
        body = data[8:]
    elif protocol == 1 and len(data) >= 8:
        body = data[8:]
        inner = body
        if len(inner) >= 20 and inner[0] >> 4 == 4 and data[0] in (3, 4, 5, 11, 12):
            row |= {"inner_protocol": inner[9], "inner_src_ip": int.from_bytes(inner[12:16]), "inner_dst_ip": int.from_bytes(inner[16:20])}
            after = inner[4 * (inner[0] & 15) :]
            row["inner_sport"], row["inner_dport"] = struct.unpack_from(">HH", after) if len(after) >= 4 else (0, 0)
    if body is not None:
        row |= {"payload": body, "payload_len": len(body)}
    return row


Record = tuple[int, int, int, bytes, int]
"""Second, microsecond, length on the wire, frame, link."""
BATCH = 4096
SECTION = b"\x0a\x0d\x0d\x0a"


def _pcap(f, head: bytes) -> Iterator[Record]:
    order, unit = _MAGIC[head]
    rest = f.read(20)
    if len(rest) < 20:
        return
    link = struct.unpack(f"{order}I", rest[16:20])[0] & 0xFFFF
    while len(record := f.read(16)) == 16:
        sec, part, caplen, wirelen = struct.unpack(f"{order}IIII", record)
        frame = f.read(caplen)
        if len(frame) < caplen:
            return
        yield sec, part // unit, wirelen, frame, link


def _ticks(options: bytes, order: str) -> int:
    """Ticks in a second of an interface, from its options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{order}HH", options, at)
        if code == 9 and size:
            exponent = options[at + 4]
            return 2 ** (exponent & 127) if exponent & 128 else 10**exponent
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _pcapng(f, head: bytes) -> Iterator[Record]:
    order, interfaces, kind = "<", [], head
    while len(kind) == 4:
        size = f.read(4)
        if len(size) < 4:
            return
        if kind == SECTION:
            magic = f.read(4)
            order, interfaces = (">" if magic == b"\x1a\x2b\x3c\x4d" else "<"), []
            body = f.read(struct.unpack(f"{order}I", size)[0] - 16)
        else:
            length = struct.unpack(f"{order}I", size)[0] - 12
            body = f.read(length)
            if len(body) < length:
                return
            number = struct.unpack(f"{order}I", kind)[0]
            if number == 1:
                interfaces.append((struct.unpack_from(f"{order}H", body)[0], _ticks(body[8:], order)))
            elif number in (2, 6) and len(body) >= 20:
                port, high, low, caplen, wirelen = struct.unpack_from(f"{order}IIIII" if number == 6 else f"{order}HxxIIII", body)
                link, ticks = interfaces[port]
                time = high << 32 | low
                yield time // ticks, time % ticks * 1_000_000 // ticks, wirelen, body[20 : 20 + caplen], link
            elif number == 3 and interfaces:
                wirelen = struct.unpack_from(f"{order}I", body)[0]
                yield 0, 0, wirelen, body[4 : 4 + wirelen], interfaces[0][0]
        f.read(4)
        kind = f.read(4)


def _erf(f, head: bytes) -> Iterator[Record]:
    while len(head) == 4:
        rest = f.read(12)
        if len(rest) < 12:
            return
        time, kind, _, size, _, wirelen = struct.unpack("<QBB", head + rest[:6]) + struct.unpack(">HHH", rest[6:])
        body = f.read(size - 16)
        if len(body) < size - 16:
            return
        at, more = 0, kind & 128
        while more:
            more = body[at] & 128
            at += 8
        if kind & 127 == 2:  # Ethernet, after two bytes that align it; the length on the wire has the checksum, which captures don't
            frame = body[at + 2 :][: max(0, wirelen - 4)]
            yield time >> 32, (time & 0xFFFFFFFF) * 1_000_000 >> 32, max(0, wirelen - 4), frame, ETHERNET
        head = f.read(4)


def records(f, name: str, kind: str | None = None) -> Iterator[Record]:
    """The packets of a capture in one of its formats."""
    head = f.read(4)
    if kind == "erf" or kind is None and ".erf" in name.rpartition("/")[2]:
        return _erf(f, head)
    if head == SECTION:
        return _pcapng(f, head)
    if len(head) < 4:
        return iter(())
    if head not in _MAGIC:
        raise ValueError(f"{name} isn't a packet capture")
    return _pcap(f, head)


@dataclass
class _File(InputPartition):
    path: str


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.kind, self.low, self.high = listed(options), options.get("kind"), None, None

    def pushFilters(self, filters):
        for f in filters:
            if f.__class__ in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("ts_sec",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low if self.low is not None else f.value, f.value)
                else:
                    self.high = min(self.high if self.high is not None else f.value, f.value)
            yield f  # Spark applies it too

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(SCHEMA), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        with opened(partition.path) as f:
            for seq, (sec, usec, wirelen, frame, link) in enumerate(records(f, partition.path, self.kind), 1):
                if (self.low is None or sec >= self.low) and (self.high is None or sec <= self.high):
                    rows.append(packet(sec, usec, seq, wirelen, frame, link))
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
            if rows:
                yield batch()


@dataclass
class _Written(WriterCommitMessage):
    name: str
    packets: int


class PcapWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.output = Output(options["path"], overwrite, ".pcap" + (f".{options['compression']}" if options.get("compression") else ""))

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        f, name = self.output.new()
        with f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65536, ETHERNET))
            n, head = 0, struct.Struct("<IIII").pack
            for batch in batches:
                columns = (batch.column(batch.schema.names.index(name)).to_pylist() for name in ("ts_sec", "ts_usec", "wirelen", "l2_bytes"))
                f.write(b"".join(head(sec, usec, len(frame or b""), wirelen) + (frame or b"") for sec, usec, wirelen, frame in zip(*columns, strict=True)))
                n += batch.num_rows
        return _Written(name, n)

    def commit(self, messages) -> None:
        self.output.commit([m.name for m in messages if m])

    def abort(self, messages) -> None:
        self.output.abort()


class PcapSource(DataSource):
    """``spark.read.format("pcap").load(path)`` and ``df.write.format("pcap").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> PcapReader:
        return PcapReader(self.options)

    def writer(self, schema, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapSource)


def frame(src_ip: int, dst_ip: int, protocol: int, transport: bytes, ttl: int = 64, ip_off: int = 0, tags: bytes = b"", ethertype: int = IPV4) -> bytes:
    """An Ethernet frame with an IPv4 packet, for tests and examples; ``tags`` stand between the addresses and the ethertype."""
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(transport), 0, ip_off, ttl, protocol, 0, src_ip, dst_ip)
    return b"\x02" * 12 + tags + ethertype.to_bytes(2) + ip + transport
