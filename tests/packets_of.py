"""Packets for tests, field by field."""

from netlume.sources.packets import SCHEMA

BASE = {
    "ts_sec": 1000, "ts_usec": 0, "seq": 1, "caplen": 60, "wirelen": 64, "ethertype": 2048, "src_ip": 0x08080808, "dst_ip": 0x2C000001, "protocol": 6, "ttl": 64, "ip_len": 100, "ip_off": 0, "l4_len": 80,
    "src_port": 1234, "dst_port": 4321, "tcp_flags": 2, "tcp_window": 29200, "tcp_doff": 10, "payload": b"", "payload_len": 0,
}
UDP = {"protocol": 17, "tcp_flags": None, "tcp_window": None, "tcp_doff": None, "udp_len": 8}
ICMP = {"protocol": 1, "tcp_flags": None, "tcp_window": None, "tcp_doff": None}


def udp(payload: bytes, **more):
    return UDP | {"payload": payload, "payload_len": len(payload), "udp_len": 8 + len(payload)} | more


def row(seq=1, **fields):
    return tuple((dict.fromkeys(SCHEMA.names) | BASE | {"seq": seq} | fields).values())


def packets(spark, *fields):
    return spark.createDataFrame([row(k, **f) for k, f in enumerate(fields)], SCHEMA)


def address(text):
    out = 0
    for part in text.split("."):
        out = out * 256 + int(part)
    return out
