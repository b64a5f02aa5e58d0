"""A packet that matches and one that doesn't, for each filter; and what has no header."""

import pytest
from pyspark.sql import functions as F

from netlume.functions.bpf import compile_filter
from netlume.operators import filters
from netlume.operators.filters import NAMES, filter_by, port_allowed, removal, with_filters, with_mask

from .packets_of import ICMP, UDP, address, packets, udp

DNS = bytes.fromhex("123481800001000100000000") + b"x"
TORRENT_B = b"\0" * 20 + bytes.fromhex("13426974546f7272656e742070726f746f636f6c")
TORRENT_C = bytes.fromhex("4102") + b"ab" + bytes.fromhex("00080000000000000000")
CASES = {
    "spoofed": ({"ip_off": 1}, {}), "erratic": ({"dst_port": 23}, {}), "non_routable": ({"src_ip": address("10.1.2.3")}, {}),
    "large_scale_scan": ({"ttl": 200, "tcp_doff": 5, "tcp_window": 1024}, {"ttl": 199, "tcp_doff": 5, "tcp_window": 1024}), "abnormal_protocol": ({"tcp_flags": 20}, {"tcp_flags": 18}),
    "ttl_200": ({"ttl": 200}, {"ttl": 250} | ICMP), "no_tcp_options": ({"tcp_doff": 5}, {"tcp_doff": 5, "tcp_flags": 18}), "tcpwin_1024": ({"tcp_window": 1024}, {}),
    "fragmented": ({"ip_off": 0x8000}, {"ip_off": 0x4000}), "last_byte_src_0": ({"src_ip": 0x08080800}, {}), "last_byte_src_255": ({"src_ip": 0x080808FF}, {}),
    "same_src_dst": ({"src_ip": 5, "dst_ip": 5}, {}), "udp_port_0": (UDP | {"src_port": 0}, {"src_port": 0}), "tcp_port_0": ({"dst_port": 0}, UDP | {"dst_port": 0}),
    "udp_destport_80": (UDP | {"dst_port": 80}, {"dst_port": 80}), "rfc5735": ({"src_ip": address("192.0.2.255")}, {"src_ip": address("192.0.3.0")}),
    "backscatter": ({"tcp_flags": 18}, {}), "bittorrent": (udp(TORRENT_B), udp(TORRENT_B[:-1])), "udp_0x31": (udp(bytes.fromhex("00000000000000003100"), ip_len=58), udp(bytes.fromhex("00000000000000003100"), ip_len=59)),
    "sip_status": (udp(b"SIP/2.0", src_port=5060, dst_port=5060), udp(b"SIP/2.0", src_port=5060)), "udp_ip_len_96": (UDP | {"ip_len": 96}, {"ip_len": 96}),
    "udp_ip_len_1500": (UDP | {"ip_len": 1500}, {"ip_len": 1500}), "port_53": ({"src_port": 53} | ICMP, {}), "tcp_port_23": ({"src_port": 23}, UDP | {"src_port": 23}),
    "tcp_port_80": ({"dst_port": 80}, {}), "tcp_port_5000": ({"dst_port": 5000}, {}), "dns_resp_non_standard": (udp(DNS, ip_len=43), udp(DNS, ip_len=42)),
    "netbios_query_name": (udp(b"\0" * 12 + bytes.fromhex("20434b4141414141"), src_port=137, dst_port=137), udp(b"\0" * 12, src_port=137, dst_port=137)),
    "not_ip": ({"src_ip": None, "protocol": None, "ethertype": 2054}, {}), "ttl_200_nonspoofed": ({"ttl": 200}, {"ttl": 200, "tcp_doff": 5, "tcp_window": 1024}),
}


def test_one_that_matches_and_one_that_does_not(spark):
    both = [case for name in NAMES for case in CASES[name]]
    rows = with_mask(with_filters(packets(spark, *both))).orderBy("seq").collect()
    for k, name in enumerate(NAMES):
        assert rows[2 * k][name] is True, name
        assert not rows[2 * k + 1][name], name
    for r in rows:
        assert r.filterbits == sum(1 << i for i, n in enumerate(NAMES) if r[n])


def value(spark, name, *cases):
    return [r[0] for r in packets(spark, *cases).orderBy("seq").select(filter_by(name)).collect()]


def test_usual_and_unusual_flags(spark):
    found = value(spark, "abnormal_protocol", *({"tcp_flags": f} for f in range(64)))
    assert {f for f, hit in enumerate(found) if not hit} == {0, 2, 16, 4, 1, 3, 18, 17, 24, 25}
    assert value(spark, "abnormal_protocol", {"tcp_flags": 2 | 64 | 128}, {"protocol": 47}, {"protocol": 41}, UDP, ICMP, {"payload": None}) == [False, True, False, False, False, None]


def test_fragments(spark):
    assert value(spark, "fragmented", *({"ip_off": x} for x in (0x2000, 0x4000, 0x8000, 1, 0))) == [False, False, True, True, False]


def test_edges_of_special_networks(spark):
    for net in filters.SPECIAL:
        start, bits = net.split("/")
        low = address(start)
        high = low + (1 << (32 - int(bits))) - 1
        inside = value(spark, "rfc5735", {"src_ip": low}, {"src_ip": high})
        assert inside == [True, True], net
    outside = ("1.0.0.0", "9.255.255.255", "11.0.0.0", "126.255.255.255", "128.0.0.0", "169.253.255.255", "169.255.0.0", "172.15.255.255", "172.32.0.0", "192.0.1.0", "192.0.3.0", "192.88.98.255", "192.88.100.0", "192.167.255.255", "192.169.0.0", "198.17.255.255", "198.20.0.0", "198.51.99.255", "198.51.101.0", "203.0.112.255", "203.0.114.0", "223.255.255.255")
    assert not any(value(spark, "rfc5735", *({"src_ip": address(a)} for a in outside)))


def test_bittorrent_signatures(spark):
    hits = (udp(bytes.fromhex("64313a7264323a696432303a")), udp(TORRENT_B), udp(TORRENT_C, ip_len=58), udp(bytes.fromhex("3102"), ip_len=48), udp(b"a" * 12 + bytes.fromhex("7fffffffab020400010000000800000000000000"), ip_len=61))
    misses = (udp(b"d1:ad2:id20", ip_len=100), udp(TORRENT_C, ip_len=57), udp(bytes.fromhex("3100"), ip_len=48), udp(b"", ip_len=61))
    assert value(spark, "bittorrent", *hits) == [True] * 5 and value(spark, "bittorrent", *misses) == [False] * 4


def test_missing_headers_are_null(spark):
    short = {"tcp_flags": None, "tcp_window": None, "tcp_doff": None, "l4_len": 3, "src_port": None, "dst_port": None, "payload": None}
    assert value(spark, "tcp_port_0", short) == [None] and value(spark, "tcpwin_1024", short, UDP) == [None, None] and value(spark, "udp_destport_80", short) == [None]
    gone = {"src_ip": None, "dst_ip": None, "protocol": None, "ttl": None, "ip_len": None, "ip_off": None, "l4_len": None, "src_port": None, "dst_port": None} | {k: None for k in ("tcp_flags", "tcp_window", "tcp_doff", "payload")}
    row = with_mask(with_filters(packets(spark, gone))).first()
    assert [n for n in NAMES if row[n]] == ["not_ip"] and row.filterbits == 1 << 28


def test_gate_of_attacks(spark):
    rows = packets(spark, {"tcp_flags": 18}, {"tcp_flags": 4}, {}, UDP | {"src_port": 53}, ICMP | {"src_port": 3}, ICMP | {"src_port": 8}).orderBy("seq").select(filters.is_backscatter()).collect()
    assert [r[0] for r in rows] == [True, True, False, False, True, False]


def test_removal_by_number_and_name(spark):
    df = packets(spark, {"ip_off": 1}, {"dst_port": 23}, {}, {"src_ip": address("10.0.0.1")}, {"ttl": 220, "tcp_doff": 5, "tcp_window": 1024})
    kept = lambda **how: sorted(r.seq for r in df.where(removal(**how)).collect())
    assert kept(spoofed=True) == [1, 2, 3, 4] and kept(erratic=True) == [2, 3] and kept(routed=True) == [3] and kept(not_scan=True) == [4] and len(kept()) == 5
    assert str(filter_by(8)) == str(filter_by("fragmented"))


@pytest.mark.parametrize(("text", "want"), [
    ("tcp", [0, 2]), ("udp port 53", [1]), ("not tcp", [1, 3]), ("src host 8.8.8.8 and tcp", [0]), ("net 44.0.0.0/8", [0, 1, 2]), ("portrange 20-25 or icmp", [2, 3]), ("(udp or icmp) && ! port 53", [3]),
    ("proto 17", [1]), ("greater 1000", [3]), ("less 64 and dst port 22", [2]), ("", [0, 1, 2, 3]), ("src net 9.0.0.0/8 || dst 44.0.0.9", [1, 2]),
])
def test_capture_filters(spark, text, want):
    df = packets(spark, {}, UDP | {"dst_port": 53, "dst_ip": address("44.0.0.9")}, {"dst_port": 22, "src_ip": address("9.1.1.1")}, ICMP | {"dst_ip": 1, "wirelen": 1500})
    assert sorted(r.seq for r in df.where(compile_filter(text)).collect()) == want


@pytest.mark.parametrize("text", ["tcp and", "(tcp", "host", "flub", "port 53 53", "proto zzz", "tcp)"])
def test_bad_capture_filters(spark, text):
    with pytest.raises(ValueError):
        compile_filter(text)


def test_ports(spark):
    rows = spark.range(5).select(port_allowed(F.col("id"), "1,3-9")).collect()
    assert [r[0] for r in rows] == [False, True, False, True, True]
    for bad in ("x", "9-3", "70000"):
        with pytest.raises(ValueError):
            port_allowed(F.lit(1), bad)
