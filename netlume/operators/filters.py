"""The thirty packet filters, each a Column of the packet relation.

A filter is true, false, or null where the header that it needs is missing.
Filters have the numbers 0 to 29, and bit i of a mask is filter i.  They are
plain expressions: a query computes the ones that it names and no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.u32 import within

#: The names of the filters by number.
NAMES = (
    "spoofed", "erratic", "non_routable", "large_scale_scan", "abnormal_protocol", "ttl_200", "no_tcp_options", "tcpwin_1024", "fragmented", "last_byte_src_0", "last_byte_src_255",
    "same_src_dst", "udp_port_0", "tcp_port_0", "udp_destport_80", "rfc5735", "backscatter", "bittorrent", "udp_0x31", "sip_status", "udp_ip_len_96", "udp_ip_len_1500", "port_53",
    "tcp_port_23", "tcp_port_80", "tcp_port_5000", "dns_resp_non_standard", "netbios_query_name", "not_ip", "ttl_200_nonspoofed",
)
#: Special-purpose networks.
SPECIAL = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
SYN, ACK, RST = 2, 16, 4
#: Sets of TCP flags that are usual (S, A, R, F, SF, SA, FA, AP, FAP), and ICMP types that answer something.
USUAL_FLAGS = (2, 16, 4, 1, 3, 18, 17, 24, 25)
ANSWERS = (0, 3, 4, 5, 11, 12, 14, 16, 18)

c = F.col

def has_ip() -> Column:
    return c("src_ip").isNotNull()


def _tcp() -> Column:
    return has_ip() & (c("protocol") == 6) & c("tcp_flags").isNotNull()


def _udp() -> Column:
    return has_ip() & (c("protocol") == 17) & (c("l4_len") >= 8)


def _icmp() -> Column:
    return has_ip() & (c("protocol") == 1) & (c("l4_len") >= 2)


def _ports() -> Column:
    return has_ip() & (c("l4_len") >= 4)


def _needs(header: Column, test: Column) -> Column:
    return F.when(header, F.coalesce(test, F.lit(False)))


def _flag(bits: int) -> Column:
    return c("tcp_flags").bitwiseAND(bits) != 0


def _payload(at: int, value: str) -> Column:
    """Whether the payload has these bytes (hex) from ``at`` on; what ends before has not."""
    return F.substring("payload", at + 1, len(value) // 2) == F.unhex(F.lit(value))


def _payload_in(at: int, *values: str) -> Column:
    return reduce(Column.__or__, (_payload(at, v) for v in values))


def _payload_number(at: int) -> Column:
    """Two bytes of the payload as a number."""
    return F.conv(F.hex(F.substring("payload", at + 1, 2)), 16, 10).cast("int")


def _port(n: int) -> Column:
    return (c("src_port") == n) | (c("dst_port") == n)


def _any(*filters: Column) -> Column:
    """True if any is; false or null otherwise, which ``_needs`` and CASE take for the same."""
    return reduce(Column.__or__, filters)


#: Bytes of peer-to-peer messages, in hexadecimal.
TORRENT_HANDSHAKE = "13426974546f7272656e742070726f746f636f6c"
TORRENT_SHORT = "7fffffffab020400010000000800000000000000"


def _bittorrent() -> Column:
    head = _payload_in(0, "64313a61", "64313a72") & _payload(4, "64323a69") & _payload(8, "6432303a")
    end = F.substring("payload", -10, 10) == F.unhex(F.lit("00080000000000000000"))
    return reduce(Column.__or__, (
        (c("udp_len") >= 20) & (c("payload_len") >= 12) & head,
        (c("udp_len") >= 48) & (c("payload_len") >= 40) & _payload(20, TORRENT_HANDSHAKE),
        (c("ip_len") >= 58) & _payload_in(0, "4102", "2102", "3102", "1102") & (c("payload_len") >= 10) & (c("payload_len") >= c("udp_len") - 8) & end,
        (c("ip_len") == 48) & _payload_in(0, "4100", "2100", "3102", "1100"),
        (c("ip_len") == 61) & _payload(12, TORRENT_SHORT),
    ))


def _dns() -> Column:
    numbers = reduce(Column.__and__, (_payload_number(at) < 10 for at in (4, 6, 8, 10)))
    return (c("ip_len") > 42) & (c("payload_len") >= 12) & (_payload_number(2).bitwiseAND(0xFFF0) == 0x8180) & numbers


def filters() -> dict[str, Column]:
    """All filters by name, in the order of their numbers."""
    f: dict[str, Column] = {}
    usual = c("tcp_flags").bitwiseAND(63).isin(*USUAL_FLAGS)
    f["abnormal_protocol"] = (
        F.when(~has_ip(), None).when(c("protocol").isin(1, 17, 41), False).when(c("protocol") != 6, True)
        .when(c("tcp_flags").isNull() | c("payload").isNull(), None).otherwise((c("tcp_flags").bitwiseAND(63) != 0) & ~usual)
    )
    f["ttl_200"] = _needs(has_ip(), (c("protocol") != 1) & (c("ttl") >= 200))
    syn_only = _flag(SYN) & ~_flag(ACK)
    f["no_tcp_options"] = _needs(_tcp(), syn_only & (c("tcp_doff") == 5))
    f["tcpwin_1024"] = _needs(_tcp(), syn_only & (c("tcp_window") == 1024))
    f["fragmented"] = _needs(has_ip(), c("ip_off").bitwiseAND(0x9FFF) != 0)
    f["last_byte_src_0"] = _needs(has_ip(), c("src_ip").bitwiseAND(255) == 0)
    f["last_byte_src_255"] = _needs(has_ip(), c("src_ip").bitwiseAND(255) == 255)
    f["same_src_dst"] = _needs(has_ip(), c("src_ip") == c("dst_ip"))
    f["udp_port_0"] = F.when(has_ip() & (c("protocol") != 17), False).when(_ports(), _port(0))
    f["tcp_port_0"] = F.when(has_ip() & (c("protocol") != 6), False).when(_ports(), _port(0))
    f["udp_destport_80"] = _needs(_udp(), c("dst_port") == 80)
    f["rfc5735"] = _needs(has_ip(), reduce(Column.__or__, (within(c("src_ip"), net) for net in SPECIAL)))
    f["backscatter"] = (
        F.when(~has_ip(), None).when(c("protocol") == 17, _needs(_udp(), c("src_port") == 53)).when(c("protocol") == 1, _needs(_icmp(), c("src_port").isin(*ANSWERS)))
        .when(c("protocol") == 6, _needs(_tcp() & c("payload").isNotNull(), (_flag(SYN) & _flag(ACK)) | _flag(RST))).otherwise(False)
    )
    f["bittorrent"] = _needs(_udp() & c("payload").isNotNull(), _bittorrent())
    f["udp_0x31"] = _needs(_udp() & c("payload").isNotNull(), (c("payload_len") >= 10) & (c("ip_len") == 58) & _payload(0, "00000000000000003100"))
    f["sip_status"] = _needs(_udp() & c("payload").isNotNull(), (c("payload_len") >= 7) & (c("src_port") == 5060) & (c("dst_port") == 5060) & _payload(0, b"SIP/2.0".hex()))
    f["udp_ip_len_96"] = _needs(has_ip(), (c("protocol") == 17) & (c("ip_len") == 96))
    f["udp_ip_len_1500"] = _needs(has_ip(), (c("protocol") == 17) & (c("ip_len") == 1500))
    f["port_53"] = _needs(has_ip(), _port(53))
    for n in (23, 80, 5000):
        f[f"tcp_port_{n}"] = _needs(_tcp(), _port(n))
    f["dns_resp_non_standard"] = _needs(_udp() & c("payload").isNotNull(), _dns())
    netbios = (c("src_port") == 137) & (c("dst_port") == 137) & (c("ip_len") > 48) & (c("payload_len") >= 20) & _payload(12, "20434b4141414141")
    f["netbios_query_name"] = _needs(_udp() & c("payload").isNotNull(), netbios)
    f["not_ip"] = ~has_ip()
    scan = syn_only & (c("tcp_doff") == 5) & (c("tcp_window") == 1024)
    f["ttl_200_nonspoofed"] = _needs(has_ip(), (c("protocol") != 1) & (c("ttl") >= 200) & ((c("protocol") != 6) | c("tcp_flags").isNull() | ~scan))
    of = lambda *names: _needs(has_ip(), _any(*(f[n] for n in names)))
    f["spoofed"] = of(*_SPOOFED)
    f["erratic"] = of(*_ERRATIC)
    f["non_routable"] = f["rfc5735"]
    f["large_scale_scan"] = _needs(has_ip(), (c("protocol") == 6) & (c("ttl") >= 200) & scan)
    return {name: f[name] for name in NAMES}


def filter_by(name_or_number: str | int) -> Column:
    """One filter, by name or number."""
    return filters()[NAMES[name_or_number] if isinstance(name_or_number, int) else name_or_number]


def with_filters(packets: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``packets`` with a boolean column for each filter, or for those named."""
    made = filters()
    return packets.withColumns({n: made[n] for n in names or NAMES})


AT_ONCE = 5
"""Filters in one generated method; the JVM doesn't compile methods of more than 8,000 bytes."""
_SPOOFED = ("abnormal_protocol", "ttl_200_nonspoofed", "fragmented", "last_byte_src_0", "last_byte_src_255", "same_src_dst", "udp_port_0", "tcp_port_0", "udp_destport_80")
_ERRATIC = (
    "spoofed", "ttl_200", "udp_0x31", "sip_status", "udp_ip_len_96", "udp_ip_len_1500", "port_53", "tcp_port_23", "tcp_port_80", "tcp_port_5000", "dns_resp_non_standard",
    "netbios_query_name", "backscatter", "bittorrent",
)
#: Filters that are made of others.
COMPOSED = ("spoofed", "erratic", "non_routable", "large_scale_scan", "ttl_200_nonspoofed")
_SCAN = ("ttl_200", "tcpwin_1024", "no_tcp_options")
_PARTS = {"spoofed": (*_SPOOFED, *_SCAN), "erratic": (*_SPOOFED, *_ERRATIC), "non_routable": ("rfc5735",), "large_scale_scan": _SCAN, "ttl_200_nonspoofed": _SCAN}


def bits_of(*names: str) -> int:
    return sum(1 << NAMES.index(n) for n in names)


def with_mask(packets: DataFrame, column: str = "filterbits", names: tuple[str, ...] = NAMES) -> DataFrame:
    """``packets`` with the mask of all filters, or of those named: the bits of others are 0, and only what the named ones are made of is computed.

    The filters that look at packets give a mask first; the composed ones
    are tests of that mask, so no filter is computed twice.
    """
    needed = {part for n in names for part in _PARTS.get(n, (n,))}
    simple = [F.when(f, F.lit(1 << NAMES.index(n))).otherwise(F.lit(0).cast("long")) for n, f in filters().items() if n in needed and n not in COMPOSED]
    first = packets.withColumn("_simple", F.lit(0).cast("long"))
    for k in range(0, len(simple), AT_ONCE):
        # The mask so far is used twice, so Catalyst keeps this step a projection, and its code a method, of its own.
        so_far = F.col("_simple")
        first = first.withColumn("_simple", so_far.bitwiseOR(F.when(so_far >= 0, reduce(Column.bitwiseOR, simple[k : k + AT_ONCE])).otherwise(F.lit(0).cast("long"))))
    m = F.col("_simple")
    any_in = lambda *names: m.bitwiseAND(F.lit(bits_of(*names))) != 0
    scan = m.bitwiseAND(F.lit(bits_of(*_SCAN)))
    old = bits_of("ttl_200")
    nonspoofed = scan.isin(old, old | bits_of("tcpwin_1024"), old | bits_of("no_tcp_options"))
    tests = {
        "spoofed": any_in(*(n for n in _SPOOFED if n not in COMPOSED)) | nonspoofed, "erratic": any_in(*(n for n in (*_SPOOFED, *_ERRATIC) if n not in COMPOSED)),
        "non_routable": any_in("rfc5735"), "large_scale_scan": scan == bits_of(*_SCAN), "ttl_200_nonspoofed": nonspoofed,
    }
    composed = (F.when(test, F.lit(1 << NAMES.index(n))).otherwise(F.lit(0).cast("long")) for n, test in tests.items() if n in names)
    asked = m if set(names) == set(NAMES) else m.bitwiseAND(F.lit(bits_of(*names)))
    return first.withColumn(column, reduce(Column.bitwiseOR, composed, asked)).drop("_simple")


def has_bit(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << NAMES.index(name))) != 0


def removal(spoofed: bool = False, erratic: bool = False, routed: bool = False, not_scan: bool = False) -> Column:
    """Which packets stay: ``spoofed`` and ``erratic`` remove such packets, ``routed`` keeps only non-routable sources, ``not_scan`` only large-scale scans.

    These are predicates of the packets themselves, so they are pushed down to
    the source and computed before any mask or tag.
    """
    f, keep = filters(), F.lit(True)
    if spoofed:
        keep &= ~F.coalesce(f["spoofed"], F.lit(False))
    if erratic:
        keep &= ~F.coalesce(f["erratic"], F.lit(False))
    if routed:
        keep &= F.coalesce(f["non_routable"], F.lit(False))
    if not_scan:
        keep &= F.coalesce(f["large_scale_scan"], F.lit(False))
    return keep


def all_of(*predicates: str) -> Column:
    """Custom filters: packets that pass every predicate (see ``functions.bpf``)."""
    from ..functions.bpf import compile_filter

    return reduce(Column.__and__, (F.coalesce(compile_filter(p), F.lit(False)) for p in predicates))


def any_of(*predicates: str) -> Column:
    """Custom filters: packets that pass one predicate at least."""
    from ..functions.bpf import compile_filter

    return reduce(Column.__or__, (F.coalesce(compile_filter(p), F.lit(False)) for p in predicates))


def is_backscatter() -> Column:
    """The gate of attack detection: TCP with SYN and ACK or with RST, and ICMP answers; unlike the filter never UDP."""
    tcp = (c("protocol") == 6) & (c("l4_len") >= 4) & ((_flag(SYN) & _flag(ACK)) | _flag(RST))
    icmp = (c("protocol") == 1) & (c("l4_len") >= 2) & c("src_port").isin(*ANSWERS)
    return F.coalesce(has_ip() & (tcp | icmp), F.lit(False))


def within_time(start: int | None = None, end: int | None = None) -> Column:
    """Packets from ``start`` on and before ``end`` (seconds); either may be open."""
    keep = F.lit(True)
    if start:
        keep &= c("ts_sec") >= start
    if end:
        keep &= c("ts_sec") < end
    return keep


def port_allowed(port: Column, allowed: str | None) -> Column:
    """Whether a port is in a list such as ``"22,80,1000-1010"``; without a list all are."""
    if not allowed:
        return F.lit(True)
    tests = []
    for part in allowed.replace(" ", "").split(","):
        low, _, high = part.partition("-")
        if not low.isdigit() or not 0 <= int(low) <= int(high or low) <= 65535:
            raise ValueError(f"not a port or a range of ports: {part!r}")
        tests.append(port.between(int(low), int(high or low)))
    return reduce(Column.__or__, tests)
