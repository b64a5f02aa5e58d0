"""Packet predicates in the capture filter language, as Columns.

The subset: ``ip``, ``ip6``, ``tcp``, ``udp``, ``icmp``, ``[ip] proto N``,
``ether proto N``, ``[src|dst] host A``, ``[src|dst] net A/N`` (or ``A mask M``),
``[src|dst] port N``, ``[src|dst] portrange N-M``, ``less N``, ``greater N``,
``not``/``!``, ``and``/``&&``, ``or``/``||``, parentheses, and comparisons of
the header fields that packets have as columns: ``tcp[13] & 2 != 0``,
``tcp[tcpflags] & (tcp-syn|tcp-ack) == tcp-syn``, ``ip[8] < 64``, ``ip[2:2] > 60``.
As in that language ``and`` and ``or`` bind alike, from the left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .u32 import within

_TOKEN = re.compile(r"\s*(&&|\|\||<=|>=|!=|==|[()\[\]!=<>&|]|[\w./:-]+)")
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17}
#: Header fields by protocol, offset and size, and the names of offsets and values.
FIELDS = {
    ("ip", 2, 2): "ip_len", ("ip", 6, 2): "ip_off", ("ip", 8, 1): "ttl", ("ip", 9, 1): "protocol", ("ip", 12, 4): "src_ip", ("ip", 16, 4): "dst_ip", ("tcp", 0, 2): "src_port", ("tcp", 2, 2): "dst_port",
    ("tcp", 13, 1): "tcp_flags", ("tcp", 14, 2): "tcp_window", ("udp", 0, 2): "src_port", ("udp", 2, 2): "dst_port", ("udp", 4, 2): "udp_len", ("icmp", 0, 1): "src_port", ("icmp", 1, 1): "dst_port",
}
OFFSETS = {"tcpflags": 13, "icmptype": 0, "icmpcode": 1}
VALUES = {"tcp-fin": 1, "tcp-syn": 2, "tcp-rst": 4, "tcp-push": 8, "tcp-ack": 16, "tcp-urg": 32, "icmp-echoreply": 0, "icmp-unreach": 3, "icmp-echo": 8, "icmp-timxceed": 11}


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r} in {text!r}")
            self.tokens.append({"!": "not", "&&": "and", "||": "or"}.get(m[1], m[1]))
            at = m.end()
        self.at = 0

    def next(self) -> str:
        if self.at == len(self.tokens):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def expression(self) -> Column:
        left = self.term()
        while self.peek() in ("and", "or"):
            left = left & self.term() if self.next() == "and" else left | self.term()
        return left

    def term(self) -> Column:
        token = self.next()
        if token == "not":
            return ~F.coalesce(self.term(), F.lit(False))
        if token == "(":
            inside = self.expression()
            if self.next() != ")":
                raise ValueError(f"a parenthesis is open in {self.text!r}")
            return inside
        return self.primitive(token)

    def number(self) -> int:
        """A number or a name of one, or several joined by ``|``."""
        token = self.next()
        if token == "(":
            out = self.number()
            if self.next() != ")":
                raise ValueError(f"a parenthesis is open in {self.text!r}")
        elif token in VALUES:
            out = VALUES[token]
        else:
            out = int(token, 0)
        if self.peek() == "|":
            self.next()
            out |= self.number()
        return out

    def comparison(self, protocol: str) -> Column:
        """What comes after a protocol: ``[offset:size]``, a mask if any, and what the field is compared with."""
        self.next()
        offset, _, size = self.next().partition(":")
        key = (protocol, OFFSETS[offset] if offset in OFFSETS else int(offset), int(size or 1))
        if self.next() != "]" or key not in FIELDS:
            raise ValueError(f"no column for a field in {self.text!r}")
        field = F.col(FIELDS[key]).cast("long")
        if self.peek() == "&":
            self.next()
            field = field.bitwiseAND(F.lit(self.number()).cast("long"))
        how, value = self.next(), F.lit(self.number())
        tests = {"=": field == value, "==": field == value, "!=": field != value, "<": field < value, ">": field > value, "<=": field <= value, ">=": field >= value}
        if how not in tests:
            raise ValueError(f"no such comparison: {how!r} in {self.text!r}")
        return F.col("src_ip").isNotNull() & (F.col("protocol") == PROTOCOLS[protocol] if protocol in PROTOCOLS else F.lit(True)) & tests[how]

    def primitive(self, token: str) -> Column:
        ip = F.col("src_ip").isNotNull()
        if self.peek() == "[":
            return self.comparison(token)
        if token in ("ip", "ether") and self.peek() == "proto":
            if token == "ip":
                return self.primitive(self.next())
            self.next()
            names = {"ip": 0x0800, "arp": 0x0806, "ip6": 0x86DD}
            name = self.next()
            return F.col("ethertype") == (names[name] if name in names else int(name, 0))
        if token == "ip":
            return ip
        if token == "ip6":
            return F.col("ethertype") == 0x86DD
        if token in PROTOCOLS:
            test = ip & (F.col("protocol") == PROTOCOLS[token])
            return test & self.primitive(self.next()) if self.peek() in ("src", "dst", "port", "portrange") else test
        if token == "proto":
            name = self.next()
            if name not in PROTOCOLS and not name.isdigit():
                raise ValueError(f"unknown protocol {name!r} in {self.text!r}")
            return ip & (F.col("protocol") == int(PROTOCOLS.get(name, name)))
        if token in ("less", "greater"):
            return F.col("wirelen") <= int(self.next()) if token == "less" else F.col("wirelen") >= int(self.next())
        sides = [token] if token in ("src", "dst") else ["src", "dst"]
        if token in ("src", "dst"):
            token = self.next()
        value = self.next() if token in ("host", "net", "port", "portrange") else token
        if token == "net" and self.peek() == "mask":
            self.next()
            mask = int.from_bytes(bytes(map(int, self.next().split("."))))
            value = f"{value}/{mask.bit_count()}"
        if token in ("port", "portrange"):
            low, _, high = value.partition("-")
            carries = F.col("protocol").isin(6, 17) & (F.col("l4_len") >= 4)
            tests = [carries & F.col(f"{s}_port").between(int(low), int(high or low)) for s in sides]
        elif re.fullmatch(r"\d+(\.\d+){3}(/\d+)?", value):
            tests = [within(F.col(f"{s}_ip"), value) for s in sides]
        else:
            raise ValueError(f"unknown word {value!r} in {self.text!r}")
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def compile_filter(text: str, known: bool = True) -> Column:
    """The predicate as a Column that is true or false, never null.

    Without ``known`` it may be null for false, which is the same to ``where``;
    then Catalyst pushes its parts down to the source like any others.
    """
    parser = _Parser(text)
    if not parser.tokens:
        return F.lit(True)
    out = parser.expression()
    if parser.peek() is not None:
        raise ValueError(f"{parser.peek()!r} is left over in {text!r}")
    return F.coalesce(out, F.lit(False)) if known else out
