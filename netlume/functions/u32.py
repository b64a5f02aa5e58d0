"""Columns that behave like unsigned 32-bit numbers, and addresses made of them.

Addresses and hashes are longs from 0 to 2**32 - 1; every step is masked, so
nothing overflows and order and division are those of unsigned numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def shl(x: Column, n: int) -> Column:
    return u32(F.shiftleft(x, n))


def dotted(ip: Column) -> Column:
    """An address as four decimal numbers."""
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def parsed(text: Column) -> Column:
    """The number of a dotted address."""
    parts = F.split(text, r"\.")
    return sum((F.shiftleft(parts[j].cast("long"), 24 - 8 * j) for j in range(4)), F.lit(0).cast("long"))


def network(ip: Column, bits: int) -> Column:
    """An address without the last 32 - ``bits`` bits."""
    return ip.bitwiseAND(F.lit(MASK - (1 << (32 - bits)) + 1))


def within(ip: Column, cidr: str) -> Column:
    """Whether an address is in a network such as ``10.0.0.0/8``."""
    address, _, bits = cidr.partition("/")
    low = 0
    for part in address.split("."):
        low = low * 256 + int(part)
    low &= MASK - (1 << (32 - int(bits or 32))) + 1
    return ip.between(F.lit(low), F.lit(low + (1 << (32 - int(bits or 32))) - 1))


def with_flow_hash(df: DataFrame, column: str, src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, ttl: Column, flags: Column, protocol: Column, length: Column) -> DataFrame:
    """``df`` with the 32-bit hash of a flow: from 59 times the source on, each word of the other fields is mixed in by shifting, adding and XOR.

    Each step is a column of its own: as one expression, with the hash so far
    three times in every step, it would have 243 copies of the first one.
    """
    long = lambda c: c.cast("long")
    words = [
        long(dst_ip), F.shiftleft(long(src_port), 16), long(dst_port),
        F.shiftleft(long(ttl), 24).bitwiseOR(F.shiftleft(long(flags), 16)), F.shiftleft(long(protocol), 8).bitwiseOR(long(length)),
    ]
    df, h = df.withColumn(column, u32(long(src_ip) * 59)), F.col(column)
    for word in words:
        df = df.withColumn(column, h.bitwiseXOR(u32(shl(h, 5) + F.shiftright(h, 27) + word)))
    return df
