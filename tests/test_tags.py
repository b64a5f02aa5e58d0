"""Flow hash, prefix lookup, losses and intervals against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlume.functions.u32 import dotted, network, parsed, with_flow_hash
from netlume.operators import intervals, tagging

from .packets_of import ICMP, packets

M = 0xFFFFFFFF


def python_hash(src, dst, sport, dport, ttl, flags, proto, length):
    h = src * 59 & M
    for v in (dst, sport << 16, dport, ttl << 24 | flags << 16, proto << 8 | length):
        h ^= ((h << 5) + (h >> 27) + v) & M
    return h


def test_flow_hash(spark):
    rng = random.Random(1)
    tuples = [(0,) * 8, (M, M, 65535, 65535, 255, 255, 255, 65535)]
    tuples += [(rng.randrange(M + 1), rng.randrange(M + 1), rng.randrange(65536), rng.randrange(65536), rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.randrange(65536)) for _ in range(500)]
    df = spark.createDataFrame(tuples, "a long, b long, c int, d int, e int, f int, g int, h int")
    assert [r[0] for r in with_flow_hash(df, "x", *(F.col(x) for x in "abcdefgh")).select("x").collect()] == [python_hash(*t) for t in tuples]
    assert python_hash(*tuples[0]) == 0


def test_addresses(spark):
    r = spark.createDataFrame([(0xC0A80001,)], "a long").select(dotted(F.col("a")), parsed(dotted(F.col("a"))), network(F.col("a"), 20)).first()
    assert tuple(r) == ("192.168.0.1", 0xC0A80001, 0xC0A80000)


prefixes = st.lists(st.tuples(st.integers(0, M), st.integers(0, 32), st.integers(0, 9)), max_size=25)


@given(prefixes, st.lists(st.integers(0, M), max_size=20))
@settings(max_examples=300, deadline=None)
def test_flattened_prefixes_are_the_longest_match(table, addresses):
    ranges = tagging.flatten_prefixes(table)
    for (_, high, _), (low, _, _) in zip(ranges, ranges[1:], strict=False):
        assert high < low
    edges = [x for low, high, _ in ranges for x in (low, high)] + [a & (M << (32 - b)) & M for a, b, _ in table]
    for ip in addresses + edges:
        match = [(b, k, v) for k, (a, b, v) in enumerate(table) if (a ^ ip) >> (32 - b) == 0]
        want = max(match)[2] if match else None
        assert next((v for low, high, v in ranges if low <= ip <= high), None) == want


def test_lookup_plans_a_hash_join_and_doubles_nothing(spark):
    table = [(0x0A000000, 8, "a"), (0x0A010000, 16, "b"), (0x0A010100, 24, "c"), (0, 0, "z")]
    ranges = tagging.range_table(spark, tagging.flatten_prefixes(table), T.StringType())
    df = packets(spark, *({"src_ip": ip} for ip in (0x0A000001, 0x0A01FFFF, 0x0A010101, 0xFFFFFFFF, None)))
    out = tagging.lookup(df, ranges, "place")
    assert [r.place for r in out.orderBy("seq").collect()] == ["a", "b", "c", "z", None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert ranges.table.count() == ranges.size
    big = tagging.lookup(df, tagging.Ranges(ranges.table, tagging.BROADCAST_RANGES + 1), "place")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in big


def test_tags_of_fragments_and_short_packets(spark):
    rows = tagging.tag(packets(spark, {}, {"ip_off": 5}, {"l4_len": 3}, ICMP | {"l4_len": 2, "src_port": 3, "dst_port": 1})).orderBy("seq").collect()
    assert [r.has_basic for r in rows] == [True, False, False, True] and [r.providers_used for r in rows] == [1, 0, 0, 1]
    assert (rows[1].tag_protocol, rows[1].tag_src_port, rows[1].ft_hash) == (0, 0, 0) and (rows[3].tag_src_port, rows[3].tag_dst_port) == (3, 1)


def test_single_origins_and_polygons(spark):
    df = spark.createDataFrame([([1],), ([1, 2],), ([],), (None,)], "a array<long>")
    assert [r[0] for r in df.select(tagging.single_origin(F.col("a"))).collect()] == [1, None, None, None]
    many = spark.createDataFrame([(list(range(12)),), ([1 << 24, (1 << 24) + 7],)], "p array<long>")
    assert [r[0] for r in many.select(tagging.polygon_ids(F.col("p"))).collect()] == [list(range(1, 8)), [(1 << 24) + 7]]


def test_losses(spark):
    numbers = [1, 2, 5, 6, 4, 5, 9]
    rows = [("s", 1, n, k) for k, n in enumerate(numbers)] + [("s", 2, n, k) for k, n in enumerate((2**64 // 2 - 1, 7))] + [("t", 1, 3, 0)]
    got = {(r.stream, r.tagger_id): (r.received, r.lost, r.gaps) for r in tagging.losses(spark.createDataFrame(rows, "stream string, tagger_id int, seqno long, arrival int")).collect()}
    assert got == {("s", 1): (7, 2 + 1 + 3, 3), ("s", 2): (2, 1, 1), ("t", 1): (1, 0, 0)}
    own = tagging.numbered(spark.range(0, 100, 1, 4)).groupBy("tagger_id").agg(F.min("seqno"), F.max("seqno"), F.count("*")).collect()
    assert {tuple(r)[1:] for r in own} == {(1, 25, 25)}


def test_intervals(spark):
    df = packets(spark, *({"ts_sec": t} for t in (65, 119, 120, 301, 358)))
    got = [tuple(r) for r in intervals.intervals(df, 60).orderBy("interval_ts").collect()]
    assert got == [(65, 55, 2, False), (120, 60, 1, True), (180, 60, 0, True), (240, 60, 0, True), (300, 59, 2, True)]
    short = [tuple(r) for r in intervals.intervals(packets(spark, {"ts_sec": 60}, {"ts_sec": 117}), 60).collect()]
    assert short == [(60, 58, 2, False)]
    assert intervals.intervals(df.limit(0)).count() == 0 and intervals.first_second(df) == 65
    assert sorted({r.interval_ts for r in intervals.assigned(df, 60, 65).collect()}) == [65, 120, 300]


def test_late_packets(spark):
    rows = [("a", k, t) for k, t in enumerate((10, 70, 59, 61, 130, 100))] + [("b", 9, 5)]
    got = intervals.late(spark.createDataFrame(rows, "stream string, arrival int, ts_sec long")).where("late").collect()
    assert sorted(r.ts_sec for r in got) == [59, 100]
