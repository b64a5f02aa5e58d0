"""Every query of the engine against DuckDB, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from netlume.queries import ORACLES, QUERIES

from .oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names and set(entry.oracle_sql()) <= names
    assert entry.entry(spark).limit(1).count() == 1


def test_stages_whose_methods_are_not_compiled_are_left_unfused(spark):
    """The JVM interprets methods over 8,000 bytes; an own, lower limit stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for own, kept in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(limit, own)
            QUERIES["flows"](spark, SF)
            assert spark.conf.get(limit) == kept
    finally:
        spark.conf.set(limit, before)


def test_packets_of_reports_with_rows_of_zeros_are_read_once(spark):
    """Beside the report only the packets' first second and the intervals ask for packets, and just for their times."""
    for name, reads in (("report_protocol", 1), ("run_report", 2)):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_suppkey#") and plan.count("Generate inline(kinds") == 1 and plan.count("Sample 0.0, 1.0") == reads, name


def test_rows_of_zeros(spark):
    """Rows stay as they are, also if they are there twice or hold nulls; others of the classes seen in an interval are zeros."""
    from netlume.operators import report

    schema = "bin_timestamp long, source_label string, metric_name string, metric_value string, src_ip_cnt long, dest_ip_cnt long, pkt_cnt long, byte_cnt long, src_asn_cnt long, metric_class string"
    rows = [(0, "a", "n", "1", 1, 2, 3, 4, 5, "x"), (0, "a", "n", "1", 1, 2, 3, 4, None, "x"), (60, "a", "n", None, 6, 7, 8, 9, 0, "x"), (60, "b", "m", "z", 1, 1, 1, 1, 1, "y")]
    dimension = spark.createDataFrame([("x", "n", "1"), ("x", "n", "2"), ("w", "n", "1")], "metric_class string, metric_name string, metric_value string")
    zeros = [(0, "a", "n", "2"), (60, "a", "n", "1"), (60, "a", "n", "2")]
    want = rows + [(*key, 0, 0, 0, 0, 0, "x") for key in zeros]
    filled = report.zero_filled(spark.createDataFrame(rows, schema), dimension)
    assert filled.columns == report.OUTPUT + ["metric_class"]
    assert sorted(map(str, map(tuple, filled.collect()))) == sorted(map(str, want))
    assert report.zero_filled(spark.createDataFrame([], schema), dimension).count() == 0


def test_filters_are_one_metric_until_they_are_counted(spark):
    """A packet is one value of each kind for all its filters; beside other metrics, and with sampled sources, each filter counts as by itself."""
    from netlume.operators import filters, report
    from netlume.queries import tagged

    packets = tagged(spark, SF, "maxmind", "netacq", "pfx2as")
    assert packets.select(F.size(F.array_compact(report.metrics(["filter"])))).distinct().count() <= 2
    assert packets.select(F.max(F.size(report.metrics(["filter"])))).first()[0] == 1
    rows = lambda limit, **how: sorted(map(tuple, report.report(packets, 600, limit, **how).select(*report.OUTPUT).collect()))
    for how in ({}, {"src_method": "sample", "src_bits": 30}):
        assert rows({"filter", "combined", "protocol"}, **how) == sorted(rows({"filter"}, **how) + rows({"combined", "protocol"}, **how))
    sampled = rows({"filter"}, src_method="sample", src_bits=30)
    turn = F.when(F.col("src_ip").bitwiseAND(3) == F.pmod(F.floor(F.col("bin") / 600), F.lit(4)), F.col("src_ip"))
    one = packets.withColumn("bin", F.col("ts_sec") - F.col("ts_sec") % 600).where(filters.has_bit(F.col("filterbits"), "port_53"))
    want = one.groupBy("bin").agg(F.countDistinct(turn), F.countDistinct("dst_ip"), F.count("*"), F.sum("ip_len"), F.countDistinct("prefix_asn")).collect()
    assert sorted((r[0], *r[4:]) for r in sampled if r[3].endswith("port-53") or r[2].endswith("port-53")) == sorted(map(tuple, want))


def test_reports_look_up_what_they_count(spark):
    for name, lookups in (("report_filters", 1), ("report_combined", 1), ("report_geo", 2), ("run_report", 4)):
        assert QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == lookups, name


def test_flows_are_counted_before_sources_are_looked_up(spark):
    """What is sorted and shuffled has no tags, and sorts begin with a number that few flows share."""
    lines = QUERIES["flows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins, sums = ([k for k, line in enumerate(lines) if word in line] for word in ("Join LeftOuter", "Aggregate ["))
    assert len(joins) == 3 and len(sums) == 1 and max(joins) < sums[0]
    assert lines[sums[0]].partition("Aggregate [")[2].startswith("_")


def test_masks_of_some_filters(spark):
    """Their bits are those of the whole mask, also where headers lack fields, and other bits are 0."""
    from netlume.operators import filters, flows

    from .packets_of import UDP, packets

    scan = {"ttl": 201, "tcp_window": 1024, "tcp_doff": 5}
    odd = packets(spark, scan, scan | {"tcp_doff": None}, scan | {"tcp_window": None}, scan | {"tcp_flags": None}, {"src_ip": None}, UDP | {"ttl": 230, "dst_port": 80}, {"protocol": None}, {"ip_off": 1})
    whole, some = ({r.seq: r.filterbits for r in rows.select("seq", "filterbits").collect()} for rows in (filters.with_mask(odd), filters.with_mask(odd, names=flows.FILTERS)))
    assert some == {seq: bits & filters.bits_of(*flows.FILTERS) for seq, bits in whole.items()} and len(set(some.values())) == 3
