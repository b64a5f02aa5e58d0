"""Parts of the packets, worked on alone and put together, give what all packets give."""

import pytest
from pyspark.sql import functions as F

from netlume.operators import archive, flows, report, tagging
from netlume.sources.packets import synthetic_packets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tagged(spark):
    return tagging.tag(synthetic_packets(spark, SF)).cache()


def parts(tagged, n=3):
    return [tagged.where(F.pmod(F.xxhash64("src_ip", "seq"), F.lit(n)) == k) for k in range(n)]


def test_flows(tagged):
    whole = flows.flows(tagged, 600)
    merged = flows.merged(*(flows.flows(p, 600) for p in parts(tagged)))
    keys = ["time", *flows.KEY, "tcp_synlen", "tcp_synwinlen"]
    count = lambda df: sorted(map(tuple, df.groupBy(*keys[:9]).agg(F.sum("packet_cnt")).collect()))
    assert count(whole) == count(merged) and merged.groupBy(*keys).count().where("count > 1").count() == 0


def test_reports(tagged):
    limit = {"protocol", "tcp_dst_port", "filter"}
    rows = None
    for p in parts(tagged):
        part = report.report(p, 600, limit)
        rows = part if rows is None else rows.unionByName(part)
    keys = ["bin_timestamp", "metric_name", "metric_value"]
    sums = lambda df: sorted(map(tuple, df.groupBy(*keys).agg(F.sum("pkt_cnt"), F.sum("byte_cnt")).collect()))
    assert sums(report.report(tagged, 600, limit)) == sums(rows)


def test_chronological(tagged):
    a, b, c = parts(tagged)
    rows = [(r.ts_sec, r.ts_usec, r.input_idx, r.seq) for r in archive.chronological(a, b, c).collect()]
    assert rows == sorted(rows) and len(rows) == tagged.count()


def test_sampling_is_repeatable(tagged):
    rows = flows.flows(tagged)
    some = flows.sampled(rows, 3000)
    assert 0.2 < some.count() / rows.count() < 0.4 and sorted(map(str, some.collect())) == sorted(map(str, flows.sampled(rows, 3000).collect()))
    assert flows.sampled(rows, 10000).count() == rows.count() and flows.sampled(rows, 0).count() == 0 and flows.sampled(rows, 5000, 1).count() > 0


def test_metric_choices():
    assert "filter" not in report.chosen() and report.chosen({"asn"}) == ["asn"]
    assert report.chosen({"netacq_country", "netacq_region"}, geo_lite=True) == ["netacq_country"] and "netacq_region" in report.chosen(None, geo_lite=True)
    with pytest.raises(ValueError):
        report.chosen({"nothing"})
