"""Metrics by interval: packets, bytes, and exact numbers of sources, destinations and source ASNs.

A packet counts for many metrics at once, and for the values of three kinds in
each.  Metrics are numbers while they are counted; only the few rows of a
result get names.  Packets fan out where they are, and map-side sums by
(interval, metric, kind, value) collapse what repeats before the one shuffle
that removes repetitions, which spreads even a metric that every packet has
over all its addresses; a second one, of counts, ends it.  Filters are one
metric until then, whose values keep the bits of all filters that they passed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.u32 import network
from .filters import NAMES, bits_of, port_allowed
from .intervals import INTERVAL, assigned
from .tagging import polygon_ids

#: How metrics are called.
CLASSES = {
    "combined": "overall", "maxmind_continent": "geo.maxmind", "maxmind_country": "geo.maxmind", "netacq_continent": "geo.netacuity", "netacq_country": "geo.netacuity",
    "netacq_region": "geo.netacuity", "netacq_polygon": "geo.netacuity", "asn": "routing.asn", "protocol": "traffic.protocol", "icmp": "traffic.icmp",
    "tcp_src_port": "traffic.port.tcp.src_port", "tcp_dst_port": "traffic.port.tcp.dst_port", "udp_src_port": "traffic.port.udp.src_port", "udp_dst_port": "traffic.port.udp.dst_port",
    "filter": "filter-criteria",
}
#: What filters 4 to 28 are called in reports.
FILTER_LABELS = {
    "abnormal_protocol": "non-spoofed.abnormal-protocol", "ttl_200": "non-spoofed.ttl-200", "no_tcp_options": "scan.no-tcp-options", "tcpwin_1024": "scan.tcp-win-1024",
    "fragmented": "non-spoofed.fragmented-v2", "last_byte_src_0": "non-spoofed.last-byte-src-0", "last_byte_src_255": "non-spoofed.last-byte-src-255",
    "same_src_dst": "non-spoofed.same-src-dst", "udp_port_0": "non-spoofed.udp-port-0", "tcp_port_0": "non-spoofed.tcp-port-0", "udp_destport_80": "non-spoofed.udp-destport-80",
    "rfc5735": "non-routed.rfc5735", "backscatter": "non-erratic.backscatter", "bittorrent": "non-erratic.bittorrent", "udp_0x31": "non-erratic.udp-0x31",
    "sip_status": "non-erratic.sip-status", "udp_ip_len_96": "non-erratic.udp-ip-len-96", "udp_ip_len_1500": "non-erratic.udp-ip-len-1500", "port_53": "non-erratic.port-53",
    "tcp_port_23": "non-erratic.tcp-port-23", "tcp_port_80": "non-erratic.tcp-port-80", "tcp_port_5000": "non-erratic.tcp-port-5000",
    "dns_resp_non_standard": "non-erratic.dns-resp-non-standard-v2", "netbios_query_name": "non-erratic.netbios-query-name", "not_ip": "not-ip", "ttl_200_nonspoofed": "unexpected",
}
#: Continents.
CONTINENTS = ("??", "AF", "AN", "AS", "EU", "NA", "OC", "SA")
ALL = tuple(k for k in CLASSES if k != "filter")
OUTPUT = ["bin_timestamp", "source_label", "metric_name", "metric_value", "src_ip_cnt", "dest_ip_cnt", "pkt_cnt", "byte_cnt", "src_asn_cnt"]
UNLABELED = "unlabeled"
_GEO = {"maxmind_continent", "maxmind_country", "netacq_continent", "netacq_country", "netacq_region", "netacq_polygon"}


_ID = {name: k for k, name in enumerate(CLASSES)}
_SEPARATOR = "\x1f"
_LABELS = tuple(FILTER_LABELS.values())
MASKS = 3
"""The kind of values that are the bits of filters that a packet passed."""


def _metric(name: str, when: Column, number: Column | None = None, place: Column | None = None) -> Column:
    """A metric of a packet, as its class and a number or a place, null where it has none."""
    number = F.lit(0) if number is None else number
    place = F.lit(None) if place is None else place
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(_ID[name]).cast("byte").alias("id"), number.cast("long").alias("number"), place.cast("string").alias("place")))


def _named(rows: DataFrame) -> DataFrame:
    """Rows with metric_class, metric_name and metric_value in place of id, number and place."""
    ident, number, place = F.col("id"), F.col("number"), F.col("place")
    base = F.element_at(F.array(*map(F.lit, CLASSES.values())), ident.cast("int") + 1)
    countries = ident.isin(*(k for n, k in _ID.items() if n.endswith("_country")))
    value = (
        F.when(ident == _ID["combined"], F.lit(""))
        .when(ident == _ID["icmp"], F.concat(F.lit("type."), F.shiftright(number, 16).cast("string"), F.lit(".code."), number.bitwiseAND(0xFFFF).cast("string")))
        .when(ident == _ID["filter"], F.element_at(F.array(*map(F.lit, _LABELS)), F.when(ident == _ID["filter"], number + 1).otherwise(1).cast("int")))
        .when(place.isNotNull(), F.substring_index(place, _SEPARATOR, -1)).otherwise(number.cast("string"))
    )
    name = F.when(countries, F.concat_ws(".", base, F.substring_index(place, _SEPARATOR, 1))).otherwise(base)
    return rows.withColumns({"metric_class": F.element_at(F.array(*map(F.lit, CLASSES)), ident.cast("int") + 1), "metric_name": name, "metric_value": value}).drop("id", "number", "place")


def _split(label: Column) -> tuple[Column, Column]:
    """What is before and after the last dot of a label."""
    return F.regexp_extract(label, r"^(.*)\.[^.]*$", 1), F.substring_index(label, ".", -1)


def chosen(limit: set[str] | None = None, geo_lite: bool = False) -> list[str]:
    """The metric classes that are reported: all but filters, or those of ``limit``; lite leaves out regions and polygons if it names any geography."""
    names = list(ALL) if not limit else [k for k in CLASSES if k in limit]
    if unknown := set(limit or ()) - set(CLASSES):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    return [k for k in names if not (geo_lite and limit and limit & _GEO and k in ("netacq_region", "netacq_polygon"))]


def _passed() -> Column:
    """The bits of the filters with a label."""
    return F.coalesce(F.col("filterbits").bitwiseAND(F.lit(bits_of(*FILTER_LABELS))), F.lit(0).cast("long"))


def _by_filter(values: DataFrame) -> DataFrame:
    """Numbers of values by metric and kind, the filters apart again.

    Few bits differ, so what is summed by them before they are taken apart is
    small.  Packets and bytes are those of kind 0, those of filters of MASKS.
    """
    metric, own = ["interval_ts", "id", "number", "place"], F.col("id") == _ID["filter"]
    bits = F.when(F.col("kind") == MASKS, F.col("value")).otherwise(F.col("bits"))
    few = values.groupBy(*metric, "kind", bits.alias("bits")).agg(F.count("value").alias("n"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"))
    each = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(bits_of(n))) != 0, F.lit(k).cast("long")) for k, n in enumerate(FILTER_LABELS))))
    apart = few.withColumn("number", F.explode(F.when(own, each).otherwise(F.array("number"))))
    number = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    counted = lambda name: F.sum(F.when(~own | (F.col("kind") == MASKS), F.col(name)).otherwise(0))
    return apart.groupBy(*metric).agg(number(0).alias("src_ip_cnt"), number(1).alias("dest_ip_cnt"), counted("pkts").alias("pkt_cnt"), counted("bytes").alias("byte_cnt"), number(2).alias("src_asn_cnt"))


def metrics(names: list[str], ports: dict[str, str] | None = None) -> Column:
    """The array of a tagged packet's metrics, null where it has one not; all filters are one.  ``ports``: allow-lists for tcp_src_port and so on."""
    c = F.col
    tagged, made = c("has_basic"), []
    if "combined" in names:
        made.append(_metric("combined", F.lit(True)))
    if "protocol" in names:
        made.append(_metric("protocol", tagged, c("tag_protocol")))
    if "icmp" in names:
        code = c("tag_src_port").cast("long") * 65536 + c("tag_dst_port")
        made.append(_metric("icmp", tagged & (c("tag_protocol") == 1) & ~((c("tag_src_port") == 255) & (c("tag_dst_port") == 255)), code))
    for protocol, number in (("tcp", 6), ("udp", 17)):
        for side in ("src", "dst"):
            if (name := f"{protocol}_{side}_port") in names:
                port = c(f"tag_{side}_port")
                made.append(_metric(name, tagged & (c("tag_protocol") == number) & port_allowed(port, (ports or {}).get(name)), port))
    for provider in ("maxmind", "netacq"):
        there = c(provider).isNotNull()
        if f"{provider}_continent" in names:
            made.append(_metric(f"{provider}_continent", there, place=c(f"{provider}.continent")))
        if f"{provider}_country" in names:
            made.append(_metric(f"{provider}_country", there, place=F.concat(c(f"{provider}.continent"), F.lit(_SEPARATOR), c(f"{provider}.country"))))
    if "asn" in names:
        made.append(_metric("asn", c("prefix_asn").isNotNull(), c("prefix_asn")))
    if "netacq_region" in names:
        made.append(_metric("netacq_region", c("netacq").isNotNull() & (c("netacq.region") > 0), c("netacq.region")))
    if "filter" in names:
        made.append(_metric("filter", _passed() != 0))
    out = F.array(*made) if made else None
    if "netacq_polygon" in names:
        ids = F.coalesce(polygon_ids(c("netacq.polygons")), F.array().cast("array<long>"))
        of = F.transform(ids, lambda p: F.struct(F.lit(_ID["netacq_polygon"]).cast("byte").alias("id"), p.alias("number"), F.lit(None).cast("string").alias("place")))
        out = of if out is None else F.concat(out, of)
    return out


def counted_ip(ip: Column, method: str = "none", bits: int = 32, interval: Column | None = None, seconds: int = INTERVAL) -> Column:
    """What of an address is counted: all of it, its prefix, or only addresses whose last bits are the interval's turn (null for others)."""
    if method == "none" or bits == 32:
        return ip
    if method == "prefixagg":
        return network(ip, bits)
    if method == "sample":
        hosts = 1 << (32 - bits)
        turn = F.pmod(F.floor(interval / seconds), F.lit(hosts))
        return F.when(ip.bitwiseAND(hosts - 1) == turn, ip)
    raise ValueError(f"no such way of counting: {method!r}")


def report(tagged: DataFrame, seconds: int = INTERVAL, limit: set[str] | None = None, ports: dict[str, str] | None = None, label: str = UNLABELED, first: int | None = None, src_method: str = "none", src_bits: int = 32, dst_method: str = "none", dst_bits: int = 32, geo_lite: bool = False) -> DataFrame:
    """A row for each interval and metric that any packet has: OUTPUT, and metric_class.

    Bytes are lengths of IP packets.  Regions and polygons have their number
    as value; ``labelled`` puts their names in.
    """
    names = chosen(limit, geo_lite)
    packets = assigned(tagged.where("src_ip is not null"), seconds, first)
    none, size, filtered = F.lit(0).cast("long"), F.coalesce("ip_len", F.lit(0)), "filter" in names
    of_kinds = [
        (counted_ip(F.col("src_ip"), src_method, src_bits, F.col("interval_ts"), seconds), F.lit(1), size),
        (counted_ip(F.col("dst_ip"), dst_method, dst_bits, F.col("interval_ts"), seconds), none, none),
        (F.col("prefix_asn"), none, none),
    ]
    if filtered:
        of_kinds.append((_passed(), F.lit(1), size))
    kinds = F.array(*(
        F.named_struct(F.lit("kind"), F.lit(kind).cast("byte"), F.lit("value"), value.cast("long"), F.lit("pkts"), pkts.cast("long"), F.lit("bytes"), length.cast("long"))
        for kind, (value, pkts, length) in enumerate(of_kinds)
    ))
    bits = [_passed().alias("bits")] if filtered else []
    fanned = packets.select("interval_ts", *bits, F.explode(metrics(names, ports)).alias("m"), kinds.alias("kinds")).where("m is not null").select("interval_ts", *(["bits"] if filtered else []), "m.*", F.inline("kinds")).where("kind = 0 or value is not null")
    metric = ["interval_ts", "id", "number", "place"]
    sums = [F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")]
    if filtered:
        own = F.col("id") == _ID["filter"]
        kept = fanned.where(own | (F.col("kind") != MASKS)).withColumn("bits", F.when(own & (F.col("kind") != MASKS), F.col("bits")).otherwise(none))
        counts = _by_filter(kept.groupBy(*metric, "kind", "value").agg(*sums, F.bit_or("bits").alias("bits")))
    else:
        number = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("value")))
        values = fanned.groupBy(*metric, "kind", "value").agg(*sums)
        counts = values.groupBy(*metric).agg(number(0).alias("src_ip_cnt"), number(1).alias("dest_ip_cnt"), F.sum("pkts").alias("pkt_cnt"), F.sum("bytes").alias("byte_cnt"), number(2).alias("src_asn_cnt"))
    out = _named(counts)
    return out.withColumnRenamed("interval_ts", "bin_timestamp").withColumn("source_label", F.lit(label)).select(*OUTPUT, "metric_class")


def labelled(rows: DataFrame, regions: DataFrame | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """Rows with the names of regions and polygons in place of their numbers; ``regions`` and ``polygons`` have id and label (``EU.DE.3``), and a number without a label is unknown."""
    for name, labels in (("netacq_region", regions), ("netacq_polygon", polygons)):
        if labels is not None:
            parent, leaf = _split(F.col("_label"))
            own = F.col("metric_class") == name
            right = labels.select(F.col("id").cast("string").alias("_id"), F.col("label").alias("_label"))
            joined = rows.join(right, own & (F.col("metric_value") == F.col("_id")), "left")
            known = joined.withColumn("metric_name", F.when(own, F.concat_ws(".", F.lit(CLASSES[name]), F.coalesce(parent, F.lit("unknown")))).otherwise(F.col("metric_name")))
            rows = known.withColumn("metric_value", F.when(own, F.coalesce(leaf, F.col("metric_value"))).otherwise(F.col("metric_value"))).select(*rows.columns)
    return rows


def expected(spark, names: list[str], ports: dict[str, str] | None = None, countries: DataFrame | None = None) -> DataFrame:
    """The metrics that have a row in every interval in which their class was seen: all of them, protocols, allowed ports, continents and ``countries`` (continent, country).

    ICMP codes, filters and ASNs aren't among these.
    """
    parts = []
    one = lambda name, values: values.select(F.lit(name).alias("metric_class"), F.lit(CLASSES[name]).alias("metric_name"), F.col("v").cast("string").alias("metric_value"))
    if "combined" in names:
        parts.append(one("combined", spark.range(1).select(F.lit("").alias("v"))))
    if "protocol" in names:
        parts.append(one("protocol", spark.range(256).withColumnRenamed("id", "v")))
    parts += [one(n, spark.range(65536).withColumnRenamed("id", "v").where(port_allowed(F.col("v"), (ports or {}).get(n)))) for n in names if n.endswith("_port")]
    for provider in ("maxmind", "netacq"):
        if (n := f"{provider}_continent") in names:
            parts.append(one(n, spark.createDataFrame([(x,) for x in CONTINENTS], "v string")))
        if (n := f"{provider}_country") in names and countries is not None:
            parts.append(countries.select(F.lit(n).alias("metric_class"), F.concat_ws(".", F.lit(CLASSES[n]), "continent").alias("metric_name"), F.col("country").alias("metric_value")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "metric_class string, metric_name string, metric_value string")


def zero_filled(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """``rows`` and, with zeros, what else of ``dimension`` belongs to the classes seen in an interval.

    ``rows`` are computed once: each brings a mark that its class was seen
    along, and what the marks stand for is left out where there are rows.
    """
    seen, metric, counts = ["bin_timestamp", "source_label", "metric_class"], ["metric_name", "metric_value"], OUTPUT[4:]
    numbers = F.struct(*counts)
    nothing = lambda column: F.lit(None).cast(rows.schema[column].dataType)
    both = F.array(
        F.struct(F.lit(False).alias("_mark"), *metric, numbers.alias("_numbers")),
        F.struct(F.lit(True).alias("_mark"), *(nothing(n).alias(n) for n in metric), F.when(F.lit(False), numbers).alias("_numbers")),
    )
    known = rows.select(*seen, F.inline(both)).groupBy(*seen, "_mark", *metric).agg(F.collect_list("_numbers").alias("_numbers"))
    right = dimension.select(F.col("metric_class").alias("_class"), *(F.col(n).alias(f"_{n}") for n in metric))
    joined = known.join(right, F.when(F.col("_mark"), F.col("metric_class")) == F.col("_class"), "left").where("not _mark or _class is not null")
    every = joined.groupBy(*seen, *(F.when(F.col("_mark"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in metric)).agg(F.flatten(F.collect_list("_numbers")).alias("_numbers"))
    filled = every.select(*seen, *metric, F.explode_outer("_numbers").alias("_n"))
    none = F.lit(0).cast("long")
    return filled.withColumns({n: F.when(F.col("_n").isNull(), none).otherwise(F.col(f"_n.{n}")) for n in counts}).select(*rows.columns)


def complete_only(rows: DataFrame, interval_rows: DataFrame) -> DataFrame:
    """Rows of intervals that are complete; others are left out of reports."""
    done = interval_rows.where("complete").select(F.col("interval_ts").alias("bin_timestamp"))
    return rows.join(done, "bin_timestamp", "left_semi")


def time_series(rows: DataFrame) -> DataFrame:
    """Rows as points (key, value, ts): one for each number of a metric; ASN metrics have no number of ASNs."""
    base = F.concat_ws(".", "source_label", "metric_name", F.when(F.col("metric_value") != "", F.col("metric_value")))
    points = F.array(*(
        F.struct(F.concat_ws(".", base, F.lit(name)).alias("key"), F.col(column).alias("value"), F.lit(name == "uniq_src_asn").alias("asn"))
        for name, column in (("uniq_src_ip", "src_ip_cnt"), ("uniq_dst_ip", "dest_ip_cnt"), ("uniq_src_asn", "src_asn_cnt"), ("pkt_cnt", "pkt_cnt"), ("ip_len", "byte_cnt"))
    ))
    flat = rows.select("metric_class", F.col("bin_timestamp").alias("ts"), F.explode(points).alias("p"))
    return flat.where("not (p.asn and metric_class = 'asn')").select("p.key", "p.value", "ts")
