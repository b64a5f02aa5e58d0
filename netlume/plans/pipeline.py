"""A run as one plan: source, filters, tags, intervals, plugins, outputs.

A configuration (YAML or a dict) becomes a chain of DataFrames; nothing runs
until a plugin's result is read or written.  Plugins are looked up by name;
``plugin`` adds others, with what they do besides when results of several runs
are merged, when a file is complete, and when a run ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bpf import compile_filter
from ..operators import archive, dos, filters, flows, intervals, report, tagging
from ..sinks.text import file_name

_ON, _OFF = {"yes", "true", "on", "enabled"}, {"no", "false", "off", "disabled"}


def on(value) -> bool:
    """A switch in one of its spellings."""
    if isinstance(value, bool):
        return value
    if (word := str(value).strip().lower()) in _ON | _OFF:
        return word in _ON
    raise ValueError(f"neither on nor off: {value!r}")


@dataclass
class Config:
    """What a run is.

    ``plugins``: (name, options); ``providers``: range tables by name;
    ``labels``: tables (id, label) of ``regions`` and ``polygons``, and
    ``countries`` (continent, country) that reports have rows for even where
    nothing came from them.  While a run is planned, ``captured`` are the
    packets before any are removed, and ``first`` is the second of the first.
    """

    sources: list[str] = field(default_factory=list)
    source_format: str = "pcap"
    interval: int = intervals.INTERVAL
    rotate: int = 0
    monitor: str = ""
    template: str = ""
    start: int = 0
    end: int = 0
    basic_filter: str = ""
    remove: dict[str, bool] = field(default_factory=dict)
    providers: dict[str, tagging.Ranges] = field(default_factory=dict)
    plugins: list[tuple[str, dict]] = field(default_factory=list)
    labels: dict[str, DataFrame] = field(default_factory=dict)
    threads: int = 4
    captured: DataFrame | None = None
    first: int | None = None

    def __post_init__(self):
        if self.interval <= 0:
            raise ValueError("intervals have to last a second at least")
        if self.end and self.end <= self.start:
            raise ValueError("the end is not after the start")


#: The words of configuration files and what they set.
_WORDS = {"interval": "interval", "rotatefreq": "rotate", "monitorid": "monitor", "outtemplate": "template", "startboundaryts": "start", "endboundaryts": "end", "threads": "threads"}
_SOURCES, _FILTERS = ("packetsource", "inputuri", "uri"), ("basicfilter", "inputfilter", "filter")
_REMOVE = {"removespoofed": "spoofed", "removeerratic": "erratic", "removerouted": "routed", "removenotscan": "not_scan"}


def config(text_or_dict: str | dict, **more) -> Config:
    """A configuration from YAML; words that mean nothing to an analysis (log files, sockets) are passed over."""
    raw = text_or_dict
    if isinstance(raw, str):
        import yaml

        raw = yaml.safe_load(raw) or {}
    out: dict = {"remove": {}, "sources": [], "plugins": []}
    for key, value in raw.items():
        if key in _WORDS:
            out[_WORDS[key]] = value if key in ("monitorid", "outtemplate") else int(value)
        elif key in _REMOVE:
            out["remove"][_REMOVE[key]] = on(value)
        elif key in _SOURCES:
            out["sources"] += value if isinstance(value, list) else [str(value)]
        elif key in _FILTERS:
            out["basic_filter"] = str(value)
        elif key == "plugins":
            for item in value or []:
                out["plugins"] += [(k, v or {}) for k, v in (item.items() if isinstance(item, dict) else [(item, {})])]
    return Config(**(out | more))


class Plugin(Protocol):
    """A plugin makes a result of tagged packets; anything that DataFrames express will do, and for the rest ``applyInPandas`` by interval and key."""

    def __call__(self, tagged: DataFrame, run: Config, options: dict) -> DataFrame: ...


@dataclass
class Hooks:
    """What a plugin does besides: ``merge`` makes one result of those of several runs, ``rotated`` gets the path and the start of a file that is complete, ``halted`` the run that ends.

    ``reads`` tells from the options which providers' tags the plugin reads;
    without it packets have the tags of all.
    """

    merge: Callable[..., DataFrame] | None = None
    rotated: Callable[[str, int], None] | None = None
    halted: Callable[[Config], None] | None = None
    reads: Callable[[dict], set[str]] | None = None


PLUGINS: dict[str, Plugin] = {}
HOOKS: dict[str, Hooks] = {}


def plugin(name: str, merge=None, rotated=None, halted=None, reads=None) -> Callable[[Plugin], Plugin]:
    def put(f: Plugin) -> Plugin:
        PLUGINS[name.lower()], HOOKS[name.lower()] = f, Hooks(merge, rotated, halted, reads)
        return f

    return put


def merged(name: str, *parts: DataFrame) -> DataFrame:
    """The results of several runs of a plugin as one: as the plugin says, else all rows."""
    merge = HOOKS[name.lower()].merge
    return merge(*parts) if merge else reduce(DataFrame.unionByName, parts)


@plugin("flowtuple", merge=flows.merged, reads=lambda options: set())
def _flows(tagged, run, options):
    rows = flows.flows_of(tagged, run.interval, run.first, **run.providers)
    return flows.ordered(rows) if on(options.get("sorttuples", "no")) else rows


@plugin("dos")
def _dos(tagged, run, options):
    words = {"min_attack_packets": "packets", "min_attack_duration": "seconds", "min_attack_packet_rate": "rate", "rate_window_size": "window", "rate_window_slide": "slide"}
    return dos.attacks(tagged, dos.Thresholds(**{words[k]: int(v) for k, v in options.items() if k in words}), run.interval, run.first)


_LIMITS = {
    "basic": {"combined", "protocol"}, "icmp": {"icmp"}, "tcpports": {"tcp_src_port", "tcp_dst_port"}, "udpports": {"udp_src_port", "udp_dst_port"}, "filter": {"filter"}, "prefixasn": {"asn"},
    "maxmind": {"maxmind_continent", "maxmind_country"}, "netacq": {"netacq_continent", "netacq_country", "netacq_region", "netacq_polygon"},
}


def _limit(options: dict) -> set[str]:
    return set().union(*(_LIMITS.get(x, {x}) for x in options.get("limitmetrics") or []))


def _report_reads(options: dict) -> set[str]:
    return {"pfx2as"} | {name.partition("_")[0] for name in report.chosen(_limit(options) or None)} & {"maxmind", "netacq"}


@plugin("report", reads=_report_reads)
def _report(tagged, run, options):
    limit = _limit(options)
    ports = {k.replace("source", "src").replace("dest", "dst").removesuffix("s"): ",".join(map(str, v if isinstance(v, list) else [v])) for k, v in options.items() if k.endswith("_ports")}
    count = lambda *keys: str(next((options[k] for k in keys if k in options), "none"))
    src, dst = count("source_ip_counting", "src_ip_counting"), count("dest_ip_counting", "dst_ip_counting")
    way = lambda text: (text.partition("/")[0].strip(), int(text.partition("/")[2] or 32))
    (src_method, src_bits), (dst_method, dst_bits) = way(src), way(dst)
    lite = options.get("geo_mode") == "lite"
    rows = report.report(
        tagged, run.interval, limit or None, ports, str(options.get("output_row_label", report.UNLABELED)), run.first, src_method, src_bits, dst_method, dst_bits, lite
    )
    rows = report.complete_only(rows, intervals.intervals(run.captured, run.interval))
    rows = report.zero_filled(rows, report.expected(tagged.sparkSession, report.chosen(limit or None, lite), ports, run.labels.get("countries")))
    rows = report.labelled(rows, run.labels.get("regions"), run.labels.get("polygons"))
    return report.time_series(rows) if options.get("output_format") == "libtimeseries" else rows.drop("metric_class")


def _counts_merged(*parts: DataFrame) -> DataFrame:
    return archive.merged_counters(reduce(DataFrame.unionByName, parts), ["packet_cnt"])


@plugin("null", merge=_counts_merged)
def _count(tagged, run, options):
    return intervals.counter(tagged, run.interval, run.first)


@plugin("archive", merge=lambda *parts: archive.chronological(*parts).drop("input_idx"))
def _archive(tagged, run, options):
    from ..sources.packets import SCHEMA

    return archive.rotated(archive.chronological(tagged.select(*SCHEMA.names)), run.interval, run.rotate)


def captured(packets: DataFrame, run: Config) -> DataFrame:
    """Packets in the run's time that its capture filter lets through; both are predicates that Catalyst takes down to the source."""
    kept = packets.where(filters.within_time(run.start, run.end))
    return kept.where(compile_filter(run.basic_filter, known=False)) if run.basic_filter else kept


def prepared(packets: DataFrame, run: Config) -> DataFrame:
    """Captured packets that removal leaves, with tags.

    Removal has no say in which intervals there are, where the first one
    begins, and which are complete.
    """
    kept = captured(packets, run)
    if any(run.remove.values()):
        kept = kept.where(filters.removal(**run.remove))
    return tagging.tag(kept, **run.providers)


def results(spark: SparkSession, run: Config, packets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result of each plugin, by its name; one row, the first packet's second, comes to the driver."""
    if unknown := [n for n, _ in run.plugins if n.lower() not in PLUGINS]:
        raise ValueError(f"no such plugins: {unknown}")
    if packets is None:
        packets = spark.read.format(run.source_format).option("paths", "\n".join(run.sources)).load() if run.source_format == "pcap" else spark.read.format(run.source_format).load(run.sources)
    all_packets = captured(packets, run)
    own = replace(run, captured=all_packets, first=intervals.first_second(all_packets))
    out = {}
    for n, options in run.plugins:
        reads = HOOKS[n.lower()].reads
        read = run.providers if reads is None else {k: v for k, v in run.providers.items() if k in reads(options)}  # a lookup that nothing reads is done all the same
        out[n] = PLUGINS[n.lower()](prepared(packets, replace(run, providers=read)), own, options)
    return out


def write(result: DataFrame, run: Config, name: str, time_column: str | None = None, fmt: str = "parquet", **options) -> str:
    """Write a plugin's result under the run's output name; with rotation in a folder for each file's start."""
    path = file_name(run.template or "%P", name, run.monitor, run.start)
    writer_of = result
    if run.rotate and time_column:
        writer_of = result.withColumn("rotate_ts", intervals.rotation(F.col(time_column), run.interval, run.rotate))
    writer = writer_of.write.mode("append").format(fmt).options(**options)
    (writer.partitionBy("rotate_ts") if run.rotate and time_column else writer).save(path)
    if name.lower() in HOOKS and (rotated := HOOKS[name.lower()].rotated):
        starts = writer_of.select("rotate_ts").distinct().orderBy("rotate_ts").collect() if run.rotate and time_column else [(run.start,)]  # a row for each file
        for row in starts:
            rotated(f"{path}/rotate_ts={row[0]}" if run.rotate and time_column else path, row[0])
    return path


def halt(run: Config) -> None:
    """Tell the plugins of a run, in their order, that it ends."""
    for name, _ in run.plugins:
        if halted := HOOKS[name.lower()].halted:
            halted(run)
