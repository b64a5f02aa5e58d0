"""Attack files of the old text format, as rows.

A file is a run of intervals, framed by lines ``# ..._INTERVAL_START number
time`` and ``# ..._INTERVAL_END``.  The first line of an interval is a header
and is passed over, packets between START PACKET and END PACKET are too, and
all others are attacks of twelve fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (
    "target_ip", "attackers", "attackers_interval", "attack_ports", "target_ports", "packets", "packets_interval", "bytes", "bytes_interval", "max_ppm", "start", "latest", "interval_number", "interval_ts",
)
_START, _END = re.compile(r"# \w+_INTERVAL_START (\S+) (\S+)"), re.compile(r"# \w+_INTERVAL_END")


def attack_lines(lines: Iterator[str]) -> Iterator[str]:
    """CSV lines: the twelve fields, and number and time of the interval."""
    number = ts = state = None
    for line in map(str.strip, lines):
        if m := _START.match(line):
            number, ts, state = m[1], m[2], "header"
        elif _END.match(line):
            state = None
        elif state == "header":
            state = "body"
        elif state == "packet":
            state = "body" if line.startswith("END PACKET") else "packet"
        elif state == "body" and line.startswith("START PACKET"):
            state = "packet"
        elif state == "body":
            if "," not in line:
                raise ValueError(f"not an attack: {line!r}")
            yield f"{line},{number},{ts}"


def read_attacks(spark: SparkSession, path: str) -> DataFrame:
    """The attacks of all files, with their fields as strings; a file is read by one task, for its lines depend on each other."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [x.split(",") for text in pdf["value"] for x in attack_lines(iter(text.splitlines()))]
            yield pd.DataFrame([r[: len(FIELDS)] for r in rows], columns=list(FIELDS), dtype=str)

    return spark.read.text(path, wholetext=True).select("value").mapInPandas(run, ", ".join(f"{n} string" for n in FIELDS))


def typed(attacks: DataFrame) -> DataFrame:
    """Attacks with numbers as numbers."""
    kinds = {"start": "double", "latest": "double"}
    return attacks.select("target_ip", *(F.col(n).cast(kinds.get(n, "long")).alias(n) for n in FIELDS[1:]))
