"""Dimension tables: prefixes with places and origins, and labels.

Files are read by Spark.  Columns are found by the names that published
databases give them (GeoLite2: network, geoname_id, continent_code,
country_iso_code; the older GeoLite: startIpNum, endIpNum, locId, country),
and by their order where they have others.  Tables of ranges are disjoint and
stay on the executors.  Prefixes may be nested, as in routing tables, and are
flattened on the driver: their number does not depend on the packets, and more
than MOST_PREFIXES are an error.  ``lookup`` broadcasts a table only if it has
few enough rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.u32 import parsed
from ..operators.tagging import GEO, NETACQ_GEO, Ranges, flatten_prefixes, range_table, ranges_from

MOST_PREFIXES = 5_000_000


def _collected(prefixes: DataFrame) -> list:
    rows = prefixes.limit(MOST_PREFIXES + 1).collect()
    if len(rows) > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    return rows


def pfx2as(spark: SparkSession, path: str) -> Ranges:
    """A range table of origins from lines ``address bits asn``; several origins are ``1_2`` or ``1,2``."""
    columns = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not value like '#%'").select(
        parsed(columns[0]).alias("address"), columns[1].cast("int").alias("bits"), F.split(columns[2], "[_,]").cast("array<long>").alias("asns")
    )
    return range_table(spark, flatten_prefixes([(r["address"], r["bits"], r["asns"]) for r in _collected(rows)]), T.ArrayType(T.LongType()))


#: What published databases call their columns.
_NETWORK, _LOW, _HIGH, _IDENT = ("network",), ("startipnum", "start_ip"), ("endipnum", "end_ip"), ("geoname_id", "locid", "id")
_CONTINENT, _COUNTRY = ("continent_code", "continent"), ("country_iso_code", "country")


def _column(df: DataFrame, names: tuple[str, ...], place: int | None = None):
    """The column with one of the names, else that at a place, else null."""
    for c in df.columns:
        if c.strip().lower() in names:
            return F.col(f"`{c}`")
    return F.col(f"`{df.columns[place]}`") if place is not None and place < len(df.columns) else F.lit(None).cast("string")


def _with_places(blocks: DataFrame, places: DataFrame, value) -> Ranges:
    """Range tables of blocks (prefixes, or ranges as numbers) and the places (_id, and what ``value`` takes) that they name."""
    ranged = any(c.strip().lower() in _LOW for c in blocks.columns)
    if ranged:
        rows = blocks.select(_column(blocks, _LOW).cast("long").alias("low"), _column(blocks, _HIGH).cast("long").alias("high"), _column(blocks, _IDENT, 2).alias("_id"))
        return ranges_from(rows.join(places, "_id").select("low", "high", value.alias("value")))
    net = F.split(_column(blocks, _NETWORK, 0), "/")
    rows = blocks.select(parsed(net[0]).alias("address"), net[1].cast("int").alias("bits"), _column(blocks, _IDENT, 1).alias("_id"))
    kind = places.select(value.alias("value")).schema["value"].dataType
    return range_table(places.sparkSession, flatten_prefixes([(r["address"], r["bits"], r["value"]) for r in _collected(rows.join(places, "_id").select("address", "bits", value.alias("value")))]), kind)


def maxmind(spark: SparkSession, blocks: str, locations: str, continents: str | None = None) -> Ranges:
    """A range table of (continent, country) from CSV: blocks (network, or first and last address as numbers, and location id) and locations (id, continent, country).

    Locations without continents need ``continents``, a CSV (country, continent).
    """
    places = spark.read.csv(locations, header=True)
    rows = places.select(_column(places, _IDENT, 0).alias("_id"), _column(places, _CONTINENT, None if continents else 1).alias("continent"), _column(places, _COUNTRY, None if continents else 2).alias("country"))
    if continents:
        of = spark.read.csv(continents, header=True)
        rows = rows.drop("continent").join(of.select(F.col(of.columns[0]).alias("country"), F.col(of.columns[1]).alias("continent")), "country", "left")
    return _with_places(spark.read.csv(blocks, header=True), rows, F.struct("continent", "country").cast(GEO))


def netacuity(spark: SparkSession, blocks: str, locations: str, polygons: str | None = None, regions: str | None = None) -> Ranges:
    """A range table of (continent, country, region, polygons) from CSV: blocks (as for ``maxmind``), locations (id, continent, country, region), and polygons (location id, table, polygon id).

    With ``regions``, a CSV (country, region code, number), locations name regions by their code.
    """
    places = spark.read.csv(locations, header=True)
    rows = places.select(_column(places, _IDENT, 0).alias("_id"), _column(places, _CONTINENT, 1).alias("continent"), _column(places, _COUNTRY, 2).alias("country"), _column(places, ("region",), 3).alias("region"))
    if regions:
        of = spark.read.csv(regions, header=True)
        rows = rows.withColumnRenamed("region", "_code").join(of.select(F.col(of.columns[0]).alias("country"), F.col(of.columns[1]).alias("_code"), F.col(of.columns[2]).alias("region")), ["country", "_code"], "left")
    if polygons:
        p = spark.read.csv(polygons, header=True)
        number = F.shiftleft(F.col(p.columns[1]).cast("long"), 24).bitwiseOR(F.col(p.columns[2]).cast("long"))
        rows = rows.join(p.groupBy(F.col(p.columns[0]).alias("_id")).agg(F.sort_array(F.collect_list(number)).alias("polygons")), "_id", "left")
    else:
        rows = rows.withColumn("polygons", F.lit(None).cast("array<long>"))
    value = F.struct("continent", "country", F.coalesce(F.col("region").cast("int"), F.lit(0)).alias("region"), F.coalesce("polygons", F.array().cast("array<long>")).alias("polygons"))
    return _with_places(spark.read.csv(blocks, header=True), rows, value.cast(NETACQ_GEO))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels (id, label) from CSV; ids are numbers."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col(df.columns[0]).cast("long").alias("id"), F.col(df.columns[1]).alias("label"))


def country_label(continent, country):
    return F.concat_ws(".", continent, country)
