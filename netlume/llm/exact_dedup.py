"""Operator 3: exact duplicates, with the frequent texts split off.

Heavy-hitter split.  Texts are compared by the SHA-256 of what is left of them
without white space.  Each task keeps a Misra-Gries summary of its digests; the
sum of the summaries names every digest that may hold more than a fixed share
of all rows, of which there can only be a bounded number.  A second pass over
the digests verifies these: it counts them exactly and finds the row that
stays, which map-side sums bring to one row per digest and task.  That table is
broadcast, and settles the rows of frequent texts where they are.  All other
digests are rare, and go through an ordinary shuffle: sums by digest, made
before it as far as they can, and a join with those of two rows or more, which
Spark can split.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MisraGries, PLACE, placed, releasing, without, written

COUNTERS = 4095
"""Counters of a Misra-Gries summary.  A digest is frequent from 4 / (COUNTERS + 1) of all rows on."""


def frequent_digests(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold 4 / (counters + 1) of the rows of ``keyed`` or more: (counters + 1) / 2 of them at most, and none that does is missing."""

    def summarise(batches):
        summary = MisraGries(counters)
        for batch in batches:
            counted = pc.value_counts(batch.column(0))
            summary.add(counted.field(0).to_pylist(), counted.field(1).to_pylist())
        found = summary.frequent()
        yield pa.RecordBatch.from_pydict({"digest": pa.array([*found, None], pa.binary()), "n": pa.array([*found.values(), summary.rows], pa.int64())})

    sums = written(keyed.select("digest").mapInArrow(releasing(summarise), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")), "frequent")
    rows = (sums.where("digest is null").first() or {"n": 0})["n"]
    return sums.where(F.col("digest").isNotNull() & (F.col("n") * (counters + 1) >= 2 * rows)).select("digest")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text), and the columns ``carry``.

    Texts are equal if they are once all of ``[\\x20\\x09-\\x0D]`` is deleted.
    The row with the most code points stays, then the one with the smallest
    id; of repeated rows one stays, and a null id stays only if all are null.
    Null counts as empty, and all empty texts are equal.  An empty table gives
    no rows.  Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)).alias("digest"),
        F.length(text).alias("size"),
        F.monotonically_increasing_id().alias("row"),
        *carry,
    )
    keyed = written(keyed, "digests")  # texts are read once; row numbers are fixed from here on
    frequent = F.broadcast(frequent_digests(keyed, counters))
    best = F.max(F.struct("size", -F.col("doc_id"), -F.col("row"), "doc_id", "row")).alias("best")
    totals = [F.count("*").alias("group_size"), best]
    winners = written(keyed.join(frequent, "digest").groupBy("digest").agg(*totals), "winners")

    def told(rows: DataFrame) -> DataFrame:
        """Rows beside the totals of their group; without any they are alone."""
        alone = F.col("best").isNull()
        keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
        return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("best.row"))).alias("kept"), "digest", *carry)

    hot = told(keyed.join(F.broadcast(winners), "digest"))
    rare = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = written(rare.groupBy("digest").agg(*totals).where("group_size > 1"), "groups")
    return hot.unionByName(told(rare.join(groups, "digest", "left")))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Rows are told apart by where they are stored, so null and repeated ids
    are judged each by its own text: of (3, "a b") and (3, "a  b") the second
    stays, as it has more code points.  Only digests and the places of rows
    that go are shuffled, not the texts.
    """
    own = placed(docs)
    gone = written(exact_dedup(own, carry=PLACE).where("not kept").select(*PLACE), "copies")
    return without(own, gone).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id
  FROM keyed
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
