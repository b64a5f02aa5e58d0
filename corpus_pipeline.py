"""A corpus from raw documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
it is written as Parquet and read again.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlume.llm import exact_dedup, packing, quality_classifier, simhash, substring_dedup
from netlume.llm.common import PLACE, placed, removed, scratch, small, without, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.drop_bad(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat a document with a smaller id are cut out.

    What is left of a text that loses words is joined by single spaces; other
    texts stay as they are.  Documents that lose all their words go.  Rows are
    told apart by where they are stored, so null and repeated ids are cut each
    for itself.  Only what is left of cut texts is shuffled.
    """
    own = placed(docs)
    cut = written(substring_dedup.substring_dedup(own, places=True).where("n_removed > 0").select(*PLACE, F.when(F.col("n_words") > F.col("n_removed"), F.col("kept_text")).alias("text")), "cut")
    places = written(cut.select(*PLACE), "cut_places")
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    changed = own.select(*others, *PLACE).join(small(places), [*PLACE]).join(cut.where("text is not null"), [*PLACE])
    changed = changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
    return without(own, places).select(*docs.columns).unionByName(changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all texts in sequences of 2048 tokens."""
    return packing.best_fit(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("substring dedup", passages), ("best-fit packing", pack)]

ORACLE_SQL = None
"""SQL can express neither the classifier nor the tokenizer; the tests hold each stage against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage writes on its way goes when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "stage", stays=True)
        if before is not None:
            removed(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
