"""Operator 10: quality rules judged by an isolation forest.

Texts are read once, for their statistics.  The forest is fitted on a bounded
sample of these (trees isolate rows by random splits of a few hundred rows
each), then every document is scored by the mean length of its paths: rows
that few splits isolate are unlike the rest.  From which score on a document
is rejected is calibrated on all labelled rows, good and bad, which are scored
where they are and counted by score, in a fixed number of steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_null, ids_of, releasing, texts_of, written
from .text_stats import NAMES, shares, statistics

TREES, ROWS, SEED = 100, 256, 10
STEPS = 100_000
"""Labelled rows are counted by score in so many steps."""
GOOD_WEIGHT = 10
"""How many times worse it is to lose a share of the good labelled rows than to keep that share of the bad ones."""


def best_threshold(good: np.ndarray, bad: np.ndarray, weight: float = GOOD_WEIGHT, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """The score above which to reject: of all, the one with the least cost on labelled rows, and of such the highest.

    ``n_good`` and ``n_bad``: how many rows have each score, one if they aren't given.
    """
    at = np.unique(np.concatenate([good, bad, [1.0]]))

    def up_to(scores: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, float]:
        order = np.argsort(scores)
        sums = np.concatenate([[0], np.cumsum(np.ones(len(scores)) if counts is None else counts[order])])
        return sums[np.searchsorted(scores[order], at, side="right")], sums[-1]

    (kept_good, all_good), (kept_bad, all_bad) = up_to(good, n_good), up_to(bad, n_bad)
    cost = weight * (1 - kept_good / max(all_good, 1)) * (all_good > 0) + kept_bad / max(all_bad, 1)
    return float(at[len(at) - 1 - np.argmin(cost[::-1])])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics NAMES of each row; null texts have no words."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t, t.split()) for t in texts_of(batch.column(1))]
            columns = np.array(rows, np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(ids_of(batch.column(0)))} | {n: pa.array(columns[:, j].copy()) for j, n in enumerate(NAMES)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


def _mean_path(n: float) -> float:
    """The mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as arrays: the feature and the value that a node splits at, its left child (the right one follows), or the path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        self.trees = [self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees if len(x) else 0)]

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, value, left, path = [], [], [], []

        def node() -> int:
            for column, start in ((feature, -1), (value, 0.0), (left, 0), (path, 0.0)):
                column.append(start)
            return len(feature) - 1

        todo = [(node(), x, 0)]
        while todo:
            k, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth == self.depth or len(part) < 2 or not len(wide):
                path[k] = depth + _mean_path(len(part))
                continue
            feature[k] = f = int(rng.choice(wide))
            value[k] = v = rng.uniform(low[f], high[f])
            left[k] = node()
            node()
            below = part[:, f] < v
            todo += [(left[k], part[below], depth + 1), (left[k] + 1, part[~below], depth + 1)]
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the sooner random splits isolate the row."""
        if not self.trees:
            return np.full(len(x), 0.5)
        total, row = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[row, f] >= value[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_mean_path(self.rows), 1e-9))


def base_failed(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _matrix(rows: DataFrame, names=NAMES) -> np.ndarray:
    table = rows.select(*names).toArrow()
    return np.stack([table.column(n).to_numpy() for n in names], axis=1) if table.num_rows else np.zeros((0, len(names)), np.int64)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_weight: float = GOOD_WEIGHT, trees: int = TREES, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, base_failed, anomaly (0 to 1), kept.

    A document fails the base rules with fewer than 10 words or with more than
    a fifth of its words in repeated windows of 5; it isn't kept then.  Others
    are kept if their anomaly is at most the threshold.  ``labels`` has doc_id
    and quality (0 or 1, nulls are passed over); without labelled rows nothing
    else is rejected.  Null and empty texts have no words and so fail.
    An empty table gives no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    stats = base_failed(written(document_statistics(docs, id_col, text_col), "statistics"))
    passed = stats.where("not base_failed")
    order = [F.xxhash64("doc_id"), "doc_id", *NAMES]
    forest = IsolationForest(shares(_matrix(passed.orderBy(*order).limit(trees * rows))), trees, rows)
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()

    def score(batches):
        for batch in batches:
            x = np.stack([batch.column(j + 1).to_numpy() for j in range(len(NAMES))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(shares(x)))], ["quality", "score"])

    scored = passed.join(marks, "doc_id").select("quality", *NAMES).mapInArrow(releasing(score), "quality int, score double")
    counted = scored.groupBy("quality", F.floor(F.col("score") * STEPS)).agg(F.count("*").alias("n"), F.max("score").alias("score")).collect()  # 2 * (STEPS + 1) rows at most
    numbers = [np.array([(r["score"], r["n"]) for r in counted if r["quality"] == k]).reshape(-1, 2).T for k in (1, 0)]
    threshold = best_threshold(numbers[0][0], numbers[1][0], good_weight, numbers[0][1], numbers[1][1])
    shared = spark.sparkContext.broadcast((forest, threshold))

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(j + 1).to_numpy() for j in range(len(NAMES))], axis=1)
            failed = batch.column(len(NAMES) + 1).to_numpy(zero_copy_only=False)
            anomaly = shared.value[0].score(shares(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly), pa.array(~failed & (anomaly <= shared.value[1]))], [*batch.schema.names, "anomaly", "kept"])

    return stats.mapInArrow(releasing(run), "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, anomaly double, kept boolean")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
