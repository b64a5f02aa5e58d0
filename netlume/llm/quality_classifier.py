"""Operator 1: a quality classifier from weak labels.

Weak-label model.  A number of heuristic labellers vote good, bad or nothing
on every document.  How often each combination of votes occurs, over all
documents, is all that expectation-maximisation needs to estimate how accurate
each labeller is, and from that the probability that a document with these
votes is good: a table of a fixed number of rows.  These posterior labels of a
bounded sample of documents train a linear scorer over hashed features of the
words' shapes and of the statistics, which then scores all documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, id_or_null, ids_of, placed, portions, releasing, texts_of, written
from .text_stats import SHARES, shares, statistics

#: Labellers: the share that a labeller looks at, up to where it votes good, and from where on bad (turned round if the first is larger).
LABELLERS = (
    ("symbols", 0.01, 0.06), ("symbol_runs", 0.03, 0.20), ("marks", 0.03, 0.15), ("dup_lines", 0.05, 0.30), ("repeats", 0.05, 0.20), ("upper", 0.15, 0.40),
    ("digits", 0.06, 0.30), ("bangs", 0.04, 0.25), ("word_length", 7.5, 11.0), ("short", 0.15, 0.04), ("sentence_length", 40.0, 80.0), ("adjacent", 0.02, 0.10),
)
LEAST_WORDS = 8
"""Labellers don't vote on texts with fewer words."""
FEATURES = 2048
SAMPLE = 6_000
"""At most so many documents, half of them likely bad ones if there are enough, train the scorer."""
KEEP = 0.3
SHAPES = 100_000
SCALES = {"word_length": 1, "sentence_length": 0.2}

_SHAPE = re.compile(rb"([A-Z]+)|([a-z]+)|([0-9]+)|([\x80-\xff]+)|(.)\5*", re.DOTALL)


def votes(x: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each row of shares one vote of each labeller: 0 bad, 1 none, 2 good; short texts get no votes."""
    out = np.ones((len(x), len(LABELLERS)), np.int64)
    for j, (name, good, bad) in enumerate(LABELLERS):
        sign = 1 if good <= bad else -1
        value = sign * x[:, SHARES.index(name)]
        out[:, j] += (value <= sign * good).astype(np.int64) - (value >= sign * bad)
    out[n_words < LEAST_WORDS] = 1
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often labellers vote each way on bad and on good documents, the share of good ones, and the probability of good for each pattern of votes.

    Labellers are taken to err independently of each other.  At the start a
    document is likely bad if two labellers say so, and likely good if none does.
    """
    n, k = patterns.shape
    weight = counts.astype(float)
    good = np.array([0.95, 0.6, 0.05])[np.minimum((patterns == 0).sum(axis=1), 2)]
    accuracy, prior = np.full((k, 2, 3), 1 / 3), 0.5
    for _ in range(rounds if n else 0):
        for c, share in ((0, 1 - good), (1, good)):
            for j in range(k):
                votes_of = np.bincount(patterns[:, j], weights=weight * share, minlength=3) + 0.5
                accuracy[j, c] = votes_of / votes_of.sum()
        prior = float(np.clip((weight * good).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        log = np.log([1 - prior, prior]) + sum(np.log(accuracy[j][:, patterns[:, j]]).T for j in range(k))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return accuracy, np.array([1 - prior, prior]), good


def _bucket(feature: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature, 1) % FEATURES


_KINDS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 else ord("0") if 48 <= b <= 57 else 0xE9 if b >= 0x80 else b for b in range(256))


def shapes_of(text: bytes) -> list[bytes]:
    """The words of a text with letters and digits replaced by their kind; there are far fewer of these than of words."""
    return text.translate(_KINDS).split()


def word_features(word: bytes) -> tuple[int, int, int]:
    """The hashed features of a word's shape: how it is written, what it ends with, its length."""
    kinds = "".join("Aa0é"[m.lastindex - 1] if m.lastindex < 5 else m.group(5).decode("latin-1") for m in _SHAPE.finditer(word))
    return _bucket(b"shape " + kinds.encode()), _bucket(b"end " + kinds[-1:].encode()), _bucket(b"size %d" % min(len(word), 32))


def share_features(share: np.ndarray) -> list[int]:
    """The hashed features of a text's shares: the range that each is in."""
    return [_bucket(b"share %d %d" % (j, min(int(value * SCALES.get(SHARES[j], 20)), 20))) for j, value in enumerate(share.tolist())]


class Remembered(dict):
    """The values of a function of shapes, for those met lately."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, word: bytes):
        if len(self) >= SHAPES:
            self.clear()
        got = self[word] = self.function(word)
        return got


def features(shapes: list[bytes], share: np.ndarray, of: Remembered) -> np.ndarray:
    """A row of FEATURES numbers: how large a part of the words has each hashed feature, and ranges of the shares."""
    row = np.zeros(FEATURES, np.float32)
    if shapes:
        row += np.bincount(np.fromiter((f for w in shapes for f in of[w]), np.int64, 3 * len(shapes)), minlength=FEATURES) / np.float32(len(shapes))
    np.add.at(row, share_features(share), 1)
    return row


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for labels between 0 and 1, both sides counting the same."""
    if not len(x):
        return np.zeros(x.shape[1], np.float32), 1.0
    used = np.flatnonzero(x.any(axis=0))  # the weights of others stay 0
    out, x = np.zeros(x.shape[1], np.float32), np.ascontiguousarray(x[:, used])
    w, b = np.zeros(len(used), np.float32), 0.0
    bad, good = max((1 - y).sum(), 1e-9), max(y.sum(), 1e-9)
    weight = (y / good + (1 - y) / bad) / 2 if min(bad, good) > 1 else np.full(len(y), 1 / len(y))
    speed = np.zeros_like(w)
    for _ in range(rounds):
        miss = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        speed = 0.9 * speed + (miss.astype(np.float32) @ x + shrink * w)
        w -= rate * speed
        b -= rate * float(miss.sum())
    out[used] = w
    return out, b


class QualityModel:
    """A fitted scorer; ``accuracy`` and ``prior`` are what the labellers turned out to be."""

    def __init__(self, weights, bias, accuracy, prior, posterior):
        self.weights, self.bias, self.accuracy, self.prior, self.posterior = weights, bias, accuracy, prior, posterior

    def word_weights(self) -> Remembered:
        """What a word of a shape adds to the score of its text, times the number of words."""
        weights = self.weights.astype(float)
        return Remembered(lambda w: sum(weights[f] for f in word_features(w)))

    def scores(self, texts: list[bytes], weight_of: Remembered) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each text is good, by the scorer and by the labellers' votes alone."""
        rows = [t.split() for t in texts]
        stats = np.array([statistics(t, w) for t, w in zip(texts, rows, strict=True)], np.int64).reshape(len(texts), -1)
        x = shares(stats) if len(texts) else np.zeros((0, len(SHARES)))
        own = [sum(map(weight_of.__getitem__, shapes_of(t))) / max(len(w), 1) for t, w in zip(texts, rows, strict=True)]
        out = np.array([a + float(self.weights[share_features(s)].sum()) for a, s in zip(own, x, strict=True)]) + self.bias
        patterns = votes(x, stats[:, 0]) if len(texts) else np.zeros((0, len(LABELLERS)), np.int64)
        weak = [self.posterior.get(int(p), 0.5) for p in patterns @ 3 ** np.arange(len(LABELLERS))]
        return 1 / (1 + np.exp(-np.clip(out, -60, 60))), np.array(weak)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Vote on all documents, estimate the labellers' accuracies, and train the scorer.

    The scorer's rows are chosen by where they are stored, so at most
    ``sample`` of them come to the driver, whatever the ids; null and repeated
    ids count like others.  Which rows they are depends on the hash of the id
    and then on the place.
    """
    own = placed(docs)
    texts = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *PLACE)
    powers = 3 ** np.arange(len(LABELLERS))

    def vote(batches):
        for batch in batches:
            stats = np.array([statistics(t, t.split()) for t in texts_of(batch.column(1))], np.int64).reshape(batch.num_rows, -1)
            pattern = votes(shares(stats), stats[:, 0]) @ powers if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(ids_of(batch.column(0))), "pattern": pa.array(pattern, pa.int64()), PLACE[0]: batch.column(2), PLACE[1]: batch.column(3)})

    voted = written(texts.mapInArrow(releasing(vote), f"doc_id long, pattern long, {PLACE[0]} binary, {PLACE[1]} long"), "votes")
    counted = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** labellers rows
    patterns = np.array([[r["pattern"] // p % 3 for p in powers] for r in counted], np.int64).reshape(-1, len(LABELLERS))
    accuracy, prior, good = expectation_maximisation(patterns, np.array([r["count"] for r in counted]))
    posterior = {r["pattern"]: float(g) for r, g in zip(counted, good, strict=True)}
    bad = [p for p, g in posterior.items() if g < 0.5]
    order = [F.xxhash64("doc_id", F.lit(1)), "doc_id", *PLACE]
    chosen = voted.where(F.col("pattern").isin(bad)).orderBy(*order).limit(sample // 2)
    chosen = chosen.unionByName(voted.where(~F.col("pattern").isin(bad)).orderBy(*order).limit(sample // 2)).select("pattern", *PLACE)

    def describe(batches):
        of = Remembered(word_features)
        for batch in portions(batches, 0):
            rows = []
            for text in texts_of(batch.column(0)):
                words = text.split()
                row = features(shapes_of(text), shares(np.array([statistics(text, words)], np.int64))[0], of)
                at = np.flatnonzero(row)
                rows.append(at.astype(np.uint16).tobytes() + row[at].tobytes())
            yield pa.RecordBatch.from_pydict({"pattern": batch.column(1), "row": pa.array(rows, pa.binary())})

    wanted = texts.join(F.broadcast(chosen), [*PLACE]).select("text", "pattern")  # `sample` rows of a few numbers; places are unique
    table = wanted.mapInArrow(releasing(describe), "pattern long, row binary").toArrow()
    rows = sorted(zip(table.column("pattern").to_pylist(), table.column("row").to_pylist(), strict=True))  # they come in any order
    x, y = np.zeros((len(rows), FEATURES), np.float32), np.array([posterior[p] for p, _ in rows])
    for k, (_, row) in enumerate(rows):
        n = len(row) // 6  # two bytes for a number and four for a value
        x[k, np.frombuffer(row, np.uint16, n)] = np.frombuffer(row, np.float32, n, 2 * n)
    w, b = train(x, y)
    return QualityModel(w, b, accuracy, prior, posterior)


def quality(docs: DataFrame, model: QualityModel | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, weak (the labellers' posterior), score (both the probability of good), kept (score >= ``keep``).

    Null and empty texts get no votes; they are scored like any other.  An
    empty table gives no rows.  Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col))

    def run(batches):
        weight_of = shared.value.word_weights()
        for batch in portions(batches, 1):
            score, weak = shared.value.scores(texts_of(batch.column(1)), weight_of)
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(ids_of(batch.column(0))), "weak": pa.array(weak, pa.float64()), "score": pa.array(score, pa.float64()), "kept": pa.array(score >= keep)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), "doc_id long, weak double, score double, kept boolean")


def drop_bad(docs: DataFrame, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        weight_of = shared.value.word_weights()
        for batch in portions(batches, at):
            yield batch.filter(pa.array(shared.value.scores(texts_of(batch.column(at)), weight_of)[0] >= keep))

    return docs.mapInArrow(releasing(run), docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
