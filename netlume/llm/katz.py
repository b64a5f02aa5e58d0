"""Operator 6: scores of an n-gram language model with Katz backoff.

Good-Turing discounted counts (smoothed, see ``discounts``) of orders 1 to
``order``, with backoff weights that are exactly normalised for every history.
Counts live in tables partitioned by key, which blocks of documents ask (see
``common``): a block sends each of its n-grams and histories once, whatever
their number in it, and is answered with sums over all blocks.  In turn these
exchanges give

* the count of each n-gram, and which block is to speak for it, and for words
  also the number of tokens N and of distinct ones V;
* for each history the sums, over the distinct n-grams that begin with it, of
  their discounted counts and of the lower-order probabilities of their last
  words, and from these its backoff weight.  Only blocks that have the history
  before a word that never follows it ask for that.

Every token is then scored by recursion over orders: by its own count if the
n-gram was seen, else by the backoff weight of its history and the order
below, which ends in one symbol for all unknown words.  Histories don't reach
beyond the beginning of a text, which is a symbol of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Block, Question, buckets_for, by_key, exchange, id_or_null, mix, releasing, replied, stage_blocks, steps, word_hashes

ORDER = 2
"""What the check tool's limits leave room for; the README has figures of order 3."""

LARGE = 5
"""Counts above this aren't discounted."""
END, BEGIN = 0x5BD1E995_9E3779B1, 0x27D4EB2F_165667C5
"""Keys of the end of a text, which is a token, and of its beginning, which is a history only."""
ADDED = 0.1
SIGN, WEIGHT = 1, 2
"""What a block asks about a history: only whether its denominator is larger by one, or its weight too."""


def held_out(ids: np.ndarray, folds: int) -> np.ndarray:
    """Whether crc32 of the id as text is 0 modulo ``folds``; documents without an id are held out."""
    return np.array([i == NULL_ID or zlib.crc32(b"%d" % i) % folds == 0 for i in ids.tolist()], bool)


def slope(numbers: np.ndarray) -> float:
    """Of the line through the logarithms of r and of how many counts are r, as in Simple Good-Turing; -2 where there is no falling line.

    Each number is spread over the gap to its neighbours that aren't 0.
    Counts of counts fall faster than 1/r, or Good-Turing would raise counts.
    """
    r = np.flatnonzero(numbers) + 1
    if len(r) < 2:
        return -2.0
    before = np.concatenate([[0], r[:-1]])
    after = np.append(r[1:], 2 * r[-1] - before[-1])
    x, y = np.log(r), np.log(2 * numbers[r - 1] / (after - before))
    x = x - x.mean()
    found = float((x * y).sum() / (x * x).sum())
    return found if found < -1 else -2.0


def discounts(numbers: list[float]) -> np.ndarray:
    """What counts 0 to LARGE are multiplied by; ``numbers``: how many counts are 1, 2, ... LARGE + 1.

    Good-Turing as Katz has it, with the ratios of the numbers taken from a
    line through their logarithms: what is taken off a count is in proportion
    to what Good-Turing takes off it, and all that is taken is the number of
    counts of 1.  All factors are above 0 and below 1, however uneven the
    numbers.  Where no count is 2 to LARGE, those of 1 can't give all that,
    and what is taken is by the line alone.
    """
    n = np.asarray(numbers, float)
    out = np.ones(LARGE + 1)
    if not n[0]:
        return out
    r = np.arange(1, LARGE + 1)
    power = slope(n) + 1
    loss = -np.expm1(power * np.log1p(1 / r))  # 1 - r*/r
    if n[1:LARGE].any():
        out[1:] = 1 - loss * (n[0] / (loss * r * n[:LARGE]).sum())
    else:
        out[1:] = 1 - loss / -np.expm1(power * np.log(LARGE + 1))
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.where(counts <= LARGE, factors[np.minimum(counts, LARGE)], 1.0) * counts


class Unigrams:
    """The lower order: discounted shares of the N tokens, and for unknown words together what these leave."""

    def __init__(self, total: float, distinct: float, numbers: list[float]):
        self.total, self.distinct, self.factors = total, distinct, discounts(numbers)
        taken = float(sum((1 - self.factors[r]) * r * n for r, n in enumerate(numbers[:LARGE], 1)))
        self.over = total if taken > 0 else total + 1  # something is left for unknown words in any case
        self.unknown = (taken or 1.0) / self.over

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factors) / self.over, self.unknown)


def backoff(seen: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and denominator of histories: ``seen`` the sum of their discounted counts, ``lower`` that of the lower-order probabilities of what follows them.

    Where nothing was taken off, the denominator is larger by one instead.
    """
    over = np.where(seen >= counts * (1 - 1e-12), counts + 1, counts).astype(float)
    known = counts > 0
    with np.errstate(all="ignore"):
        weight = (1 - seen / over) / (1 - lower)
    return np.where(known, weight, 1.0), np.where(known, over, 1.0)


class Order:
    """The distinct n-grams of a block: their sorted 64-bit keys and ``counts`` in the documents to learn from.

    ``at`` is the number of the n-gram that ends at each token (-1: none is
    long enough), ``history`` and ``shorter`` are the numbers, in the order
    below, of the n-gram without its last and without its first word.
    """

    __slots__ = ("keys", "counts", "at", "history", "shorter", "total", "speaks")


class Grams:
    """The n-grams of a block, order by order; ``orders[1]`` are words, the end and the beginning of a text."""

    def __init__(self, block: Block, folds: int, order: int):
        docs, vocab = len(block.ids), len(block.vocab)
        self.lengths = block.lengths + 1
        ends = np.cumsum(self.lengths) - 1
        self.starts = ends - self.lengths + 1
        words = np.empty(len(block.words) + docs, np.int64)
        is_word = np.ones(len(words), bool)
        is_word[ends] = False
        words[is_word], words[ends] = block.words, vocab
        self.held_out = held_out(block.ids, folds)
        self.learned = np.repeat(~self.held_out, self.lengths)
        keys = np.concatenate([word_hashes(block.vocab, 4), np.array([END, BEGIN], np.uint64)])
        rank = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[rank] = np.arange(len(keys))
        one = Order()
        one.keys, one.at = keys[rank], place[words]
        one.counts = np.bincount(one.at[self.learned], minlength=len(keys))
        one.counts[place[vocab + 1]] = int((~self.held_out).sum())  # texts begin as often as they end
        self.begin = int(place[vocab + 1])
        self.orders = [None, one]
        for _ in range(order - 1):
            self._longer()

    def _longer(self) -> None:
        below, words, new = self.orders[-1], self.orders[1], Order()
        before = np.empty_like(below.at)
        before[1:] = below.at[:-1]
        before[self.starts] = self.begin if len(self.orders) == 2 else -1
        there = np.flatnonzero((before >= 0) & (below.at >= 0))
        codes, first, number = np.unique(before[there] * len(words.keys) + words.at[there], return_index=True, return_inverse=True)
        history, last = codes // len(words.keys), codes % len(words.keys)
        with np.errstate(over="ignore"):
            keys = mix(mix(below.keys[history]) + words.keys[last] * np.uint64(0x9E3779B97F4A7C15))
        rank = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[rank] = np.arange(len(keys))
        new.keys, new.history, new.shorter = keys[rank], history[rank], below.at[there[first]][rank]
        new.at = np.full(len(below.at), -1, np.int64)
        new.at[there] = place[number]
        new.counts = np.bincount(new.at[there][self.learned[there]], minlength=len(keys))
        self.orders.append(new)


def _sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order, begin, number = by_key(keys)
    return number, *(np.add.reduceat(v[order], begin) for v in values)


def _numbers(counts: np.ndarray) -> list[float]:
    return np.bincount(np.minimum(counts, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2].tolist()


def _totals(counters: DataFrame, question: int, width: int) -> list[float]:
    row = counters.where(F.col("question") == question).agg(*(F.sum(F.col("counters")[j]).alias(f"c{j}") for j in range(width))).first()
    return [float(x or 0) for x in row]


def _joined(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Arrays of all parts one after another, keys as they are, and where each part ends."""
    return [np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), *(np.concatenate([p[j] for p in parts]) for j in range(1, len(parts[0])))], np.cumsum([len(p[0]) for p in parts])


def _answer_counts(parts):
    (keys, counts), ends = _joined(parts)
    order, begin, number = by_key(keys)
    sums = np.add.reduceat(counts[order], begin)
    speaks = np.zeros(len(keys), np.int64)
    speaks[order[begin]] = 1  # sorting keeps the order of blocks, so this is one block for each n-gram
    begins = int(sums[number[keys == np.uint64(BEGIN)][:1]].sum())  # not a token
    numbers = _numbers(np.delete(sums, number[keys == np.uint64(BEGIN)][:1]) if begins else sums)
    return np.split(2 * sums[number] + speaks, ends[:-1]), (sums.sum() - begins, (sums > 0).sum() - (begins > 0), *numbers)


def _answer_histories(parts):
    (keys, counts, seen, lower, asks), ends = _joined(parts)
    number, seen, lower = _sum_by_key(keys, seen, lower)
    weight, over = backoff(seen[number], lower[number], counts)
    out = np.where(over > counts, -1.0, 1.0) * np.where(asks == WEIGHT, weight, 1.0)  # the sign says that the denominator is larger by one
    return [x[a > 0] for x, a in zip(np.split(out, ends[:-1]), np.split(asks, ends[:-1]), strict=True)], ()


OUTPUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, folds: int = 10, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A-Z become a-z; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end.
    The model of n-grams of up to ``order`` words learns from documents whose
    id (crc32 of it as text) isn't 0 modulo ``folds``; all are scored.  Null
    and empty texts are their end alone.  A null id is held out.  If nothing
    is learned every token is the unknown symbol, with probability 1.  An
    empty table gives no rows.  Other columns aren't read.  Words are told
    apart by 64-bit hashes.
    """
    blocks = stage_blocks(docs, lower=True, id_col=id_col, text_col=text_col, name="texts")
    few, many = buckets_for(blocks, "n_distinct"), buckets_for(blocks)
    size = {k: few if k == 1 else many for k in range(1, order + 1)}
    models: dict[int, object] = {}  # the unigrams, and the discounts of each higher order, as they become known
    rounds: list[list[tuple[str, int]]] = [[("count", 1), *([("count", 2)] if order > 1 else [])]]
    rounds += [[("weight", k), *([("count", k + 1)] if k < order else [])] for k in range(2, order + 1)]

    def replies(row, kind: str, k: int) -> np.ndarray | None:
        for r, questions in enumerate(rounds):
            if (kind, k) in questions:
                before = questions[: questions.index((kind, k))]
                return replied(row[f"replies{r}"], sum(size[j] if what == "count" else size[j - 1] for what, j in before), size[k] if kind == "count" else size[k - 1])
        raise KeyError(kind)

    def told(row, upto: int) -> Grams:
        """N-grams of orders up to ``upto`` with their counts, as far as these are known."""
        grams = Grams(Block.of(row["block_id"], row["data"]), folds, upto)
        for k in range(1, upto + 1):
            o = grams.orders[k]
            if any(("count", k) in q for q in rounds[: row["known"]]):
                got = replies(row, "count", k)
                got = np.zeros(0, np.int64) if got is None else got
                o.total, o.speaks = got >> 1, (got & 1).astype(bool)
        return grams

    def asking(grams: Grams, k: int) -> np.ndarray:
        """What the block has to know about each history (an n-gram of the order below): WEIGHT if a word follows that never did in the documents to learn from; SIGN if it may be that nothing was taken off."""
        o, below = grams.orders[k], grams.orders[k - 1]
        out = np.zeros(len(below.keys), np.uint8)
        used = o.history[below.total[o.history] > (LARGE if (models[k][1:] < 1).all() else 0)]
        out[used] = SIGN
        out[o.history[o.total == 0]] = WEIGHT
        out[below.total == 0] = 0
        return out

    def probabilities(row, grams: Grams, upto: int) -> list[np.ndarray]:
        """Of the n-grams of each order up to ``upto``, by recursion from those of the order below."""
        out = [np.empty(0), models[1].probability(grams.orders[1].total)]
        for k in range(2, upto + 1):
            o, below = grams.orders[k], grams.orders[k - 1]
            weight, over = np.ones(len(below.keys)), below.total.astype(float)
            asked = np.flatnonzero(asking(grams, k))
            if len(asked):
                got = replies(row, "weight", k)
                weight[asked] = np.abs(got)
                over[asked] += got < 0
            out.append(np.where(o.total > 0, discounted(o.total, models[k]) / np.maximum(over, 1)[o.history], weight[o.history] * out[-1][o.shorter]))
        return out

    def ask_counts(k: int):
        def ask(row):
            o = row["grams"].orders[k]
            return o.keys, lambda a, b: [steps(o.keys[a:b]), o.counts[a:b]]

        return ask

    def ask_weights(k: int):
        def ask(row):
            grams = row["grams"]
            o, below = grams.orders[k], grams.orders[k - 1]
            p = probabilities(row, grams, k - 1)[-1]
            mine = o.speaks & (o.total > 0)
            seen = np.bincount(o.history[mine], weights=discounted(o.total[mine], models[k]), minlength=len(below.keys))
            lower = np.bincount(o.history[mine], weights=p[o.shorter[mine]], minlength=len(below.keys))
            asks = asking(grams, k)
            used = np.flatnonzero((asks > 0) | (seen > 0))
            keys = below.keys[used]
            return keys, lambda a, b: [steps(keys[a:b]), below.total[used[a:b]], seen[used[a:b]], lower[used[a:b]], asks[used[a:b]]]

        return ask

    def with_grams(ask, upto: int, known: int):
        """What asks first in a round makes the n-grams that all others of the round use."""

        def first(row):
            if "grams" not in row:
                row["known"] = known
                row["grams"] = told(row, upto)
            return ask(row)

        return first

    asked = blocks
    for r, questions in enumerate(rounds):
        upto = max(k for _, k in questions)
        made = [
            Question(size[k], with_grams(ask_counts(k), upto, r), _answer_counts) if kind == "count" else Question(size[k - 1], with_grams(ask_weights(k), upto, r), _answer_histories)
            for kind, k in questions
        ]
        answers, counters = exchange(asked, made, f"round{r}")
        asked = asked.join(answers.withColumnRenamed("replies", f"replies{r}"), "block_id", "left")
        for j, (kind, k) in enumerate(questions):
            if kind == "count":
                total, distinct, *numbers = _totals(counters, j, LARGE + 3)
                models[k] = Unigrams(total, distinct, numbers) if k == 1 else discounts(numbers)

    def score(batches):
        total, distinct = models[1].total, models[1].distinct
        for batch in batches:
            for row in range(batch.num_rows):
                row = {c: batch.column(j)[row].as_py() for j, c in enumerate(batch.schema.names)}
                row["known"] = len(rounds)
                grams = told(row, order)
                one, p = grams.orders[1], probabilities(row, grams, order)
                top = np.log10(p[1])[one.at]
                for k in range(2, order + 1):
                    long = grams.orders[k].at >= 0  # a token near the beginning has no n-gram of high orders
                    top[long] = np.log10(p[k])[grams.orders[k].at[long]]
                base = np.log10((one.total + ADDED) / (total + ADDED * (distinct + 1)))
                known = (one.total > 0).astype(np.int64)
                each = lambda values: np.add.reduceat(values, grams.starts)  # noqa: E731,B023  each text has a token at least
                ids = Block.of(row["block_id"], row["data"]).ids
                yield pa.RecordBatch.from_pydict({
                    "doc_id": id_or_null(ids), "held_out": pa.array(grams.held_out), "n_tokens": pa.array(grams.lengths, pa.int64()), "n_known": pa.array(each(known[one.at])),
                    "train_tokens": pa.array(np.full(len(ids), int(total))), "base_score": pa.array(each(base[one.at])), "score": pa.array(each(top)),
                })

    return asked.mapInArrow(releasing(score), OUTPUT)


def op6_katz(spark, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
