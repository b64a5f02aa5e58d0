"""Operator 6, held against a model made of dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from netlume.llm.katz import LARGE, discounts, katz_scores


def learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


class Brute:
    def __init__(self, rows):
        texts = [(text or "").encode().lower().split() + ["</s>"] for i, text in rows if learns(i)]
        self.words, self.pairs, self.follow = Counter(), Counter(), defaultdict(set)
        self.histories = Counter()
        for tokens in texts:
            for h, w in zip(["<s>", *tokens], tokens, strict=False):
                self.words[w] += 1
                self.pairs[h, w] += 1
                self.histories[h] += 1
                self.follow[h].add(w)
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.d1, self.d2 = (self.factors(c) for c in (self.words, self.pairs))
        taken = sum((1 - self.d1[c]) * c for c in self.words.values() if c <= LARGE)
        self.over, self.unknown = (self.n, taken / self.n) if taken > 0 else (self.n + 1, 1 / (self.n + 1))

    @staticmethod
    def factors(counts):
        numbers = Counter(counts.values())
        return discounts([numbers[r] for r in range(1, LARGE + 2)])

    @staticmethod
    def times(c, d):
        return c * (d[c] if c <= LARGE else 1)

    def lower(self, w):
        return self.times(self.words[w], self.d1) / self.over if self.words[w] else self.unknown

    def p(self, h, w):
        if not self.histories[h]:
            return self.lower(w)
        seen = sum(self.times(self.pairs[h, x], self.d2) for x in self.follow[h])
        over = self.histories[h] + (seen >= self.histories[h] * (1 - 1e-12))
        if self.pairs[h, w]:
            return self.times(self.pairs[h, w], self.d2) / over
        return (1 - seen / over) / (1 - sum(map(self.lower, self.follow[h]))) * self.lower(w)

    def row(self, i, text):
        tokens = (text or "").encode().lower().split() + ["</s>"]
        base = sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in tokens)
        score = sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *tokens], tokens, strict=False))
        return i, not learns(i), len(tokens), sum(self.words[w] > 0 for w in tokens), self.n, base, score


def compare(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    model = Brute(rows)
    want = sorted((model.row(*r) for r in rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz_scores(df, order=2).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return model, got


class BruteOfOrder(Brute):
    """Any order, by the definition: histories of up to ``order`` - 1 tokens, which end at the beginning of the text."""

    def __init__(self, rows, order):
        super().__init__(rows)
        self.order, self.counts, self.after, self.memo = order, [None, None], defaultdict(set), {}
        texts = [["<s>", *(text or "").encode().lower().split(), "</s>"] for i, text in rows if learns(i)]
        for k in range(2, order + 1):
            grams = Counter(tuple(t[j : j + k]) for t in texts for j in range(len(t) - k + 1))
            self.counts.append(grams)
            for g in grams:
                self.after[g[:-1]].add(g[-1])
        self.d = [None, None, *(self.factors(c) for c in self.counts[2:])]

    def of(self, h, w):
        """The probability of w after the tuple h."""
        if not h:
            return self.lower(w)
        if (h, w) not in self.memo:
            k = len(h) + 1
            c, d = self.counts[k], self.d[k]
            total = sum(c[(*h, x)] for x in self.after[h])
            if not total:
                p = self.of(h[1:], w)
            else:
                seen = sum(self.times(c[(*h, x)], d) for x in self.after[h])
                over = total + (seen >= total * (1 - 1e-12))
                p = self.times(c[(*h, w)], d) / over if c[(*h, w)] else (1 - seen / over) / (1 - sum(self.of(h[1:], x) for x in self.after[h])) * self.of(h[1:], w)
            self.memo[h, w] = p
        return self.memo[h, w]

    def score(self, text):
        tokens = ["<s>", *(text or "").encode().lower().split(), "</s>"]
        return sum(math.log10(self.of(tuple(tokens[max(0, j - self.order + 1) : j]), tokens[j])) for j in range(1, len(tokens)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_any_order(odd, sample, order):
    for df in (odd, sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        model = BruteOfOrder(rows, order)
        want = sorted(((i, model.score(text)) for i, text in rows), key=str)
        got = sorted(((r.doc_id, r.score) for r in katz_scores(df, order=order).collect()), key=str)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert sorted(g[1] for g in got) == pytest.approx(sorted(w[1] for w in want), rel=1e-9, abs=1e-9)
        known = [w for w, c in model.words.items() if c]
        for h in list(model.after)[:: max(1, len(model.after) // 7)]:
            assert sum(model.of(h, w) for w in known) + model.of(h, b"never seen") == pytest.approx(1)


def test_higher_orders_use_more_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = {k: sum(r.score for r in katz_scores(docs, order=k).collect() if r.held_out) for k in (1, 2)}
    assert score[2] > score[1]


def test_odd_texts(odd):
    compare(odd)


def test_documents(sample):
    model, _ = compare(sample)
    for h in ["<s>", b"the", b"never seen", *list(model.follow)[:40]]:
        assert sum(model.p(h, w) for w in model.words) + model.p(h, b"never seen") == pytest.approx(1)


def test_better_than_the_base_on_held_out_texts(spark):
    rows = [r for r in katz_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_discounts():
    assert (discounts([0] * 6) == 1).all()
    d = discounts([100, 40, 20, 12, 8, 6])
    assert d[0] == 1 and (d[1:] > 0).all() and (d[1:] < 1).all()
    assert sum((1 - d[r]) * r * n for r, n in enumerate([100, 40, 20, 12, 8], 1)) == pytest.approx(100)
    assert (discounts([5, 0, 0, 0, 0, 3])[1:] > 0).all()


def test_discounts_of_uneven_numbers():
    """Words and pairs of sf0.01, where copies in groups of five make the fifth number as large as the fourth."""
    for numbers in ([51654, 14844, 5474, 2713, 2570, 1129], [206781, 32217, 5097, 1904, 2579, 670]):
        d = discounts(numbers)
        assert (d[1:] > 0).all() and (d[1:] < 1).all() and (d[2:] > d[1:-1]).all()
        assert sum((1 - d[r]) * r * n for r, n in enumerate(numbers[:LARGE], 1)) == pytest.approx(numbers[0])


def test_discounts_change_little_with_one_group_of_copies():
    """Without the smoothing the fourth factor passes 1 between these two."""
    a, b = discounts([1000, 400, 200, 120, 95, 60]), discounts([1000, 400, 200, 120, 97, 60])
    assert abs(a - b).max() < 0.01


def test_discounts_of_few_numbers():
    for numbers in ([7, 0, 0, 0, 0, 0], [7, 0, 0, 0, 0, 3], [1, 0, 0, 0, 9, 0], [3, 5, 8, 9, 9, 9], [10**9, 1, 0, 0, 0, 0]):
        d = discounts(numbers)
        assert (d[1:] > 0).all() and (d[1:] < 1).all()


def test_empty(empty):
    assert katz_scores(empty).count() == 0


def test_nothing_to_learn_from(odd):
    rows = katz_scores(odd.where("doc_id is null")).collect()
    assert [r.score for r in rows] == [0, 0] and [r.train_tokens for r in rows] == [0, 0]
