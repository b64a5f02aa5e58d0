"""Operators 1 and 10."""

import re
from collections import Counter

import numpy as np
import pytest

from netlume.llm.common import scratch
from netlume.llm.quality_classifier import LABELLERS, LEAST_WORDS, Remembered, drop_bad, expectation_maximisation, features, fit, quality, shapes_of, train, word_features
from netlume.llm.text_stats import SHARES, shares, statistics
from netlume.llm.quality_rules import IsolationForest, best_threshold, quality_rules


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def test_base_rules(odd, sample, labels):
    for df in (odd, sample):
        want = sorted(((r.doc_id, *brute_base(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
        rows = quality_rules(df, labels).collect()
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str) == want
        assert not any(r.kept and r.base_failed for r in rows)


def test_rules_agree_with_labels(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules(spark.read.parquet(f"{at}/documents.parquet"), labels).collect()}
    good = [got[r.doc_id].kept for r in labels.collect() if r.quality == 1 and not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in labels.collect() if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_classifier_agrees_with_labels_it_never_saw(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in quality(spark.read.parquet(f"{at}/documents.parquet")).collect()}
    rows = [r for r in spark.read.parquet(f"{at}/labels.parquet").collect()]
    assert np.mean([got[r.doc_id] for r in rows if r.quality == 1]) > 0.98 and np.mean([got[r.doc_id] for r in rows if r.quality == 0]) < 0.2


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    right = np.linspace(0.7, 0.95, len(LABELLERS))
    votes = np.where(rng.random((len(good), len(right))) < right, np.where(good, 2, 0)[:, None], np.where(good, 0, 2)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    accuracy, prior, _ = expectation_maximisation(patterns, counts)
    hit = accuracy[:, 1, 2] / (accuracy[:, 1, 2] + accuracy[:, 1, 0])
    assert abs(prior[1] - 0.8) < 0.02 and np.abs(hit - right).max() < 0.03


def test_forest_isolates_outliers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(2000, 3)), [[9, 9, 9], [-8, 7, 9]]])
    score = IsolationForest(x).score(x)
    assert set(np.argsort(score)[-2:]) == {2000, 2001}


def test_threshold():
    assert best_threshold(np.array([0.1, 0.2, 0.3]), np.array([0.5, 0.6])) == 0.3
    assert best_threshold(np.array([]), np.array([])) == 1.0


def test_scorer_separates():
    x = np.eye(4, dtype=np.float32)[[0, 1, 0, 1, 2]]
    w, b = train(x, np.array([1, 0, 1, 0, 1.0]))
    assert ((x @ w + b > 0) == [True, False, True, False, True]).all()


def test_odd_and_empty(odd, empty, labels):
    assert quality(odd).count() == odd.count() and set(drop_bad(odd).columns) == set(odd.columns)
    assert quality(empty).count() == quality_rules(empty, labels).count() == drop_bad(empty).count() == 0
    assert quality_rules(odd, labels.limit(0)).where("not kept and not base_failed").count() == 0


def brute_votes(text):
    words = text.split()
    if len(words) < LEAST_WORDS:
        return (1,) * len(LABELLERS)
    share = shares(np.array([statistics(text, words)], np.int64))[0]
    out = []
    for name, good, bad in LABELLERS:
        value = share[SHARES.index(name)]
        out.append((2 if value <= good else 0 if value >= bad else 1) if good <= bad else (2 if value >= good else 0 if value <= bad else 1))
    return tuple(out)


def brute_em(votes, rounds=100):
    """Expectation-maximisation document by document."""
    good = [(0.95, 0.6, 0.05)[min(v.count(0), 2)] for v in votes]
    for _ in range(rounds):
        table = []
        for j in range(len(LABELLERS)):
            sums = [[0.5] * 3, [0.5] * 3]
            for v, g in zip(votes, good, strict=True):
                sums[0][v[j]] += 1 - g
                sums[1][v[j]] += g
            table.append([[x / sum(row) for x in row] for row in sums])
        prior = min(max(sum(good) / len(good), 1e-3), 1 - 1e-3)
        new = []
        for v in votes:
            odds = np.log(prior / (1 - prior)) + sum(np.log(table[j][1][x] / table[j][0][x]) for j, x in enumerate(v))
            new.append(1 / (1 + np.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        if done:
            break
        good = new
    return good


def test_posteriors_and_scores_by_brute_force(spark, sample):
    rows = [(r.doc_id, (r.text or "").encode()) for r in sample.collect()]
    model = fit(sample)
    got = {r.doc_id: r for r in quality(sample, model).collect()}
    for (i, _), want in zip(rows, brute_em([brute_votes(t) for _, t in rows]), strict=True):
        assert got[i].weak == pytest.approx(want, abs=1e-6)
    of = Remembered(word_features)
    for i, text in rows:
        x = features(shapes_of(text), shares(np.array([statistics(text, text.split())], np.int64))[0], of)
        score = 1 / (1 + np.exp(-(float(x.astype(float) @ model.weights.astype(float)) + model.bias)))
        assert got[i].score == pytest.approx(score, abs=1e-4) and got[i].kept == (got[i].score >= 0.3)


@pytest.mark.parametrize("ident", ["1", "null"])
def test_no_more_rows_than_the_sample_train_the_scorer(spark, monkeypatch, ident):
    """Thousands of rows of one id, or of none: rows are chosen by their place."""
    from netlume.llm import quality_classifier as module

    seen = []
    monkeypatch.setattr(module, "train", lambda x, y: seen.append(len(x)) or (np.zeros(x.shape[1], np.float32), 0.0))
    docs = spark.range(30_000).selectExpr(f"cast({ident} as long) AS doc_id", "concat('Some words that make a line of a text, number ', id, if(id % 5 = 0, ' $$$ ### !!! ### $$$ !!!', '.')) AS text")
    with scratch(spark):
        fit(docs, sample=1000)
    assert len(seen) == 1 and 500 <= seen[0] <= 1000


def test_shapes_are_those_of_whole_words():
    assert word_features(b"a" * 70 + b"!!") != word_features(b"a" * 72)
    assert word_features(b"aA0." * 40) != word_features(b"aA0." * 39 + b"aA0")


def test_threshold_of_counts():
    rng = np.random.default_rng(4)
    good, bad = rng.random(300).round(2) * 0.8, rng.random(50).round(2)
    (g, n), (b, m) = np.unique(good, return_counts=True), np.unique(bad, return_counts=True)
    assert best_threshold(g, b, 10, n, m) == best_threshold(good, bad, 10)


def test_kept_by_brute_force(spark, sample, labels):
    """Which documents stay, from the anomalies of all rows and of all labelled ones."""
    rows = quality_rules(sample, labels).collect()
    mark = {}
    for r in labels.collect():
        mark.setdefault(r.doc_id, set()).add(r.quality)
    passed = [r for r in rows if not r.base_failed]
    at = {k: np.array([r.anomaly for r in passed if k in mark.get(r.doc_id, ())]) for k in (0, 1)}
    costs = [(10 * (at[1] > t).mean() + (at[0] <= t).mean() if len(at[0]) else 10 * (at[1] > t).mean(), -t) for t in [*at[0], *at[1], 1.0]]
    limit = -min(costs)[1]
    assert len(at[1]) > 5 and all(r.kept == (not r.base_failed and r.anomaly <= limit) for r in rows)
