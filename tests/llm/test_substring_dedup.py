import hashlib

from netlume.llm.substring_dedup import substring_dedup


def brute(rows, k=13):
    """n_words, n_removed and the kept words of (doc_id, text), from the definition."""
    first, split = {}, []
    for i, text in rows:
        words = (text or "").encode().split()
        split.append((i, words))
        key = float("inf") if i is None else i
        for s in range(len(words) - k + 1):
            w = tuple(words[s : s + k])
            first[w] = min(first.get(w, key), key)
    out = []
    for i, words in split:
        key, cut = float("inf") if i is None else i, set()
        for s in range(len(words) - k + 1):
            if first[tuple(words[s : s + k])] < key:
                cut.update(range(s, s + k))
        out.append((i, len(words), len(cut), hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in cut)).hexdigest()))
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup(df, **more).collect()), key=str)


def test_odd_texts(odd):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_documents(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    want = brute(rows)
    assert got(sample) == want and sum(x[2] for x in want) > 100


def test_other_windows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(odd, window=3) == brute(rows, 3) and got(odd, window=6) == brute(rows, 6)


def test_spans_name_the_removed_words(odd):
    for r in substring_dedup(odd).collect():
        assert sum(s.length for s in r.removed) == r.n_removed


def test_empty(empty):
    assert substring_dedup(empty).count() == 0


def test_larger(larger):
    assert got(larger) == brute([(r.doc_id, r.text) for r in larger.collect()])


def test_shards_and_letters(sample, monkeypatch):
    """Many small shards, and more words than two letters can spell."""
    from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value

    from netlume.llm import substring_dedup as module

    want = brute([(r.doc_id, r.text) for r in sample.collect()])
    monkeypatch.setattr(module, "SHARD", 50)
    monkeypatch.setattr(module, "BASE", 9)
    monkeypatch.setattr(module, "LONGEST", 20)
    register_pickle_by_value(module)
    try:
        assert got(sample) == want
    finally:
        unregister_pickle_by_value(module)


def test_windows_are_confirmed_by_words(monkeypatch):
    """A hash that takes all windows for equal is found out."""
    import numpy as np

    from netlume.llm import substring_dedup as module

    monkeypatch.setattr(module, "MULTIPLIERS", (0, *module.MULTIPLIERS))
    words = np.array([1, 2, 3, 9, 1, 2, 3, 4, 5], np.uint32)
    order, begin = module._equal_windows(words, np.arange(7), 3)
    kinds = [sorted(order[a:b].tolist()) for a, b in zip(begin, [*begin[1:], 7], strict=True)]
    assert sorted(kinds) == [[0, 4], [1], [2], [3], [5], [6]]
