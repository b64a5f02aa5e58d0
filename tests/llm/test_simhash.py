import random

import numpy as np
import pytest
import xxhash

from netlume.llm import simhash
from netlume.llm.components import components
from netlume.llm.simhash import PLANES, drop_near_duplicates, fingerprint, links, simhash_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """The set of each node's component, by comparing all pairs."""
    nodes = list(range(len(prints)))
    root = nodes[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in nodes:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in nodes]


def test_fingerprints(odd, sample):
    for df in (odd, sample):
        rows = df.select("doc_id", "text").collect()
        assert [fingerprint((r.text or "").encode()) for r in rows] == [brute_print(r.text) for r in rows]


def test_positions_left_by_any_three_hold_a_plane():
    from itertools import combinations

    for three in combinations(range(8), 3):
        assert any(not set(p) & set(three) for p in PLANES)


def test_components_of_documents(odd, sample):
    for df in (odd, sample):
        rows = [(r.doc_id, brute_print(r.text)) for r in df.select("doc_id", "text").collect()]
        roots = brute_components([p for _, p in rows])
        least = {}
        for (i, _), r in zip(rows, roots, strict=True):
            least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
        want = sorted(((i, p, least[r]) for (i, p), r in zip(rows, roots, strict=True)), key=str)
        assert sorted(((r.doc_id, r.print % 2**64, r.component_id) for r in simhash_components(df).collect()), key=str) == want


@pytest.mark.parametrize("long_list", [1500, 20, 2])
def test_no_link_is_lost(spark, monkeypatch, long_list):
    """Clusters of close prints, with long lists split and looked up."""
    rng = random.Random(long_list)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value

    register_pickle_by_value(simhash)  # so that the executors see the changed limit
    try:
        pairs = [(r.u, r.v) for r in links(spark.createDataFrame([(x,) for x in signed], "print long")).collect()]
    finally:
        unregister_pickle_by_value(simhash)
    at = {p: k for k, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = find(at[u]), find(at[v])
        root[max(a, b)] = min(a, b)
    assert [find(x) for x in range(len(prints))] == brute_components(prints)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in range(101, 300)] + [(300, 299), (400, 400)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 301)}


def test_one_of_each_stays(odd):
    kept = drop_near_duplicates(odd)
    ids = {r.component_id for r in simhash_components(odd).collect()}
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == ids


def test_empty(empty):
    assert simhash_components(empty).count() == 0


def test_one_row_of_each_component_stays(same_ids, odd):
    for df in (same_ids, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        roots = brute_components([brute_print(t) for _, t in rows])
        best = {}
        for (i, _), root in zip(rows, roots, strict=True):
            best[root] = min(best.get(root, (True, 0)), (i is None, i or 0)) if root in best else (i is None, i or 0)
        stay = drop_near_duplicates(df)
        assert stay.columns == df.columns
        assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(None if null else i) for null, i in best.values())


def test_components_of_a_long_chain(spark):
    chain = [(k + 1, k) for k in range(300)]
    assert {r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0}
