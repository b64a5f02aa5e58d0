"""Packed arrays, places, blocks and the exchange."""

import numpy as np
import pytest

from netlume.llm.common import PLACE, Block, Question, buckets_for, exchange, pack, placed, replied, small, splits, stage_blocks, steps, unpack, without, written


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.array([1, 2**40, 7]), np.array([-3, 5]), np.array([True, False]), np.array([1.5, np.nan]), np.frombuffer(b"text", np.uint8), np.array([2**64 - 1], np.uint64)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b, equal_nan=a.dtype.kind == "f")


def test_places_are_the_same_whenever_they_are_read(spark, tmp_path, odd):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "x"))
    docs = placed(spark.read.parquet(str(tmp_path / "x")))
    a = {tuple(map(str, r)) for r in docs.collect()}
    b = {tuple(map(str, r)) for r in docs.repartition(3).where("id >= 0").collect()}
    assert a == b and len({(bytes(r[PLACE[0]]), r[PLACE[1]]) for r in docs.collect()}) == 1000
    twice = docs.drop(*PLACE)
    assert placed(twice.unionByName(twice)).select(*PLACE).distinct().count() == 2000
    gone = written(docs.where("id % 3 = 0").select(*PLACE), "gone")
    for most in (10, 1_000_000):
        left = docs.join(small(gone, most), [*PLACE], "left_anti")
        assert sorted(r.id for r in left.collect()) == [k for k in range(1000) if k % 3]
    assert without(docs, gone).count() == 666


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_exchange(spark, larger, buckets):
    """The number of blocks that have each word, asked by all blocks."""
    blocks = stage_blocks(larger, block_bytes=200_000)

    def keys_of(row):
        block = Block.of(row["block_id"], row["data"])
        return np.sort(np.array([hash_of(w) for w in block.vocab], np.uint64))

    def hash_of(word):
        import xxhash

        return xxhash.xxh64_intdigest(word)

    def ask(row):
        keys = keys_of(row)
        return keys, lambda a, b: [steps(keys[a:b])]

    def answer(parts):
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        values, counts = np.unique(np.concatenate(keys), return_counts=True)
        return [counts[np.searchsorted(values, k)] for k in keys], (len(values),)

    replies, counters = exchange(blocks, [Question(buckets, ask, answer), Question(2, ask, answer)], "test")
    rows = [(r, Block.of(r["block_id"], r["data"])) for r in blocks.join(replies, "block_id").collect()]
    seen = {}
    for _, block in rows:
        for w in block.vocab:
            seen[hash_of(w)] = seen.get(hash_of(w), 0) + 1
    for r, _ in rows:
        want = [seen[int(k)] for k in keys_of(r)]
        assert replied(r["replies"], 0, buckets).tolist() == want == replied(r["replies"], buckets, 2).tolist()
    totals = counters.groupBy("question").agg({"counters": "count"}).collect()
    assert sum(c.counters[0] for c in counters.where("question = 0").collect()) == len(seen) and len(totals) == 2
    assert replied(None) is None and buckets_for(blocks) == 1 and splits(larger) >= 1
