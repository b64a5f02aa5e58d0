import hashlib
import re
from collections import defaultdict

import pytest

from netlume.llm.exact_dedup import MisraGries, drop_duplicates, exact_dedup, frequent_digests


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact_dedup(df, **more).collect()), key=str)


@pytest.mark.parametrize("counters", [4095, 7, 1])
def test_odd_texts(odd, counters):
    """With few counters most groups take the shuffle, with many the broadcast."""
    assert got(odd, counters=counters) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


@pytest.mark.parametrize("counters", [4095, 31])
def test_documents(sample, counters):
    assert got(sample, counters=counters) == brute([(r.doc_id, r.text) for r in sample.collect()])


def test_no_frequent_digest_is_missing(spark):
    from pyspark.sql import functions as F

    values = [0] * 300 + [1] * 200 + list(range(2, 2000))
    keyed = spark.createDataFrame([(v,) for v in values], "v int").repartition(7).select(F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("digest"))
    found = {bytes(r.digest) for r in frequent_digests(keyed, counters=63).collect()}
    assert {hashlib.sha256(str(v).encode()).digest() for v in (0, 1)} <= found and len(found) <= 32


def test_misra_gries_error():
    m = MisraGries(4)
    for k in range(100):
        m.add([k, "x"], [1, 1])
    assert 100 - m.rows / 5 <= m.held["x"] <= 100 and len(m.held) <= 4


def test_kept_rows(odd):
    kept = drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == sum(x[3] for x in got(odd))


def test_larger(larger):
    assert got(larger, counters=63) == brute([(r.doc_id, r.text) for r in larger.collect()])


def test_rows_with_one_id_are_judged_each_by_its_text(same_ids):
    rows = [tuple(r) for r in same_ids.collect()]
    want = {}
    for r in rows:
        key = norm(r[1])
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in want or rank < want[key][0]:
            want[key] = (rank, r[:2])
    assert sorted((tuple(r)[:2] for r in drop_duplicates(same_ids).collect()), key=str) == sorted((r for _, r in want.values()), key=str)


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
