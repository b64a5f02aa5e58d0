import hashlib

import corpus_pipeline as pipeline
from netlume.llm.quality_classifier import quality

from .conftest import DOCS, LINE
from .test_exact_dedup import norm
from .test_simhash import brute_components, brute_print
from .test_substring_dedup import brute as brute_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id for r in quality(docs).where("kept").collect()}
    at = 0
    for name, stage in pipeline.STAGES:
        before = docs.collect() if at else None
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if at < 4:
            assert docs.columns == COLUMNS
        if at == 0:
            assert {r.doc_id for r in docs.collect()} == want
        if at == 1:
            best = {}
            for r in before:
                key = norm(r.text)
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
            assert {r.doc_id for r in docs.collect()} == {i for _, i in best.values()}
        if at == 2:
            roots = brute_components([brute_print(r.text) for r in before])
            least = {}
            for r, root in zip(before, roots, strict=True):
                least[root] = min(least.get(root, 1 << 60), r.doc_id)
            assert {r.doc_id for r in docs.collect()} == set(least.values())
        if at == 3:
            cut = {i: (n, gone, sha) for i, n, gone, sha in brute_passages([(r.doc_id, r.text) for r in before])}
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) == {i for i, (n, gone, _) in cut.items() if gone < n or not n}
            for r in before:
                if r.doc_id in after:
                    n, gone, sha = cut[r.doc_id]
                    assert after[r.doc_id].text == r.text if not gone else hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() == sha
                    assert after[r.doc_id].n_chars == (r.n_chars if not gone else len(after[r.doc_id].text))
        if at == 4:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before}
        at += 1
    run = pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_odd_texts(spark, odd):
    docs = odd.select(*COLUMNS)
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == COLUMNS and docs.count() > 3
    assert pipeline.pack(spark, docs, "").count() >= docs.count()


def test_passages_of_null_and_repeated_ids(spark):
    texts = [(1, LINE), (2, f"a {LINE}"), (2, f"a {LINE}"), (2, f"b  {LINE} c"), (2, "clean  as it is"), (2, LINE), (2, None), (3, "alone")]
    texts += [(None, LINE), (None, None), (None, ""), (None, "also  clean"), (None, f"x {LINE} y"), (None, f"{LINE} z"), (None, LINE)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], DOCS).repartition(3)
    want = [(1, LINE), (2, "a"), (2, "a"), (2, "b c"), (2, "clean  as it is"), (2, None), (3, "alone")]
    want += [(None, None), (None, ""), (None, "also  clean"), (None, "x y"), (None, "z")]
    got = pipeline.passages(spark, docs, "")
    assert got.columns == COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def whole(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages_on_null_and_repeated_ids(spark, same_ids):
    """Each stage, on the same input, against the definition, as a multiset of whole rows."""
    rows = [tuple(r) for r in same_ids.collect()]
    kept = quality(same_ids).where("kept").count()
    assert len(whole(pipeline.quality(spark, same_ids, ""))) == kept

    def first_of(groups):
        """One row of each group, by id; which of several rows that are alike in this isn't said."""
        out = {}
        for key, rank, row in groups:
            if key not in out or rank < out[key][0]:
                out[key] = (rank, {row})
            elif rank == out[key][0]:
                out[key][1].add(row)
        return [options for _, options in out.values()]

    def check(got, groups):
        assert len(got) == len(groups) and all(sum(r in options for r in got) == 1 for options in groups)

    check(whole(pipeline.exact(spark, same_ids, "")), first_of((norm(r[1]), (-len(r[1] or ""), r[0] is None, r[0] or 0), r) for r in rows))
    roots = brute_components([brute_print(r[1]) for r in rows])
    check(whole(pipeline.near(spark, same_ids, "")), first_of((root, (r[0] is None, r[0] or 0), r) for r, root in zip(rows, roots, strict=True)))
    want = []
    first = {}
    for r in rows:
        words = (r[1] or "").split()
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            first[w] = min(first.get(w, 1 << 62), 1 << 62 if r[0] is None else r[0])
    for r in rows:
        words, gone = (r[1] or "").split(), set()
        for k in range(len(words) - 12):
            if first[tuple(words[k : k + 13])] < (1 << 62 if r[0] is None else r[0]):
                gone.update(range(k, k + 13))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        if not gone:
            want.append(r)
        elif len(gone) < len(words):
            want.append((r[0], left, r[2], r[3], len(left)))
    assert whole(pipeline.passages(spark, same_ids, "")) == sorted(want, key=str)
    packed = pipeline.pack(spark, same_ids, "").where("piece = 0").collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(r[0]) for r in rows)


def test_what_stages_leave_goes(spark, tmp_path, monkeypatch):
    from netlume.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert not list(tmp_path.glob("scratch-*")) and len(list(tmp_path.glob("stage-*"))) == 1


def test_empty(spark, empty):
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
