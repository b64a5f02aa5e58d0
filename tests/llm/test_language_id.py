"""Operator 7."""

import itertools
import zlib

import numpy as np

from netlume.llm.language_id import fit, language_spans, letters_of, viterbi


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(7)
    lengths = np.array([5, 0, 3, 1, 4])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 2
    got, at = viterbi(scores, lengths, 1.5), 0

    def value(labels, part):
        return sum(part[j, k] for j, k in enumerate(labels)) - 1.5 * sum(a != b for a, b in itertools.pairwise(labels))

    for n in lengths:
        part, labels = scores[at : at + n], got[at : at + n]
        assert value(labels, part) >= max(value(x, part) for x in itertools.product(range(3), repeat=int(n))) - 1e-4
        at += n


def test_long_texts_keep_their_labels():
    scores = np.tile(np.array([[-40.0, -41.0]], np.float32), (5000, 1))
    scores[2500:] = scores[2500:, ::-1]
    assert (viterbi(scores, np.array([5000]), 12.0) == np.repeat([0, 1], 2500)).all()


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.lang_pred for r in language_spans(docs, fit(docs)).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 100 and np.mean([got[r.doc_id] == r.lang for r in rows]) > 0.98


def test_spans_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs)
    of = {lang: [r.text for r in docs.where(f"lang = '{lang}' and n_chars > 2000").limit(2).collect()] for lang in ("en", "fr")}
    en, fr = (" ".join(of[lang][0].split()[:200]) for lang in ("en", "fr"))
    mixed = spark.createDataFrame([(1, f"{en} {fr}", None), (2, "здравствуйте привет", None), (3, "123 $$$", None)], "doc_id long, text string, lang string")
    one, two, three = language_spans(mixed, model).orderBy("doc_id").collect()
    assert [s.lang for s in one.spans] == ["en", "fr"] and abs(one.spans[1].start - 200) <= 3 and sum(s.length for s in one.spans) == 400
    assert two.lang_pred in model.names and (three.lang_pred, three.score, three.spans) == ("und", 0, [])


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("добрый день как дела", "ru"), ("good day how are you", "en"), ("καλημέρα τι κάνεις", "el"))]
    df = spark.createDataFrame([(3 * i + j, t, lang) for j in range(3) for i, t, lang in rows[j::3]], "doc_id long, text string, lang string")
    model = fit(df)
    new = spark.createDataFrame([(1, "day дела", None), (2, "κάνεις", None), (3, "xyzzy", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_spans(new, model).orderBy("doc_id").collect()][1:] == ["el", "en"]


def test_odd_and_empty(odd, empty):
    rows = {r.doc_id: r for r in language_spans(odd, fit(odd)).collect() if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect()}
    for i, r in rows.items():
        assert (r.lang_pred == "und") == (not letters_of(texts[i] or "")) and 0 <= r.score <= 1
    assert language_spans(empty, fit(empty)).count() == 0
    assert {r.lang_pred for r in language_spans(odd, fit(empty)).collect()} == {"und"}
