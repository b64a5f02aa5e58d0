"""Operators 2, 5 and 9, held against the libraries."""

import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from netlume.llm import packing, sentencepiece_codec
from netlume.llm import token_counts as counts
from netlume.llm.packing import best_fit, plan
from netlume.llm.sentencepiece_codec import Lexicon, lexicon, sentencepiece_decode, sentencepiece_encode
from netlume.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(counts.MODEL))


def test_counts_are_the_librarys(odd, sample, library):
    for df in (odd, sample):
        rows = df.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in rows), key=str)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df).collect()), key=str) == want


def test_counts_with_a_full_cache(monkeypatch, library):
    monkeypatch.setattr(counts, "CACHE", 5)
    lengths = counts.Lengths({"▁the": 1}, counts.MODEL)
    text = "the cat sat on the mat, the  dog\n\nran  \n off. Ünïcödé 梦梦  x"
    assert sum(lengths[u] for u in counts.pre_tokens(text)) == len(library.encode(text)) and len(lengths) <= 6


def test_segmentations_are_the_librarys(sample):
    lex = lexicon(counts.MODEL)
    words = {u for r in sample.collect() for u in counts.pre_tokens(r.text)} | {"▁①①a", "▁▁▁", "\n", "▁" + "x" * 300, "▁" + "ab" * 200, "aaaa①bbb", "▁▁▁▁▁word", "①", "▁"}
    library = counts.loaded(counts.MODEL)
    for word, ids in lex.segment(list(words)).items():
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word), word
        assert lex.decode(ids) == word.replace("▁", " ").removeprefix(" ")


def test_only_one_piece_is_taken_at_a_character(sample, monkeypatch):
    """The pieces that end at a character are asked about until one may follow, which none of the others may."""
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 0)  # so that hardly an answer is remembered
    asked, lex = [], Lexicon(counts.MODEL)
    may_follow = lex.may_follow
    monkeypatch.setattr(lex, "may_follow", lambda left, right: asked.append((left, right)) or may_follow(left, right))
    words = sorted({u for r in sample.collect() for u in counts.pre_tokens(r.text) if not u.startswith("▁▁")} - {"▁"})
    lex.segment(words)
    prefixes = {w[:n] for w in words for n in range(1, len(w) + 1)}
    assert len(asked) < 1.5 * len(prefixes)
    for word in words[::50]:
        node, ways = lex.root, 0
        for c in word:
            while c not in node and node is not lex.root:
                node = node[sentencepiece_codec.SHORTER]
            node = node.get(c, lex.root)
        for length, piece, _, _ in node.get(sentencepiece_codec.ENDING, ()):
            head = word[:-length]
            ways += not head or may_follow(int(np.frombuffer(lex.segment([head])[head], "<u4")[-1]), piece)
        assert ways == (word[-1] in lex.characters), word


def test_round_trip(odd, sample, library):
    for df in (odd, sample):
        texts = sorted((r.text or "").replace("▁", " ") for r in df.select("text").collect())
        want = sorted(np.array(library.encode(r.text or ""), "<u4").tobytes() for r in df.select("text").collect())
        assert sorted(bytes(r.ids) for r in sentencepiece_encode(df).collect()) == want
        rows = sentencepiece_decode(sentencepiece_encode(df)).collect()
        assert sorted(r.decoded for r in rows) == texts
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert r.decoded == library.decode(ids) and r.n_tokens == len(ids) and r.round_trip and r.decoded_crc32 == zlib.crc32(r.decoded.encode())


def pieces_of(tokenizer, text, length):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    return [(k, k * length, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(ids) // length)) if (p := ids[k * length : (k + 1) * length])]


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(odd, sample, length):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (odd, sample):
        want = sorted(((r.doc_id, *p) for r in df.select("doc_id", "text").collect() for p in pieces_of(tokenizer, r.text, length)), key=str)
        rows = best_fit(df, length=length).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for members in sequences.values():
            members.sort()
            assert [o for o, _ in members] == np.cumsum([0, *(n for _, n in members)])[:-1].tolist() and sum(n for _, n in members) <= length
        assert len(sequences) <= -(-sum(w[3] for w in want) // length) * 11 // 9 + 1


def test_units_of_words_are_the_librarys(monkeypatch):
    """Letters that only become lower, those around them that don't, marks that join with them, apostrophes and the names of special tokens, with any state of the cache."""
    known, rng = packing.WordIds(packing.TOKENIZER), random.Random(3)
    pool = [*map(chr, range(0x20, 0x250)), *"\x00\t\n\x1c\u0327\u0301\u0308\u03a3\u03c3\u03c2\u1e9e\ufb01\u0416\u68a6\ud55c\u1112\u1161\u3000", "<|endoftext|>", "'s", "'RE", "<|", "|>"]
    for size in [3, 20, len(pool)] * 60:
        monkeypatch.setattr(packing, "CACHE", rng.choice([0, 5, 10**6]))
        some = rng.sample(pool, size)
        texts = [None, "", *("".join(rng.choice(some) + rng.choice(["", "", " ", ".", "e"]) for _ in range(rng.randrange(40))) for _ in range(20))]
        ids, ends = known.of_texts(pa.array(texts, pa.string()))
        assert [p.tolist() for p in np.split(ids, ends)[:-1]] == [[*known.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [len(x) for x in known.of_texts(pa.array([], pa.string()))] == [0, 0]


def test_words_cost_merges_and_one_lookup(sample, monkeypatch):
    """Words of Latin letters don't pass through the whole tokenizer, and a unit is looked up once in a batch, however often it occurs."""
    rows = sample.select("doc_id", "text").collect()
    words = [w for r in rows for w in r.text.encode().split()]
    encoded, lookups, encode = [], [], packing.WordIds._encoded
    monkeypatch.setattr(packing.WordIds, "_encoded", lambda self, text: encoded.append(len(text)) or encode(self, text))
    known = packing.WordIds(packing.TOKENIZER)
    encoded.clear()
    known.get = lambda w: lookups.append(w) or dict.get(known, w)
    monkeypatch.setattr(packing, "_TOKENIZERS", {packing.TOKENIZER: known})
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r.doc_id for r in rows]), "text": pa.array([r.text for r in rows])})
    assert sum(b.num_rows for b in packing.token_pieces(docs)([batch])) >= len(rows)
    assert sum(encoded) < 0.1 * sum(map(len, set(words)))
    assert len(lookups) <= len(set(words)) < 0.5 * len(words)


def naive_best_fit(lengths, room):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(room - n)
    return len(gaps)


def test_plan_uses_as_many_sequences_as_best_fit():
    rng = np.random.default_rng(3)
    for room in (10, 100, 2048):
        lengths = rng.integers(1, room + 1, 3000).tolist() + [1] * 50 + [room // 3] * 500
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        steps = plan(histogram, room)
        assert len({s for _, _, m, first, _ in steps for s in range(first, first + m)}) == naive_best_fit(lengths, room)


def test_empty(empty):
    assert token_counts(empty).count() == best_fit(empty).count() == sentencepiece_decode(sentencepiece_encode(empty)).count() == 0


def test_runs_of_spaces_are_the_librarys():
    lex, library = lexicon(counts.MODEL), counts.loaded(counts.MODEL)
    words = ["▁" * k + w for k in [*range(1, 70), 500, 501, 515] for w in ("", "word", "①x", ".", "(", "12", "é")]
    assert all(np.frombuffer(ids, "<u4").tolist() == library.encode(w) for w, ids in lex.segment(words).items())


def test_scores_decide():
    """Other ranks give other pieces: those that merging by these ranks ends with."""
    own = lexicon(counts.MODEL)
    other = Lexicon(counts.MODEL, [-s for s in own.scores])
    words = [f"▁{w}" for w in "the different segmentation of words follows from another order of merging pieces international understanding".split()]
    a, b = own.segment(words), other.segment(words)
    assert sum(a[w] != b[w] for w in words) >= 3
    for w in words:
        assert [other.pieces[i] for i in np.frombuffer(b[w], "<u4").tolist()] == other.merged(w)


def test_encoder_of_the_library_is_not_used(monkeypatch):
    lex = Lexicon(counts.MODEL)
    monkeypatch.setattr(counts, "_MODELS", {})
    monkeypatch.setattr(counts, "loaded", lambda model: pytest.fail("the library's encoder"))
    assert lex.segment(["▁hello", "▁▁▁world", "▁▁"])


def test_decoded_column_that_is_there(spark, odd):
    rows = sentencepiece_decode(sentencepiece_encode(odd).selectExpr("*", "1 AS decoded"))
    assert rows.columns.count("decoded") == 1 and rows.where("decoded is null").count() == 0


def test_frequent_pre_tokens_of_all_rows(spark):
    """What is frequent in all rows is found, wherever it is, and no pre-token is shuffled."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('common words and number', id, ' ', if(id > 2000, 'late', 'early'), ' common') AS text").repartition(6)
    table = dict(zip(*counts.table_entries(counts.frequent_lengths(docs, "text", counts.MODEL, entries=6, counters=64)), strict=True))
    assert {"▁common", "▁words", "▁and", "▁early"} <= set(table) and len(table) <= 6
    library = counts.loaded(counts.MODEL)
    assert all(n == len(library.encode(u)) for u, n in table.items())
    assert counts.table_entries(counts.packed_table([], [])) == ([], [])
