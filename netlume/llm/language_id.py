"""Operator 7: the language of texts, and of the spans of mixed texts.

The script of a word's letters narrows the candidates: a language whose
training texts hardly use the script is out.  A word's score for a language is
the sum of the log probabilities of its byte n-grams.  Viterbi over the words
of a text, with a penalty for each switch, labels them, and so divides the
text into spans; the text's language is the one whose spans hold most letters.

The model is a table of as many n-gram buckets as there are, for each
language, counted over all documents to learn from.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_null, ids_of, mix, portions, releasing

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SWITCH = 12.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
"""A language uses a script from this share of its letters on."""
UNKNOWN = "und"

#: Where scripts begin in Unicode; a script reaches to the next one.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_NUMBERS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def words_of(text: str | None) -> list[bytes]:
    """The lower-case words of a text; only ASCII white space divides."""
    return text.lower().encode().split() if text else []


def script_numbers(words: list[str]) -> np.ndarray:
    """The script of the first letter of each word."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _NUMBERS[np.searchsorted(_STARTS, first, side="right") - 1]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words, with a space before and after, and the number of the word of each."""
    data = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8).astype(np.uint64)
    space = data == 32
    word = np.cumsum(space) - 1
    buckets, of = [], []
    for n in ORDERS:
        at = np.arange(max(0, len(data) - n + 1))
        inside = np.zeros(len(at), bool)
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | data[j : j + len(at)]
            if 0 < j < n - 1:
                inside |= space[j : j + len(at)]
        at = at[~inside]
        buckets.append((mix(code[at]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        of.append(word[at])
    return np.concatenate(buckets), np.concatenate(of)


class Languages:
    """A fitted model: for each language log probabilities of buckets, and the scripts that it uses."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        total = counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
        self.table = np.ascontiguousarray(np.log((counts + SMOOTHING) / total).T.astype(np.float32))
        self.uses = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)) & (scripts > 0)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word; all 0 where no language uses its script, and out of reach where another one does."""
        if not words:
            return np.zeros((0, len(self.names)), np.float32)
        bucket, of = ngrams(words)
        out = np.zeros((len(words), len(self.names)), np.float32)
        for j in range(len(self.names)):
            out[:, j] = np.bincount(of, weights=self.table[bucket, j], minlength=len(words))[: len(words)] / len(ORDERS)
        uses = self.uses[:, script_numbers(words)].T
        out[~uses] = -1e6
        out[~uses.any(axis=1)] = 0
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of texts that stand one after another; all texts go forward together."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # how many texts are longer than t
    dp = np.zeros((len(lengths), scores.shape[1]), np.float32)
    origin = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.int32)
    here = np.arange(scores.shape[1], dtype=origin.dtype)
    for t in range(steps):
        a = active[t]
        at, now = starts[:a] + t, dp[:a]
        if t:
            best = now.argmax(axis=1)
            switched = now[np.arange(a), best][:, None] - penalty
            stay = now >= switched
            origin[at] = np.where(stay, here, best[:, None])
            now = np.where(stay, now, switched)
        dp[:a] = now + scores[at]
        if t % 64 == 63:
            dp[:a] -= dp[:a].max(axis=1, keepdims=True)
    labels = np.zeros(len(scores), np.int64)
    state = dp.argmax(axis=1) if len(lengths) else np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        labels[at] = state[:a]
        state[:a] = origin[at, state[:a]]
    return labels


MOST_LANGUAGES = 256
"""A model has a table for each language, which are on the driver and broadcast; more languages than this are an error of the column."""


def _fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Count the n-grams of all documents to learn from: those with a language whose id isn't 0 modulo ``folds``."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (_fold(id_col, folds) != 0))
    if len(found := rows.select(F.col(lang_col).cast("string")).distinct().limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages, such as {sorted(r[0] for r in found[:5])}")

    def count(batches):
        tables = defaultdict(lambda: np.zeros(BUCKETS + len(SCRIPT_NAMES)))
        for batch in batches:
            found = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang].update(words_of(text))
            for lang, seen in found.items():
                pairs = [(x, n) for w, n in seen.items() if (x := letters_of(w.decode()))]
                words, times = [w for w, _ in pairs], np.array([n for _, n in pairs], float)
                if words:
                    bucket, of = ngrams(words)
                    tables[lang][:BUCKETS] += np.bincount(bucket, weights=times[of], minlength=BUCKETS)
                    size = np.fromiter(map(len, words), float, len(words))
                    tables[lang][BUCKETS:] += np.bincount(script_numbers(words), weights=times * size, minlength=len(SCRIPT_NAMES))
                else:
                    tables[lang]  # a language without a letter is still a language
        for lang, table in tables.items():
            at = np.flatnonzero(table) if table.any() else np.array([BUCKETS])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "key": pa.array(at, pa.int32()), "n": pa.array(table[at])})

    parts = rows.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(releasing(count), "lang string, key int, n double")
    table = parts.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows and some for each language at most
    langs, keys, n = table.column("lang").to_pylist(), table.column("key").to_numpy(), table.column("n").to_numpy()
    names = sorted(set(langs))
    counts = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)))
    counts[[names.index(x) for x in langs], keys] = n
    return Languages(names, counts[:, :BUCKETS], counts[:, BUCKETS:])


OUTPUT = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,length:long>>"


def language_spans(docs: DataFrame, model: Languages, switch: float = SWITCH, with_spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the share of the letters in its spans), spans (runs of words).

    Words are divided by ``[\\x20\\x09-\\x0D]``; those without a letter go with
    the words around them.  A text that is null or has no letter is "und" with
    score 0 and no spans, and so is every text if no language is known.  Of
    languages with as many letters the one that sorts first wins.  An empty
    table gives no rows.  Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: list[list[bytes]]):
        languages = shared.value
        k = len(languages.names)
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
        clean = [letters_of(w.decode()) for w in number]
        size = np.array([len(w) for w in clean], np.int64)
        scores = np.zeros((len(number), k), np.float32)
        with_letters = np.flatnonzero(size)
        scores[with_letters] = languages.word_scores([clean[j] for j in with_letters.tolist()])
        lengths = np.array([len(words) for words in texts], np.int64)
        labels = viterbi(scores[flat], lengths, switch) if k else np.zeros(len(flat), np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        letters = np.bincount(owner * max(k, 1) + labels, weights=size[flat], minlength=len(texts) * max(k, 1)).reshape(len(texts), max(k, 1))
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        known = (total > 0) & (k > 0)
        names = [languages.names[b] if known[d] else UNKNOWN for d, b in enumerate(best.tolist())]
        score = np.where(known, letters.max(axis=1) / np.maximum(total, 1), 0.0)
        spans = [[] for _ in texts]
        if with_spans and len(flat):
            cut = np.flatnonzero((np.diff(labels) != 0) | (np.diff(owner) != 0)) + 1
            begin = np.concatenate([[0], cut])
            first = np.cumsum(lengths) - lengths
            for b, n in zip(begin.tolist(), np.diff(np.concatenate([begin, [len(flat)]])).tolist(), strict=True):
                d = int(owner[b])
                if known[d]:
                    spans[d].append({"lang": languages.names[labels[b]], "start": int(b - first[d]), "length": n})
        return names, score.tolist(), spans

    def run(batches):
        for batch in portions(batches, 1, 8_000_000):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            names, scores, spans = label(texts)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(ids_of(batch.column(0))), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, kind)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), OUTPUT)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_spans(docs, fit(docs), with_spans=False)
    return found.select("doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
