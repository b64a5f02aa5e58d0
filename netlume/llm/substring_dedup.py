"""Operator 4: removal of passages that repeat an earlier document.

Repeated-phrase automata, sharded by anchor.

1. Every window of ``window`` words has an anchor, the least hash of the
   shorter word groups in it.  Equal windows have equal anchors, so only
   windows whose anchor occurs in two documents can recur; one anchor in five
   windows or so is all that is exchanged.
2. What can recur of all documents, the segments of windows with one anchor
   that recurs, goes to the shard of that anchor, as words.  A block of
   documents sends a segment once, with the least and the largest id.
3. A shard confirms the windows that occur in two documents, word by word,
   joins those that always occur together to passages, and compiles these into
   Aho-Corasick automata over an alphabet in which every word has two or three
   letters.  It streams all segments that it got, from all documents, through
   its automaton, and answers where passages lie and which document is the
   first to hold them.  No other shard can hold a window of these segments, so
   all text is streamed once, whatever the number of shards.
4. Each block removes what lies in a passage that an earlier document holds.

The work of a shard is bounded: there are as many as the number of words asks
for, and a passage that very many documents hold comes once from each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, PLACE, Block, Question, buckets_for, by_key, exchange, id_or_null, mix, releasing, replied, rolling, stage_blocks, steps, word_hashes

WINDOW, GROUP = 13, 5
SHARD, LONGEST = 200_000, 64
"""Words of segments that go through one automaton (more if one anchor has more), and words of a passage."""
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB)
BASE = 256
"""Letters that can follow each other in an automaton; it looks through them one by one, so there must not be one for each word."""


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def _windows(block: Block, window: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and their anchors, which are spread over all numbers."""
    n = len(block.words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = block.owners()
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    groups = rolling(word_hashes(block.vocab, 1)[block.words], group, 0x9E3779B97F4A7C15)
    return at, mix(_sliding_min(groups, window - group + 1)[at])


def _least_and_most(order: np.ndarray, begin: np.ndarray, ids: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.minimum.reduceat(ids[order], begin), np.maximum.reduceat((ids if most is None else most)[order], begin)


def _anchors(block: Block, window: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors of a block, and the least and largest id of documents that have each."""
    at, anchor = _windows(block, window, group)
    ids = block.ids[block.owners()[at]] if len(at) else np.zeros(0, np.int64)
    turn = np.ones(len(at), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])
    order, begin, _ = by_key(anchor[turn])
    return anchor[turn][order][begin], *_least_and_most(order, begin, ids[turn])


def _distinct(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each run of words among the distinct ones, and the first run of each of these; compared by the words themselves."""
    numbers: dict[bytes, int] = {}
    raw, size = words.tobytes(), words.itemsize
    which = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)), np.int64, len(starts))
    first = np.zeros(len(numbers), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return which, first


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Segments:
    """The segments of a block: places ``starts``, windows in each ``counts``, and the number ``which`` among the distinct ones, which are in the order of their ``keys`` (anchors)."""

    def __init__(self, block: Block, replies, window: int, group: int):
        at, anchor = _windows(block, window, group)
        flags = replied(replies)
        keep = flags.astype(bool)[np.searchsorted(np.unique(anchor), anchor)] if flags is not None else np.zeros(len(at), bool)
        at, anchor = at[keep], anchor[keep]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(new)
        self.block, self.starts, self.counts = block, at[begin], np.diff(np.append(begin, len(at)))
        which, first = _distinct(block.words, self.starts, self.starts + self.counts + window - 1)
        keys = anchor[begin[first]]
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.which, self.first, self.keys = rank[which] if len(which) else which, first[order], keys[order]
        owner = block.owners()[self.starts] if len(at) else np.zeros(0, np.int64)
        self.ids = block.ids[owner]
        by, begins, _ = by_key(self.which)
        self.least, self.most = _least_and_most(by, begins, self.ids)
        self.window = window

    def message(self, a: int, b: int) -> list[np.ndarray]:
        """Distinct segments a to b: keys, words in each, ids, the words, and their vocabulary."""
        first = self.first[a:b]
        lengths = self.counts[first] + self.window - 1
        used, words = np.unique(self.block.words[_ranges(self.starts[first], lengths)], return_inverse=True)
        vocab = self.block.vocab
        return [steps(self.keys[a:b]), lengths, self.least[a:b], self.most[a:b] - self.least[a:b], words, np.frombuffer(b" ".join([vocab[w] for w in used.tolist()]), np.uint8)]

    def removed(self, earliest: np.ndarray) -> np.ndarray:
        """Which words of the block go; ``earliest``: the first document of each window of the distinct segments."""
        offsets = np.cumsum(self.counts[self.first]) - self.counts[self.first]
        value = earliest[_ranges(offsets[self.which], self.counts)]
        gone = _ranges(self.starts, self.counts)[value < np.repeat(self.ids, self.counts)]
        edges = np.zeros(len(self.block.words) + 1, np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + self.window, -1)
        return np.cumsum(edges[:-1]) > 0


def _equal_windows(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal windows side by side, and where each kind begins; hashes find them, words confirm them."""
    for multiplier in MULTIPLIERS:
        order, begin, number = by_key(rolling(mix(words.astype(np.uint64)), window, multiplier)[at])
        other = at[order[begin]][number]
        if all((words[at + j] == words[other + j]).all() for j in range(window)):
            return order, begin
    raise ValueError("no hash tells these windows apart")


def _spelled(numbers: np.ndarray, letters: int) -> str:
    """Words by number as ``letters`` letters each, with an alphabet of its own for each of them, so that no word begins inside another; 0 is in no passage."""
    out = np.empty((len(numbers), letters), "<u4")
    for j in range(letters):
        out[:, j] = np.where(numbers > 0, numbers // BASE**j % BASE + BASE * j + 1, 0)
    return out.tobytes().decode("utf-32-le")


def _passages(at: np.ndarray, earliest: np.ndarray, here: np.ndarray, before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages that join windows which always occur together, as (where one begins, its length, the earliest document).

    A passage has at most LONGEST words or so; longer ones are cut into
    passages that overlap, so that each window is in one of them.
    """
    order = np.argsort(at)
    at, earliest, here, before = at[order], earliest[order], here[order], before[order]
    joined = np.zeros(len(at), bool)
    joined[1:] = (at[1:] == at[:-1] + 1) & (before[1:] == here[:-1]) & (earliest[1:] == earliest[:-1])
    number = np.arange(len(at))
    run = np.maximum.accumulate(np.where(joined, 0, number))
    begin = np.flatnonzero((number - run) % max(1, LONGEST - window + 1) == 0)
    size = np.diff(np.append(begin, len(at)))
    return at[begin], size + window - 1, earliest[begin]


def _earliest(words: np.ndarray, lengths: np.ndarray, least: np.ndarray, most: np.ndarray, window: int) -> np.ndarray:
    """For each window of distinct segments (``words`` one after another) the first document that holds it, if another one does too, as an automaton of the confirmed passages finds it."""
    import ahocorasick

    ends = np.cumsum(lengths)
    at = _ranges(ends - lengths, lengths - window + 1)
    owner = np.repeat(np.arange(len(lengths)), lengths - window + 1)
    order, begin = _equal_windows(words, at, window)
    low, high = _least_and_most(order, begin, least[owner], most[owner])
    here, before = (np.add.reduceat(mix(x.astype(np.uint64))[order], begin) for x in (at + 1, at))
    shared = low < high
    found = np.full(len(at), NULL_ID)
    if not shared.any():
        return found
    places, sizes, values = _passages(at[order[begin]][shared], low[shared], here[shared], before[shared], window)
    patterns = words[_ranges(places, sizes)]
    used = np.unique(patterns)
    letters = 2 if len(used) < BASE**2 else 3
    number = np.where(words == used[at_most := np.minimum(np.searchsorted(used, words), len(used) - 1)], at_most + 1, 0)
    stream, begins = _spelled(number, letters), places * letters
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for a, size, value in zip(begins.tolist(), sizes.tolist(), values.tolist(), strict=True):
        automaton.add_word(stream[a : a + size * letters], (size, value))
    automaton.make_automaton()
    last, size, value = np.array([(end, size, value) for end, (size, value) in automaton.iter(stream)], np.int64).T
    last = last // letters
    counts = size - window + 1
    window_at = np.full(len(words), -1, np.int64)
    window_at[at] = np.arange(len(at))
    hit = window_at[_ranges(last - size + 1, counts)]
    found[hit[hit >= 0]] = np.repeat(value, counts)[hit >= 0]  # what reaches across segments ends or begins with windows of one
    return found


def _answer_segments(parts: list, window: int) -> list[np.ndarray]:
    """What a shard answers to each block: the first document of each window of each segment, NULL_ID where that is none before the block's last."""
    vocab: dict[bytes, int] = {}
    words = []
    for p in parts:
        number = np.array([vocab.setdefault(w, len(vocab) + 1) for w in p[5].tobytes().split(b" ")], np.uint32)
        words.append(number[p[4]])
    sent = np.array([len(p[0]) for p in parts])
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    words, lengths, least, span = np.concatenate(words), *(np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
    ends = np.cumsum(lengths)
    which, first = _distinct(words, ends - lengths, ends)
    by, begins, _ = by_key(which)
    low, high = _least_and_most(by, begins, least, least + span)
    order = np.argsort(keys[first], kind="stable")
    size, key = lengths[first][order], keys[first][order]
    turn = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # a shard ends where an anchor does
    shard = (np.cumsum(size)[turn] - size[turn]) // SHARD
    cuts = [*turn[np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))].tolist(), len(order)]
    earliest = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = order[a:b]
        earliest.append(_earliest(words[_ranges((ends - lengths)[first[part]], size[a:b])], size[a:b], low[part], high[part], window))
    earliest, counts = np.concatenate(earliest), size - window + 1
    offset = np.empty(len(order), np.int64)
    offset[order] = np.cumsum(counts) - counts
    windows = lengths - window + 1
    out = earliest[_ranges(offset[which], windows)]
    out = np.where(out < np.repeat(least + span, windows), out, NULL_ID)
    per_part = np.add.reduceat(windows, np.cumsum(sent) - sent)
    return np.split(out, np.cumsum(per_part)[:-1])


OUTPUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,length:long>>, kept_text string"
PLACE_OUTPUT = f"{OUTPUT}, {PLACE[0]} binary, {PLACE[1]} long"


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", places: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (runs of words), kept_text.

    A word is removed if a window of ``window`` words that covers it also
    starts in a document with a smaller id.  Words are kept as they are;
    kept_text joins them by one space.  Null and empty texts have no words, a
    text of fewer than ``window`` words loses none, an empty table gives no
    rows.  A null id counts as larger than all others and stays null; rows
    with one id count as one document, so they take nothing from each other.
    Other columns aren't read.  With ``places`` the rows of ``placed``
    documents keep their PLACE.
    """
    group = min(GROUP, window)
    blocks = stage_blocks(docs, id_col=id_col, text_col=text_col, name="passages", places=places)
    buckets = buckets_for(blocks)

    def ask_anchors(row):
        keys, least, most = _anchors(Block.of(row["block_id"], row["data"]), window, group)
        return keys, lambda a, b: [steps(keys[a:b]), least[a:b], most[a:b] - least[a:b]]

    def answer_anchors(parts):
        keys, least, span = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), *(np.concatenate([p[j] for p in parts]) for j in (1, 2))
        order, begin, number = by_key(keys)
        low, high = _least_and_most(order, begin, least, least + span)
        return np.split((low < high)[number].astype(np.uint8), np.cumsum([len(p[0]) for p in parts])[:-1]), ()

    anchors, _ = exchange(blocks, [Question(buckets, ask_anchors, answer_anchors)], "anchors")

    def ask_segments(row):
        segments = Segments(Block.of(row["block_id"], row["data"]), row["replies"], window, group)
        return segments.keys, segments.message

    asked = blocks.join(anchors, "block_id", "left")
    earliest, _ = exchange(asked, [Question(buckets, ask_segments, lambda parts: (_answer_segments(parts, window), ()))], "windows")

    def locate(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                row = {c: batch.column(j)[row].as_py() for j, c in enumerate(batch.schema.names)}
                block = Block.of(row["block_id"], row["data"])
                first = replied(row["earliest"])
                gone = np.zeros(len(block.words), bool) if first is None else Segments(block, row["replies"], window, group).removed(first)
                starts, vocab = block.starts().tolist(), block.vocab
                texts, spans, counts = [], [], []
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    cut = gone[a:b]
                    counts.append(int(cut.sum()))
                    kept = (block.words[a:b][~cut] if counts[-1] else block.words[a:b]).tolist()
                    texts.append(b" ".join([vocab[w] for w in kept]))
                    if counts[-1]:
                        step = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                        spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(step[::2], step[1::2], strict=True)])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": id_or_null(block.ids), "n_words": pa.array(block.lengths, pa.int64()), "n_removed": pa.array(counts, pa.int64()),
                    "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                    **({PLACE[0]: pa.array([x.tobytes() for x in block.files], pa.binary()), PLACE[1]: pa.array(block.rows, pa.int64())} if places else {}),
                })

    return asked.join(earliest.withColumnRenamed("replies", "earliest"), "block_id", "left").mapInArrow(releasing(locate), PLACE_OUTPUT if places else OUTPUT)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
