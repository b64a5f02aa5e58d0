"""Operator 9: token sequences of a fixed length, packed best-fit.

Length-histogram planning.  Texts are tokenised and cut once; what the plan
needs is only how many pieces there are of each length, a table of at most
``length`` rows.  Best-fit decreasing runs over these counts: it places all
pieces of one length into all sequences with the best-fitting gap in one step.
Each step is a range of ranks within a length that takes a range of sequences,
and pieces find their step by their rank.  Ranks come from counts by task, so
no length, however many pieces have it, is gathered in one place.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_null, ids_of, portions, releasing, written
from .token_counts import vocabulary_path

TOKENIZER, LENGTH, END = "word_bpe_49k.json", 2048, 0
CACHE = 600_000
PUNCTUATION, END_OF_WORD = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "</w>"
_TOKENIZERS: dict = {}


class WordIds(dict):
    """The ids of units of words as bytes; white space bounds all tokens of this tokenizer, so a text's ids are those of its words.

    A word of letters alone is one pre-token, and the last of its tokens is
    one that ends a word; punctuation after it is another pre-token.  So
    letters and punctuation are units that are encoded apart, many at once, and
    put together.  Letters that the normalizer only makes lower (``plain``)
    need neither it nor the pre-tokenizer's expression, only the merges.  Other
    words are encoded whole, with a special token between them.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.mark = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()), None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        self.merges = self._merges_alone()
        self.plain = self._plain()

    def _merges_alone(self):
        """A tokenizer with this one's merges that cuts at white space and maps bytes, and does nothing else."""
        from tokenizers import Tokenizer

        parts = json.loads(self.tokenizer.to_str()) | {"added_tokens": [], "normalizer": None, "post_processor": None}
        parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        merges = Tokenizer.from_str(json.dumps(parts))
        model = merges.model
        model._resize_cache(0)  # words come once
        merges.model = model
        return merges

    def _plain(self) -> str:
        """Letters before U+0250 (from U+0300 on some join with the one before) that become one lower letter and stand in one pre-token with it.  If none does: a line end, which no word has."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if not normal or not cut:
            return "\n"
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and normal.normalize_str(c) == c.lower() == pc.utf8_lower(c).as_py()]
        return "".join(c for c in letters if len(cut.pre_tokenize_str(3 * c.lower())) == 1 and self._encoded(f"b{c}b").tolist() == self.merges.encode(f"b{c.lower()}b").ids) or "\n"

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _merged(self, text: str) -> np.ndarray:
        return np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_letters(self, cores: list[bytes], encoded) -> None:
        for at in range(0, len(cores), 2000):
            part = cores[at : at + 2000]
            ids = encoded(b" ".join(part).decode())
            ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(ends) != len(part):
                self._learn_others(part)
                continue
            data, begin = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist(), strict=True):
                self[w] = data[begin:end]
                begin = end

    def _learn_others(self, words: list[bytes]) -> None:
        mark, number = self.mark or (None, None)
        plain = [w for w in words if mark and b"<|" not in w]
        for w in set(words).difference(plain):
            self[w] = self._encoded(w.decode()).tobytes()
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self._encoded(mark.join([w.decode() for w in part]))
            cuts = np.flatnonzero(ids == number)
            data, begin = ids.tobytes(), 0
            for w, end in zip(part, [*(4 * cuts).tolist(), len(data)], strict=True):
                self[w] = data[begin:end]
                begin = end + 4

    def learn(self, plain: list[bytes], others: list[bytes]) -> None:
        """Encode units that aren't known yet: lower words of ``plain`` letters, and others."""
        letters = [w.decode().lower().isalpha() for w in others]
        self._learn_letters(plain, self._merged)
        self._learn_letters([w for w, x in zip(others, letters, strict=True) if x], self._encoded)
        self._learn_others([w for w, x in zip(others, letters, strict=True) if not x])

    def _units(self, words: pa.Array) -> tuple[list[bytes], int, np.ndarray]:
        """The distinct units that words consist of, how many of them, which come first, are of ``plain`` letters, and of each word the numbers of two."""
        cores = pc.ascii_rtrim(words, characters=PUNCTUATION.decode())
        tails = pc.utf8_ltrim(words, characters=self.plain)
        plain = pc.and_(pc.match_substring_regex(cores, f"^[{self.plain}]+$"), pc.invert(pc.match_substring(tails, "<|")))
        whole = pc.invert(plain)
        stems, ends = [], []
        for w in words.filter(whole).to_pylist():
            core = w.encode().rstrip(PUNCTUATION).decode()
            apart = core.lower().isalpha() and "<|" not in w
            stems.append(core.encode().lower().decode() if apart else w)  # of bytes: ASCII letters
            ends.append(w[len(core) :] if apart else "")
        stem = pa.concat_arrays([pc.utf8_lower(cores.filter(plain)), pa.array(stems, words.type)]).dictionary_encode()
        tail = pa.concat_arrays([tails.filter(plain), pa.array(ends, words.type)]).dictionary_encode()
        split, of, last = pc.sum(plain).as_py() or 0, stem.indices.to_numpy(), tail.indices.to_numpy()
        is_plain, units = plain.to_numpy(zero_copy_only=False), np.empty((len(words), 2), np.int64)
        for at, k in ((is_plain, slice(split)), (~is_plain, slice(split, None))):
            units[at, 0], units[at, 1] = of[k], last[k] + len(stem.dictionary)
        return [*_strings(stem.dictionary), *_strings(tail.dictionary)], int(of[:split].max(initial=-1)) + 1, units

    def of_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow string column, an end id after each, and where each text's ids end; null counts as empty.

        Words, and then their units, are numbered by Arrow, so that each unit
        is looked up once, and ids are put together by number.
        """
        if len(self) > CACHE:
            self.clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = lists.flatten().dictionary_encode()
        names, n_plain, units = self._units(coded.dictionary)
        ids = list(map(self.get, names))
        gaps = [k for k, x in enumerate(ids) if x is None]
        cut = bisect_left(gaps, n_plain)
        self.learn([names[k] for k in gaps[:cut]], [names[k] for k in gaps[cut:]])
        for k in gaps:
            ids[k] = self[names[k]]
        table, ends = _joined(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, units.ravel())
        table, sizes = np.append(table, np.uint32(END)), np.append(np.diff(ends[1::2], prepend=0), 1)
        last = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64) + 1) - 1  # the place of each text's end among all words and ends
        code = np.full(len(coded) + len(column), len(sizes) - 1, np.int32)
        word = np.ones(len(code), bool)
        word[last] = False
        code[word] = coded.indices.to_numpy()
        data, ends = _joined(table, sizes, code)
        return data, ends[last]


def _strings(column: pa.Array) -> list[bytes]:
    """An Arrow array of strings without line ends, as UTF-8."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column.cast(pa.binary())), b"\n")[0].as_py().split(b"\n") if len(column) else []


def _joined(table: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table``, which has one of each of ``sizes``, that have these numbers, one after another, and where each ends."""
    size = sizes[code]
    ends = np.cumsum(size)
    places = np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - size), size)
    places += np.arange(len(places))
    return table[places], ends


def _word_ids(name: str) -> WordIds:
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = WordIds(name)
    return _TOKENIZERS[name]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of ``length`` ids at most of each text and the end id: doc_id, piece, start, length, ids_crc32, ids, and task and rank (the number of the piece among those of its length in its task)."""

    def run(batches):
        known, task, ranks = _word_ids(tokenizer), TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in portions(batches, 1):
            ids, ends = known.of_texts(batch.column(1))
            data, begins = ids.view(np.uint8), np.append(0, ends)
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, first, last in zip(ids_of(batch.column(0)).tolist(), begins[:-1].tolist(), ends.tolist(), strict=True):
                for k, at in enumerate(range(first, last, length)):
                    n = min(length, last - at)
                    piece = data[4 * at : 4 * (at + n)]
                    for column, value in zip(rows, (doc_id, k, at - first, n, zlib.crc32(piece), piece.tobytes() if with_ids else None, task, ranks[n]), strict=True):
                        column.append(value)
                    ranks[n] += 1
            names, kinds = ("piece", "start", "length", "ids_crc32", "ids", "task", "rank"), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(np.array(rows[0], np.int64))} | {c: pa.array(x, k) for c, x, k in zip(names, rows[1:], kinds, strict=True)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long")


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Steps (length, first rank, count, first sequence, offset): the pieces of
    that length with these ranks go to as many sequences from the first on, to
    that offset.  There are as many steps as pairs of lengths and gaps meet,
    however many pieces there are.
    """
    steps, gaps, at_gap, sequences = [], [], {}, 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in at_gap:
                insort(gaps, gap)
                at_gap[gap] = []
            at_gap[gap].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, n = at_gap[gap].pop()
                if not at_gap[gap]:
                    del at_gap[gap], gaps[k]
                m = min(n, left)
                steps.append((length, rank, m, first, room - gap))
                put(gap, first + m, n - m)
                put(gap - length, first, m)
                rank, left = rank + m, left - m
            else:  # no gap is large enough: as many new sequences as these fill, or one that they don't
                each = room // length
                m, each = (left // each, each) if left >= each else (1, left)
                for j in range(each):
                    steps.append((length, rank, m, sequences, j * length))
                    rank, left = rank + m, left - m
                put(room - each * length, sequences, m)
                sequences += m
    return steps


def best_fit(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Where each piece of each text goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if they are asked for.

    Null and empty texts are one piece, the end id alone.  Only texts with
    more ids than ``length`` are cut, and all their pieces but the last are of
    that length.  An empty table gives no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, length, id_col, text_col, with_ids), "pieces")
    counts = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    steps = np.array(sorted(plan(histogram, length)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(steps)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("rank")).alias("rank")
    )

    def run(batches):
        of, first, _, sequence, offset = shared.value.T
        key = (of << 48) + first
        for batch in batches:
            rank = batch.column(6).to_numpy()
            k = np.searchsorted(key, (batch.column(3).to_numpy() << 48) + rank, side="right") - 1
            placed = [pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *placed], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    placed = ranked.mapInArrow(releasing(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return placed if with_ids else placed.drop("ids")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
