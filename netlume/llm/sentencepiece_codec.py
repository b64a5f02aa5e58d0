"""Operator 2: texts to the ids that the SentencePiece library gives, and back.

Shared-prefix Viterbi.  The distinct marked words (with the spaces before
them) of a batch that the worker hasn't segmented yet are sorted, which lays
them out as a depth-first walk through their trie: a word differs from the one
before it only below their common prefix.  What the search knows of that
prefix is reused; only the rest is computed.  The pieces that end at a
character, which are the lattice's edges, come from an Aho-Corasick automaton.

The public model is one of merges: its scores are ranks, the best-ranked two
neighbours are joined first, of equal ones the leftmost, and the segmentation
with the best sum of scores is not the one that this ends with.  The state of
the search is therefore the last piece, and its transitions come from the
ranks: a piece may follow another one if merging the characters of both by
rank ends with the two as they are.  A sequence of pieces in which all
neighbours may follow each other is the one that merging ends with, and there
is one for each word and each of its prefixes.  So of the pieces that end at a
character only one can follow what is before it: the search takes that, the
longest being asked first, and has no scores to compare.

Pieces of spaces alone rank below all others, so merging first joins a word
with the last space before it, and then what is left of the run, from its left
end.  Runs are merged by rank, words go through the trie, whatever the number
of spaces before them.  The library's encoder is not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_null, ids_of, portions, releasing
from .token_counts import MODEL, SPACE, loaded, pre_tokens

UNKNOWN = -1
"""Stands for a character without a piece, which becomes the pieces of its bytes."""
ENDING, SHORTER = None, 0
"""Keys of a node besides characters: the pieces that end there, and the node of its longest proper suffix."""
NEVER = float("-inf")
PAIRS, RUNS = 500_000, 10_000
CACHE = 600_000
_LEXICA: dict = {}


class Lexicon:
    """The pieces of a model as a trie, with their scores.  ``scores``: others than the model's."""

    def __init__(self, model: str, scores: list[float] | None = None):
        sp = loaded(model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(self.pieces))]
        self.scores = scores or [sp.get_score(i) for i in range(len(self.pieces))]
        self.rank = {p: self.scores[i] for i, p in enumerate(self.pieces) if self.plain[i]}
        self.number = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        self.longest_run = max((len(p) for p in self.rank if not p.strip(SPACE)), default=1)
        self.lone_space = np.array([self.number.get(SPACE, 0)], "<u4").tobytes()
        self.pairs, self.known, self.runs = {}, {}, {}  # known: words and their ids, for all tasks of the worker
        # Others are never what merging ends with.
        self.root = self._automaton([i for i, p in enumerate(self.pieces) if self.plain[i] and self.merged(p) == [p]])
        byte_pieces = set(self.bytes.values())
        self.texts = [bytes([int(p[3:5], 16)]) if i in byte_pieces else p.replace(SPACE, " ").encode() if self.plain[i] else b"" for i, p in enumerate(self.pieces)]

    def _automaton(self, pieces: list[int]) -> dict:
        """The root of a trie of pieces, whose nodes name theirs that end there, the longest first: length, number, the number as the left one of a pair, and as an id."""
        self.characters = {self.pieces[i] for i in pieces if len(self.pieces[i]) == 1}
        root: dict = {}
        for i in pieces:
            node = root
            for c in self.pieces[i]:
                node = node.setdefault(c, {})
            node[ENDING] = ((len(self.pieces[i]), i, i << 32, np.array([i], "<u4").tobytes()),)
        level = [(root, c, node) for c, node in root.items()]
        while level:
            below = []
            for parent, c, node in level:
                below += [(node, k, child) for k, child in node.items() if k is not ENDING]
                at = parent.get(SHORTER)
                while at is not None and c not in at:
                    at = at.get(SHORTER)
                node[SHORTER] = root if at is None else at[c]
                # A character without a piece is never joined with others.
                node[ENDING] = node.get(ENDING, ()) + node[SHORTER].get(ENDING, ()) if c in self.characters else ()
            level = below
        return root

    def merged(self, text: str, border: int = -1) -> list[str] | None:
        """What merging by rank makes of characters; None as soon as it joins those on both sides of ``border``."""
        parts, rank = [*text], self.rank.get
        values = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while values:
            best = max(values)
            if best == NEVER:
                break
            at = values.index(best)  # the leftmost of equal ones
            if at + 1 == border:
                return None
            border -= at + 1 < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(values):
                values[at] = rank(parts[at] + parts[at + 1], NEVER)
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves two pieces side by side as they are; remembered, as few pairs make up most texts."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.pairs[key] = self.merged(a + b, len(a)) is not None
        return found

    def run(self, n: int) -> bytes:
        """The ids of ``n`` spaces in a row; merging goes from the left, so a long run begins with pieces of one kind."""
        if n not in self.runs:
            if len(self.runs) >= RUNS:
                self.runs.clear()
            head = self.merged(SPACE * min(n, 4 * self.longest_run))[0]
            alike = max(0, n // len(head) - 4)
            parts = [head] * alike + self.merged(SPACE * (n - alike * len(head)))
            self.runs[n] = self._ids([self.number.get(p, UNKNOWN) for p in parts], parts)
        return self.runs[n]

    def _ids(self, numbers: list[int], parts: list[str]) -> bytes:
        ids = []
        for i, p in zip(numbers, parts, strict=True):
            ids += [i] if i >= 0 else [self.bytes[b] for b in p.encode()]
        return np.array(ids, "<u4").tobytes()

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word (little-endian unsigned 32-bit), with all the spaces before it."""
        spaced, plain = {}, set()
        for word in words:
            if word != SPACE and not word.startswith(SPACE + SPACE):
                plain.add(word)
            else:
                rest = word.lstrip(SPACE)
                spaced[word] = len(word) - len(rest), SPACE + rest
        cores = {core for _, core in spaced.values() if core != SPACE}
        found = self._segmented(sorted(plain | cores))
        for word, (n, core) in spaced.items():
            if core == SPACE:
                found[word] = self.run(n)
            elif found[core][:4] == self.lone_space:  # the last space isn't joined with the word, but with the run
                found[word] = self.run(n) + found[core][4:]
            else:
                found[word] = self.run(n - 1) + found[core]
        for core in cores - plain:
            del found[core]
        return found

    def _segmented(self, words: list[str]) -> dict[str, bytes]:
        """The ids of sorted words with one space before them at most."""
        root, known = self.root, self.pairs.get
        # By length of the prefix: its node, its last piece as the left one of a pair, and its ids; a last piece of None stands for no way to end there.
        states, before, out = [(root, UNKNOWN, b"")], "", {}
        for word in words:
            shared = 0
            for a, b in zip(word, before):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            node = states[shared][0]
            for d in range(shared, len(word)):
                c = word[d]
                while (to := node.get(c)) is None and node is not root:
                    node = node[SHORTER]
                node = root if to is None else to
                for length, piece, pair, own in node.get(ENDING, ()):
                    _, last, ids = states[d + 1 - length]
                    if last is None:
                        continue
                    if last != UNKNOWN:
                        follows = known(last | piece)
                        if not (self.may_follow(last >> 32, piece) if follows is None else follows):
                            continue
                    states.append((node, pair, ids + own))
                    break
                else:
                    _, last, ids = states[d]
                    lost = c in self.characters or last is None
                    states.append((node, None, None) if lost else (node, UNKNOWN, ids + self._ids([UNKNOWN], [c])))
            out[word] = states[-1][2]
            before = word
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join([self.texts[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return text.removeprefix(b" ").decode(errors="replace")


def lexicon(model: str) -> Lexicon:
    if model not in _LEXICA:
        _LEXICA[model] = Lexicon(model)
    return _LEXICA[model]


def sentencepiece_encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), decoded_crc32, round_trip.

    The worker decodes the ids again: decoded_crc32 is that of the decoded
    text in UTF-8, and round_trip says whether it is the text that was encoded
    (but for U+2581, which stands for a space).  Null and empty texts have no
    ids.  An empty table gives no rows.  Other columns aren't read.
    """

    def run(batches):
        lex = lexicon(model)
        for batch in portions(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            units = [pre_tokens(t) for t in texts]
            new = set().union(*units).difference(lex.known) if units else set()
            if len(lex.known) + len(new) > CACHE:
                lex.known.clear()
                new = set().union(*units)
            lex.known |= lex.segment(list(new))
            ids = [b"".join(map(lex.known.__getitem__, u)) for u in units]
            decoded = [lex.decode(x) for x in ids]
            yield pa.RecordBatch.from_pydict({
                "doc_id": id_or_null(ids_of(batch.column(0))), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()),
                "decoded_crc32": pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()), "round_trip": pa.array([d == t.replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)]),
            })

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), "doc_id long, n_tokens long, ids binary, decoded_crc32 long, round_trip boolean")


def sentencepiece_decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded: the text of the ids.

    Decoding gives what was encoded, but for U+2581, which stands for a space;
    null ids give null.  A column called decoded is replaced.
    """
    if ids_col != "decoded":
        encoded = encoded.drop("decoded")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded string"
    at = encoded.columns.index(ids_col)

    def run(batches):
        lex = lexicon(model)
        for batch in batches:
            decoded = [None if x is None else lex.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(releasing(run), schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    found = sentencepiece_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "decoded_crc32", "round_trip")
