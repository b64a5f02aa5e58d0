"""Operator 5: token counts of whole texts.

Map-side two-tier lookup.  A text falls into pre-tokens that no piece of the
vocabulary reaches across, so its count is the sum of theirs.  The counts of
frequent pre-tokens come from a broadcast table of a fixed number of entries;
all others are encoded once in each worker and kept in its cache, which is
bounded too.  Which pre-tokens are frequent is found over all texts: each task
sums up its own in a Misra-Gries summary of a fixed size, summaries (one row
for each task) meet in a few tasks, which add them up, and the sums of these
meet in the driver.  Pre-tokens are never shuffled, and no count depends on
what the table or the caches hold.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MisraGries, id_or_null, ids_of, pack, portions, releasing, unpack

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
"""Pre-tokens: a word with the spaces before it, spaces alone, a line end.  Checked against the vocabulary by ``_checked``."""

TABLE, CACHE = 65_536, 1_000_000
COUNTERS, MERGERS, LONGEST = 65_536, 8, 64
"""Counters of a summary, tasks that add summaries up, and characters of a pre-token in the table."""
_MODELS: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _checked(pieces: list[str]) -> None:
    for p in pieces:
        if "\n" in p or SPACE in p.lstrip(SPACE):
            raise ValueError(f"the piece {p!r} reaches across pre-tokens")


def loaded(model: str):
    """The library's model without the space that it puts before a text, once for each worker; pre-tokens bring that space along."""
    if model not in _MODELS:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(vocabulary_path(model), "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError(f"{model} normalises texts in another way than this operator")
        spec.add_dummy_prefix = False
        _checked([p.piece for p in proto.pieces])
        _MODELS[model] = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    return _MODELS[model]


def pre_tokens(text: str | None) -> list[str]:
    return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lengths(dict):
    """Token counts of pre-tokens: the frequent ones, and a cache of others that starts anew when it is full."""

    def __init__(self, frequent: dict[str, int], model: str):
        super().__init__(frequent)
        self.frequent, self.model = frequent, loaded(model)

    def __missing__(self, unit: str) -> int:
        if len(self) >= CACHE:
            self.clear()
            self.update(self.frequent)
        n = self[unit] = len(self.model.encode(unit))
        return n


def packed_table(units: list[str], numbers: list[int]) -> bytes:
    """Strings and numbers as one compressed string; a zero byte stands before each string but the first."""
    return pack(np.frombuffer("\0".join(units).encode(), np.uint8), np.array(numbers, np.int64))


def table_entries(table: bytes) -> tuple[list[str], list[int]]:
    units, numbers = unpack(table)
    return (units.tobytes().decode().split("\0"), numbers.tolist()) if len(numbers) else ([], [])


def frequent_lengths(docs: DataFrame, text_col: str, model: str, entries: int = TABLE, counters: int = COUNTERS, mergers: int = MERGERS) -> bytes:
    """Counts of the most frequent pre-tokens of all rows, at most ``entries`` of them, as ``packed_table``."""

    def summed(summary: MisraGries) -> pa.RecordBatch:
        found = summary.frequent()
        return pa.RecordBatch.from_pydict({"summary": pa.array([packed_table([*found], [*found.values()])], pa.binary())})

    def count(batches):
        summary = MisraGries(counters)
        for batch in portions(batches, 0):
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(pre_tokens(text))
            kept = [u for u in seen if len(u) <= LONGEST and "\0" not in u]
            summary.add(kept, [seen[u] for u in kept])
        yield summed(summary)

    def merge(batches):
        summary = MisraGries(counters)
        for batch in batches:
            for table in batch.column(0).to_pylist():
                summary.add(*table_entries(table))
        yield summed(summary)

    summaries = docs.select(F.col(text_col).cast("string")).mapInArrow(releasing(count), "summary binary")
    total = MisraGries(counters)
    for r in summaries.repartition(mergers).mapInArrow(releasing(merge), "summary binary").collect():  # ``mergers`` rows of a fixed size
        total.add(*table_entries(r["summary"]))
    top = sorted(((n, u) for u, n in total.held.items() if n > 1), key=lambda x: (-x[0], x[1]))[:entries]
    encode = loaded(model).encode
    return packed_table([u for _, u in top], [len(encode(u)) for _, u in top])


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, as the library's encode gives them for the whole text.

    Nothing is added at either end, and the names of special tokens in texts
    are ordinary text, as is the library's default.  Null and empty texts have
    no tokens; an empty table gives no rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, model))

    def run(batches):
        lengths = Lengths(dict(zip(*table_entries(shared.value), strict=True)), model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [sum(map(lengths.__getitem__, pre_tokens(t))) for t in texts]
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(ids_of(batch.column(0))), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(releasing(run), "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)
