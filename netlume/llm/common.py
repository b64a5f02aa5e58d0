"""What the training-data operators share: the shared folder, places of rows,
packed arrays, word blocks, and the keyed exchange between blocks.

Blocks
    ``stage_blocks`` cuts a table of texts, in the order in which its tasks
    read it, into blocks of some MB of text, one row each.  A block holds the
    block's vocabulary and its texts as arrays of vocabulary numbers.  Blocks
    are written to the shared folder, bucketed by their number into as many
    parts as the size of the input asks for, so later steps join small things
    to them without moving the texts again.

Exchange
    ``exchange`` lets blocks ask questions about keys (hashes of words, word
    windows, ...).  A block names each of its keys once, however often the key
    occurs in it, so a key that a third of all rows hold costs one entry for
    each block.  Keys are dealt by ranges to buckets; there are as many of
    these as the measured number of words asks for, so that none outgrows a
    worker.  A message is what a block has for a bucket: the segments that any
    shuffle has, packed.  There is none without an entry, so messages are never
    more than entries.  Keys go as differences of sorted ones.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = np.iinfo(np.int64).max
"""Stands for a null id inside blocks: it orders after all others."""

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the session names in ``spark.checkpoint.dir``.  Only a
    local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="netlume-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


_SCRATCH: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What ``written`` writes inside goes when this ends, but for results written with ``stays``."""
    at = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(at)
    try:
        yield
    finally:
        _SCRATCH.remove(at)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, bucket: tuple[int, str] | None = None, stays: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    This cuts the lineage, and lets go of the shuffle files behind it.  With
    ``bucket`` the files are bucketed, without a shuffle.
    """
    spark = df.sparkSession
    at = f"{_SCRATCH[-1] if _SCRATCH and not stays else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        if bucket is None:
            df.write.parquet(at)
            return spark.read.schema(df.schema).parquet(at)
        table = f"netlume_{name}_{uuid.uuid4().hex}"
        df.write.option("path", at).bucketBy(*bucket).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved here, so that the catalog entry is not needed any more
    spark.sql(f"DROP TABLE {table}")
    return out


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


PLACE = ("_place_file", "_place_row")
"""The columns that name a row by where it is stored: the MD5 of its file's path, and its number in that file."""


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with PLACE, the same for a row however often and wherever it is read.

    A table that isn't read from Parquet files as they are is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        docs = written(docs, "rows")
    return docs.withColumns({PLACE[0]: F.unhex(F.md5("_metadata.file_path")), PLACE[1]: F.col("_metadata.row_index")})


FEW_ROWS = 1_000_000
"""So many places (under 100 MB of them) are broadcast; more go through a shuffle."""


def small(places: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written table of places, to be broadcast if its rows, which are counted, are few."""
    return F.broadcast(places) if places.count() <= most else places


def without(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``placed`` documents that aren't at any of the written ``places``; texts stay where they are if the places are few."""
    return docs.join(small(places), [*PLACE], "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that was freed back to the system; a worker serves many tasks, of all stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """A function of record batches that calls ``release`` when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


SPLIT_BYTES = 64 << 20


def splits(docs: DataFrame) -> int:
    """Parts for a table of texts: one for each SPLIT_BYTES of files, by the plan's own estimate, and as many as a shuffle has at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), min(size // SPLIT_BYTES, 100_000) if size < 1 << 50 else 0)  # more stands for a size that isn't known


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    if a.dtype.kind == "b":
        return a.astype(np.uint8)
    if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
        most = int(a.max())
        return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64, copy=False)
    return a


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as one compressed string; the first bytes of all numbers come first, then the second ones."""
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        small = _narrow(a)
        planes = np.ascontiguousarray(small).view(np.uint8).reshape(len(small), -1).T if len(small) else small
        parts += [struct.pack("<4s4sQ", a.dtype.str.encode().ljust(4), small.dtype.str.encode().ljust(4), len(a)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, in the types that they had."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, held, length = struct.unpack_from("<4s4sQ", raw, at)
        at += 16
        dtype, small = np.dtype(kind.strip().decode()), np.dtype(held.strip().decode())
        a = np.frombuffer(raw, np.uint8, length * small.itemsize, at)
        at += length * small.itemsize
        out.append(np.ascontiguousarray(a.reshape(small.itemsize, length).T).view(small).reshape(length).astype(dtype, copy=False) if small.itemsize > 1 else a.view(small).astype(dtype, copy=False))
    return out


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 strings; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def portions(batches, column: int, most: int = 4_000_000):
    """Record batches cut so that the texts in one have about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if not pa.types.is_null(batch.column(column).type) else np.zeros(batch.num_rows)
        portion = np.cumsum(sizes + 16) // most
        cuts = np.flatnonzero(np.diff(portion)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def ids_of(column) -> np.ndarray:
    """An Arrow column of ids as int64, null as NULL_ID."""
    return np.array([NULL_ID if x is None else x for x in column.to_pylist()], np.int64)


def id_or_null(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


class MisraGries:
    """Counts that are too low by at most ``rows / (counters + 1)``."""

    def __init__(self, counters: int):
        self.counters, self.rows, self.held = counters, 0, {}

    def add(self, values: list, counts: list[int]) -> None:
        held = self.held
        for v, c in zip(values, counts, strict=True):
            held[v] = held.get(v, 0) + c
            self.rows += c
        if len(held) > self.counters:
            cut = sorted(held.values(), reverse=True)[self.counters]
            self.held = {v: c - cut for v, c in held.items() if c > cut}

    def frequent(self) -> dict:
        """Counters above the error; leaving out the others makes it at most twice as large."""
        return {v: c for v, c in self.held.items() if c * (self.counters + 1) > self.rows}


class Block:
    """Documents as arrays: ``ids`` and ``lengths`` by document, ``words`` (numbers into ``vocab``) one after another; ``files`` and ``rows`` are their places if they were asked for."""

    __slots__ = ("block_id", "ids", "lengths", "words", "vocab", "files", "rows")

    def __init__(self, block_id, ids, lengths, words, vocab, files=None, rows=None):
        self.block_id, self.ids, self.lengths, self.words, self.vocab, self.files, self.rows = block_id, ids, lengths, words, vocab, files, rows

    @classmethod
    def of(cls, block_id: int, data: bytes) -> Block:
        ids, lengths, words, vocab, *places = unpack(data)
        files, rows = (places[0].reshape(-1, DIGEST), places[1]) if places else (None, None)
        return cls(block_id, ids, lengths.astype(np.int64), words, vocab.tobytes().split(b" ") if len(vocab) else [], files, rows)

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)])

    def owners(self) -> np.ndarray:
        """The number in the block of the document of each word."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)


BLOCK_SCHEMA = "block_id long, n_words long, n_distinct long, data binary"
BLOCK_BYTES = 4_000_000
DIGEST = 16
"""Bytes of the MD5 of a path."""


def stage_blocks(docs: DataFrame, lower: bool = False, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", name: str = "blocks", places: bool = False) -> DataFrame:
    """Blocks of the words ``[^\\x20\\x09-\\x0D]+`` of all texts; ``lower`` maps A-Z to a-z first.

    A text is never cut; a block takes texts until it holds ``block_bytes``.
    ``places`` keeps the PLACE of each row.
    """

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        ids, lengths, words, vocab, held, files, rows = [], [], [], {}, 0, [], []

        def flush():
            nonlocal ids, lengths, words, vocab, held, count, files, rows
            flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
            own = [np.frombuffer(b"".join(files), np.uint8), np.array(rows, np.int64)] if places else []
            data = pack(np.array(ids, np.int64), np.array(lengths, np.uint32), flat, np.frombuffer(b" ".join(vocab), np.uint8), *own)
            out = pa.RecordBatch.from_pydict({
                "block_id": pa.array([(task << 24) + count], pa.int64()), "n_words": pa.array([len(flat) + len(ids)], pa.int64()), "n_distinct": pa.array([len(vocab) + 2], pa.int64()),
                "data": pa.array([data], pa.binary()),
            })
            ids, lengths, words, vocab, held, count, files, rows = [], [], [], {}, 0, count + 1, [], []
            return out

        for batch in batches:
            where = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if places else [(None, None)] * batch.num_rows
            for i, text, (file, row) in zip(ids_of(batch.column(0)).tolist(), texts_of(batch.column(1)), where, strict=True):
                split = (text.lower() if lower else text).split()  # bytes: exactly the ASCII white space above, and A-Z only
                words.append(np.fromiter([vocab.setdefault(w, len(vocab)) for w in split], np.uint32, len(split)))
                ids.append(i)
                lengths.append(len(split))
                if places:
                    files.append(file)
                    rows.append(row)
                held += len(text) + 16
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    blocks = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *(PLACE if places else ())).mapInArrow(releasing(run), BLOCK_SCHEMA)
    return written(blocks, name, (splits(docs), "block_id"))


ENTRIES = 1_500_000
"""Entries in a bucket of an exchange, if each word is one."""


def buckets_for(blocks: DataFrame, column: str = "n_words") -> int:
    """How many buckets an exchange needs in which each word (or distinct word) of a block is an entry at most."""
    return max(1, -(-int(blocks.agg(F.sum(column)).first()[0] or 0) // ENTRIES))


def word_hashes(vocab: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in vocab), np.uint64, len(vocab))


def rolling(values: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """A hash of each k consecutive values (as if all were one document)."""
    n = max(0, len(values) - k + 1)
    out, m = np.zeros(n, np.uint64), np.uint64(multiplier)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= m
            out += values[j : j + n]
    return mix(out)


def _bounds(buckets: int) -> np.ndarray:
    """Where the range of keys of each bucket begins."""
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the first and the differences; ``np.cumsum`` makes them keys again."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out


class Question:
    """One kind of question of an exchange.

    ``request(row)`` gives the sorted 64-bit keys of a block and a function
    that gives for a range of them the arrays to send.  ``reduce(parts)`` gets
    for a bucket what the blocks sent (lists of arrays, in the order of the
    blocks) and returns an array of answers for each, and counters.
    """

    def __init__(self, buckets: int, request, reduce):
        self.buckets, self.request, self.reduce = buckets, request, reduce


def exchange(asked: DataFrame, questions: list[Question], name: str) -> tuple[DataFrame, DataFrame]:
    """Ask questions from all blocks, and answer each of them.

    ``asked`` has block_id, data, and what the requests need besides.
    Returned are a table of (block_id, replies) and one of (question,
    counters), a row for each bucket.  All requests of a row are called
    together, so they may share what the first has made of it.
    """
    names = asked.columns
    offsets = np.concatenate([[0], np.cumsum([q.buckets for q in questions])]).tolist()

    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                of = {c: batch.column(j)[row].as_py() for j, c in enumerate(names)}
                to, data = [], []
                for q, offset in zip(questions, offsets, strict=False):
                    keys, cut = q.request(of)
                    ends = np.append(np.searchsorted(keys, _bounds(q.buckets)), len(keys))
                    for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                        to.append(offset + b)
                        data.append(pack(*cut(int(ends[b]), int(ends[b + 1]))))
                if to:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(to, pa.int32()), "block_id": pa.array([of["block_id"]] * len(to), pa.int64()), "data": pa.array(data, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id").combine_chunks()  # sums of fractions don't depend on what came first
        bucket = table.column("bucket")[0].as_py()
        k = int(np.searchsorted(offsets, bucket, "right")) - 1
        answers, counters = questions[k].reduce([unpack(x) for x in table.column("data").to_pylist()])
        first = [[float(k), *map(float, counters)]] + [None] * (len(answers) - 1)
        release()
        return pa.Table.from_pydict({"block_id": table.column("block_id"), "bucket": table.column("bucket"), "data": pa.array([pack(a) for a in answers], pa.binary()), "counters": pa.array(first, pa.list_(pa.float64()))})

    requests = asked.mapInArrow(releasing(ask), "bucket int, block_id long, data binary").repartition(max(2 * offsets[-1], partitions(asked.sparkSession)), "bucket")
    answers = written(requests.groupBy("bucket").applyInArrow(answer, "block_id long, bucket int, data binary, counters array<double>"), name)
    replies = answers.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "data")).alias("replies"))
    return replies, answers.where("counters is not null").select(F.col("counters")[0].cast("int").alias("question"), F.expr("slice(counters, 2, size(counters) - 1)").alias("counters"))


def replied(replies, first: int = 0, buckets: int | None = None) -> np.ndarray | None:
    """The answers in the order of the keys that were asked, of the question whose buckets begin at ``first``; None if there were no keys."""
    own = [r for r in replies or () if first <= r["bucket"] and (buckets is None or r["bucket"] < first + buckets)]
    return np.concatenate([unpack(r["data"])[0] for r in sorted(own, key=lambda r: r["bucket"])]) if own else None


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, where each distinct key begins in it, and the number of each entry's key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number
