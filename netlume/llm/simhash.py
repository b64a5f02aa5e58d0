"""Operator 8: near duplicates by 64-bit SimHash.

Byte-position inverted index with count filtering.  Fingerprints that differ
in at most 3 bits differ in at most 3 of their 8 bytes, so they share 5
positional bytes or more.  The index posts each distinct fingerprint under 14
choices of 4 positions, the planes of a 2x2x2 cube: any 3 positions are
outside one of them, so any two fingerprints with 5 shared bytes meet in a
posting list.  In a list the shared positional bytes of each pair are tallied,
pairs that reach 5 are retained, and the differing bits of those are counted.

A list yields the links of a spanning star of each of its components, never
its pairs.  Copies are one entry, whatever their number.  Lists of more than
LONG_LIST entries are split by one more position, again without loss, since 5
positions have to agree.  Where 5 do agree in a list that is still so long,
all its pairs reach the minimum, so counting tells nothing; there the entries
within 3 bits are looked up among the 2,324 ways to change 3 bytes, which
takes time in proportion to the list and finds the same links.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, id_or_null, ids_of, partitions, placed, releasing, texts_of, without, written
from .components import components

SEED, SHINGLE, BITS, BYTES = 42, 3, 3, 8
LEAST_SHARED = BYTES - BITS
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
LONG_LIST = 1500
OFTEN = 1000
"""Fingerprints of a thousandth of all rows or more are looked up without a shuffle."""


def fingerprint(text: bytes) -> int:
    """The SimHash of the word shingles of a text; 0 if it has no words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        begins = [0, *(e + 1 for e in ends)]
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1 :], strict=False)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long) of all rows, and the columns PLACE if ``docs`` has them."""
    carry = [c for c in PLACE if c in docs.columns]

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": id_or_null(ids_of(batch.column(0))), "print": pa.array(prints.view(np.int64)), **{c: batch.column(2 + j) for j, c in enumerate(carry)}})

    types = {PLACE[0]: "binary", PLACE[1]: "long"}
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *carry).mapInArrow(releasing(run), ", ".join(["doc_id long, print long", *(f"{c} {types[c]}" for c in carry)]))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits."""
    differ = x ^ y
    unlike = np.zeros(differ.shape, np.uint8)
    for j in range(BYTES):
        unlike += ((differ >> np.uint64(8 * j)) & np.uint64(255)) != 0
    return (unlike <= BYTES - LEAST_SHARED) & (np.bitwise_count(differ) <= BITS)


def _balls(width: int) -> np.ndarray:
    """All numbers of ``width`` bits with 1 to BITS of them set."""
    return np.array([sum(1 << b for b in c) for k in range(1, BITS + 1) for c in combinations(range(width), k)], np.uint64)


def _stars(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of a list to the least of its component; the prints are sorted and distinct."""
    n = len(prints)
    near = _near(prints[:, None], prints[None, :])
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(n)
    return prints[moved], prints[label[moved]]


def _links(prints: np.ndarray, free: list[int]):
    """The links in a posting list; ``free``: the positions in which its members may differ."""
    if len(prints) <= LONG_LIST:
        yield _stars(prints)
    elif len(free) > BITS:  # one more position agrees: a list for each and each of its bytes
        for p in free:
            byte = (prints >> np.uint64(8 * p)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for part in np.split(prints[order], np.flatnonzero(np.diff(byte[order])) + 1):
                if len(part) > 1:
                    yield from _links(part, [f for f in free if f != p])
    else:  # look up all that lies within reach: in proportion to the list
        reach = np.zeros(0, np.uint64)
        narrow = _balls(8 * len(free))
        for j, p in enumerate(free):
            part = ((narrow >> np.uint64(8 * j)) & np.uint64(255)) << np.uint64(8 * p)
            reach = part if not len(reach) else reach | part
        for mask in reach:
            other = prints ^ mask
            at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
            found = (prints[at] == other) & (other < prints)
            yield prints[found], other[found]


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): stars that connect the distinct fingerprints that are linked, directly or through others of their list, and no others."""
    spark = nodes.sparkSession
    buckets = 4 * partitions(spark)
    byte = [F.shiftrightunsigned("print", 8 * j).bitwiseAND(255) for j in range(BYTES)]
    keys = F.array(*(sum((F.shiftleft(byte[p], 8 * i) for i, p in enumerate(plane)), F.lit(k << 32)) for k, plane in enumerate(PLANES)))
    postings = nodes.select("print", F.explode(keys).alias("key")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        key, prints = table.column("key").to_numpy(), table.column("print").to_numpy().view(np.uint64)
        order = np.lexsort((prints, key))
        key, prints = key[order], prints[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([begin, [len(key)]]))
        pairs = begin[size == 2]
        pairs = pairs[_near(prints[pairs], prints[pairs + 1])]
        found = [(prints[pairs + 1], prints[pairs])]
        for a, n in zip(begin[size > 2], size[size > 2], strict=True):
            plane = PLANES[int(key[a] >> 32)]
            found += _links(prints[a : a + n], [p for p in range(BYTES) if p not in plane])
        u, v = (np.concatenate([x[j] for x in found]).view(np.int64) for j in (0, 1))
        return pa.Table.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    return postings.groupBy("bucket").applyInArrow(run, "u long, v long")


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes`` (one row for each fingerprint) with the root of their component."""
    roots = components(links(nodes))
    return nodes.join(roots, nodes["print"] == roots["node"], "left").select(*nodes.columns, F.coalesce("root", "print").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, print (the fingerprint), component_id.

    Fingerprints link at 3 or fewer differing bits, also to other texts and
    also at 0, that of a text without words or a null text; component_id is
    the smallest doc_id that links reach.  Null ids are passed over for
    component_id, unless a component has no other.  An empty table gives no
    rows.  Other columns aren't read.
    """
    prints = written(fingerprints(docs.drop(*PLACE), id_col, text_col), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    rooted = _rooted(nodes)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.join(least, "root").select("print", "component_id", "n"), "members")
    often = F.broadcast(of.where(F.col("n") >= max(1, prints.count() // OFTEN)).select("print", "component_id"))  # OFTEN rows at most, or few more
    hot = prints.join(often, "print")
    rare = prints.join(often.select("print"), "print", "left_anti").join(of.drop("n"), "print")
    return hot.unionByName(rare).select("doc_id", "print", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that with the smallest id, and one without an id only where no other is left.

    Rows are told apart by where they are stored: of repeated rows, of rows
    with one id in one component, and of rows without an id one stays.  Texts
    aren't shuffled, only fingerprints and the places of rows that go.
    """
    own = placed(docs)
    prints = written(fingerprints(own), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *PLACE)).alias("least")
    nodes = written(prints.groupBy("print").agg(least), "nodes")
    stay = _rooted(nodes).groupBy("root").agg(F.min("least").alias("least")).select(*(F.col(f"least.{c}").alias(c) for c in PLACE))
    gone = written(prints.select(*PLACE).join(stay, [*PLACE], "left_anti"), "near")
    return without(own, gone).select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
