"""Avro object container files without a jar: formats "ocf" for reading and writing.

Codecs null, deflate and snappy; records of null, boolean, int, long, float,
double, bytes, string, enum, fixed, arrays, maps and unions of null and one
type.  A file is a partition.  On close a file may get an empty ``.done``
beside it.  Files are on any file system that ``files`` knows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import Output, listed, opened

MAGIC, BLOCK, BATCH = b"Obj\x01", 16 * 1024, 4096
_SPARK = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType()}
_AVRO = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "bytes", T.StringType: "string"}


def _long(f) -> int:
    out = shift = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError
        out |= (b[0] & 127) << shift
        if b[0] < 128:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def _varint(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(f) -> bytes:
    return f.read(_long(f))


def _blocks(f, item) -> Iterator:
    while n := _long(f):
        if n < 0:
            _long(f)
        for _ in range(abs(n)):
            yield item()


def _integer(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 128:
        return (b >> 1) ^ -(b & 1), at + 1
    out, shift = b & 127, 7
    while True:
        at += 1
        b = data[at]
        out |= (b & 127) << shift
        if b < 128:
            return (out >> 1) ^ -(out & 1), at + 1
        shift += 7


def _decoder(kind):
    """A function from bytes and a place in them to a value of a type and the place after it; the type is looked at once, not for each value."""
    if isinstance(kind, list):
        kinds = [_decoder(k) for k in kind]

        def union(data, at):
            k, at = _integer(data, at)
            return kinds[k](data, at)

        return union
    name = kind["type"] if isinstance(kind, dict) else kind
    if isinstance(name, (dict, list)):
        return _decoder(name)
    if name in ("int", "long"):
        return _integer
    if name == "null":
        return lambda data, at: (None, at)
    if name == "boolean":
        return lambda data, at: (data[at] == 1, at + 1)
    if name in ("string", "bytes", "fixed"):

        def sized(data, at):
            n, at = (kind["size"], at) if name == "fixed" else _integer(data, at)
            if at + n > len(data):
                raise IndexError
            return (data[at : at + n].decode() if name == "string" else data[at : at + n]), at + n

        return sized
    if name in ("float", "double"):
        number = struct.Struct("<f" if name == "float" else "<d")
        return lambda data, at: (number.unpack(data[at : at + number.size])[0], at + number.size)
    if name == "enum":

        def symbol(data, at):
            k, at = _integer(data, at)
            return kind["symbols"][k], at

        return symbol
    if name in ("array", "map"):
        text, item = _decoder("string"), _decoder(kind["items" if name == "array" else "values"])

        def many(data, at):
            out, keys = [], []
            while True:
                n, at = _integer(data, at)
                if not n:
                    return (out if name == "array" else dict(zip(keys, out, strict=True))), at
                if n < 0:
                    _, at = _integer(data, at)
                for _ in range(abs(n)):
                    if name == "map":
                        key, at = text(data, at)
                        keys.append(key)
                    x, at = item(data, at)
                    out.append(x)

        return many
    if name == "record":
        fields = [_decoder(x["type"]) for x in kind["fields"]]

        def record(data, at):
            out = []
            for take in fields:
                x, at = take(data, at)
                out.append(x)
            return tuple(out), at

        return record
    raise ValueError(f"unknown Avro type {kind!r}")


@cache
def _small() -> list[bytes]:
    """Ports, lengths, flags and other small numbers."""
    return [_varint(n) for n in range(65536)]


def _encoder(kind):
    """A function that appends the bytes of a value of a type to a bytearray; the type is looked at once, not for each value."""
    if isinstance(kind, list):
        ways = {t == "null": (_varint(j), _encoder(t)) for j, t in reversed(list(enumerate(kind)))}
        (null, _), (mark, inner) = ways.get(True, (None, None)), ways[False]

        def union(out, x):
            if x is None:
                out += null
            else:
                out += mark
                inner(out, x)

        return union
    if kind == "null":
        return lambda out, x: None
    if kind in ("int", "long"):
        small = _small()

        def integer(out, x):
            out += small[x] if 0 <= x < 65536 else _varint(int(x))

        return integer
    if kind in ("string", "bytes"):
        text = kind == "string"

        def sized(out, x):
            data = x.encode() if text else bytes(x)
            out += _varint(len(data))
            out += data

        return sized
    if kind == "boolean":
        return lambda out, x: out.append(1 if x else 0)
    if kind in ("float", "double"):
        pack = struct.Struct("<f" if kind == "float" else "<d").pack
        return lambda out, x: out.extend(pack(x))
    if kind["type"] == "array":
        item = _encoder(kind["items"])

        def array(out, x):
            if x:
                out += _varint(len(x))
                for y in x:
                    item(out, y)
            out.append(0)

        return array
    fields = [(f["name"], _encoder(f["type"])) for f in kind["fields"]]

    def record(out, x):
        for name, put in fields:
            put(out, x[name])

    return record


def avro_schema(schema: T.StructType, name: str = "row") -> dict:
    """The Avro schema of rows; nullable fields are unions with null."""

    def kind(t):
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": ["null", kind(t.elementType)] if t.containsNull else kind(t.elementType)}
        if isinstance(t, T.StructType):
            return avro_schema(t, f"{name}_{len(t)}")
        return _AVRO[type(t)]

    return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", kind(f.dataType)] if f.nullable else kind(f.dataType)} for f in schema]}


def spark_schema(kind) -> T.DataType:
    if isinstance(kind, list):
        return spark_schema(next(k for k in kind if k != "null"))
    name = kind["type"] if isinstance(kind, dict) else kind
    if isinstance(name, (dict, list)):
        return spark_schema(name)
    if name == "record":
        return T.StructType([T.StructField(f["name"], spark_schema(f["type"])) for f in kind["fields"]])
    if name == "array":
        return T.ArrayType(spark_schema(kind["items"]))
    if name == "map":
        return T.MapType(T.StringType(), spark_schema(kind["values"]))
    return {"enum": T.StringType(), "fixed": T.BinaryType()}.get(name) or _SPARK[name]


def _header(f) -> tuple[dict, str, bytes]:
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = dict(_blocks(f, lambda: (_bytes(f).decode(), _bytes(f))))
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


CODECS = ("null", "deflate", "snappy")


def packed(codec: str, data: bytes) -> bytes:
    """A block in its codec; a snappy block ends with the CRC-32 of what is in it."""
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        return c.compress(data) + c.flush()
    if codec == "snappy":
        return pa.compress(data, codec="snappy", asbytes=True) + zlib.crc32(data).to_bytes(4)
    return data


def unpacked(codec: str, data: bytes, name: str = "") -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "snappy":
        size = shift = at = 0
        while True:  # a snappy block begins with its unpacked size
            size |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                break
        out = pa.decompress(data[:-4], decompressed_size=size, codec="snappy", asbytes=True)
        if zlib.crc32(out) != int.from_bytes(data[-4:]):
            raise ValueError(f"{name} is damaged")
        return out
    return data


@dataclass
class _File(InputPartition):
    path: str


class OcfReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType):
        self.paths, self.schema = paths, schema

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator:
        rows = self._rows(partition)
        if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.NullType)) for f in self.schema):
            yield from rows
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        while held := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def _rows(self, partition: _File) -> Iterator[tuple]:
        with opened(partition.path) as f:
            kind, codec, sync = _header(f)
            if codec not in CODECS:
                raise ValueError(f"{partition.path}: no reader for codec {codec}")
            take = _decoder(kind)
            while True:
                try:
                    n = _long(f)
                except EOFError:
                    return
                block, at = unpacked(codec, _bytes(f), partition.path), 0
                try:
                    for _ in range(n):
                        row, at = take(block, at)
                        yield row
                except (IndexError, struct.error) as e:
                    raise ValueError(f"{partition.path} is damaged") from e
                if f.read(16) != sync:
                    raise ValueError(f"{partition.path} is damaged")


@dataclass
class _Written(WriterCommitMessage):
    name: str


class OcfWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.kind, self.codec = avro_schema(schema), options.get("codec", "deflate")
        if self.codec not in CODECS:
            self.codec = "deflate"
        self.output = Output(options["path"], overwrite, ".avro", options.get("done", "false") == "true")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        f, name = self.output.new()
        sync = os.urandom(16)
        meta = {"avro.schema": json.dumps(self.kind).encode(), "avro.codec": self.codec.encode()}
        with f:
            f.write(MAGIC + _varint(len(meta)) + b"".join(_varint(len(k)) + k.encode() + _varint(len(v)) + v for k, v in meta.items()) + b"\x00" + sync)
            held, n = bytearray(), 0
            puts = [_encoder(x["type"]) for x in self.kind["fields"]]

            def flush():
                data = packed(self.codec, bytes(held))
                f.write(_varint(n) + _varint(len(data)) + data + sync)

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for put, x in zip(puts, row, strict=True):
                        put(held, x)
                    n += 1
                    if len(held) >= BLOCK:
                        flush()
                        held, n = bytearray(), 0
            if n:
                flush()
        return _Written(name)

    def commit(self, messages) -> None:
        self.output.commit([m.name for m in messages if m])

    def abort(self, messages) -> None:
        self.output.abort()


class OcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocf"

    def schema(self):
        with opened(listed(self.options)[0]) as f:
            return spark_schema(_header(f)[0])

    def reader(self, schema) -> OcfReader:
        return OcfReader(listed(self.options), schema)

    def writer(self, schema, overwrite: bool) -> OcfWriter:
        return OcfWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OcfSource)


def read_flows(spark: SparkSession, path: str):
    """Flow files as flows: fields by name, in their order.  All providers count as used: what isn't known is ``??`` or 0 in the fields themselves."""
    from ..operators.flows import FIELDS

    rows = spark.read.format("ocf").load(path)
    return rows.select(*FIELDS)
