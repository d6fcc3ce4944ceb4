"""The binary map format: a Python data source that reads blobs in parallel, and a writer.

A file is a row of blobs of a few thousand features. The driver reads only the blob headers; each
task then reads and unpacks its own blobs. The path must be one that all executors can open.
"""

from __future__ import annotations

import datetime
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eonmap.sources import tables

SCHEMAS = {"nodes": tables.NODES, "ways": tables.WAYS, "relations": tables.RELATIONS}
KINDS = "nwr"
#: Blobs that a task reads; features that the writer puts into a blob.
BLOBS, FEATURES = 16, 8000
#: Coordinates are in units of a billionth of a degree, stored in steps of a hundred.
NANO, STEP = 1e-9, 100


# ------------------------------------------------------------- wire format
def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at:at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at:at + n], at + n
        yield key >> 3, value


def packed(data: bytes, signed: bool = False, summed: bool = False) -> np.ndarray:
    """Numbers of a packed field; ``signed``: zigzag; ``summed``: differences."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    begin = np.r_[0, last[:-1] + 1]
    nth = np.arange(len(b)) - np.repeat(begin, last - begin + 1)
    v = np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * nth).astype(np.uint64), begin)
    out = ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64) if signed else v.view(np.int64)
    return np.cumsum(out) if summed else out


def _put(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _number(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _pack(values: list[int], signed: bool = False, summed: bool = False) -> bytes:
    if summed:
        values = [b - a for a, b in zip([0, *values], values, strict=False)]
    return b"".join(_number((v << 1 if v >= 0 else -2 * v - 1) if signed else v) for v in values)


# ------------------------------------------------------------- reading
def blob_places(path: str) -> list[tuple[str, int, int]]:
    """Type, offset and size of each blob."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            info = dict(fields(f.read(struct.unpack(">I", head)[0])))
            out.append((bytes(info[1]).decode(), f.tell(), int(info[3])))
            f.seek(int(info[3]), 1)
    return out


def _unpack(blob: bytes) -> bytes:
    f = dict(fields(blob))
    return bytes(f[1]) if 1 in f else zlib.decompress(f[3])


def header_timestamp(path: str) -> str | None:
    """Date and time of the snapshot, null if the header has none."""
    kind, at, n = blob_places(path)[0]
    with open(path, "rb") as f:
        f.seek(at)
        seconds = dict(fields(_unpack(f.read(n)))).get(32)
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if kind == "OSMHeader" and seconds else None


def block_rows(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows of nodes, ways or relations in a block."""
    strings, groups, granularity, lat0, lon0 = [], [], STEP, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [bytes(x).decode() for _, x in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 19:
            lat0 = packed(_number(v))[0]
        elif n == 20:
            lon0 = packed(_number(v))[0]
    place = lambda v, zero: round((int(zero) + granularity * int(v)) * NANO, 9)
    for g in groups:
        for n, v in fields(g):
            if kind == "nodes" and n == 2:
                f = dict(fields(v))
                kv, at = packed(f.get(10, b"")).tolist(), 0
                for i, lat, lon in zip(*(packed(f.get(k, b""), True, True).tolist() for k in (1, 8, 9)), strict=True):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield i, place(lon, lon0), place(lat, lat0), tags
            elif n == {"nodes": 1, "ways": 3, "relations": 4}[kind]:
                f = dict(fields(v))
                tags = {strings[k]: strings[x] for k, x in zip(packed(f.get(2, b"")).tolist(), packed(f.get(3, b"")).tolist(), strict=True)}
                if kind == "nodes":
                    i, lat, lon = (int(packed(_number(f[k]), True)[0]) for k in (1, 8, 9))
                    yield i, place(lon, lon0), place(lat, lat0), tags
                elif kind == "ways":
                    yield f[1], packed(f.get(8, b""), True, True).tolist(), tags
                else:
                    roles, refs, types = packed(f.get(8, b"")).tolist(), packed(f.get(9, b""), True, True).tolist(), packed(f.get(10, b"")).tolist()
                    yield f[1], tags, [{"type": KINDS[t], "ref": r, "role": strings[s]} for t, r, s in zip(types, refs, roles, strict=True)]


@dataclass
class Blobs(InputPartition):
    places: list[tuple[str, int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[Blobs]:
        data = [b for b in blob_places(self.path) if b[0] == "OSMData"]
        return [Blobs(data[i:i + BLOBS]) for i in range(0, len(data), BLOBS)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for _, at, n in partition.places:
                f.seek(at)
                yield from block_rows(_unpack(f.read(n)), self.kind)


class PbfSource(DataSource):
    """``spark.read.format("osmpbf").option("kind", "ways").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema: object) -> PbfReader:
        return PbfReader(self.options["path"].removeprefix("file://"), self.options.get("kind", "nodes"))


def read_pbf(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("osmpbf").option("kind", kind).load(path)


# ------------------------------------------------------------- writing
def encode_block(rows: list[tuple], kind: str) -> bytes:
    """A block of rows as ``block_rows`` gives them."""
    table: dict[str, int] = {"": 0}
    s = lambda x: table.setdefault(x, len(table))
    if kind == "nodes":
        kv = [n for r in rows for n in [*[s(x) for p in r[3].items() for x in p], 0]]
        place = lambda x: round(x / (NANO * STEP))
        group = _put(2, _put(1, _pack([r[0] for r in rows], True, True)) + _put(8, _pack([place(r[2]) for r in rows], True, True)) + _put(9, _pack([place(r[1]) for r in rows], True, True)) + _put(10, _pack(kv)))
    else:
        parts = []
        for r in rows:
            tags = r[2] if kind == "ways" else r[1]
            own = _put(1, r[0]) + _put(2, _pack([s(k) for k in tags])) + _put(3, _pack([s(v) for v in tags.values()]))
            if kind == "ways":
                own += _put(8, _pack(list(r[1]), True, True))
            else:
                own += _put(8, _pack([s(m["role"] or "") for m in r[2]])) + _put(9, _pack([m["ref"] for m in r[2]], True, True)) + _put(10, _pack([KINDS.index(m["type"]) for m in r[2]]))
            parts.append(_put(3 if kind == "ways" else 4, own))
        group = b"".join(parts)
    return _put(1, b"".join(_put(1, x.encode()) for x in table)) + _put(2, group)


def _blob(kind: str, data: bytes) -> bytes:
    body = _put(2, len(data)) + _put(3, zlib.compress(data))
    head = _put(1, kind.encode()) + _put(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def write_pbf(path: str, nodes: DataFrame, ways: DataFrame, relations: DataFrame, timestamp: int | None = None) -> None:
    """Nodes, then ways, then relations, each in order of id. Executors make the blobs, of a bounded
    number of features; the driver appends them one after another."""
    features = _put(4, b"OsmSchema-V0.6") + _put(4, b"DenseNodes") + (_put(32, timestamp) if timestamp else b"")
    with open(path, "wb") as f:
        f.write(_blob("OSMHeader", features))
        for kind, df in (("nodes", nodes), ("ways", ways), ("relations", relations)):
            columns = [c.strip().split(" ")[0] for c in ("id, lon, lat, tags", "id, refs, tags", "id, tags, members")[list(SCHEMAS).index(kind)].split(",")]

            def make(batches: Iterator[pd.DataFrame], kind: str = kind, columns: list[str] = columns) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for a in range(0, len(b), FEATURES):
                        rows = [tuple(dict(v) if c == "tags" else v for c, v in zip(columns, r, strict=True)) for r in b[columns][a:a + FEATURES].itertuples(index=False)]
                        yield pd.DataFrame({"first": [int(rows[0][0])], "blob": [_blob("OSMData", encode_block(rows, kind))]})

            clean = df.withColumn("tags", F.coalesce("tags", F.create_map().cast(tables.TAGS))).select(*columns)
            blobs = tables.materialise(clean.repartitionByRange("id").sortWithinPartitions("id").mapInPandas(make, "first bigint, blob binary"))
            for r in blobs.orderBy("first").toLocalIterator():
                f.write(r["blob"])
