"""Token ids in binary shards: a shared zstandard dictionary, one frame a document, an offset index.

Documents are dealt by ranges of their id and encoded in that order. Each task writes shards of its own
and returns a row a shard; the rows that Spark commits are the manifest, so the shards of a lost or
repeated task are not part of the output. A shard reads as

    magic | frames | index (Arrow stream: doc_id, start, n_tokens, at, size) | footer (JSON) | its length | magic

``start`` counts ids from the shard's first, the manifest holds what stands before the shard. A
frame is one document, compressed with the dictionary that all shards share, whose SHA-256 is in the
footer: a short document is read by its index row alone, and costs no neighbour's bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eonmap.llm.common import materialise, slices

MAGIC = b"EONTOK01"
#: Ids in a shard (one document at least), and texts, as characters, that a worker encodes at once.
SHARD_IDS, CHARS = 32_000_000, 2_000_000
#: The dictionary: its bytes, about how many documents it is trained on, and ids taken of each.
DICTIONARY, SAMPLE, SAMPLE_IDS = 65_536, 2_000, 2_048
#: Parts of texts whose ids a worker remembers: of two generations, the older one goes as a whole when the newer one is half as many.
REMEMBERED = 1_200_000
#: Letters, and characters that the pattern below cuts as the vocabulary's own does.
LATIN, KNOWN = "a-zß-öø-ÿ", r"\t-\r -~À-ÖØ-öø-ÿ"
UNKNOWN = re.compile(f"[^{KNOWN}]")
#: The vocabulary's pattern over these characters, once they are lowered (contractions are its fixed values); words, which start unlike all else, come first.
PARTS = re.compile(rf"[{LATIN}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LATIN}0-9]+")


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct part once.

    The vocabulary lowers text and cuts it at white space, letters, digits and marks before it
    merges, so parts encode alike wherever they stand. Words with other characters than ``KNOWN``
    go to the library as they are, and so do texts that hold ``<|``, which may be a special token.
    Vocabularies of other kinds are given whole texts.
    """

    def __init__(self, vocabulary: str, width: np.dtype):
        from tokenizers import Tokenizer

        self.library, self.width = Tokenizer.from_str(vocabulary), width
        told = json.loads(vocabulary)
        self.by_word = told["model"].get("end_of_word_suffix") == "</w>" and told["normalizer"] == LOWERING and told["pre_tokenizer"] == CUTTING
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.by_word:
            size = self.library.get_vocab_size()
            self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        again = [p for p in new if p in self.older]
        self.parts.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = new.difference(again)
        odd = [p for p in new if UNKNOWN.search(p)]
        self.parts.update(zip(odd, self._whole(odd), strict=True))
        new = list(new.difference(odd))
        for a, b in slices(map(len, new), 20_000):
            some = new[a:b]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                starts, raw, step = [0, *ends[:-1].tolist()], ids.tobytes(), self.width.itemsize
                self.parts.update(zip(some, (raw[x * step:y * step] for x, y in zip(starts, ends.tolist(), strict=True)), strict=True))
            else:
                self.parts.update(zip(some, self._whole(some), strict=True))

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not UNKNOWN.search(text):
            return PARTS.findall(text.lower())
        out: list[str] = []
        for odd, words in itertools.groupby(text.replace("\n", " ").split(" "), lambda w: UNKNOWN.search(w) is not None):
            out += words if odd else PARTS.findall(" ".join(words).lower())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if not self.by_word:
            return self._whole(texts)
        if len(self.parts) > REMEMBERED // 2:
            self.parts, self.older = {}, self.parts
        special = [i for i, t in enumerate(texts) if "<|" in t]
        cut = [[] if "<|" in t else self._cut(t) for t in texts]
        self._learn(set().union(*cut).difference(self.parts))
        out = [b"".join(map(self.parts.__getitem__, parts)) for parts in cut]
        for i, ids in zip(special, self._whole([texts[i] for i in special]), strict=True):
            out[i] = ids
        return out


#: How the word-end vocabulary prepares text (fixed values of its file); ``PARTS`` is only right for these.
LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTING = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


ENCODERS: dict[tuple[int, str], Encoder] = {}


class Plan(NamedTuple):
    """What all tasks share: vocabulary, id after each document, type of an id, dictionary."""

    vocabulary: str
    end_id: int
    width: str
    dictionary: bytes

    def encoder(self) -> Callable[[list[str | None]], list[bytes]]:
        """Packed ids of texts. A worker that is used again keeps what it has learned."""
        width, key = np.dtype(self.width), (hash(self.vocabulary), self.width)
        encoder, end = ENCODERS.get(key) or ENCODERS.setdefault(key, Encoder(self.vocabulary, width)), np.array([self.end_id], width).tobytes()
        return lambda texts: [ids + end for ids in encoder.encode([t or "" for t in texts])]


def id_width(vocabulary: str, end_id: int) -> str:
    """Two bytes an id where all ids fit, else four."""
    told = json.loads(vocabulary)
    return "<u2" if max(end_id, *told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])) < 65_536 else "<u4"


def encoded(batches: Iterator[pa.RecordBatch], encode: Callable[[list[str | None]], list[bytes]], text: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Batches with the row that each list of packed ids starts at."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)).astype(np.int64)
        for a, b in slices(sizes.tolist(), CHARS):
            yield batch, a, encode(batch.column(text).slice(a, b - a).to_pylist())


def train_dictionary(docs: DataFrame, plan: Plan, size: int = DICTIONARY, sample: int = SAMPLE) -> bytes:
    """A dictionary trained on id arrays of about ``sample`` documents, ``SAMPLE_IDS`` ids of each, chosen by hash.

    Only how well frames compress depends on it. Too few or too small documents give an empty one.
    """
    n = docs.count()
    share = F.lit(min(1.0, sample / max(n, 1)))
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1_000_000_007)) < share * 1_000_000_007
    some = docs.where(chosen & (F.length("text") > 0)).select("doc_id", F.substring("text", 1, 8 * SAMPLE_IDS).alias("text")).limit(2 * sample)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    step = np.dtype(plan.width).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids in encoded(batches, shared.value.encoder(), 1):
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_IDS * step] for x in ids], pa.binary())], names=["ids"])

    arrays = sorted(bytes(r["ids"]) for r in some.mapInArrow(work, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, arrays, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # the library refuses too few samples
        return b""


def _dictionary(data: bytes) -> Any:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """One task's shards, in order; each is closed before the next is begun."""

    def __init__(self, path: str, plan: Plan, kind: pa.DataType, partition: int):
        self.files, self.folder = pa.fs.FileSystem.from_uri(path)
        self.plan, self.kind, self.partition, self.seq = plan, kind, partition, 0
        self.frames = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(plan.dictionary))
        self.step = np.dtype(plan.width).itemsize
        self.out = None

    def _open(self) -> None:
        self.name = f"{self.partition:06d}-{self.seq:04d}-{uuid.uuid4().hex}.ids"
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        self.out.write(MAGIC)
        self.at, self.n_ids, self.rows = len(MAGIC), 0, []

    def add(self, doc_id: pa.Scalar, ids: bytes) -> Iterator[dict[str, Any]]:
        """Append a document; yields the manifest row of a shard that is full."""
        if self.out is None:
            self._open()
        frame = self.frames.compress(ids)
        self.out.write(frame)
        self.rows.append((doc_id, self.n_ids, len(ids) // self.step, self.at, len(frame)))
        self.at, self.n_ids = self.at + len(frame), self.n_ids + len(ids) // self.step
        if self.n_ids >= SHARD_IDS:
            yield from self.close()

    def close(self) -> Iterator[dict[str, Any]]:
        if self.out is None:
            return
        ids, *numbers = zip(*self.rows, strict=True)
        index = pa.table({"doc_id": pa.array([i.as_py() for i in ids], self.kind), **{n: pa.array(v, pa.int64()) for n, v in zip(("start", "n_tokens", "at", "size"), numbers, strict=True)}})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        packed = sink.getvalue().to_pybytes()
        footer = json.dumps({"index_at": self.at, "index_size": len(packed), "width": self.plan.width, "n_docs": len(self.rows), "n_ids": self.n_ids,
                             "dictionary": hashlib.sha256(self.plan.dictionary).hexdigest()}).encode()
        self.out.write(packed + footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        yield {"part": self.partition, "seq": self.seq, "name": self.name, "n_docs": len(self.rows), "n_ids": self.n_ids, "n_bytes": self.at + len(packed) + len(footer) + 4 + len(MAGIC)}
        self.out, self.seq = None, self.seq + 1


class Shard:
    """A shard that is open for reading."""

    def __init__(self, files: pa.fs.FileSystem, path: str, dictionary: bytes):
        self.file = files.open_input_file(path)
        tail = self._read(self.file.size() - len(MAGIC) - 4, len(MAGIC) + 4)
        if tail[4:] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        n = struct.unpack("<I", tail[:4])[0]
        self.told = json.loads(self._read(self.file.size() - len(tail) - n, n))
        if self.told["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = pa.ipc.open_stream(self._read(self.told["index_at"], self.told["index_size"])).read_all().combine_chunks()
        self.frames = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in a row of the index; only its own frame is read."""
        frame = self._read(self.index["at"][row].as_py(), self.index["size"][row].as_py())
        return np.frombuffer(self.frames.decompress(frame), self.told["width"])

    def all(self, rows: int = 2_000, most: int = 16_000_000) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
        """All documents in order, some at a time: rows of the index, and their ids."""
        sizes, ats = self.index["size"].to_numpy(), self.index["at"].to_numpy()
        for first in range(0, len(sizes), rows):
            for a, b in slices(sizes[first:first + rows].tolist(), most):
                a, b = first + a, first + b
                raw = memoryview(self._read(int(ats[a]), int(sizes[a:b].sum())))
                own = ats[a:b] - ats[a]
                yield self.index.slice(a, b - a), [np.frombuffer(self.frames.decompress(raw[x:x + n]), self.told["width"]) for x, n in zip(own.tolist(), sizes[a:b].tolist(), strict=True)]


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts below ``path``: ``shards``, ``manifest`` and ``dictionary`` (both Parquet).

    Order: ascending id, null first; rows of one id by their text's hash. Null and empty texts are the
    end id alone; repeated rows are documents of their own; an empty table gives an empty manifest;
    other columns are not read. Texts are whole, however long. ``path`` is a URI that executors can
    write to through Arrow's file systems.
    """
    spark = docs.sparkSession
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    plan = Plan(vocabulary, end_id, id_width(vocabulary, end_id), b"")
    plan = plan._replace(dictionary=train_dictionary(some, plan))
    spark.createDataFrame([(hashlib.sha256(plan.dictionary).hexdigest(), bytearray(plan.dictionary))], "sha256 string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    files, folder = pa.fs.FileSystem.from_uri(path)
    files.create_dir(f"{folder}/shards", recursive=True)
    shared = spark.sparkContext.broadcast(plan)  # the vocabulary file and the dictionary: a few MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = None, None
        names = ["part", "seq", "name", "n_docs", "n_ids", "n_bytes"]
        rows: list[dict[str, Any]] = []
        for batch in batches:
            if writer is None:
                encode = shared.value.encoder()
                writer = ShardWriter(f"{path}/shards", shared.value, batch.schema.field(0).type, TaskContext.get().partitionId())
            for whole, first, ids in encoded(iter([batch]), encode, 1):
                for i, packed in enumerate(ids, first):
                    rows += writer.add(whole.column(0)[i], packed)
        if writer is not None:
            rows += writer.close()
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = some.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInArrow(work, "part int, seq int, name string, n_docs long, n_ids long, n_bytes long"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard, never a document
    found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    kept = {r["name"] for r in found.select("name").toLocalIterator()}
    for info in files.get_file_info(pa.fs.FileSelector(f"{folder}/shards")):
        if info.base_name not in kept:  # left by a task that was lost or run twice
            files.delete_file(info.path)


def _over_shards(spark: SparkSession, path: str, columns: Callable[[pa.Table, list[np.ndarray], int], dict[str, pa.Array]], schema: str) -> DataFrame:
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shared = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.parquet(f"{path}/manifest").select("name", "start")
    n = max(1, min(shards.count(), 10_000))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(f"{path}/shards")
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for index, ids in Shard(files, f"{folder}/{name}", shared.value).all():
                    made = columns(index, ids, start)
                    yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return shards.repartition(n, "name").mapInArrow(work, schema)


def _doc_kind(spark: SparkSession, path: str) -> str:
    """Spark's name for the type of the ids in the first shard; long where there is none."""
    first = spark.read.parquet(f"{path}/manifest").select("name").head()
    if first is None:
        return "long"
    from pyspark.sql.pandas.types import from_arrow_type

    files, folder = pa.fs.FileSystem.from_uri(f"{path}/shards")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    return from_arrow_type(Shard(files, f"{folder}/{first[0]}", dictionary).index.schema.field("doc_id").type).simpleString()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) of every document in the files of ``write_ids``."""
    def columns(index: pa.Table, ids: list[np.ndarray], start: int) -> dict[str, pa.Array]:
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate(ids).astype(np.int32)
        return {"doc_id": index["doc_id"].combine_chunks(), "start": pc.add(index["start"], start).combine_chunks(), "n_tokens": index["n_tokens"].combine_chunks(),
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}

    return _over_shards(spark, path, columns, f"doc_id {_doc_kind(spark, path)}, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ids read in the files."""
    def columns(index: pa.Table, ids: list[np.ndarray], start: int) -> dict[str, pa.Array]:
        return {"doc_id": index["doc_id"].combine_chunks(), "start": pc.add(index["start"], start).combine_chunks(), "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())}

    return _over_shards(spark, path, columns, f"doc_id {_doc_kind(spark, path)}, start long, n_tokens long, ids_crc32 long")


def read_one(spark: SparkSession, path: str, name: str, row: int) -> np.ndarray:
    """Ids of the document at a row of a shard's index, reading its own frame only."""
    files, folder = pa.fs.FileSystem.from_uri(f"{path}/shards")
    return Shard(files, f"{folder}/{name}", bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])).ids(row)
