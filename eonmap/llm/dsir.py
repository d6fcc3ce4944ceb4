"""Importance resampling towards a target set by hashed features, with an external sort-count.

Documents become packed streams of uint16 feature buckets with the offsets of the documents, stored
as Parquet in the shared folder. Each block of a stream is sorted and run-length encoded, and Spark
adds up the runs of a bucket. The stored streams are then read once more: a document's weight is the
sum of its buckets' gains, ``np.add.reduceat`` over its range of the stream. Words are split and
hashed once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import materialise, slices
from eonmap.operators.numbering import numbered

#: Bytes that make up words; A-Z are lowered, all others part words.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))
#: Bytes of text in a block of a stream (one document at least), and features remembered by a worker.
BLOCK_BYTES, REMEMBERED = 8_000_000, 1_000_000


class Buckets(dict):
    """Feature -> bucket, remembered up to a bound."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def features_of(text: bytes | None, low: int, high: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of ``low`` to ``high`` of them."""
    words = text.translate(LOWERED).split() if text else []
    if (low, high) == (1, 1):
        return len(words), words
    return len(words), [b" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def streams(texts: DataFrame, n_buckets: int, low: int, high: int, keep: list[str]) -> DataFrame:
    """Blocks of documents: the kept columns as lists, ``words`` (int64), ``offsets`` (int64, one more than
    documents) and ``stream`` (uint16), packed little-endian."""
    kinds = {c: texts.schema[c].dataType.simpleString() for c in keep}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(n_buckets)
        for batch in batches:
            text = batch.column(len(keep)).cast(pa.large_binary())
            sizes = np.nan_to_num(pa.compute.binary_length(text).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in slices(sizes.tolist(), BLOCK_BYTES):
                words, counts, parts = [], [0], []
                for t in text.slice(a, b - a).to_pylist():
                    n, found = features_of(t, low, high)
                    words.append(n)
                    counts.append(len(found))
                    parts.append(np.fromiter(map(known.__getitem__, found), np.dtype("<u2"), len(found)))
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(i).slice(a, b - a)) for i in range(len(keep))]
                packed = [np.array(words, "<i8").tobytes(), np.cumsum(np.array(counts, "<i8")).tobytes(), np.concatenate(parts).tobytes()]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([p], pa.binary()) for p in packed)], names=[*keep, "words", "offsets", "stream"])

    schema = ", ".join([f"`{c}` array<{k}>" for c, k in kinds.items()] + ["words binary", "offsets binary", "stream binary"])
    return texts.mapInArrow(work, schema)


def bucket_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, n) over all blocks: each is sorted and run-length encoded, and Spark adds up the runs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                run = np.sort(np.frombuffer(packed, "<u2"))
                starts = np.flatnonzero(np.diff(run.astype(np.int32), prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(run[starts].astype(np.int32)), pa.array(np.diff(starts, append=len(run)).astype(np.int64))], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: dict[int, int], target: dict[int, int], n_buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln of the smoothed target share over the corpus share)."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    rows = ((float(corpus.get(b, 0)), float(target.get(b, 0))) for b in range(n_buckets))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n_buckets) / ((s + 1) * (t_all + n_buckets)))) for s, t in rows], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray, keep: list[str]) -> DataFrame:
    """One row a document: the kept columns, n_words, n_features, weight."""
    shared = blocks.sparkSession.sparkContext.broadcast(gains)  # eight bytes a bucket, 65,536 buckets at most
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in keep}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, offsets, stream = (np.frombuffer(batch.column(len(keep) + j)[i].as_py(), kind) for j, kind in enumerate(("<i8", "<i8", "<u2")))
                total = np.zeros(len(words), np.int64)
                full = np.flatnonzero(np.diff(offsets))  # reduceat would give an empty range its neighbour's gain
                if len(full):
                    total[full] = np.add.reduceat(shared.value[stream], offsets[full])
                kept = [batch.column(j).slice(i, 1).flatten() for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words), pa.array(np.diff(offsets)), pa.array(total)], names=[*keep, "n_words", "n_features", "weight"])

    schema = ", ".join([f"`{c}` {k}" for c, k in kinds.items()] + ["n_words long, n_features long, weight long"])
    return blocks.select(*keep, "words", "offsets", "stream").mapInArrow(work, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and id; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_buckets: int = 10_000,
             low: int = 1, high: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs``.

    The ``percent`` of the documents with ``least_words`` or more that score highest are ranked, ties to the
    smaller id (null last); the others' rank is null. Null and empty texts have no feature, weight 0
    and are not ranked. Repeated rows are rows of their own. Empty tables: no documents give no rows,
    no target texts give every bucket the same share. Other columns are not read. A very long text
    is a block of its own, two bytes a feature. No step holds more than a block, or a row a bucket.
    """
    if not 0 < n_buckets <= 65_536:
        raise ValueError("buckets are packed in 16 bits")
    renamed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = materialise(streams(renamed, n_buckets, low, high, ["doc_id"]))
    goal = streams(target.select(F.col(f"`{target_col}`").alias("text")), n_buckets, low, high, [])
    gains = gains_of(*({r["bucket"]: r["n"] for r in bucket_counts(b).collect()} for b in (blocks, goal)), n_buckets)
    scored = materialise(weights(blocks, gains, ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    long_enough = F.col("n_words") >= least_words
    drawn = scored.where(long_enough).count() * percent // 100
    ranked = numbered(scored.where(long_enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return ranked.withColumn("rank", rank).drop("place").unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
