"""Compact encodings: quantised and delta coordinates, varint rings, tag dictionaries."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eonmap.operators.numbering import numbered

#: Steps of the coordinate grid over the globe, and the grid of topology in degrees.
LON_STEPS, LAT_STEPS, TOPOLOGY_GRID = 4_000_000, 2_000_000, 1e-5


def quantize(lon: Column, lat: Column) -> Column:
    """struct(x, y) on the integer grid; halves go to the even number."""
    return F.struct(F.bround(lon * (LON_STEPS / 360), 0).cast("int").alias("x"), F.bround(lat * (LAT_STEPS / 180), 0).cast("int").alias("y"))


def unquantize(p: Column) -> Column:
    return F.struct((p["x"] / (LON_STEPS / 360)).alias("lon"), (p["y"] / (LAT_STEPS / 180)).alias("lat"))


def snap(lon: Column, lat: Column, grid: float = TOPOLOGY_GRID) -> Column:
    """struct(qlon, qlat) on the topology grid."""
    return F.struct(F.bround(lon / grid, 0).cast("bigint").alias("qlon"), F.bround(lat / grid, 0).cast("bigint").alias("qlat"))


def deltas(xs: Column) -> Column:
    """First value, then differences."""
    return F.transform(xs, lambda x, i: x - F.coalesce(F.when(i > 0, F.get(xs, i - 1)), F.lit(0)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def running_sums(ds: pd.Series) -> pd.Series:
    """The inverse of ``deltas``; null stays null. An expression would copy its array at every step."""
    return ds.map(lambda d: None if d is None else np.cumsum(d, dtype=np.int64))


# ------------------------------------------------------------- varint rings
def encode_rings(rings: list[np.ndarray]) -> list[bytes]:
    """Signed ids as varints of the zigzag difference of their magnitudes, with a bit for a change of sign."""
    n = np.array([len(r) for r in rings], np.int64)
    flat = np.concatenate(rings).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
    first = np.zeros(len(flat), bool)
    starts = np.cumsum(n) - n
    first[starts[n > 0]] = True
    size, minus = np.abs(flat), flat < 0
    step = size - np.where(first, 0, np.r_[0, size[:-1]] if len(flat) else size)
    turn = minus != np.where(first, False, np.r_[False, minus[:-1]] if len(flat) else minus)
    value = (np.where(step < 0, -2 * step - 1, 2 * step) << 1) | turn
    # each value as groups of seven bits, low ones first
    groups = np.maximum(1, -(-np.array([int(v).bit_length() for v in value], np.int64) // 7)) if len(value) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(value)), groups)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups)
    data = ((value[owner] >> (7 * nth)) & 127).astype(np.uint8) | ((nth < groups[owner] - 1).astype(np.uint8) << 7)
    ends = np.r_[0, np.cumsum(groups)][np.cumsum(n)]
    return [data[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def decode_rings(codes: Iterable[bytes]) -> list[np.ndarray]:
    """The inverse of ``encode_rings``."""
    out = []
    for code in codes:
        b = np.frombuffer(code, np.uint8)
        if not len(b):
            out.append(np.zeros(0, np.int64))
            continue
        last = np.flatnonzero(b < 128)
        begin = np.r_[0, last[:-1] + 1]
        nth = np.arange(len(b)) - np.repeat(begin, last - begin + 1)
        value = np.add.reduceat((b & 127).astype(np.int64) << (7 * nth), begin)
        zigzag = value >> 1
        size = np.cumsum((zigzag >> 1) ^ -(zigzag & 1))
        out.append(np.where(np.cumsum(value & 1) % 2 == 1, -size, size))
    return out


@F.pandas_udf(T.BinaryType())
def ring_to_varint(rings: pd.Series) -> pd.Series:
    """array<bigint> of signed way ids to bytes; null stays null."""
    some = rings.notna()
    out = pd.Series([None] * len(rings), index=rings.index, dtype=object)
    out[some] = encode_rings([np.asarray(r, np.int64) for r in rings[some]])
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def varint_to_ring(codes: pd.Series) -> pd.Series:
    """Bytes to array<bigint>; null stays null."""
    some = codes.notna()
    out = pd.Series([None] * len(codes), index=codes.index, dtype=object)
    out[some] = pd.Series(decode_rings(codes[some]), index=codes.index[some], dtype=object)
    return out


# ------------------------------------------------------------- tag dictionaries
def tag_tables(tags: DataFrame, id_col: str, tags_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three dictionaries: (key, value, index) of pairs and (value, index) of values that occur more
    than once, most frequent first (ties by first appearance), and (key, index) of all keys in order."""
    pairs = tags.select(id_col, F.posexplode(F.map_entries(tags_col)).alias("pos", "e")).select(id_col, "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    where = F.struct(id_col, "pos")
    pair = pairs.groupBy("key", "value").agg(F.count("*").alias("n"), F.min(where).alias("at"))
    value = pairs.groupBy("value").agg(F.count("*").alias("n"), F.min(where).alias("at"))
    def indexed(rows: DataFrame, order: list, columns: list[str]) -> DataFrame:
        return numbered(rows, order, "number").select(*columns, (F.col("number") - 1).alias("index"))

    by_use = [F.desc("n"), F.col("at"), F.col("value")]
    return indexed(pair.where("n > 1"), by_use, ["key", "value"]), indexed(pairs.select("key").distinct(), ["key"], ["key"]), indexed(value.where("n > 1"), by_use, ["value"])


def encode_tags(tags: DataFrame, id_col: str, tags_col: str, tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """id, flat: a JSON array for each row. A pair in the dictionary is -(index + 1); another tag is its
    key's index and then its value, as an index or, if it occurs once, as text."""
    pair, key, value = tables
    rows = tags.select(F.col(id_col).alias("id"), F.posexplode_outer(F.map_entries(tags_col)).alias("pos", "e")).select("id", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    rows = rows.join(pair.withColumnRenamed("index", "p"), ["key", "value"], "left").join(key.withColumnRenamed("index", "k"), "key", "left").join(value.withColumnRenamed("index", "v"), "value", "left")
    quoted = F.regexp_extract(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", 1)
    token = F.when(F.col("p").isNotNull(), (-(F.col("p") + 1)).cast("string")).when(
        F.col("k").isNotNull(), F.concat_ws(",", F.col("k").cast("string"), F.coalesce(F.col("v").cast("string"), quoted)))
    each = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", token.alias("t")))))
    return rows.groupBy("id").agg(each.alias("ts")).select("id", F.concat(F.lit("["), F.array_join(F.col("ts.t"), ","), F.lit("]")).alias("flat"))


def decode_tags(flat: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """id, tags (a map): the inverse of ``encode_tags``."""
    pair, key, value = tables
    items = flat.select("id", F.from_json("flat", "array<string>").alias("xs"), F.from_json(F.regexp_replace("flat", r'"(?:[^"\\]|\\.)*"', "null"), "array<bigint>").alias("ns"))
    # a key index is a whole number that does not stand where a value must
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(False).alias("value"))

    def step(acc: Column, i: Column) -> Column:
        take = ~acc["value"]
        return F.struct(F.when(take, F.concat(acc["at"], F.array(i))).otherwise(acc["at"]).alias("at"), (take & (F.get("ns", i) >= 0)).alias("value"))

    heads = F.when(F.size("xs") > 0, F.aggregate(F.sequence(F.lit(0), F.size("xs") - 1), start, step, lambda acc: acc["at"])).otherwise(F.array().cast("array<int>"))
    rows = items.select("id", "xs", "ns", F.explode_outer(heads).alias("i"))
    rows = rows.select("id", "i", F.get("ns", F.col("i")).alias("n"), F.get("xs", F.col("i") + 1).alias("x"), F.get("ns", F.col("i") + 1).alias("vn"))
    rows = rows.join(pair.select(F.col("key").alias("pk"), F.col("value").alias("pv"), (-(F.col("index") + 1)).alias("n")), "n", "left")
    rows = rows.join(key.select(F.col("key").alias("kk"), F.col("index").alias("kn")), F.col("n") == F.col("kn"), "left")
    rows = rows.join(value.select(F.col("value").alias("vv"), F.col("index").alias("vi")), (F.col("vn") == F.col("vi")) & (F.col("n") >= 0), "left")
    entry = F.struct(F.col("i"), F.coalesce("pk", "kk").alias("key"), F.when(F.col("n") < 0, F.col("pv")).when(F.col("vn").isNotNull(), F.col("vv")).otherwise(F.col("x")).alias("value"))
    out = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), entry))).alias("es"))
    return out.select("id", F.map_from_entries(F.transform("es", lambda e: F.struct(e["key"], e["value"]))).alias("tags"))
