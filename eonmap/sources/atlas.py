"""Atlas drawings (SVG, a file a year) and other small sources."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eonmap.functions import dates, geometry

SVG = "{http://www.w3.org/2000/svg}"
DRAWN = "file string, layer string, id string, d string, fill string, title string"


def drawn_paths(content: bytes, file: str) -> list[tuple]:
    """Rows of one drawing: filled paths and ellipses with their layer and the title of their text."""
    root = ET.fromstring(content)
    titles = {}
    for t in root.iter(f"{SVG}text"):
        title = t.find(f"{SVG}title")
        if t.get("id") and title is not None and title.text:
            titles[t.get("id")] = title.text.strip()
    out = []
    for group in root.iter(f"{SVG}g"):
        for x in group:
            fill = x.get("fill") or (re.search(r"fill:\s*([^;]+)", x.get("style") or "") or [None, None])[1]
            if fill == "none" or x.tag not in (f"{SVG}path", f"{SVG}ellipse"):
                continue
            d = x.get("d") if x.tag == f"{SVG}path" else geometry.ellipse_path(*(float(x.get(k, 0)) for k in ("cx", "cy", "rx", "ry")))
            out.append((file, group.get("id"), x.get("id"), d, fill, titles.get(x.get("id"))))
    return out


def read_drawings(spark: SparkSession, glob: str) -> DataFrame:
    """file, layer, id, d, fill, title, year and ordinal (of the file in order of years).

    A drawing is read whole by one task; files are dealt over the executors.
    """
    files = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                yield pd.DataFrame(drawn_paths(content, file), columns=[c.split(" ")[0] for c in DRAWN.split(", ")])

    rows = files.mapInPandas(parse, DRAWN).withColumn("year", dates.atlas_year(F.col("file")))
    years = files.select(dates.atlas_year(F.col("file")).alias("year")).distinct()
    return rows.join(years.withColumn("ordinal", F.row_number().over(Window.orderBy("year"))), "year")


def read_eras(spark: SparkSession, path: str) -> DataFrame:
    """start and end of each line; blank lines are passed over."""
    return spark.read.csv(path, schema="start int, end int").where("start is not null")


def read_config(content: str, defaults: dict) -> dict:
    """JSON with comments and trailing commas; missing and empty values are the defaults."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", content, flags=re.S)
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept)
    found = json.loads(kept)
    return {**found, **{k: found.get(k) or v for k, v in defaults.items()}}


def read_summaries(spark: SparkSession, glob: str) -> DataFrame:
    """date (the folder), file, type and count of summary files; of a metric that several files of a day give, the last file's."""
    rows = spark.read.csv(glob, header=True, schema="type string, count double")
    path = F.input_file_name()
    rows = rows.select(F.element_at(F.split(path, "/"), -2).alias("date"), F.element_at(F.split(path, "/"), -1).alias("file"), "type", "count", F.monotonically_increasing_id().alias("line"))
    return rows.groupBy("date", "type").agg(F.max(F.struct("file", "line", "count")).alias("last")).select("date", "last.file", "type", "last.count")
