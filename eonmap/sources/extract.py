"""The viewer's extract as files: written as one JSON object a file, read back in both of its forms.

A file's members are written by all tasks and joined in one, in order, a line each, so that the driver sees names only.
Ways are read in parallel, from any place in the file; relations too where each has a line, else as their file's one value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eonmap.functions import codecs, dates
from eonmap.operators.numbering import numbered
from eonmap.plans.features import GEOM, measured
from eonmap.sources.tables import shared_dir

#: The year in which features without an end are taken to end, and the fields of a relation.
ACTIVE_END = "2100-01-01"
CHRONOLOGY = "array<struct<id:bigint,name:string,prev:bigint,next:bigint>>"
CODED = f"tagPairs array<array<string>>, tagKeys array<string>, tagVals array<string>, relations array<struct<id:bigint,tags:string,ways:array<array<string>>,nodes:array<bigint>,chronology:{CHRONOLOGY}>>"
PLAIN = f"id bigint, tags map<string,string>, ways array<array<array<bigint>>>, nodes array<bigint>, chronology {CHRONOLOGY}"
CHUNK = 8_000_000
#: The texts around the members of a file of relations, each a line of its own in files that are written here.
HEADS = ('{"tagPairs":[', '],"tagKeys":[', '],"tagVals":[', '],"relations":[', "]}")


# ------------------------------------------------------------- writing
def one_file(spark: SparkSession, path: str, sections: Sequence[tuple[str, DataFrame | None]]) -> None:
    """One file of texts and members: for each section its text, then its rows (column value, no line ends) with commas, a line each.

    Rows stand in the order of their frame. Parts are written by Spark; one task joins them under another
    name and renames the file when it is whole, so that a lost task leaves no half of it.
    """
    stage = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.Path(stage)
    files = folder.getFileSystem(conf)
    plan: list[tuple[str, list[str] | None]] = []
    for i, (text, rows) in enumerate(sections):
        names = None
        if rows is not None:
            rows.select("value").write.text(f"{stage}/{i}")
            names = sorted(s.getPath().toString() for s in files.listStatus(hadoop.Path(f"{stage}/{i}")) if s.getPath().getName().startswith("part-") and s.getLen())
        plan.append((text, names))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, name = pa.fs.FileSystem.from_uri(path)
            whole = f"{name}.{uuid.uuid4().hex}"
            with out.open_output_stream(whole) as sink:
                for text, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sink.write(text.encode() + (b"" if names is None else b"\n"))
                    for k, part in enumerate(names or []):
                        source, place = pa.fs.FileSystem.from_uri(part)
                        with source.open_input_stream(place) as stream:
                            held = b",\n" if k else b""  # a line's end gets a comma once another line follows
                            while chunk := stream.read(CHUNK):
                                sink.write(held)
                                held = b",\n" if chunk.endswith(b"\n") else b""
                                sink.write(chunk.removesuffix(b"\n").replace(b"\n", b",\n"))
                    sink.write(b"\n" if names else b"")
            out.move(whole, name)
            yield pa.RecordBatch.from_pydict({"path": [name]})

    spark.createDataFrame(plan, "text string, names array<string>").coalesce(1).mapInArrow(join, "path string").collect()
    files.delete(folder, True)


def write_extract(found: dict[str, DataFrame], folder: str, level: str) -> None:
    """``web_extract``'s tables as waysN.json and nodesN.json ({id: data}) and relationsN.b64.json (tag tables and relations by end)."""
    spark = found["ways"].sparkSession
    member = lambda data: F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":'), data).alias("value")
    files, place = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)
    one_file(spark, f"{folder}/ways{level}.json", [("{", found["ways"].orderBy("id").select(member(F.to_json("deltas")))), ("}", None)])
    nodes = found.get("nodes")
    one_file(spark, f"{folder}/nodes{level}.json", [("{", None if nodes is None else nodes.orderBy("id").select(member(F.to_json(F.struct("loc", "tags"))))), ("}", None)])
    text = lambda *c: F.to_json(F.array(*c))
    one = lambda c: F.regexp_extract(text(c), r"(?s)^\[(.*)\]$", 1).alias("value")
    some = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f',"{name}":'), F.to_json(c))).otherwise("")
    relation = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"tags":'), "flat", F.lit(',"ways":'), F.to_json("ways"), some("nodes", "nodes"), some("chronology", "chronology"), F.lit("}"))
    one_file(spark, f"{folder}/relations{level}.b64.json", [
        (HEADS[0], found["pairs"].orderBy("index").select(text("key", "value").alias("value"))), (HEADS[1], found["keys"].orderBy("index").select(one("key"))),
        (HEADS[2], found["values"].orderBy("index").select(one("value"))), (HEADS[3], found["relations"].select(relation.alias("value"))), (HEADS[4], None)])


# ------------------------------------------------------------- reading
def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """id, deltas of a file {id: [numbers]}, which tasks read from anywhere: a list's end ends a record."""
    rows = spark.read.text(path, lineSep="],")
    form = r'"(-?\d+)"\s*:\s*\[([-\d,\s]*)'
    rows = rows.where(F.rlike("value", F.lit(form)))
    numbers = F.transform(F.filter(F.split(F.regexp_extract("value", form, 2), r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("bigint"))
    return rows.select(F.regexp_extract("value", form, 1).cast("bigint").alias("id"), numbers.alias("deltas"))


def coded_sibling(spark: SparkSession, path: str) -> str:
    """The path of the coded form of a file of relations where there is one, else the path itself."""
    if not path.endswith(".json") or path.endswith(".b64.json"):
        return path
    other = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.removesuffix(".json") + ".b64.json")
    there = other.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(other)
    return other.toString() if there else path


def has_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file of relations has a line for each member, as ``write_extract`` makes them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(max(stream.read(), 0) for _ in range(len(HEADS[0]) + 1)) == f"{HEADS[0]}\n".encode()
    finally:
        stream.close()


def coded_lines(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    """Relations, and the tables of tag pairs, keys and values with their index, of a file of lines: tasks read it from anywhere."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", at.alias("at"))
    found = {r["value"]: F.struct(F.lit(r["at"]["block"]).alias("block"), F.lit(r["at"]["row"]).alias("row")) for r in lines.where(F.col("value").isin(*HEADS)).collect()}
    part = lambda k: lines.where((F.col("at") > found[HEADS[k]]) & (F.col("at") < found[HEADS[k + 1]])).select("at", F.rtrim("value", F.lit(",")).alias("value"))
    index = lambda rows: numbered(rows, ["at"], "number").withColumn("index", F.col("number") - 1)
    text = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    pair = F.from_json("value", "array<string>")
    one = f"id bigint, tags string, ways array<array<string>>, nodes array<bigint>, chronology {CHRONOLOGY}"
    rows = part(3).select(F.from_json("value", one).alias("r")).select("r.*")
    return rows, index(part(0)).select(pair[0].alias("key"), pair[1].alias("value"), "index"), index(part(1)).select(text.alias("key"), "index"), index(part(2)).select(text.alias("value"), "index")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """id, tags, ways (signed ids by polygon and ring), nodes, chronology, from either form of the file.

    Which form it is the content says: an object with tag tables and coded rings, or a list of plain relations.
    """
    path = coded_sibling(spark, path)
    if has_lines(spark, path):
        rows, pairs, keys, values = coded_lines(spark, path)
    else:
        whole = spark.read.schema(CODED).json(path, multiLine=True)
        coded = not whole.where(F.col("relations").isNotNull()).isEmpty()
        if not coded:
            return spark.read.schema(PLAIN).json(path, multiLine=True).where("id is not null")
        table = lambda c: whole.select(F.posexplode(c).alias("index", "x"))
        pairs = table("tagPairs").select(F.col("x")[0].alias("key"), F.col("x")[1].alias("value"), "index")
        keys, values = table("tagKeys").select(F.col("x").alias("key"), "index"), table("tagVals").select(F.col("x").alias("value"), "index")
        rows = whole.select(F.explode("relations").alias("r")).select("r.*")
    tags = codecs.decode_tags(rows.select("id", F.col("tags").alias("flat")), (pairs, keys, values))
    rings = rows.select("id", F.posexplode("ways").alias("polygon", "codes")).select("id", "polygon", F.posexplode("codes").alias("n", "code"))
    rings = rings.withColumn("ring", codecs.varint_to_ring(F.unbase64("code")))
    polygons = rings.groupBy("id", "polygon").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ring"))), lambda x: x["ring"]).alias("rings"))
    ways = polygons.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("polygon", "rings"))), lambda x: x["rings"]).alias("ways"))
    empty = F.coalesce("ways", F.array().cast("array<array<array<bigint>>>")).alias("ways")
    return rows.select("id", "nodes", "chronology").join(tags, "id").join(ways, "id", "left").select("id", "tags", empty, "nodes", "chronology")


# ------------------------------------------------------------- geometry
def way_corners(ways: DataFrame) -> DataFrame:
    """way, pts (x, y in degrees) of coded ways."""
    every = lambda at: F.filter("deltas", lambda _, i: i % 2 == at).alias(f"d{at}")
    parts = ways.where(F.size("deltas") >= 2).select("id", every(0), every(1))
    sums = parts.select("id", codecs.running_sums("d0").alias("xs"), codecs.running_sums("d1").alias("ys"))
    place = lambda x, y: F.struct((x / (codecs.LON_STEPS / 360)).alias("x"), (y / (codecs.LAT_STEPS / 180)).alias("y"))
    return sums.select(F.col("id").alias("way"), F.zip_with("xs", "ys", place).alias("pts"))


def drawn(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """id, geom of relations of an extract, one row each; empty where nothing can be drawn.

    A ring is the points of its ways in order, without the first point of every way but the ring's first.
    A missing way is skipped, and its successor still goes without its first point. Rings of fewer than
    three points go, with an outer ring its polygon. Geometry is as drawn: ``measured`` repairs it.
    """
    rings = relations.select("id", F.posexplode("ways").alias("polygon", "rings")).select("id", "polygon", F.posexplode("rings").alias("n", "ring"))
    refs = rings.select("id", "polygon", "n", F.posexplode("ring").alias("at", "signed")).withColumn("way", F.abs("signed"))
    pts = F.when(F.col("signed") < 0, F.reverse("pts")).otherwise(F.col("pts"))
    own = F.when(F.col("at") == 0, pts).otherwise(F.slice(pts, F.lit(2), F.size(pts)))
    placed = refs.join(way_corners(ways), "way").select("id", "polygon", "n", "at", own.alias("own"))
    whole = placed.groupBy("id", "polygon", "n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])).alias("pts"))
    closed = (F.size("pts") > 1) & (F.col("pts")[0] == F.element_at("pts", -1))
    whole = whole.where(F.size("pts") >= 3).select("id", "polygon", "n", F.when(closed, F.slice("pts", F.lit(1), F.size("pts") - 1)).otherwise(F.col("pts")).alias("ring"))
    polygons = whole.groupBy("id", "polygon").agg(F.array_sort(F.collect_list(F.struct("n", "ring"))).alias("rings")).where("rings[0].n = 0")
    made = polygons.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("polygon", F.transform("rings", lambda r: r["ring"]).alias("p")))), lambda x: x["p"]).alias("geom"))
    return relations.select("id").join(made, "id", "left").select("id", F.coalesce("geom", F.array().cast(GEOM)).alias("geom"))


def shown(relations: DataFrame, geom: DataFrame, nodes: DataFrame) -> DataFrame:
    """value: a GeoJSON feature a relation, as the viewer draws it: its polygons (id, geom), or, where it has no ways, the
    points (id, loc) of its nodes, marked ``_relation_node``."""
    places = relations.where((F.size("ways") == 0) & (F.size("nodes") > 0)).select("id", F.posexplode("nodes").alias("at", "node"))
    places = places.join(nodes.select(F.col("id").alias("node"), "loc"), "node").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "loc"))), lambda x: x["loc"]).alias("points"))
    closed = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda x: F.array(x["x"], x["y"]))))
    rows = relations.select("id", "tags").join(geom.select("id", closed.alias("rings")), "id", "left").join(places, "id", "left")
    feature = lambda kind, at, tags: F.to_json(F.struct(F.lit("Feature").alias("type"), "id", F.struct(F.lit(kind).alias("type"), F.col(at).alias("coordinates")).alias("geometry"), tags.alias("properties")))
    flat = F.to_json(F.map_concat(F.col("tags"), F.create_map(F.lit("_relation_node"), F.lit("@true"))))
    points = F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"geometry":{"type":"MultiPoint","coordinates":'), F.to_json("points"), F.lit('},"properties":'), F.replace(flat, F.lit('"@true"'), F.lit("true")), F.lit("}"))
    return rows.select(F.when(F.col("points").isNotNull(), points).otherwise(feature("MultiPolygon", "rings", F.col("tags"))).alias("value"))


def extract_features(relations: DataFrame, ways: DataFrame, level: str = "2", skipped: Observation | None = None) -> DataFrame:
    """id, name, whmid, lo, hi (fractional years), km2, box, geom: what ``coverage_gap`` compares.

    Boundaries of the level with a start; a missing or unreadable end is ``ACTIVE_END``. Faulty geometry is
    replaced by its valid parts. ``skipped`` counts no_date and no_geometry as the first job runs.
    """
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    year = lambda text: dates.fractional_year(dates.start_of(dates.parse_date(text)))
    some = relations.where(~F.col("tags")["type"].eqNullSafe(F.lit("chronology")) & (F.col("tags")["boundary"] == "administrative") & (F.col("tags")["admin_level"] == level))
    dated = some.select("id", F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), F.coalesce(F.col("tags")["whmid"], F.lit("")).alias("whmid"), year(tag("start_date")).alias("lo"),
                        F.coalesce(year(tag("end_date")), year(F.lit(ACTIVE_END))).alias("hi"), "ways")
    rows = measured(dated.drop("ways").join(drawn(dated.where("lo is not null"), ways), "id", "left"), repair=True).withColumn("has", F.size("geom") > 0)
    if skipped is not None:
        rows = rows.observe(skipped, F.count_if(F.col("lo").isNull()).alias("no_date"), F.count_if(F.col("lo").isNotNull() & ~F.col("has")).alias("no_geometry"))
    return rows.where("lo is not null and has").select("id", "name", "whmid", "lo", "hi", "km2", "box", "geom")
