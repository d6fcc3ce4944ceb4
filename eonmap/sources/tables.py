"""Feature tables: schemas, scans, and tables written to cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "map<string,string>"
NODES = f"id bigint, lon double, lat double, tags {TAGS}"
WAYS = f"id bigint, refs array<bigint>, tags {TAGS}"
RELATIONS = f"id bigint, tags {TAGS}, members array<struct<type:string,ref:bigint,role:string>>"
#: Keys that get columns of their own, since only columns are pruned and pushed to the scan.
PROMOTED = {"name": "name", "name_en": "name:en", "boundary": "boundary", "admin_level": "admin_level", "type": "type",
            "start_date": "start_date", "end_date": "end_date", "start_date_edtf": "start_date:edtf", "end_date_edtf": "end_date:edtf"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="eonmap-tables-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def promote(df: DataFrame) -> DataFrame:
    """Adds the promoted tag columns."""
    return df.withColumns({c: F.col("tags")[k] for c, k in PROMOTED.items()})


def write_features(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet with promoted columns; ``by``: a column to lay partitions out by, such as admin_level."""
    out = promote(df).write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def read_features(spark: SparkSession, path: str, levels: list[str] | None = None) -> DataFrame:
    """A feature table; with ``levels`` only those administrative levels are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("admin_level").cast("string").isin(*levels)) if levels else df


def way_points(ways: DataFrame, nodes: DataFrame, least: int = 1) -> DataFrame:
    """id, pts (node_id, lon, lat in order): ways with their places; nodes without a valid place are
    left out, and ways with fewer than ``least`` points too."""
    valid = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    refs = ways.select("id", F.posexplode("refs").alias("pos", "node_id"))
    placed = refs.join(nodes.where(valid).select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")
    pts = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("p"))
    pts = pts.select("id", F.transform("p", lambda x: F.struct(x["node_id"].alias("node_id"), x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("pts"))
    return pts.where(F.size("pts") >= least)


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id stands in another table."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def counts(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """type, count for nodes, ways and relations; an error if any way is empty (a broken extract)."""
    empty = ways.where(F.size(F.coalesce("refs", F.array().cast("array<bigint>"))) == 0).limit(1).count()
    if empty:
        raise ValueError("the extract has ways without nodes")
    out = None
    for name, df in (("nodes", nodes), ("ways", ways), ("relations", relations)):
        row = df.agg(F.lit(name).alias("type"), F.count("*").alias("count"))
        out = row if out is None else out.unionByName(row)
    return out


def snapshot_date(path: str, header: str | None = None, setting: str | None = None) -> str:
    """Date of a snapshot: the header's, or planet-YYMMDD in the file name, or a setting."""
    if header:
        return header[:10]
    if m := re.search(r"planet-(\d{2})(\d{2})(\d{2})", path):
        return f"20{m[1]}-{m[2]}-{m[3]}"
    if setting:
        return setting
    raise ValueError(f"{path} has no date")


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """properties, geometry_type, coordinates (as JSON) of a GeoJSON collection or a single feature."""
    geometry = "struct<type:string, coordinates:string>"
    whole = spark.read.schema(
        f"type string, features array<struct<type:string, properties:{properties}, geometry:{geometry}>>, properties {properties}, geometry {geometry}"
    ).option("multiLine", "true").json(path)
    one = F.array(F.struct(F.col("type"), F.col("properties"), F.col("geometry")))
    return whole.select(F.explode(F.coalesce("features", one)).alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), "f.geometry.coordinates")
