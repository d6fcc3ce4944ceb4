"""The atlas: history of its drawings, import to features and topology, and its correction mesh."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eonmap.functions import arrangement, dates, geometry, text
from eonmap.operators import temporal, topology
from eonmap.plans.features import ARROW_GEOM, GEOM, MEET, cells, combined, dissolved, from_geom, measured, meeting, once_each, shape_key
from eonmap.sources import tables

VALUES = ["fill", "d", "title", "layer"]
#: Radii in degrees: a border with another country, a match on the other map, and of the mesh's weights.
BORDER, MATCH, REACH = 0.25, 1.5, 3.0


def history(drawings: DataFrame) -> DataFrame:
    """Segments (id, run, values, first, last year): years in a row in which a path looks the same.

    A path that is missing from a drawing ends its segment, whatever the years between drawings.
    """
    return temporal.runs(drawings, ["id"], ["year", "ordinal"], VALUES, "ordinal")


def changes(segments: DataFrame) -> DataFrame:
    """Segments with only the values that differ from the one before."""
    return temporal.only_changes(segments, ["id"], ["run"], VALUES)


def full_states(changed: DataFrame) -> DataFrame:
    """The inverse of ``changes``."""
    return temporal.fill_forward(changed, ["id"], ["run"], VALUES)


def state_in(segments: DataFrame, year: int) -> DataFrame:
    return temporal.state_at(segments, ["id"], "first", "last", F.lit(year))


def project(rows: DataFrame, mesh: geometry.Mesh | None = None) -> DataFrame:
    """Adds geom: a path's rings in degrees, each ring a polygon, without jumps over the date line."""
    shared = rows.sparkSession.sparkContext.broadcast(mesh)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d in b["d"]:
                rings = [geometry.unwrap(geometry.canvas_to_lonlat(r, shared.value)) for r in geometry.parse_path(d) if len(r) >= 3]
                out.append(from_geom([[r] for r in rings]))
            yield b.assign(geom=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(work, f"{schema}, geom {GEOM}")


def clip_to(rows: DataFrame, land: DataFrame) -> DataFrame:
    """Replaces geom by its polygons inside ``land`` (column geom, any polygons); empty where none is.

    Faulty rows count by the even-odd rule, faulty land by its valid parts. Equal rows are cut once, by each of
    unequal land polygons; they meet on grid cells and are cut pair by pair; a shape's parts are then united, so that borders between land polygons
    leave no seam. Lines and points of contact are no part of the result.
    """
    own = tables.materialise(rows.withColumn("__shape", shape_key()))
    shapes = tables.materialise(own.groupBy("__shape").agg(F.first("geom").alias("geom")))

    def sound(columns: list[list]) -> list[list]:
        return [[g if arrangement.why_invalid(g) is None else arrangement.repair(g, odd=True) for g in columns[0]]]

    left = tables.materialise(measured(once_each(shapes, ["geom"], sound, [("geom", GEOM, ARROW_GEOM)])).where("box is not null").select("__shape", "box", "geom"))
    single = land.select(F.explode("geom").alias("polygon")).select(F.array("polygon").alias("geom")).withColumn("land", shape_key()).groupBy("land").agg(F.first("geom").alias("geom"))
    pairs = meeting(left, tables.materialise(measured(single, repair=True).where("box is not null").select("land", "box", "geom")), [], ["__shape"], ["land"], MEET)
    parts = combined(pairs.select(F.col("a___shape").alias("__shape"), "a_geom", "b_geom"), "intersection").where(F.size("geom") > 0)
    made = dissolved(parts.select("__shape", "geom"), ["__shape"]).withColumnRenamed("geom", "clipped")
    geom = F.coalesce("clipped", F.array().cast(GEOM)).alias("geom")
    return own.join(made, "__shape", "left").select(*[F.col(f"`{c}`") for c in rows.columns if c != "geom"], geom)


def features(segments: DataFrame, mesh: geometry.Mesh | None = None) -> DataFrame:
    """(id, run, tags, geom): each segment as a feature with its title's parts and its years."""
    parsed = segments.withColumn("t", text.parse_title("title")).withColumn("p", text.path_id(F.col("id")))
    name = F.coalesce(F.nullif(F.col("t.name"), F.lit("")), F.nullif(F.col("p.name"), F.lit("")), F.col("p.id"))
    pairs = [("name", name), ("start_date", dates.year_text(F.col("first"))), ("end_date", dates.year_text(F.col("last") + 1)), ("title:raw", F.col("title")), ("color", F.col("fill")),
             ("whmid", F.nullif(F.col("p.id"), F.lit(""))), *[(k, F.col(f"t.{k}")) for k in ("span", "leader", "dynasty", "note")]]
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda _, v: v.isNotNull() & (v != ""))
    return project(parsed.withColumn("tags", tags).select("id", "run", "first", "tags", "d"), mesh).drop("d")


def chronologies(made: DataFrame) -> DataFrame:
    """name, members (feature ids by start), whmid if all have one: features of one name, two or more."""
    key = F.struct("first", "id", "run")
    out = made.groupBy(F.col("tags")["name"].alias("name")).agg(F.array_sort(F.collect_list(key)).alias("members"), F.count_distinct(F.col("tags")["whmid"]).alias("n_ids"), F.min(F.col("tags")["whmid"]).alias("whmid"))
    return out.where(F.size("members") >= 2).select("name", "members", F.when(F.col("n_ids") == 1, F.col("whmid")).alias("whmid"))


def import_topology(made: DataFrame) -> dict[str, DataFrame]:
    """Nodes, ways and references of the features' outer rings, without spurs."""
    feature = F.concat_ws("#", "id", F.col("run").cast("string"))
    rings = made.select(feature.alias("feature"), F.posexplode("geom").alias("ring", "polygon")).select("feature", "ring", F.col("polygon")[0].alias("points"))
    out = topology.topology(rings)
    ways = topology.prune_spurs(out["ways"])
    return {**out, "ways": ways, "refs": out["refs"].join(ways.select("way"), "way", "left_semi")}


def chronology_html(chron: DataFrame) -> DataFrame:
    """A list item a chronology, by the start of its first member."""
    item = F.concat(F.lit("<li>"), text.escape_html(F.col("name")), F.lit(" ("), F.size("members").cast("string"), F.lit(")</li>"))
    return chron.select(F.col("members")[0]["first"].alias("first"), item.alias("html")).orderBy("first", "html")


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (a_*, b_*) within a radius in degrees, by grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.explode(F.flatten(F.transform(F.sequence(cell("lon") - 1, cell("lon") + 1), lambda x: F.transform(F.sequence(cell("lat") - 1, cell("lat") + 1), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("cell"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.struct(cell("lon").alias("x"), cell("lat").alias("y")).alias("cell"))
    d2 = (F.col("a_lon") - F.col("b_lon")) ** 2 + (F.col("a_lat") - F.col("b_lat")) ** 2
    return left.join(right, "cell").withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def vertices(rows: DataFrame) -> DataFrame:
    """country, lon, lat of all vertices of (name, geom)."""
    p = rows.select(text.country_name(F.col("name")).alias("country"), F.explode(F.flatten(F.flatten("geom"))).alias("p"))
    return p.select("country", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")).distinct()


def control_points(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """lon, lat, dlon, dlat: vertices on land borders and the way to the nearest one of the same country on the other map."""
    mine = vertices(ours)
    border = _near(mine, mine, BORDER).where("a_country <> b_country").select(F.col("a_country").alias("country"), F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")).distinct()
    match = _near(border, vertices(theirs), MATCH).where("a_country = b_country")
    best = match.groupBy("a_country", "a_lon", "a_lat").agg(F.min_by(F.struct("b_lon", "b_lat"), "d2").alias("b"))
    return best.select(F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat"), (F.col("b.b_lon") - F.col("a_lon")).alias("dlon"), (F.col("b.b_lat") - F.col("a_lat")).alias("dlat"))


def correction_mesh(control: DataFrame, reach: float = REACH) -> DataFrame:
    """lon, lat (whole degrees), dlon, dlat: means of the control points within reach, weighted by 1 / distance²; a point in place counts alone."""
    spark = control.sparkSession
    grid = spark.range(360 * 180).select((F.col("id") % 360 - 180).cast("double").alias("lon"), (F.floor(F.col("id") / 360) - 90).cast("double").alias("lat"))
    near = _near(grid, control, reach)
    w = F.when(F.col("d2") > 0, 1 / F.col("d2"))
    agg = lambda c: F.coalesce(F.avg(F.when(F.col("d2") == 0, F.col(c))), F.sum(w * F.col(c)) / F.sum(w))
    return near.groupBy(F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")).agg(agg("b_dlon").alias("dlon"), agg("b_dlat").alias("dlat"))


def offset_stats(control: DataFrame) -> DataFrame:
    return control.agg(F.count("*").alias("n"), *[f(c) for c in ("dlon", "dlat") for f in (lambda c: F.avg(c).alias(f"mean_{c}"), lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}"))])


def to_mesh(rows: DataFrame) -> geometry.Mesh:
    """The mesh as arrays: 360 x 180 cells at most."""
    dlon, dlat = np.zeros((180, 360)), np.zeros((180, 360))
    for r in rows.limit(360 * 180).collect():
        dlon[int(r["lat"]) + 90, int(r["lon"]) + 180], dlat[int(r["lat"]) + 90, int(r["lon"]) + 180] = r["dlon"], r["dlat"]
    return geometry.Mesh(dlon, dlat)


__all__ = ["cells", "changes", "chronologies", "chronology_html", "clip_to", "control_points", "correction_mesh", "features", "full_states", "history", "import_topology", "offset_stats", "project", "state_in", "to_mesh", "vertices"]
