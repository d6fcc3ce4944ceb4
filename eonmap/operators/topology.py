"""Shared-boundary topology: polygons to nodes, junctions and ways that neighbours have in common.

All steps are relational. A ring is laid out as one row a vertex; junctions, pieces between them and
the ways that equal pieces share come from grouping and windows over rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eonmap.functions.codecs import TOPOLOGY_GRID, snap
from eonmap.operators.numbering import numbered
from eonmap.sources.tables import materialise


def ring_vertices(rings: DataFrame, grid: float = TOPOLOGY_GRID) -> DataFrame:
    """(feature, ring, points array<struct<x,y>>) to (feature, ring, pos, qlon, qlat): vertices on the
    grid, without the closing one and without repeats of the vertex before. Rings of fewer than three
    vertices, or with a vertex twice, go."""
    q = F.transform("points", lambda p: snap(p["x"], p["y"], grid))
    marked = rings.select("feature", "ring", q.alias("q"))
    n = F.size("q")
    fresh = F.filter(F.transform("q", lambda v, i: F.struct(v.alias("v"), (~v.eqNullSafe(F.get("q", F.when(i > 0, i - 1).otherwise(-1)))).alias("new"))), lambda x: x["new"])
    lean = marked.withColumn("q", F.col("q")).select("feature", "ring", F.transform(F.when(n > 0, fresh), lambda x: x["v"]).alias("v"))
    last_is_first = F.element_at("v", -1).eqNullSafe(F.element_at("v", 1)) & (F.size("v") > 1)
    lean = lean.where(F.size("v") > 0).select("feature", "ring", F.when(last_is_first, F.slice("v", 1, F.size("v") - 1)).otherwise(F.col("v")).alias("v"))
    good = lean.where((F.size("v") >= 3) & (F.size(F.array_distinct("v")) == F.size("v")))
    return good.select("feature", "ring", F.posexplode("v").alias("pos", "p")).select("feature", "ring", "pos", "p.qlon", "p.qlat")


def number_nodes(vertices: DataFrame) -> DataFrame:
    """Adds node: numbers from 1 in the order in which places are first seen."""
    first = vertices.groupBy("qlon", "qlat").agg(F.min(F.struct("feature", "ring", "pos")).alias("at"))
    return vertices.join(numbered(first, ["at"], "node").drop("at"), ["qlon", "qlat"])


def with_next(vertices: DataFrame) -> DataFrame:
    """Adds next and prev: the neighbours of each vertex around its ring."""
    w = Window.partitionBy("feature", "ring").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.withColumn("next", F.coalesce(F.lead("node").over(w), F.first("node").over(whole))).withColumn("prev", F.coalesce(F.lag("node").over(w), F.last("node").over(whole)))


def junctions(vertices: DataFrame) -> DataFrame:
    """node: places where other than two different edges meet."""
    e = with_next(vertices).select(F.explode(F.array(F.struct(F.col("node").alias("node"), F.col("next").alias("to")), F.struct(F.col("node").alias("node"), F.col("prev").alias("to")))).alias("e")).select("e.*")
    return e.groupBy("node").agg(F.count_distinct("to").alias("degree")).where("degree <> 2").select("node")


def split_rings(vertices: DataFrame, joints: DataFrame) -> DataFrame:
    """(feature, ring, piece, nodes): rings cut at junctions, each piece with both its ends.

    A ring without a junction is one closed piece from its least node on.
    """
    marked = vertices.join(joints.withColumn("joint", F.lit(True)), "node", "left").withColumn("joint", F.coalesce("joint", F.lit(False)))
    rings = marked.groupBy("feature", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "joint"))).alias("v"))
    nodes, n = F.transform("v", lambda x: x["node"]), F.size("v")
    rings = rings.select("feature", "ring", nodes.alias("nodes"), F.filter(F.transform("v", lambda x, i: F.when(x["joint"], i)), lambda i: i.isNotNull()).alias("cuts"), n.alias("n"))
    least = F.array_position("nodes", F.array_min("nodes")).cast("int") - 1
    rings = rings.withColumn("start", F.when(F.size("cuts") > 0, F.element_at("cuts", 1)).otherwise(least))
    turned = F.concat(F.slice("nodes", F.col("start") + 1, F.col("n")), F.slice("nodes", F.lit(1), F.col("start")), F.array(F.get("nodes", F.col("start"))))
    cuts = F.when(F.size("cuts") > 0, F.concat(F.transform("cuts", lambda c: c - F.element_at("cuts", 1)), F.array(F.col("n")))).otherwise(F.array(F.lit(0), F.col("n")))
    flat = rings.select("feature", "ring", turned.alias("t"), cuts.alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.slice("t", F.get("c", i) + 1, F.get("c", i + 1) - F.get("c", i) + 1))
    return flat.select("feature", "ring", F.posexplode(pairs).alias("piece", "nodes"))


def canonical(nodes: Column) -> Column:
    """A piece and its reverse have one canonical form."""
    return F.least(nodes, F.reverse(nodes))


def share_ways(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways (way, nodes) and references (feature, ring, piece, way, forward): equal pieces are one way.

    Ways are numbered from 1 in the order in which they are first seen.
    """
    form = pieces.withColumn("form", canonical(F.col("nodes")))
    first = form.groupBy("form").agg(F.min(F.struct("feature", "ring", "piece")).alias("at"))
    ways = materialise(numbered(first, ["at"], "way").select("form", "way"))
    refs = form.join(ways, "form").select("feature", "ring", "piece", "way", (F.col("nodes") == F.col("form")).alias("forward"))
    return ways.select("way", F.col("form").alias("nodes")), refs


def prune_spurs(ways: DataFrame) -> DataFrame:
    """Ways less those with an end that no other way has, again until there are none; closed ones stay."""
    while True:
        ends = ways.select("way", F.explode(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1))).alias("node"))
        loose = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("way").alias("way")).where("n = 1").select("way").distinct()
        left = materialise(ways.join(loose, "way", "left_anti"))
        if left.count() == ways.count():
            return left
        ways = left


def topology(rings: DataFrame, grid: float = TOPOLOGY_GRID) -> dict[str, DataFrame]:
    """nodes (node, lon, lat), ways and references of (feature, ring, points)."""
    vertices = materialise(number_nodes(ring_vertices(rings, grid)))
    pieces = split_rings(vertices, junctions(vertices))
    ways, refs = share_ways(pieces)
    nodes = vertices.select("node", (F.col("qlon") * grid).alias("lon"), (F.col("qlat") * grid).alias("lat")).distinct()
    return {"nodes": nodes, "ways": ways, "refs": refs}
