"""Queries over feature tables: nodes, ways and relations (see ``sources.tables``).

Each takes DataFrames and returns DataFrames. Geometry is made once for each relation, in Arrow
batches, and is then a column; joins in space and time are equi-joins on grid cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from eonmap.functions import arrangement, codecs, dates, edtf, geometry, text
from eonmap.operators import graph, numbering, quadtree, relational, temporal
from eonmap.sources import tables

RING = "array<struct<x:double,y:double>>"
GEOM = f"array<array<{RING}>>"
#: Keys whose features have no dates by nature, levels of coverage, decades' levels.
TIMELESS_KEYS = ("natural", "waterway", "water")
TIMELESS_VALUES = ("wood wetland beach cave_entrance peak cliff coastline tree_row water scrub grassland heath bare_rock glacier stream river pond basin lake").split()
COVERAGE_LEVELS, DECADE_LEVELS = ("1", "2", "3", "4"), ("2", "4")
#: The year after which a date is far away; an EDTF text of two dots; names and forms of warnings and faults.
FAR_FUTURE = 2050
TWO_DOTS = r"^(-?\d[\d-]*)?\.\.(-?\d[\d-]*)?$"
WARNINGS = {"open_ring": ("nonclosed-ring", "OpenRingWarning(node_id_start=%d, node_id_end=%d)"),
            "uncontained_inner": ("uncontained-inner-ring", "UncontainedInnerRingWarning(way_id=%d)"),
            "missing_way": ("invalid-way-reference", "MissingWayWarning(way_id=%d)")}
FAULTS = {"Nested shells": "nested-shells", "Ring Self-intersection": "ring-self-intersect", "Self-intersection": "self-intersect"}
#: Share of a unit's area inside another from which it is contained.
CONTAINED = 0.90
#: Partitions, and rows of each, of which equal rows go to one task.
PARTS, HOT = 32, 500_000
#: Sets of shapes whose common area a task remembers.
KNOWN = 1_000
#: Whether the boxes of a pair share more than a border.
MEET = "a_box[0] < b_box[2] and b_box[0] < a_box[2] and a_box[1] < b_box[3] and b_box[1] < a_box[3]"


def to_geom(value: object) -> geometry.Geometry:
    """A geometry column's value as arrays."""
    return [[np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in polygon] for polygon in value] if value is not None else []


def from_geom(geom: geometry.Geometry) -> list:
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in polygon] for polygon in geom]


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_GEOM = pa.list_(pa.list_(pa.list_(POINT)))


def geoms_of(column: pa.Array | pa.ChunkedArray) -> list[geometry.Geometry]:
    """A geometry column as arrays, which are views of its buffers; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    polygons, rings = column.values, column.values.values
    points = np.stack([rings.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1) if len(rings.values) else np.zeros((0, 2))
    of_row, of_polygon, of_ring = (a.offsets.to_numpy().tolist() for a in (column, polygons, rings))
    there = column.is_valid().to_pylist()
    return [[[points[of_ring[r]:of_ring[r + 1]] for r in range(of_polygon[p], of_polygon[p + 1])] for p in range(of_row[i], of_row[i + 1])] if ok else [] for i, ok in enumerate(there)]


def geom_array(geoms: Sequence[geometry.Geometry]) -> pa.Array:
    """The reverse of ``geoms_of``."""
    rings = [r for g in geoms for polygon in g for r in polygon]
    points = np.concatenate([np.zeros((0, 2)), *rings])
    offsets = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, i])) for i in (0, 1)], fields=list(POINT))
    lines = pa.ListArray.from_arrays(offsets(map(len, rings)), flat)
    polygons = pa.ListArray.from_arrays(offsets(len(polygon) for g in geoms for polygon in g), lines)
    return pa.ListArray.from_arrays(offsets(map(len, geoms)), polygons)


def with_computed(rows: DataFrame, inputs: Sequence[str], f: Callable[[list[list]], list[list]], new: Sequence[tuple[str, str, pa.DataType]], drop: Sequence[str] = ()) -> DataFrame:
    """Adds columns (name, Spark type, Arrow type) that ``f`` makes from lists of the values of ``inputs``.

    Batches are Arrow; the other columns pass through untouched. Columns in ``drop`` go. Geometries are
    arrays for ``f``, and come from it as arrays.
    """
    drop = [*drop, *[n for n, _, _ in new if n in rows.columns]]
    keep = [c for c in rows.columns if c not in drop or c in inputs]
    out = [c for c in keep if c not in drop]
    drawn = {c for c in inputs if rows.schema[c].dataType.simpleString() == GEOM}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f([geoms_of(b.column(keep.index(c))) if c in drawn else b.column(keep.index(c)).to_pylist() for c in inputs])
            arrays = [geom_array(v) if t.equals(ARROW_GEOM) else pa.array(v, t) for v, (_, _, t) in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(keep.index(c)) for c in out], *arrays], names=[*out, *[n for n, _, _ in new]])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out] + [f"{n} {t}" for n, t, _ in new])
    return rows.select(*keep).mapInArrow(work, schema)


def remembered(f: Callable[[list[list]], list[list]]) -> Callable[[list[list]], list[list]]:
    """``f`` on lists of which equal rows stand together: each is worked out once, also where it goes on in the next list."""
    last: dict[tuple, tuple] = {}

    def shape_of(value: object) -> object:
        if isinstance(value, list) and (not value or isinstance(value[0], list)):
            return tuple(tuple(r.tobytes() for r in polygon) for polygon in value)
        return repr(value)

    def each(columns: list[list]) -> list[list]:
        keys = [tuple(map(shape_of, row)) for row in zip(*columns, strict=True)]
        new: dict[tuple, int] = {}
        for i, k in enumerate(keys):
            if k not in last:
                new.setdefault(k, i)
        made = dict(last)
        if new:
            at = list(new.values())
            made.update(zip(new, zip(*f([[c[i] for i in at] for c in columns]), strict=True), strict=True))
        last.clear()
        if keys:
            last[keys[-1]] = made[keys[-1]]
        found = [made[k] for k in keys]
        return [list(c) for c in zip(*found, strict=True)] if found else f(columns)

    return each


def once_each(rows: DataFrame, inputs: Sequence[str], f: Callable[[list[list]], list[list]], new: Sequence[tuple[str, str, pa.DataType]], drop: Sequence[str] = ()) -> DataFrame:
    """``with_computed`` for work that is dear for its bytes: rows are dealt anew by their inputs, since small tables would
    else be few tasks, and equal inputs stand together and are worked out once for ``PARTS`` partitions and ``HOT`` rows of each, so that very many equal rows are no single task."""
    part = F.struct(F.floor(F.spark_partition_id() / PARTS).alias("of"), F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / HOT).alias("at"))
    keyed = rows.withColumn("__key", F.xxhash64(*inputs)).withColumn("__part", part)
    dealt = keyed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key", "__part").sortWithinPartitions("__key")
    return with_computed(dealt, inputs, remembered(f), new, [*drop, "__key", "__part"])


def shape_key(geom: str = "geom") -> Column:
    """A key of a geometry's value: two hashes, so that unequal ones don't share it."""
    return F.struct(F.xxhash64(geom).alias("h1"), F.xxhash64(F.lit(1), geom).alias("h2"))


# ------------------------------------------------------------- geometry of relations
def relation_geometry(relations: DataFrame, way_pts: DataFrame, any_outer: bool = False, leave_open: bool = False) -> DataFrame:
    """id, geom, warnings (kind, a, b), polygons (rings of signed way ids) of the relations' member ways.

    Ways are taken in the order of the members. A relation without ways has an empty geometry. A
    relation with its ways is one row, which bounds what a task holds at a time. leave_open: rings
    that don't close are left as they are, without a made-up way.
    """
    parts = relational.split_members(F.col("members"), any_outer)
    refs = relations.select("id", F.posexplode_outer(F.concat(
        F.transform(parts["outer"], lambda r: F.struct(r.alias("way"), F.lit("outer").alias("role"))),
        F.transform(parts["inner"], lambda r: F.struct(r.alias("way"), F.lit("inner").alias("role"))))).alias("pos", "m")).select("id", "pos", "m.*")
    pts = way_pts.select(F.col("id").alias("way"), "pts")
    rows = refs.join(pts, "way", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("way").isNotNull(), F.struct("pos", "way", "role", "pts")))).alias("ways"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ways in b["ways"]:
                nodes = {w["way"]: [p["node_id"] for p in w["pts"]] for w in ways if w["pts"] is not None}
                coords = {w["way"]: np.array([(p["lon"], p["lat"]) for p in w["pts"]], float) for w in ways if w["pts"] is not None}
                polygons, warns = geometry.assemble_polygons([w["way"] for w in ways if w["role"] == "outer"], [w["way"] for w in ways if w["role"] == "inner"], nodes, coords, leave_open)
                out.append((from_geom(geometry.polygon_points(polygons, coords)), [{"kind": w.kind, "a": w.a, "b": w.b} for w in warns], polygons))
            yield pd.DataFrame({"id": b["id"], "geom": [x[0] for x in out], "warnings": [x[1] for x in out], "polygons": [x[2] for x in out]})

    return rows.mapInPandas(build, f"id bigint, geom {GEOM}, warnings array<struct<kind:string,a:bigint,b:bigint>>, polygons array<array<array<bigint>>>")


def areas(relations: DataFrame, way_pts: DataFrame, ways: DataFrame) -> DataFrame:
    """ftype, id, tags, geom of what covers land: closed ways of three corners or more, and relations
    of type multipolygon or boundary whose rings all close. Tags area=no make a way a line."""
    ring = way_pts.select("id", "pts").where((F.size("pts") >= 4) & (F.col("pts")[0]["node_id"] == F.element_at("pts", -1)["node_id"]))
    corner = F.transform(F.slice("pts", 1, F.size("pts") - 1), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    closed = ways.where(~F.col("tags")["area"].eqNullSafe(F.lit("no")) & (F.size("tags") > 0)).select("id", "tags").join(ring, "id")
    closed = closed.select(F.lit("w").alias("ftype"), "id", "tags", F.array(F.array(corner)).alias("geom"))
    some = relations.where(F.col("tags")["type"].isin("multipolygon", "boundary"))
    drawn = relation_geometry(some, way_pts, any_outer=True).where((F.size("geom") > 0) & ~F.exists("warnings", lambda w: w["kind"] == "open_ring"))
    return closed.unionByName(some.select("id", "tags").join(drawn.select("id", "geom"), "id").select(F.lit("r").alias("ftype"), "id", "tags", "geom"))


def measured(rows: DataFrame, repair: bool = False) -> DataFrame:
    """Adds km2, fault (null if valid) and the bounding box of ``geom``.

    repair: faulty geometries are replaced by their valid parts (``arrangement.repair``) before they are measured.
    """
    def measure(columns: list[list]) -> list[list]:
        geoms = columns[0]
        faults = [arrangement.why_invalid(g) for g in geoms]
        if repair:
            geoms = [g if f is None else arrangement.repair(g) for g, f in zip(geoms, faults, strict=True)]
        corners = [np.concatenate([r for p in g for r in p]) if g else None for g in geoms]
        boxes = [None if c is None else [*c.min(axis=0).tolist(), *c.max(axis=0).tolist()] for c in corners]
        return [[geometry.area_km2(g) for g in geoms], faults, boxes, *([geoms] if repair else [])]

    new = [("km2", "double", pa.float64()), ("fault", "string", pa.string()), ("box", "array<double>", pa.list_(pa.float64()))]
    return once_each(rows, ["geom"], measure, [*new, ("geom", GEOM, ARROW_GEOM)] if repair else new)


def repaired(rows: DataFrame, odd: bool = False) -> DataFrame:
    """Replaces ``geom`` by valid polygons of what it covers; ``odd``: by the even-odd rule (see ``arrangement.repair``)."""
    return once_each(rows, ["geom"], lambda columns: [[arrangement.repair(g, odd) for g in columns[0]]], [("geom", GEOM, ARROW_GEOM)])


def cells(box: Column, degrees: float) -> Column:
    """Numbers of the grid cells that a box touches."""
    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / degrees).cast("int"), F.floor(hi / degrees).cast("int"))

    return F.flatten(F.transform(span(box[0], box[2]), lambda x: F.transform(span(box[1], box[3]), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def meeting(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: Sequence[str], b_id: Sequence[str], where: str = "true") -> DataFrame:
    """Pairs of rows of two tables (columns a_*, b_*) with equal keys and boxes that meet, that hold ``where``.

    ``a_id`` and ``b_id`` name the columns that tell the rows of each table apart. Boxes are laid out over the cells
    of a quadtree, small where boxes stand thick, without their geometries, which join the pairs afterwards,
    once for each. A pair comes once: from the cell that holds the lower left corner of the common box.
    """
    tree = quadtree.quadtree(a.select("box").unionByName(b.select("box")))
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    left = quadtree.with_cells(side(a.drop("geom"), "a"), tree, "a_box", "cell")
    right = quadtree.with_cells(side(b.drop("geom"), "b"), tree, "b_box", "cell_b")
    on = F.col("cell") == F.col("cell_b")
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    lo = [F.greatest(F.col("a_box")[i], F.col("b_box")[i]) for i in (0, 1)]
    hi = [F.least(F.col("a_box")[i], F.col("b_box")[i]) for i in (2, 3)]
    once = quadtree.holds(F.col("cell"), *lo)
    # never sent whole through the driver: a box may have many cells, and small files hold large geometries
    pairs = left.join(right.hint("merge"), on).where((lo[0] <= hi[0]) & (lo[1] <= hi[1]) & once & F.expr(where)).drop("cell", "cell_b")
    for df, p, ids in ((a, "a", a_id), (b, "b", b_id)):
        if "geom" in df.columns:
            pairs = pairs.join(side(df.select(*ids, "geom"), p).hint("merge"), [f"{p}_{c}" for c in ids])
    return pairs


def overlaid(pairs: DataFrame) -> DataFrame:
    """Adds shared_km2, rest_km2 (a less b) and rung to pairs with a_geom and b_geom, which go.

    rung counts how many finer grids failed before the pair came through; where all did, nothing is shared.
    """
    def areas(columns: list[list]) -> list[list]:
        got = [arrangement.overlay_km2(x, y) for x, y in zip(*columns, strict=True)]
        return [[g[0] for g in got], [g[2] for g in got], [g[3] for g in got]]

    return once_each(pairs, ["a_geom", "b_geom"], areas, [("shared_km2", "double", pa.float64()), ("rest_km2", "double", pa.float64()), ("rung", "int", pa.int32())], ["a_geom", "b_geom"])


def combined(pairs: DataFrame, how: str) -> DataFrame:
    """Adds geom and rung to pairs with a_geom and b_geom, which go: their intersection, union, difference or
    symmetric difference as polygons; empty where only lines or points are left."""
    def draw(columns: list[list]) -> list[list]:
        got = [arrangement.combine(x, y, how) for x, y in zip(*columns, strict=True)]
        return [[g for g, _ in got], [rung for _, rung in got]]

    return once_each(pairs, ["a_geom", "b_geom"], draw, [("geom", GEOM, ARROW_GEOM), ("rung", "int", pa.int32())], ["a_geom", "b_geom"])


def dissolved(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, geom: the union of the geometries of each key, without the borders between them.

    Parts that stand alone are not drawn again.
    """
    together = parts.groupBy(*keys).agg(F.collect_list("geom").alias("geoms"))

    def unite(columns: list[list]) -> list[list]:
        return [[to_geom(g[0]) if len(g) == 1 else arrangement.union([to_geom(x) for x in g]) for g in columns[0]]]

    return with_computed(together, ["geoms"], unite, [("geom", GEOM, ARROW_GEOM)], ["geoms"])


# ------------------------------------------------------------- quality
def feature_counts(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    return tables.counts(nodes, ways, relations)


def example(kind: str, line: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.coalesce(line, F.lit("")).alias("text"))


def date_quality(objects: DataFrame, fixed_timeless: bool = False) -> tuple[DataFrame, DataFrame]:
    """Examples (type, ftype, fid, text) and counters (type, count) for dated objects (ftype, id, tags).

    An object with an unreadable date gives its first such date (and a range in its name), and
    nothing else. fixed_timeless: test timeless features by their values; by default by the keys,
    which hardly ever holds. Nulls and empty texts are missing dates; an empty table gives zeros.
    """
    tag = lambda k: F.col("tags")[k]
    rows = objects.where(relational.has_any_key(F.col("tags"), ["start_date", "end_date", "start_date:edtf", "end_date:edtf"]))
    rows = rows.select("ftype", F.col("id").alias("fid"), "tags", relational.display_name(F.col("tags")).alias("name"), *[
        F.nullif(tag(k), F.lit("")).alias(c) for k, c in (("start_date", "start"), ("end_date", "end"), ("start_date:edtf", "start_e"), ("end_date:edtf", "end_e"))])
    rows = rows.withColumn("ps", dates.parse_date(F.col("start"))).withColumn("pe", dates.parse_date(F.col("end")))
    bad = lambda raw, p: F.col(raw).isNotNull() & F.col(p).isNull()
    rows = rows.withColumn("wrong", F.when(bad("start", "ps"), F.col("start")).when(bad("end", "pe"), F.col("end")))
    fine, has_s, has_e = F.col("wrong").isNull(), F.col("start").isNotNull(), F.col("end").isNotNull()
    rows = edtf.with_interval(edtf.with_interval(rows, "start_e", "es"), "end_e", "ee")
    timeless = F.lit(False)
    for k in TIMELESS_KEYS:
        timeless = timeless | F.coalesce(tag(k).isin(*(TIMELESS_VALUES if fixed_timeless else TIMELESS_KEYS)), F.lit(False))
    timeless = fine & has_e & ~has_s & timeless
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit(" "), "name")
    first = lambda c: dates.start_of(F.col(c))
    found = [F.when(~fine, example("date-invalid", said(F.col("wrong")))), F.when(relational.date_range_in_name(tag("name")), example("date-in-name", tag("name"))),
             F.when(fine & has_e & ~has_s & ~timeless, example("date-end-no-start", F.lit(""))),
             F.when(fine & (dates.date_key(first("ps")) > dates.date_key(first("pe"))), example("date-start-after-end", said(F.col("start"), " > ", F.col("end")))),
             F.when(fine & (F.col("ps")["y"] > FAR_FUTURE), example("date-far-future", said(F.col("start")))),
             F.when(fine & (F.col("pe")["y"] > FAR_FUTURE), example("date-far-future", said(F.col("end"))))]
    off, dotted = [], []
    for plain, p, e, i, k in (("start", "ps", "start_e", "es", "start_date"), ("end", "pe", "end_e", "ee", "end_date")):
        has = F.col(e).isNotNull() & fine
        found.append(F.when(has & F.col(plain).isNull(), example("date-edtf-without-plain", said(f"{k}:edtf=", F.col(e)))))
        unread = has & F.col(plain).isNotNull() & F.col(i).isNull()
        found.append(F.when(unread, example("date-edtf-invalid", said(f"{k}:edtf=", F.col(e)))))
        dotted.append((unread & F.col(e).rlike(TWO_DOTS) & (F.col(e) != "..")).cast("int"))
        lo, hi = dates.start_of(F.col(p)), dates.end_of(F.col(p))
        apart = has & F.col(p).isNotNull() & F.col(i).isNotNull() & ~((dates.date_key(lo) <= dates.date_key(F.col(i)["hi"])) & (dates.date_key(F.col(i)["lo"]) <= dates.date_key(hi)))
        found.append(F.when(apart, example("date-edtf-mismatch", said(f"{k}=", F.col(plain), f" vs {k}:edtf=", F.col(e)))))
        off.append((apart & dates.one_day_off(lo, hi, F.col(i)["lo"], F.col(i)["hi"])).cast("int"))
    total = lambda *xs: F.coalesce(F.sum(sum((F.coalesce(x.cast("int"), F.lit(0)) for x in xs), F.lit(0))), F.lit(0))
    examples = rows.select("ftype", "fid", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("f.type", "ftype", "fid", "f.text")
    # all readable objects count as relations, as the counter always did
    counts = {"dated-relations": total(fine), "dated-features": total(has_s | has_e), "dated-timeless": total(timeless),
              "date-edtf-features": total(fine & (F.col("start_e").isNotNull() | F.col("end_e").isNotNull())),
              "date-edtf-invalid-dot-dot": total(*dotted), "date-edtf-mismatch-off-by-one-day": total(*off)}
    one = rows.agg(*[c.alias(n) for n, c in counts.items()])
    counters = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("type"), F.col(f"`{c}`").cast("bigint").alias("count")) for c in one.columns])).alias("x")).select("x.*")
    return examples, counters


def chronology_members(relations: DataFrame) -> DataFrame:
    """chrono_id, pos, type, member of relations of type chronology."""
    rows = relations.where(F.col("tags")["type"] == "chronology")
    return rows.select(F.col("id").alias("chrono_id"), F.posexplode("members").alias("pos", "m")).select("chrono_id", "pos", F.col("m.type").alias("type"), F.col("m.ref").alias("member"))


def chronology_quality(relations: DataFrame, objects: DataFrame, width: int = 500_000) -> DataFrame:
    """type, chrono_id, text: chronologies without a name, and with members that have no date, overlap, or lie outside.

    objects: ftype, id, tags of all objects; those with a date tag are dated. Members with an
    unreadable date are passed over. Of overlapping pairs the first ten are named, in member order.
    """
    of = relations.where(F.col("tags")["type"] == "chronology").select(F.col("id").alias("chrono_id"), "tags", relational.display_name(F.col("tags")).alias("name"))
    title = F.when(F.col("name") != "", F.concat("name", F.lit(" "))).otherwise("")
    start, end = F.nullif(F.col("tags")["start_date"], F.lit("")), F.nullif(F.col("tags")["end_date"], F.lit(""))
    of = of.select("chrono_id", "name", title.alias("title"), start.alias("cs"), end.alias("ce"))
    members = chronology_members(relations).withColumnRenamed("type", "ftype").withColumnRenamed("member", "fid").withColumn("what", F.concat("ftype", F.lit("/"), "fid"))
    known = objects.where(relational.has_any_key(F.col("tags"), ["start_date", "end_date", "start_date:edtf", "end_date:edtf"])).select("ftype", F.col("id").alias("fid"), start.alias("s"), end.alias("e"))
    broken = (F.col("s").isNotNull() & dates.parse_date(F.col("s")).isNull()) | (F.col("e").isNotNull() & dates.parse_date(F.col("e")).isNull())
    known = known.withColumn("broken", broken)
    line = lambda kind, rows: rows.join(of, "chrono_id").select(F.lit(kind).alias("type"), "chrono_id", F.concat("title", "text").alias("text"))
    undated = temporal.undated_members(members, known.where("not broken").select("ftype", "fid"), known.where("broken").select("ftype", "fid"), ["ftype", "fid"])
    undated = undated.groupBy("chrono_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "what"))), lambda x: x["what"]), ",").alias("text"))
    dated = members.join(known.where("not broken"), ["ftype", "fid"]).withColumn("r", dates.date_range(F.col("s"), F.col("e")))
    dated = dated.withColumn("lo", dates.date_key(F.col("r")["start"])).withColumn("hi", dates.date_key(F.col("r")["end"]))
    dated = dated.withColumn("label", F.concat("what", F.lit(" ("), dates.format_range(F.col("s"), F.col("e")), F.lit(")")))
    pairs = temporal.overlap_pairs(dated.withColumn("id", F.struct("pos", "label")), ["chrono_id"], "id", "lo", "hi", width)
    order = F.struct(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    # the ten first by a window, so that no list of all pairs is held
    shown = pairs.select("chrono_id", order.alias("o")).withColumn("i", F.row_number().over(Window.partitionBy("chrono_id").orderBy("o.p.pos", "o.q.pos"))).where("i <= 10")
    shown = shown.groupBy("chrono_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: F.concat(x["o"]["p"]["label"], F.lit(" + "), x["o"]["q"]["label"])), ", ").alias("text"))
    r = dates.date_range(F.col("cs"), F.col("ce"))
    parent = of.where("cs is not null or ce is not null").select("chrono_id", r.alias("p"), dates.format_range(F.col("cs"), F.col("ce")).alias("whole"))
    parent = parent.select("chrono_id", "whole", dates.date_key(F.col("p")["start"]).alias("plo"), dates.date_key(F.col("p")["end"]).alias("phi"))
    outside = temporal.outside_parent(dated.select("chrono_id", "pos", "lo", "hi", "label"), parent, "chrono_id", "pos", "lo", "hi", "plo", "phi")
    outside = outside.select("chrono_id", F.concat("label", F.lit(" outside "), "whole").alias("text"))
    nameless = of.where("name = ''").select("chrono_id", F.lit("").alias("text"))
    out = line("chronology-anonymous", nameless)
    for kind, rows in (("chronology-undated-member", undated), ("chronology-overlapping-members", shown), ("chronology-member-outside-range", outside)):
        out = out.unionByName(line(kind, rows))
    return out


def _years(snapshot: str, start: Column, end: Column) -> Column:
    """Years of a feature up to the snapshot where its end is missing or unreadable."""
    until = F.coalesce(dates.start_of(dates.parse_date(end)), dates.start_of(dates.parse_date(F.lit(snapshot))))
    return dates.fractional_year(until) - dates.fractional_year(dates.start_of(dates.parse_date(start)))


def bad_geometry(relations: DataFrame, way_pts: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Examples (type, ftype, fid, text, earth_years), the weightiest first, and counters (type, count)
    of valid and invalid relations.

    A relation has one row for each kind of warning, with all warnings of the kind. Validity is
    tested only where there are none, since rings that were closed here are not the data's.
    """
    geom = measured(relation_geometry(relations, way_pts))
    rows = geom.join(relations.select("id", "tags"), "id")
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    weight = F.greatest(F.coalesce(_years(snapshot, tag("start_date"), tag("end_date")), F.lit(0.0)), F.lit(0.0)) * F.col("km2") / geometry.LAND_KM2
    label = text.level_prefix(F.col("tags")["admin_level"], relational.display_name(F.col("tags")))
    problem = lambda kind, why: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), why.alias("why"))
    def warned(kind: str, name: str, form: str) -> Column:
        own = F.filter("warnings", lambda w: w["kind"] == kind)
        shown = F.array_join(F.transform(own, lambda w: F.format_string(form, *[w["a"], w["b"]][:form.count("%")])), ", ")
        return F.when(F.size(own) > 0, problem(name, F.concat(label, shown)))

    found = [warned(kind, name, form) for kind, (name, form) in WARNINGS.items()]
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in FAULTS.items() for x in kv])[F.col("fault")], F.lit("other"))
    found.append(F.when(F.size("geom") == 0, problem("no-shapely", F.trim(label))).when((F.size("warnings") == 0) & F.col("fault").isNotNull(), problem(kind, F.concat(label, "fault"))))
    rows = tables.materialise(rows.select("id", weight.alias("earth_years"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found")))
    line = F.when(F.col("p.why") != "", F.concat(F.format_string("(%.4fey) ", F.col("earth_years")), "p.why")).otherwise(F.format_string("%.4f earth-yr", F.col("earth_years")))
    examples = rows.select("id", "earth_years", F.explode("found").alias("p")).select("p.type", F.lit("r").alias("ftype"), F.col("id").alias("fid"), line.alias("text"), "earth_years")
    n = rows.agg(*[F.coalesce(F.sum((F.size("found") == 0).cast("bigint") if ok else (F.size("found") > 0).cast("bigint")), F.lit(0)).alias(c) for c, ok in (("geom-valid", True), ("geom-invalid", False))])
    counters = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("type"), F.col(f"`{c}`").alias("count")) for c in n.columns])).alias("x")).select("x.*")
    return examples.orderBy(F.desc("earth_years"), "fid"), counters


# ------------------------------------------------------------- coverage
def coverage_rows(areas: DataFrame, snapshot: str, skipped: Observation | None = None) -> DataFrame:
    """Areas (ftype, id, tags, geom) of the coverage levels with level, name, lo, hi (fractional years), km2 and box.

    Areas without a start are left out; a missing or unreadable end is the snapshot's date. ``skipped`` counts
    those left out while the first job over the rows runs: no_date, and no_start where an end is known.
    """
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    s, own_end = dates.start_of(dates.parse_date(tag("start_date"))), dates.start_of(dates.parse_date(tag("end_date")))
    e = F.coalesce(own_end, dates.start_of(dates.parse_date(F.lit(snapshot))))
    rows = areas.where(F.col("tags")["admin_level"].isin(*COVERAGE_LEVELS)).select(
        "ftype", "id", F.col("tags")["admin_level"].alias("level"), relational.display_name(F.col("tags")).alias("name"), tag("start_date").alias("start"), tag("end_date").alias("end"),
        dates.fractional_year(s).alias("lo"), dates.fractional_year(e).alias("hi"), own_end.isNotNull().alias("ends"), "geom")
    if skipped is not None:
        rows = rows.observe(skipped, F.count_if(F.col("lo").isNull() & ~F.col("ends")).alias("no_date"), F.count_if(F.col("lo").isNull() & F.col("ends")).alias("no_start"))
    return measured(rows.where("lo is not null").drop("ends"), repair=True)


def skip_counts(spark: SparkSession, skipped: Observation) -> DataFrame:
    """type, count of the areas that ``coverage_rows`` left out, once a job has run over its rows."""
    return spark.createDataFrame([(f"skipped-{k.replace('_', '-')}", float(n)) for k, n in skipped.get.items()], "type string, count double")


def earth_years(rows: DataFrame) -> DataFrame:
    """level, earth_years: time times area over the earth's land; negative spans are summed as they are."""
    return rows.groupBy("level").agg(F.round(F.sum((F.col("hi") - F.col("lo")) * F.col("km2")) / geometry.LAND_KM2, 6).alias("earth_years"))


def earth_year_examples(rows: DataFrame, k: int = 2500) -> DataFrame:
    weighted = rows.withColumn("earth_years", (F.col("hi") - F.col("lo")) * F.col("km2") / geometry.LAND_KM2)
    return weighted.select("level", "ftype", "id", "earth_years", text.earth_years_text(F.col("earth_years"), F.col("name"), F.col("start"), F.col("end")).alias("text")).orderBy(F.desc("earth_years"), "id").limit(k)


def double_coverage(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """level, a_type, a, b_type, b, earth_years: pairs that cover the same land at the same time, the weightiest first.

    The one that starts first is b. Pairs that can't have ``least`` earth years are not drawn.
    """
    own = rows.select("level", "ftype", "id", "lo", "hi", "km2", "box", "geom")
    later = f"(a_lo > b_lo or (a_lo = b_lo and struct(a_ftype, a_id) > struct(b_ftype, b_id))) and {MEET}"
    heavy = f"(least(a_hi, b_hi) - greatest(a_lo, b_lo)) * least(a_km2, b_km2) / {geometry.LAND_KM2} >= {least}"
    pairs = meeting(own, own, ["level"], ["level", "ftype", "id"], ["level", "ftype", "id"], f"{later} and a_lo < b_hi and b_lo < a_hi and {heavy}")
    span = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    out = overlaid(pairs.select(F.col("a_level").alias("level"), F.col("a_ftype").alias("a_type"), F.col("a_id").alias("a"), F.col("b_ftype").alias("b_type"), F.col("b_id").alias("b"), span.alias("span"), "a_geom", "b_geom"))
    out = out.where("shared_km2 > 0").withColumn("earth_years", F.col("span") * F.col("shared_km2") / geometry.LAND_KM2)
    return out.select("level", "a_type", "a", "b_type", "b", "earth_years").orderBy(F.desc("earth_years"))


def double_coverage_by_shape(rows: DataFrame) -> DataFrame:
    """level, earth_years: the totals of ``double_coverage`` by level and pair of shapes, without a row for each pair.

    Rows of equal geometry are one shape. How long two of them, or two of two shapes, are there together is summed over
    the times at which their numbers change, so that the work grows with rows and with pairs of unequal shapes that overlap.
    """
    keyed = tables.materialise(rows.where("lo < hi").select("level", shape_key().alias("shape"), "lo", "hi", "km2", "box", "geom"))
    shapes = tables.materialise(keyed.groupBy("level", "shape").agg(F.first("km2").alias("km2"), F.first("box").alias("box"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("geom").alias("geom")))
    alive = tables.materialise(temporal.elementary(keyed.select("level", "shape", "lo", "hi"), ["level", "shape"], "lo", "hi"))
    twice = alive.groupBy("level", "shape").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("alive") * (F.col("alive") - 1) / 2).alias("years"))
    own = twice.where("years > 0").join(shapes.select("level", "shape", "km2"), ["level", "shape"]).select("level", (F.col("years") * F.col("km2") / geometry.LAND_KM2).alias("earth_years"))
    pairs = meeting(shapes, shapes, ["level"], ["level", "shape"], ["level", "shape"], f"a_shape < b_shape and a_lo < b_hi and b_lo < a_hi and {MEET}")
    shared = tables.materialise(overlaid(pairs.select(F.col("a_level").alias("level"), "a_shape", "b_shape", "a_geom", "b_geom")).where("shared_km2 > 0"))
    step = lambda side: shared.select("level", "a_shape", "b_shape", F.col(f"{side}_shape").alias("shape")).join(alive, ["level", "shape"]).select(
        "level", "a_shape", "b_shape", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.col("alive").alias("n")), F.struct(F.col("hi").alias("at"), (-F.col("alive")).alias("n")))).alias("m")).select(
        "level", "a_shape", "b_shape", "m.at", *[(F.col("m.n") if c == side else F.lit(0)).cast("bigint").alias(c) for c in "ab"])
    marks = step("a").unionByName(step("b")).groupBy("level", "a_shape", "b_shape", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("level", "a_shape", "b_shape").orderBy("at")
    together = marks.select("level", "a_shape", "b_shape", (F.sum("a").over(w) * F.sum("b").over(w) * (F.lead("at").over(w) - F.col("at"))).alias("years"))
    together = together.groupBy("level", "a_shape", "b_shape").agg(F.sum("years").alias("years")).where("years > 0")
    other = together.join(shared, ["level", "a_shape", "b_shape"]).select("level", (F.col("years") * F.col("shared_km2") / geometry.LAND_KM2).alias("earth_years"))
    return own.unionByName(other)


def double_coverage_totals(pairs: DataFrame) -> DataFrame:
    """type (double-covered-admin-2, say) and count: the earth years of all pairs of each level."""
    return pairs.groupBy(F.concat(F.lit("double-covered-admin-"), "level").alias("type")).agg(F.round(F.sum("earth_years"), 6).alias("count"))


def decade_coverage(areas: DataFrame) -> DataFrame:
    """level, decade, km2: area of the union of what exists in each decade.

    A decade's areas are cut into boxes of ten degrees, so that one task unites one box at a time.
    """
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    s, e = dates.lenient_year(tag("start_date")), dates.lenient_year(tag("end_date"))
    rows = areas.where(F.col("tags")["admin_level"].isin(*DECADE_LEVELS)).dropDuplicates(["ftype", "id"]).select(
        F.col("tags")["admin_level"].alias("level"), "id", "geom", dates.patched_start(s, s, e).alias("s"), e.alias("e"))
    pieces = clipped(measured(rows, repair=True).where("box is not null"), 10.0)
    pieces = temporal.expand_decades(pieces, F.col("s"), F.col("e"))

    def unite(b: pa.Table) -> pa.Table:
        km2 = arrangement.union_km2(geoms_of(b.column("geom")))
        return pa.table({"level": b.column("level")[:1], "decade": b.column("decade")[:1].cast(pa.int64()), "km2": [km2]})

    one = pieces.select("level", "decade", "cell", "geom").groupBy("level", "decade", "cell").applyInArrow(unite, "level string, decade bigint, km2 double")
    return one.groupBy("level", "decade").agg(F.sum("km2").alias("km2"))


def clipped(rows: DataFrame, degrees: float) -> DataFrame:
    """A row for each grid cell that a row's box touches, with ``cell`` and what of ``geom`` lies in it; empty pieces go."""
    def cut(columns: list[list]) -> list[list]:
        out = []
        for cell, g in zip(*columns, strict=True):
            x, y = cell["cx"] * degrees, cell["cy"] * degrees
            window = np.array([(x, y), (x + degrees, y), (x + degrees, y + degrees), (x, y + degrees)])
            part = [[geometry.clip_convex(r, window) for r in rings] for rings in g]
            out.append([[r for r in rings if len(r) >= 3] for rings in part if len(rings[0]) >= 3])
        return [out]

    some = with_computed(rows.withColumn("cell", F.explode(cells(F.col("box"), degrees))), ["cell", "geom"], remembered(cut), [("geom", GEOM, ARROW_GEOM)])
    return some.where(F.size("geom") > 0)


def coverage_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, name, whmid, earth_years, uncovered, pct: how much of each row of ``a`` no row of ``b`` covers, in space and time.

    Rows have id, name, whmid, lo, hi, km2, box and geom; the first set is never reduced, so rows
    without partners stay. Both are cut into boxes of ten degrees, and each row's time is cut where
    a partner starts or ends; one task unites what is there in one box at one time.
    """
    own = a.where("lo < hi")
    mine = tables.materialise(clipped(own.select("id", "lo", "hi", "box", "geom"), 10.0).select("id", "lo", "hi", "cell", F.col("box").alias("at"), "geom"))
    # of equal pieces in a cell one is left, with the times at which any of them is there
    pieces = tables.materialise(clipped(b.where("lo < hi").select("lo", "hi", "box", "geom"), 10.0).withColumn("b", shape_key()).select("b", "lo", "hi", "cell", "box", F.col("geom").alias("other")))
    theirs = tables.materialise(pieces.groupBy("b", "cell").agg(F.first("box").alias("box"), F.first("other").alias("other")))
    times = temporal.islands(pieces.select("b", "cell", "lo", "hi"), ["b", "cell"], "lo", "hi").select("b", "cell", F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    there = tables.materialise(theirs.drop("other").join(times, ["b", "cell"]))
    inside = "at[0] < box[2] and box[0] < at[2] and at[1] < box[3] and box[1] < at[3]"
    pairs = mine.drop("geom").join(there.hint("merge"), "cell").where(f"lo < bhi and blo < hi and {inside}")
    pairs = tables.materialise(pairs.select("id", "cell", "b", F.greatest("lo", "blo").alias("blo"), F.least("hi", "bhi").alias("bhi")))
    pieces = temporal.elementary(pairs, ["id", "cell"], "blo", "bhi").select("id", "cell", F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    there = pieces.join(pairs, ["id", "cell"]).where("blo <= plo and phi <= bhi")
    drawn = there.join(theirs.select("b", "cell", "other"), ["b", "cell"]).select("id", "cell", "plo", "phi", F.col("other").alias("geom"), F.lit(False).alias("own"))
    drawn = drawn.unionByName(pieces.join(mine.select("id", "cell", "geom"), ["id", "cell"]).select("id", "cell", "plo", "phi", "geom", F.lit(True).alias("own")))

    shared: dict[tuple, float] = {}

    def covered(t: pa.Table) -> pa.Table:
        geoms = list(zip(t.column("own").to_pylist(), geoms_of(t.column("geom")), strict=True))
        key = tuple(sorted((own, tuple(tuple(r.tobytes() for r in polygon) for polygon in g)) for own, g in geoms))
        if key not in shared:
            if len(shared) >= KNOWN:
                shared.clear()
            shared[key] = arrangement.overlay_km2(*[[polygon for own, g in geoms if own == side for polygon in g] for side in (True, False)])[0]
        km2 = shared[key]
        return pa.table({"id": t.column("id")[:1], "covered": [(t.column("phi")[0].as_py() - t.column("plo")[0].as_py()) * max(0.0, km2) / geometry.LAND_KM2]})

    kind = a.schema["id"].dataType.simpleString()
    sums = drawn.groupBy("id", "cell", "plo", "phi").applyInArrow(covered, f"id {kind}, covered double").groupBy("id").agg(F.sum("covered").alias("covered"))
    total = (F.col("hi") - F.col("lo")) * F.col("km2") / geometry.LAND_KM2
    out = own.select("id", "name", "whmid", total.alias("earth_years")).join(sums, "id", "left")
    out = out.withColumn("uncovered", F.greatest(F.col("earth_years") - F.coalesce("covered", F.lit(0.0)), F.lit(0.0))).drop("covered")
    return out.withColumn("pct", F.when(F.col("earth_years") > 0, F.round(100 * F.col("uncovered") / F.col("earth_years"), 1)))


def gap_by_chronology(gap: DataFrame) -> DataFrame:
    """Gaps of one chronology together: key, n, earth_years, uncovered, pct, name (the first base name)."""
    key = F.coalesce(F.nullif("whmid", F.lit("")), F.col("id").cast("string"))
    out = gap.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum("earth_years").alias("earth_years"), F.sum("uncovered").alias("uncovered"), F.min_by(text.base_name(F.col("name")), F.col("id")).alias("name"))
    return out.withColumn("pct", F.when(F.col("earth_years") > 0, F.round(100 * F.col("uncovered") / F.col("earth_years"), 1))).orderBy(F.desc("uncovered"))


def in_cells(rows: DataFrame, degrees: float) -> DataFrame:
    """``clipped`` with part_km2, the area of the piece, and full: whether it covers its whole cell."""
    def measure(columns: list[list]) -> list[list]:
        km2 = [geometry.area_km2(g) for g in columns[0]]
        whole = [geometry.area_km2([[np.array([(x, y), (x + degrees, y), (x + degrees, y + degrees), (x, y + degrees)])]]) for x, y in ((c["cx"] * degrees, c["cy"] * degrees) for c in columns[1])]
        return [km2, [k >= w * (1 - 1e-12) for k, w in zip(km2, whole, strict=True)]]

    return with_computed(clipped(rows, degrees), ["geom", "cell"], remembered(measure), [("part_km2", "double", pa.float64()), ("full", "boolean", pa.bool_())])


def region_era(rows: DataFrame, regions: DataFrame, eras: DataFrame, degrees: float = 10.0) -> DataFrame:
    """region, era (its start), earth_years. rows have ids of their own; regions: name (once each), geom, box; eras: start, end; both are short lists.

    Rows and regions are cut into cells once and meet cell by cell. Where a region fills its cell, a row's
    piece counts as it is; only pieces on a region's border are overlaid.
    """
    own = in_cells(rows.select("id", "lo", "hi", "box", "geom"), degrees).where("part_km2 > 0").drop("box", "full")
    borders = tables.materialise(in_cells(measured(regions.select("name", "geom"), repair=True).where("box is not null"), degrees).where("part_km2 > 0"))
    own = tables.materialise(own)
    whole = own.join(borders.where("full").select("cell", F.col("name").alias("region")), "cell").select("region", "lo", "hi", F.col("part_km2").alias("shared_km2"))
    cut = own.withColumnRenamed("geom", "a_geom").join(borders.where("not full").select("cell", F.col("name").alias("region"), F.col("geom").alias("b_geom")), "cell")
    inside = whole.unionByName(overlaid(cut.select("region", "lo", "hi", "a_geom", "b_geom")).select("region", "lo", "hi", "shared_km2"))
    timed = temporal.range_join(inside, eras, "lo", "hi", "start", "end").where("shared_km2 > 0")
    return timed.groupBy("region", F.col("start").alias("era")).agg((F.sum(F.col("shared") * F.col("shared_km2")) / geometry.LAND_KM2).alias("earth_years"))


# ------------------------------------------------------------- duplicates
def duplicate_relations(relations: DataFrame, way_pts: DataFrame) -> DataFrame:
    """ids, n, extra, length of relations with equal tags and shape, the largest groups first.

    Only relations with equal tags are drawn. Those whose ways are all missing have one empty shape.
    """
    tagged = relations.withColumn("key", F.to_json(relational.identity_tags(F.col("tags"))))
    again = tagged.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").select("key")
    some = tagged.join(again, "key", "left_semi")
    shapes = relation_geometry(some, way_pts.where(F.size("pts") >= 2), any_outer=True)

    def shape(columns: list[list]) -> list[list]:
        keys = [geometry.rounded_vertices([r for p in g for r in p]) for g in columns[0]]
        return [[repr(k[0]) for k in keys], [k[1] for k in keys]]

    drawing = with_computed(shapes.select("id", "geom"), ["geom"], shape, [("shape", "string", pa.string()), ("length", "double", pa.float64())], ["geom"])
    drawn = some.select("id", "key").join(drawing, "id", "left").fillna({"shape": "()", "length": 0.0})
    lengths = drawn.groupBy("key", "shape").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"), F.max("length").alias("length")).where("n >= 2")
    return lengths.select("ids", "n", (F.col("n") - 1).alias("extra"), "length").orderBy(F.desc("n"), F.desc("length"))


# ------------------------------------------------------------- connectivity
def connectivity(relations: DataFrame, way_pts: DataFrame) -> dict[str, DataFrame]:
    """Nodes (node, members, dropped), edges (a, b) and colours (node, colour) of the states that share borders.

    Copies become one; members of one chronology are one node; a unit inside a contemporary one goes
    into it, with its ways and its time, and through it into what that went into. Units without
    area contain nothing and are in nothing. Pairs are taken by the first way that they share, in
    the order of relations and their members. Colours go to nodes of high degree first.
    """
    states = relations.where(relational.admin_boundary(F.col("tags"), ["2"]) & ~F.col("tags")["type"].eqNullSafe(F.lit("chronology")))
    parts = relational.split_members(F.col("members"))
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    ways = F.array_distinct(F.concat(parts["outer"], parts["inner"]))
    rows = states.select("id", "tags", "members", ways.alias("order"), F.array_sort(ways).alias("ways"), tag("start_date").alias("s"), tag("end_date").alias("e"))
    chron = chronology_members(relations).where("type = 'r'").select("chrono_id", "pos", F.col("member").alias("member_id"))
    chron = tables.materialise(graph.merged_chronologies(chron))
    rows = rows.join(chron.select(F.col("member_id").alias("id")).distinct().withColumn("in_chron", F.lit(True)), "id", "left")
    rows = tables.materialise(rows.withColumn("way_key", F.to_json("ways")).withColumn("sk", F.coalesce("s", F.lit(""))).withColumn("ek", F.coalesce("e", F.lit(""))))
    key = ["way_key", "sk", "ek"]
    kept = relational.keepers(rows, key, F.col("in_chron"), "id").select("keeper", *key)
    copies = rows.select("id", *key).join(kept, key).where("id <> keeper").select("id", F.col("keeper").alias("into"))
    rows = rows.join(kept.select(F.col("keeper").alias("id")), "id", "left_semi")
    rows = tables.materialise(rows.withColumn("r", dates.date_range(F.col("s"), F.col("e"))).withColumn("lo", dates.date_key(F.col("r")["start"])).withColumn("hi", dates.date_key(F.col("r")["end"])))
    shapes = measured(relation_geometry(rows, way_pts), repair=True).where("km2 > 0").select("id", "km2", "geom").join(rows.select("id", "lo", "hi"), "id")
    placed = rows.select("id", F.posexplode("order").alias("pos", "way"))
    seen = placed.groupBy("way").agg(F.min(F.struct("id", "pos")).alias("first"))
    # only contemporaries meet, so that a border of many ages makes no pair of each two of them
    met = numbering.overlapping_neighbours(placed.join(rows.select("id", "lo", "hi"), "id"), "way", "id", "lo", "hi").select("way", F.col("a").alias("x"), F.explode("bs").alias("y"))
    near = met.select("way", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(seen, "way").groupBy("a", "b").agg(F.min("first").alias("first"))
    side = lambda p: shapes.select(*[F.col(c).alias(f"{p}_{c}") for c in shapes.columns])
    pairs = near.join(side("a").hint("merge"), F.col("a") == F.col("a_id")).join(side("b").hint("merge"), F.col("b") == F.col("b_id")).where("a_lo < b_hi and b_lo < a_hi")
    lean = overlaid(pairs.select("a", "b", "first", "a_km2", "b_km2", "a_geom", "b_geom"))
    a_in_b = F.col("a_km2") <= F.col("b_km2")
    inside = lean.where(F.col("shared_km2") >= CONTAINED * F.least("a_km2", "b_km2")).select(
        F.when(a_in_b, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(a_in_b, F.col("b")).otherwise(F.col("a")).alias("large"), F.struct("first", "a", "b").alias("rank"))
    dropped = graph.final_home(graph.contained_into(inside))
    own_chron = chron.select(F.col("member_id").alias("id"), F.col("chrono_id").alias("node"), "pos")
    node_of = rows.select("id").join(own_chron.drop("pos"), "id", "left").select("id", F.coalesce("node", "id").alias("node"))
    home = rows.select("id", "ways", "lo", "hi").join(dropped, "id", "left").withColumn("at", F.coalesce("into", "id")).join(node_of.withColumnRenamed("id", "at"), "at")
    home = tables.materialise(home)
    edges = tables.materialise(graph.node_edges(home.select("node", F.explode("ways").alias("way_id")), home.select("node", F.col("lo").alias("start"), F.col("hi").alias("end")), of_ages=True))
    gone = copies.join(home.select(F.col("id").alias("into"), "node"), "into").select("id", "node", F.lit(True).alias("gone"))
    whole = home.select("id", "node", F.col("into").isNotNull().alias("gone")).unionByName(gone)
    # members stand as in their chronology
    whole = whole.join(own_chron, ["id", "node"], "left")
    list_of = lambda c: F.transform(F.array_sort(F.collect_set(F.when(c, F.struct("pos", "id")))), lambda x: x["id"])
    nodes = whole.groupBy("node").agg(list_of(~F.col("gone")).alias("members"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("id")))).alias("dropped"))
    nodes = tables.materialise(nodes)
    return {"nodes": nodes, "edges": edges.orderBy("a", "b"), "colours": graph.first_fit(edges, graph.by_degree(nodes, edges))}


def relation_colours(nodes: DataFrame, colours: DataFrame) -> DataFrame:
    """id, colour, node of every relation of a coloured graph: members and what was dropped into them."""
    every = nodes.select("node", F.explode(F.concat("members", "dropped")).alias("id"))
    return every.join(colours, "node").groupBy("id").agg(F.min(F.struct("node", "colour")).alias("c")).select("id", "c.colour", "c.node")


# ------------------------------------------------------------- web extract and view
def web_extract(relations: DataFrame, way_pts: DataFrame, level: str, nodes: DataFrame | None = None, chronology: DataFrame | None = None, colours: DataFrame | None = None,
                ring_m2: float = 50.0, line_m: float = 10.0) -> dict[str, DataFrame]:
    """The viewer's tables of a level: ways (id, deltas, before, after), nodes (id, loc, tags), relations
    (id, flat tags, ways, nodes, chronology) by end, and the dictionaries pairs, keys and values.

    ways of a relation: a list of rings for each polygon, coded in base64; rings that don't close stay
    open. chronology: entries (id, name, prev, next) from ``chronology_entries``. colours: id, colour,
    node from ``relation_colours``, which become tags. Tolerances are in metres, of about ten to a
    step of the grid. Relations without ways or nodes have empty lists.
    """
    rows = relations.where(relational.admin_boundary(F.col("tags"), [level]))
    if colours is not None:
        rows = rows.join(colours, "id", "left")
        added = F.create_map(F.lit("color"), F.col("colour").cast("string"), F.lit("color:id"), F.col("node").cast("string"))
        rows = rows.withColumn("tags", F.when(F.col("colour").isNotNull(), F.map_concat(F.map_filter("tags", lambda k, _: ~k.isin("color", "color:id")), added)).otherwise(F.col("tags")))
    parts = relational.split_members(F.col("members"))
    used = rows.select(F.explode(F.concat(parts["outer"], parts["inner"])).alias("id")).distinct()
    pts = way_pts.join(used, "id", "left_semi").where(F.size("pts") > 0)

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["pts"]:
                grid = np.rint(np.array([(q["lon"] * codecs.LON_STEPS / 360, q["lat"] * codecs.LAT_STEPS / 180) for q in p])).astype(np.int64)
                closed = len(p) >= 2 and bool(np.all(grid[0] == grid[-1]))
                kept = geometry.simplify_ring(grid.astype(float), ring_m2 / 100) if closed else geometry.simplify_line(grid.astype(float), line_m / 10)
                out.append(np.diff(grid[kept], axis=0, prepend=0).ravel().tolist())
            yield pd.DataFrame({"id": b["id"], "deltas": out, "before": b["pts"].map(len), "after": [len(o) // 2 for o in out]})

    ways = pts.mapInPandas(thin, "id bigint, deltas array<bigint>, before int, after int")
    # relations of the same ways are put together once, as the first of them
    first = rows.groupBy(parts["outer"].alias("outer"), parts["inner"].alias("inner")).agg(F.min("id").alias("shape"))
    drawn = rows.select("id", parts["outer"].alias("outer"), parts["inner"].alias("inner")).join(first, ["outer", "inner"]).select("id", "shape")
    rings = relation_geometry(rows.join(first.select(F.col("shape").alias("id")), "id", "left_semi"), way_pts, leave_open=True).select("id", F.posexplode("polygons").alias("polygon", "rings"))
    coded = rings.select("id", "polygon", F.posexplode("rings").alias("n", "ring")).withColumn("code", F.base64(codecs.ring_to_varint("ring")))
    coded = coded.groupBy("id", "polygon").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("codes"))
    coded = coded.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("polygon", "codes"))), lambda x: x["codes"]).alias("ways"))
    coded = drawn.join(coded.withColumnRenamed("id", "shape"), "shape").select("id", "ways")
    tagged = rows.select("id", relational.kept_tags(F.col("tags")).alias("tags"))
    dictionaries = codecs.tag_tables(tagged, "id", "tags")
    flat = codecs.encode_tags(tagged, "id", "tags", dictionaries)
    order = dates.sort_key(F.coalesce(F.nullif(F.col("tags")["end_date"], F.lit("")), F.lit("2030")))
    out = rows.select("id", order.alias("o"), parts["nodes"].alias("nodes")).join(flat, "id").join(coded, "id", "left")
    if chronology is not None:
        out = out.join(chronology, "id", "left")
    else:
        out = out.withColumn("chronology", F.lit(None).cast("array<struct<id:bigint,name:string,prev:bigint,next:bigint>>"))
    empty = F.coalesce("ways", F.array().cast("array<array<string>>")).alias("ways")
    out = out.orderBy(F.col("o.y"), F.col("o.m"), F.col("o.d"), "id").select("id", "flat", empty, "nodes", "chronology")
    found = {"ways": ways, "relations": out, "pairs": dictionaries[0], "keys": dictionaries[1], "values": dictionaries[2]}
    if nodes is not None:
        wanted = rows.select(F.explode(parts["nodes"]).alias("id")).distinct()
        found["nodes"] = nodes.join(wanted, "id", "left_semi").select("id", F.array("lon", "lat").alias("loc"), "tags")
    return found


def chronology_entries(relations: DataFrame) -> DataFrame:
    """id, chronology (id, name, prev, next): for each member relation the chronologies it stands in, by their ids."""
    rows = chronology_members(relations).where("type = 'r'")
    names = relations.where(F.col("tags")["type"] == "chronology").select(F.col("id").alias("chrono_id"), relational.display_name(F.col("tags")).alias("name"))
    near = temporal.neighbours(rows, ["chrono_id"], ["pos"], "member").join(names, "chrono_id")
    entry = F.struct("chrono_id", "pos", F.struct(F.col("chrono_id").alias("id"), "name", "prev", "next").alias("e"))
    return near.groupBy(F.col("member").alias("id")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("chronology"))


def view_at(relations: DataFrame, decimal_year: float) -> DataFrame:
    """Relations (id, start_date, end_date, next) that the viewer shows at a time."""
    rows = relations.withColumn("lo", dates.decimal_earliest(F.col("start_date"))).withColumn("end_lo", dates.decimal_earliest(F.col("end_date"))).withColumn("end_hi", dates.decimal_latest(F.col("end_date")))
    split = temporal.split_shared_bounds(rows, "id", "next", "start_date", "end_date", "end_lo", "end_hi")
    split = split.withColumn("s", F.coalesce("eff_start", "lo")).withColumn("e", F.coalesce("eff_end", dates.decimal_exclusive_end(F.col("end_date"))))
    return temporal.time_slice(split, "s", "e", F.lit(decimal_year)).select(*relations.columns)


def find_by_name(objects: DataFrame, pattern: str) -> DataFrame:
    """ftype, id, name, name_en (null where it is the name) of matching objects."""
    hit = objects.where(relational.name_matches(F.col("tags"), pattern))
    return hit.select("ftype", "id", F.col("tags")["name"].alias("name"), F.nullif(F.col("tags")["name:en"], F.col("tags")["name"]).alias("name_en"))


def remap(features: DataFrame, fixed: dict[str, str]) -> DataFrame:
    """Tags of an import: name_xx becomes name:xx, fixed tags are added, features without a name go."""
    tags = F.map_concat(F.transform_keys("tags", lambda k, _: F.regexp_replace(k, r"^name_(\w\w)$", "name:$1")), F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]))
    return features.where(F.coalesce(F.col("tags")["name"], F.lit("")) != "").withColumn("tags", tags)


# ------------------------------------------------------------- metrics
def collate(history: DataFrame | None, today: DataFrame, date: str) -> DataFrame:
    """The wide history (a row a day) with one more day: today is (type, count); a repeated metric's last value wins."""
    wide = relational.to_wide(today.withColumn("date", F.lit(date)), "date", "type", "count")
    out = wide if history is None else history.unionByName(wide, allowMissingColumns=True)
    return out.select("date", *sorted(c for c in out.columns if c != "date")).orderBy("date")


def series(metrics: DataFrame) -> DataFrame:
    """date, type, count, share (of the first value), order: series with the largest last value first."""
    rows = relational.normalised(metrics, ["type"], "date", "count")
    last = metrics.groupBy("type").agg(F.max_by("count", "date").alias("last"))
    return rows.join(last.withColumn("order", F.row_number().over(Window.orderBy(F.desc("last"), "type"))), "type").drop("last")
