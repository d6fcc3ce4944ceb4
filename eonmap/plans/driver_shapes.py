"""Geometry that is cut, clipped, repaired and tested, over shapes made from the driver's keys, with SQL.

Shapes are made of unit cells (an L of five, an O of twelve around a hole of four, two squares that overlap),
or of triangles with a side on a meridian, so that their areas have closed forms that SQL can state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eonmap.functions import arrangement
from eonmap.plans import atlas, features
from eonmap.plans.driver import query, table
from eonmap.plans.driver_maps import CELL_KM2, SNAPSHOT, part_areas, part_relations, q_sql
from eonmap.sources import extract, sinks, tables

L_SHAPE = [[[(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]]]
L_CELLS = "(0, 0), (1, 0), (2, 0), (0, 1), (0, 2)"
O_SHAPE = [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]]
O_CELLS = "(0, 0), (1, 0), (2, 0), (3, 0), (0, 1), (3, 1), (0, 2), (3, 2), (0, 3), (1, 3), (2, 3), (3, 3)"


def drawn(shape: list[list[list[tuple[int, int]]]], x: Column, y: Column) -> Column:
    """A geometry of corners at offsets from (x, y)."""
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return F.array(*[F.array(*[F.array(*[corner(*p) for p in ring]) for ring in polygon]) for polygon in shape])


def at(key: Column) -> tuple[Column, Column]:
    return key % 40 - 20, F.floor(key / 40) % 20 - 10


AT = "{k} % 40 - 20 as x0, ({k} // 40) % 20 - 10 as y0"


@query(f"""
with p as (select p_partkey as id, {AT.format(k="p_partkey")} from part), a as (select id, x0 + dx as x, y0 + dy as y from p, (values {L_CELLS}) o(dx, dy)),
b as (select id, x0 + id % 5 - 2 + dx as x, y0 + id % 3 - 2 + dy as y from p, (values {O_CELLS}) o(dx, dy)),
c as (select id, {CELL_KM2} as km2, a.id is not null as ina, b.id is not null as inb from a full join b using (id, x, y))
select id, how, round(coalesce(sum(case how when 'intersection' then (ina and inb)::int when 'union' then 1 when 'difference' then (ina and not inb)::int else (ina <> inb)::int end * km2), 0), 3) as km2
from c, (values ('intersection'), ('union'), ('difference'), ('symmetric')) h(how) group by id, how""")
def map_boolean_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's L with an O beside, across or around it: areas of the polygons of all four operations."""
    k = F.col("p_partkey")
    x, y = at(k)
    pairs = table(spark, sf_dir, "part").select(k.alias("id"), drawn(L_SHAPE, x, y).alias("a_geom"), drawn(O_SHAPE, x + k % 5 - 2, y + k % 3 - 2).alias("b_geom"))
    made = [features.combined(pairs, how).select("id", F.lit(how).alias("how"), "geom") for how in arrangement.CHOICES]
    every = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return features.measured(every).select("id", "how", F.round("km2", 3).alias("km2"))


@query(f"""
with p as (select p_partkey as id, {AT.format(k="p_partkey")} from part), a as (select id, x0 + dx as x, y0 + dy as y from p, (values {L_CELLS}) o(dx, dy)),
s as (select s_suppkey as id, {AT.format(k="(s_suppkey * 7)")} from supplier),
land as (select x0 + dx as x, y0 + dy as y from s, (values {L_CELLS}) o(dx, dy) where id % 2 = 0 union select x0 + dx, y0 + dy from s, (values {O_CELLS}) o(dx, dy) where id % 2 = 1)
select a.id, round(coalesce(sum(case when land.x is not null then {CELL_KM2.replace("y", "a.y").replace("sqra.y", "sqry")} end), 0), 3) as km2 from a left join land on a.x = land.x and a.y = land.y group by a.id""")
def map_clip_to_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' L-shapes inside the suppliers' land, concave and with holes, of which many overlap."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    own = table(spark, sf_dir, "part").select(k.alias("id"), drawn(L_SHAPE, *at(k)).alias("geom"))
    land = table(spark, sf_dir, "supplier").select(F.when(s % 2 == 0, drawn(L_SHAPE, *at(s * 7))).otherwise(drawn(O_SHAPE, *at(s * 7))).alias("geom"))
    return features.measured(atlas.clip_to(own, land)).select("id", F.round("km2", 3).alias("km2"))


BROKEN = [[[[(0, 0), (2, 2), (2, 0), (0, 2)]]], [[[(0, 0), (2, 0), (2, 2), (0, 2)]], [[(1, 1), (3, 1), (3, 3), (1, 3)]]],
          [[[(0, 0), (2, 0), (2, 1), (5, 1), (2, 1), (2, 2), (0, 2)]]], [[[(0, 0), (3, 0), (3, 3), (0, 3)]], [[(1, 1), (2, 1), (2, 2), (1, 2)]]]]


def band_sql(low: int, high: int) -> str:
    """Area of a degree of longitude between two latitudes above y0."""
    return CELL_KM2.replace(q_sql("y + 1"), q_sql(f"(y0 + {high})")).replace(q_sql("y"), q_sql(f"(y0 + {low})"))


@query(f"""
with c as (select c_custkey as id, c_custkey % 4 as kind, {AT.format(k="c_custkey")} from customer)
select id, case kind when 3 then 'Nested shells' else 'Self-intersection' end as fault,
       round(case kind when 0 then 0.5 * {band_sql(0, 2)} when 1 then 2 * {band_sql(0, 1)} + 3 * {band_sql(1, 2)} + 2 * {band_sql(2, 3)} when 2 then 2 * {band_sql(0, 2)} else 3 * {band_sql(0, 3)} end, 3) as km2,
       round(case kind when 0 then {band_sql(0, 2)} when 1 then 2 * {band_sql(0, 1)} + 2 * {band_sql(1, 2)} + 2 * {band_sql(2, 3)} when 2 then 2 * {band_sql(0, 2)} else 3 * {band_sql(0, 3)} - {band_sql(1, 2)} end, 3) as odd_km2
from c""")
def map_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties, squares that overlap, a spike and nested shells: the fault, and the area by both rules of repair."""
    k = F.col("c_custkey")
    x, y = at(k)
    geom = F.when(k % 4 == 0, drawn(BROKEN[0], x, y)).when(k % 4 == 1, drawn(BROKEN[1], x, y)).when(k % 4 == 2, drawn(BROKEN[2], x, y)).otherwise(drawn(BROKEN[3], x, y))
    rows = tables.materialise(table(spark, sf_dir, "customer").select(k.alias("id"), geom.alias("geom")))
    odd = features.measured(features.repaired(rows, odd=True)).select("id", F.round("km2", 3).alias("odd_km2"))
    return features.measured(rows, repair=True).select("id", "fault", F.round("km2", 3).alias("km2")).join(odd, "id")


SQUARE = [(0, 0, 0), (1, 2, 0), (2, 2, 2), (3, 0, 2), (0, 0, 0)]
#: Ways of a relation by kind of fault: role, and corners (node, x, y); a way without corners is missing.
KINDS: list[list[tuple[str, list[tuple[int, float, float]]]]] = [
    [("outer", SQUARE)],
    [("outer", SQUARE[:3]), ("outer", [SQUARE[4], SQUARE[3], SQUARE[2]]), ("inner", [(4, 0.5, 0.5), (5, 0.5, 1.5), (6, 1.5, 1.5), (4, 0.5, 0.5)])],
    [("outer", SQUARE[:4])],
    [("outer", SQUARE), ("inner", [(4, 5, 5), (5, 6, 5), (6, 6, 6), (4, 5, 5)])],
    [("outer", SQUARE), ("outer", [])],
    [("outer", [(0, 0, 0), (1, 2, 2), (2, 2, 0), (3, 0, 2), (0, 0, 0)])],
    [("outer", [(0, 0, 0), (1, 2, 0), (2, 1, 1), (3, 2, 2), (4, 0, 2), (2, 1, 1), (0, 0, 0)])],
    [("outer", SQUARE), ("outer", [(4, 0.5, 0.5), (5, 1.5, 0.5), (6, 1.5, 1.5), (4, 0.5, 0.5)])],
]


@query("""
with c as (select c_custkey % 8 as kind from customer)
select type, cast(count as double) as count from (
  select 'geom-valid' as type, count(*) as count from c where kind <= 1 union all select 'geom-invalid', count(*) from c where kind > 1
  union all select 'nonclosed-ring', count(*) from c where kind = 2 union all select 'uncontained-inner-ring', count(*) from c where kind = 3
  union all select 'invalid-way-reference', count(*) from c where kind = 4 union all select 'self-intersect', count(*) from c where kind = 5
  union all select 'ring-self-intersect', count(*) from c where kind = 6 union all select 'nested-shells', count(*) from c where kind = 7)""")
def map_bad_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as relations, good ones of one way and of several with a hole, and one kind for each fault."""
    k = F.col("c_custkey")
    made = [(kind, j, role, i, node, float(x), float(y)) for kind, ways in enumerate(KINDS) for j, (role, corners) in enumerate(ways) for i, (node, x, y) in enumerate(corners or [(-1, 0, 0)])]
    corners = spark.createDataFrame(made, "kind int, j int, role string, i int, node int, x double, y double")
    placed = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 8).cast("int").alias("kind"), at(k)[0].alias("x0"), at(k)[1].alias("y0")).join(F.broadcast(corners), "kind")
    placed = placed.withColumn("way", F.col("id") * 10 + F.col("j"))
    nodes = placed.where("node >= 0").select((F.col("id") * 10 + F.col("node")).alias("id"), (F.col("x") + F.col("x0")).alias("lon"), (F.col("y") + F.col("y0")).alias("lat"), F.create_map().cast(tables.TAGS).alias("tags")).dropDuplicates(["id"])
    ways = placed.where("node >= 0").groupBy(F.col("way").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("id") * 10 + F.col("node")).alias("ref")))), lambda c: c["ref"]).alias("refs")).withColumn("tags", F.create_map().cast(tables.TAGS))
    member = F.struct(F.lit("w").alias("type"), F.col("way").alias("ref"), "role")
    tags = F.create_map(F.lit("name"), F.col("id").cast("string"), F.lit("admin_level"), F.lit("4"))
    relations = placed.where("i = 0").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", member.alias("m")))).alias("ms")).select("id", tags.alias("tags"), F.col("ms.m").alias("members"))
    examples, counters = features.bad_geometry(relations, tables.way_points(ways, nodes), SNAPSHOT)
    return sinks.summary(counters, examples.select("type", "ftype", "fid", "text"))


@query("""
select type, cast(count as double) as count from (select 'skipped-no-date' as type, count(*) filter (p_partkey % 6 in (1, 2)) as count from part union all select 'skipped-no-start', count(*) filter (p_partkey % 6 = 3) from part
union all select 'kept', count(*) filter (p_partkey % 6 in (0, 4, 5)) from part)""")
def map_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' squares without dates (or unreadable ones), and with an end only: counted as the coverage's one job runs."""
    k = F.col("id")
    start = F.when(k % 6 == 1, "").when(k % 6 == 2, "about then").when(k % 6 == 3, "").otherwise(F.col("tags")["start_date"])
    end = F.when(k % 6 == 1, "").when(k % 6 == 2, "x").when(k % 6 == 4, "later").otherwise(F.col("tags")["end_date"])
    dated = F.map_concat(F.map_filter("tags", lambda n, _: ~n.isin("start_date", "end_date")), F.create_map(F.lit("start_date"), start, F.lit("end_date"), end))
    skipped = Observation("skipped")
    rows = tables.materialise(features.coverage_rows(part_areas(spark, sf_dir).withColumn("tags", dated), SNAPSHOT, skipped).drop("geom"))
    return features.skip_counts(spark, skipped).unionByName(rows.agg(F.lit("kept").alias("type"), F.count("*").cast("double").alias("count")))


STEP = "round_even({x} * ({n}::double / {of}), 0) / ({n}::double / {of})"
LON, LAT = STEP.format(x="{x}", n="4000000", of="360"), STEP.format(x="{x}", n="2000000", of="180")


@query(f"""
with p as (select p_partkey as id, p_brand as name, p_size as s, {LON.format(x="(3 * p_size)")} as x0, {LON.format(x="(3 * p_size + 1)")} as x1, {LAT.format(x="1")} as y1 from part)
select id, name, 6 as tags, round({CELL_KM2.replace(q_sql("y + 1"), q_sql("y1")).replace(q_sql("y"), "0")} * (x1 - x0), 3) as km2, 2100.0::double as hi from p where s % 7 <> 0""")
def map_extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' relations as the viewer's files, read back: areas and tags from the files; those of every seventh size lack their way."""
    nodes, ways, relations = part_relations(spark, sf_dir)
    dated = relations.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("start_date"), F.lit("1900"), F.lit("whmid"), F.col("id").cast("string"))))
    # a small file would be one or two tasks
    dated = tables.materialise(dated.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"))
    found = features.web_extract(dated, tables.way_points(ways, nodes).where("id % 7 <> 0"), "2", ring_m2=0.0, line_m=0.0)
    folder = f"{tables.shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    extract.write_extract(found, folder, "2")
    read = tables.materialise(extract.read_relations(spark, f"{folder}/relations2.json"))
    rows = extract.extract_features(read, extract.read_ways(spark, f"{folder}/ways2.json"))
    return rows.join(read.select("id", F.size("tags").alias("tags")), "id").select("id", "name", "tags", F.round("km2", 3).alias("km2"), "hi")
