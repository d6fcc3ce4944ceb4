"""Composite queries and function tables over the driver's tables, each with the same question in SQL.

Parts and suppliers become squares of one degree on a grid, with years from their keys, so that areas
and overlaps have closed forms that SQL can state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eonmap.functions import codecs, dates, geometry, text
from eonmap.operators import graph, relational, temporal, topology
from eonmap.plans import features, view
from eonmap.plans.driver import day_key, query, shared_key_edges, table
from eonmap.sources import sinks, tables

SNAPSHOT = "2026-01-01"


# ------------------------------------------------------------- maps from keys
def q_sql(lat: str) -> str:
    """The equal-area projection's function of latitude."""
    s = f"sin(radians({lat}))"
    return f"((1 - {geometry._E2!r}) * ({s} / (1 - {geometry._E2!r} * {s} * {s}) - ln((1 - {geometry._E!r} * {s}) / (1 + {geometry._E!r} * {s})) / (2 * {geometry._E!r})))"


#: Squares of parts (2,000 at the small scale) and suppliers in SQL: id, name, level, x, y, lo, hi (years), km2 and, for suppliers, whmid.
CELL_KM2 = f"({geometry.A!r} * {geometry.A!r} * radians(1) / 2e6 * ({q_sql('y + 1')} - {q_sql('y')}))"
MAP_SQL = f"""
with p0 as (select p_partkey as id, p_name as name, 1 + p_partkey % 4 as level, p_partkey % 40 - 20 as x, (p_partkey // 40) % 20 - 10 as y,
                   1000 + (p_partkey * 13) % 97 as lo, 1000 + (p_partkey * 13) % 97 + 1 + p_size as hi from part),
p as (select *, {CELL_KM2} as km2 from p0),
s0 as (select s_suppkey as id, s_name as name, s_suppkey % 40 - 20 as x, (s_suppkey // 40) % 20 - 10 as y, 1000 + (s_suppkey * 11) % 97 as lo,
              1000 + (s_suppkey * 11) % 97 + 30 as hi, cast(s_nationkey as varchar) as whmid from supplier),
s as (select *, {CELL_KM2} as km2 from s0)
"""


def square(x: Column, y: Column) -> Column:
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return F.array(F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))


def part_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ftype, id, tags, geom of the parts' squares."""
    k = F.col("p_partkey")
    lo = 1000 + (k * 13) % 97
    tags = F.create_map(F.lit("admin_level"), (1 + k % 4).cast("string"), F.lit("name"), F.col("p_name"),
                        F.lit("start_date"), lo.cast("string"), F.lit("end_date"), (lo + 1 + F.col("p_size")).cast("string"))
    return table(spark, sf_dir, "part").select(F.lit("r").alias("ftype"), k.alias("id"), tags.alias("tags"), square(k % 40 - 20, F.floor(k / 40) % 20 - 10).alias("geom"))


def supplier_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lo = (1000 + (k * 11) % 97).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("whmid"),
                                                   lo.alias("lo"), (lo + 30).alias("hi"), square(k % 40 - 20, F.floor(k / 40) % 20 - 10).alias("geom"))


@query(MAP_SQL + "select cast(level as varchar) as level, round(sum((hi - lo) * km2) / 149e6, 6) as earth_years from p group by level")
def map_earth_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.earth_years(features.coverage_rows(part_areas(spark, sf_dir), SNAPSHOT))


@query(MAP_SQL + """select 'double-covered-admin-' || a.level as type, round(sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * a.km2) / 149e6, 6) as count
from p a join p b on a.x = b.x and a.y = b.y and a.level = b.level and a.id < b.id and a.lo < b.hi and b.lo < a.hi group by a.level""")
def map_double_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.double_coverage_totals(features.double_coverage_by_shape(features.coverage_rows(part_areas(spark, sf_dir), SNAPSHOT)))


@query(MAP_SQL + """, d as (select distinct level, x, y, km2, unnest(range(cast(ceil(lo / 10.0) * 10 as int), hi + 1, 10)) as decade from p where level in (2, 4))
select cast(decade as bigint) as year, printf('%.0f', coalesce(sum(km2) filter (where level = 2), 0)) as admin2_km2, printf('%.0f', coalesce(sum(km2) filter (where level = 4), 0)) as admin4_km2
from d group by decade""")
def map_decade_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.decade_table(features.decade_coverage(part_areas(spark, sf_dir)))


@query(MAP_SQL + """, t as (select s.id, greatest(s.lo, p.lo) as lo, least(s.hi, p.hi) as hi from s join p on s.x = p.x and s.y = p.y and s.lo < p.hi and p.lo < s.hi),
m as (select *, max(hi) over (partition by id order by lo, hi rows between unbounded preceding and 1 preceding) as top from t),
c as (select id, sum(case when top is null then hi - lo else greatest(0, hi - greatest(lo, top)) end) as years from m group by id),
g as (select s.id, s.whmid, s.name, (s.hi - s.lo) * s.km2 / 149e6 as ey, (s.hi - s.lo - coalesce(c.years, 0)) * s.km2 / 149e6 as un from s left join c using (id))
select whmid as key, count(*) as n, round(sum(ey), 6) as earth_years, round(sum(un), 6) as uncovered, arg_min(name, id) as name from g group by whmid""")
def map_gap_by_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = features.measured(supplier_areas(spark, sf_dir))
    theirs = features.coverage_rows(part_areas(spark, sf_dir), SNAPSHOT).select("id", "lo", "hi", "box", "geom")
    out = features.gap_by_chronology(features.coverage_gap(ours, theirs))
    return out.select("key", "n", F.round("earth_years", 6).alias("earth_years"), F.round("uncovered", 6).alias("uncovered"), "name")


@query(MAP_SQL + """, eras(lo, hi) as (values (1000, 1040), (1040, 1070), (1070, 1100), (1100, 2000)), r as (select r_name, -20 + 8 * r_regionkey as x0 from region)
select r_name as region, cast(e.lo as bigint) as era, round(sum((least(p.hi, e.hi) - greatest(p.lo, e.lo)) * km2) / 149e6, 6) as earth_years
from p join r on x >= x0 and x < x0 + 8 join eras e on p.lo < e.hi and e.lo < p.hi group by 1, 2""")
def map_region_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    x = -20 + 8 * F.col("r_regionkey")
    regions = features.measured(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.array(F.array(F.array(corner(x, -10), corner(x + 8, -10), corner(x + 8, 10), corner(x, 10)))).alias("geom")))
    eras = spark.createDataFrame([(1000, 1040), (1040, 1070), (1070, 1100), (1100, 2000)], "start bigint, end bigint")
    rows = features.coverage_rows(part_areas(spark, sf_dir), SNAPSHOT).select("id", "lo", "hi", "box", "geom")
    out = features.region_era(rows, regions, eras)
    return out.select("region", "era", F.round("earth_years", 6).alias("earth_years"))


def part_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations: a part's relation is drawn by the square way of its size."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("s")).distinct()
    corner = F.explode(F.array(*[F.struct((F.col("s") * 4 + i).alias("id"), (F.col("s") * 3 + dx).cast("double").alias("lon"), F.lit(float(dy)).alias("lat")) for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    nodes = sizes.select(corner.alias("n")).select("n.*", F.create_map().cast(tables.TAGS).alias("tags"))
    ways = sizes.select(F.col("s").alias("id"), F.array(*[F.col("s") * 4 + i for i in (0, 1, 2, 3, 0)]).alias("refs"), F.create_map().cast(tables.TAGS).alias("tags"))
    member = F.array(F.struct(F.lit("w").alias("type"), F.col("p_size").cast("bigint").alias("ref"), F.lit("outer").alias("role")))
    tags = F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), F.lit("2"), F.lit("name"), F.col("p_brand"), F.lit("source"), F.col("p_name"))
    return nodes, ways, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"), member.alias("members"))


@query("""select 'nodes' as type, 4 * count(distinct p_size) as count from part union all select 'ways', count(distinct p_size) from part union all select 'relations', count(*) from part""")
def map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_counts(*part_relations(spark, sf_dir))


@query("""select min(p_partkey) as first_id, max(p_partkey) as last_id, count(*) as n, count(*) - 1 as extra from part group by p_brand, p_size having count(*) >= 2""")
def map_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = part_relations(spark, sf_dir)
    out = features.duplicate_relations(relations, tables.way_points(ways, nodes))
    return out.select(F.col("ids")[0].alias("first_id"), F.element_at("ids", -1).alias("last_id"), "n", "extra")


@query("""select p_size as id, 5 as n, cast(3 * p_size as double) as west, cast(3 * p_size + 1 as double) as east from (select distinct p_size from part)""")
def map_way_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = part_relations(spark, sf_dir)
    used = relations.select(F.explode(relational.split_members(F.col("members"))["outer"]).alias("id"))
    pts = tables.way_points(tables.by_ids(ways, used), nodes, 3)
    lon = F.transform("pts", lambda p: p["lon"])
    return pts.select(F.col("id").cast("int").alias("id"), F.size("pts").alias("n"), F.array_min(lon).alias("west"), F.array_max(lon).alias("east"))


@query("""with t as (select 'geom-valid' as type, count(*) as count from part where p_size <= 40 union all select 'geom-invalid', count(*) from part where p_size > 40)
select type, cast(count as double) as count from t union all select 'invalid-way-reference', cast(count(*) as double) from part where p_size > 40
union all select 'no-shapely', cast(count(*) as double) from part where p_size > 40""")
def map_bad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of sizes over 40 are missing from the extract."""
    nodes, ways, relations = part_relations(spark, sf_dir)
    examples, counters = features.bad_geometry(relations, tables.way_points(ways, nodes).where("id <= 40"), SNAPSHOT)
    return sinks.summary(counters, examples.select("type", "ftype", "fid", "text"))


@query(MAP_SQL + """, v as (select id, unnest([{'i': 0, 'x': x, 'y': y}, {'i': 1, 'x': x + 1, 'y': y}, {'i': 2, 'x': x + 1, 'y': y + 1}, {'i': 3, 'x': x, 'y': y + 1}]) as c from p),
e as (select a.id, a.c.x as x, a.c.y as y, b.c.x as tx, b.c.y as ty from v a join v b on a.id = b.id and b.c.i in ((a.c.i + 1) % 4, (a.c.i + 3) % 4)),
d as (select x, y, count(distinct (tx, ty)) as degree from e group by 1, 2),
r as (select id, greatest(1, count(*) filter (where degree <> 2)) as pieces from v join d on c.x = d.x and c.y = d.y group by id)
select (select count(*) from d) as nodes, (select count(*) from d where degree <> 2) as junctions,
       (select cast(sum(degree) / 2 as bigint) from d where degree <> 2) as ways, (select cast(sum(pieces) as bigint) from r) as refs""")
def map_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = part_areas(spark, sf_dir).select(F.col("id").alias("feature"), F.lit(0).alias("ring"), F.col("geom")[0][0].alias("points"))
    vertices = tables.materialise(topology.number_nodes(topology.ring_vertices(rings)))
    joints = topology.junctions(vertices)
    ways, refs = topology.share_ways(topology.split_rings(vertices, joints))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(vertices.select("node").distinct(), "nodes").join(n(joints, "junctions")).join(n(ways, "ways")).join(n(refs, "refs"))


# ------------------------------------------------------------- dates and chronologies as tags
def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ftype, id, tags: orders as dated objects, of shapes by key: good, without start, unreadable, reversed, far away, with EDTF."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    y = F.substring(d, 1, 4)
    end = F.when(k % 7 == 2, F.concat(y, F.lit("x"))).when(k % 7 == 3, "1066").when(k % 7 == 4, "9999").otherwise(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 400), "yyyy-MM-dd"))
    pairs = [("start_date", F.when(k % 7 != 1, d)), ("end_date", end), ("name", F.col("o_orderstatus")), ("start_date:edtf", F.when(k % 5 == 1, y).when(k % 5 == 2, F.concat(F.lit("../"), y)).when(k % 5 == 3, F.concat(y, F.lit("..2050"))))]
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs])), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select(F.lit("r").alias("ftype"), k.alias("id"), tags.alias("tags"))


@query("""
with o as (select o_orderkey as k, o_orderkey % 7 as a, o_orderkey % 5 as b from orders), f as (select * from o where a <> 2)
select type, cast(count as double) as count from (
  select 'dated-relations' as type, count(*) as count from f union all select 'dated-features', count(*) from o union all select 'dated-timeless', 0
  union all select 'date-edtf-features', count(*) from f where b in (1, 2, 3) union all select 'date-edtf-invalid-dot-dot', count(*) from f where b = 3 and a <> 1
  union all select 'date-edtf-mismatch-off-by-one-day', 0 union all select 'date-invalid', count(*) from o where a = 2
  union all select 'date-end-no-start', count(*) from f where a = 1 union all select 'date-start-after-end', count(*) from f where a = 3
  union all select 'date-far-future', count(*) from f where a = 4 union all select 'date-edtf-without-plain', count(*) from f where a = 1 and b in (1, 2, 3)
  union all select 'date-edtf-invalid', count(*) from f where b = 3 and a <> 1)""")
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples, counters = features.date_quality(order_objects(spark, sf_dir))
    return sinks.summary(counters, examples)


@query("""
with m as (select o_custkey as c, o_orderkey as o, year(o_orderdate) as s, year(o_orderdate) + 1 + o_orderkey % 3 as e, o_orderkey % 11 = 0 as undated from orders),
x as (select a.c, least((a.o, 'r/' || a.o || ' (' || a.s || '-' || a.e || ')'), (b.o, 'r/' || b.o || ' (' || b.s || '-' || b.e || ')')) as p, greatest((a.o, 'r/' || a.o || ' (' || a.s || '-' || a.e || ')'), (b.o, 'r/' || b.o || ' (' || b.s || '-' || b.e || ')')) as q
      from m a join m b on a.c = b.c and a.o < b.o and a.s < b.e and b.s < a.e where not a.undated and not b.undated),
n as (select c, p[2] || ' + ' || q[2] as t, row_number() over (partition by c order by p[1], q[1]) as i from x),
t as (select 'chronology-overlapping-members' as type, c, string_agg(t, ', ' order by i) as t from n where i <= 10 group by c
      union all select 'chronology-undated-member', c, string_agg('r/' || o, ',' order by o) from m where undated group by c
      union all select 'chronology-member-outside-range', c, arg_min('r/' || o || ' (' || s || '-' || e || ') outside 1993-1998', o) from m where not undated and (s < 1993 or e > 1998) group by c)
select type, c as chrono_id, case when c % 4 = 0 then '' else c_name || ' ' end || t as text from t join customer on c = c_custkey
union all select 'chronology-anonymous', c_custkey, '' from customer where c_custkey % 4 = 0""")
def chronology_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chronologies of their orders, by key; those of every fourth have no name."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    members = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(F.lit("r").alias("type"), k.alias("ref"), F.lit("").alias("role"))).alias("members"))
    tags = F.create_map(F.lit("type"), F.lit("chronology"), F.lit("name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")), F.lit("start_date"), F.lit("1993"), F.lit("end_date"), F.lit("1998"))
    rows = table(spark, sf_dir, "customer").join(members, F.col("c_custkey") == F.col("o_custkey"), "left")
    relations = rows.select(F.col("c_custkey").alias("id"), tags.alias("tags"), F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members"))
    dated = F.create_map(F.lit("start_date"), F.col("y").cast("string"), F.lit("end_date"), (F.col("y") + 1 + F.col("o_orderkey") % 3).cast("string"))
    objects = orders.select(F.lit("r").alias("ftype"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 == 0, F.create_map(F.lit("name"), F.lit("x"))).otherwise(dated).alias("tags"))
    return features.chronology_quality(relations, objects, 50_000)


# ------------------------------------------------------------- graphs
@query("""
with recursive n as (select o_orderkey as a, lead(o_orderkey) over w as b, o_orderdate as d, lead(o_orderdate) over w as e from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
e as (select a, b from n where e::date - d::date <= 90), both_ways as (select a as x, b as y from e union all select b, a from e),
r(node, other) as (select distinct x, x from both_ways union select r.node, y from r join both_ways on other = x)
select node, min(other) as component from r group by node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked to the customer's next one within 90 days: many chains."""
    near = temporal.neighbours(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    after = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("next"), day_key("o_orderdate").alias("then"))
    links = near.select("o_orderkey", "next", day_key("o_orderdate").alias("day")).join(after, "next").where("then - day <= 90")
    return graph.components(links.select(F.col("o_orderkey").alias("a"), F.col("next").alias("b")))


@query("""
with o as (select distinct l_suppkey as node, l_partkey as way from lineitem),
r as (select l_suppkey as node, min(l_shipdate::date - date '1970-01-01') as s, min(l_shipdate::date - date '1970-01-01') + 5 * (l_suppkey % 7) as e from lineitem group by l_suppkey)
select distinct a.node as a, b.node as b from o a join o b on a.way = b.way and a.node < b.node join r ra on ra.node = a.node join r rb on rb.node = b.node and ra.s < rb.e and rb.s < ra.e""")
def shared_way_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a part and whose first weeks overlap."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy(F.col("l_suppkey").alias("node")).agg(F.min(day_key("l_shipdate")).alias("start"))
    return graph.node_edges(lines.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("way_id")), first.withColumn("end", F.col("start") + 5 * (F.col("node") % 7)))


@query("""
with p as (select distinct l_partkey, l_suppkey from lineitem),
e as (select a.l_suppkey as a, b.l_suppkey as b from p a join p b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey group by 1, 2 having count(*) >= 2),
d as (select node, count(*) as degree from (select a as node from e union all select b from e) group by node),
i as (select degree, row_number() over (order by degree, node) - 1 as i, count(*) over () as n from d)
select min(degree) as least, max(degree) filter (where i = n // 2) as upper_median, max(degree) as most, cast(0 as bigint) as isolated from i""")
def degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_stats(graph.degrees(shared_key_edges(spark, sf_dir)))


# ------------------------------------------------------------- sequences
@query("""
with s as (select user_id, event_type, ts, lead(ts) over (partition by user_id order by ts, event_id) as until from events), a as (select max(f) as moment from (select min(ts) as f from events group by user_id))
select user_id, max(ts) as ts, arg_max(event_type, ts) as event_type from s, a where ts <= moment and moment <= until group by user_id""")
def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user last did when the last user first came; both ends of a segment count."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    at = events.groupBy("user_id").agg(F.min("ts").alias("first")).agg(F.max("first")).first()[0]
    segments = temporal.neighbours(events, ["user_id"], ["ts", "event_id"], "ts").select("user_id", "event_type", "ts", F.col("next").alias("until"))
    return temporal.state_at(segments, ["user_id"], "ts", "until", F.lit(at).cast("timestamp_ntz")).select("user_id", "event_type", "ts")


@query("""
with s as (select user_id, event_type, ts, event_id, lead(ts) over (partition by user_id order by ts, event_id) as until from events), a as (select max(f) as moment from (select min(ts) as f from events group by user_id))
select event_id, user_id from s, a where ts <= moment and (until is null or moment < until)""")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    at = events.groupBy("user_id").agg(F.min("ts").alias("first")).agg(F.max("first")).first()[0]
    segments = temporal.neighbours(events, ["user_id"], ["ts", "event_id"], "ts")
    return temporal.time_slice(segments, "ts", "next", F.lit(at).cast("timestamp_ntz")).select("event_id", "user_id")


MONTH_LO = "floor((year(d) + (dayofyear(date_trunc('month', d)) - 0.5) / (365 + case when year(d) % 4 = 0 and (year(d) % 100 <> 0 or year(d) % 400 = 0) then 1 else 0 end)) * 100000 + 0.5) / 100000"
MONTH_HI = MONTH_LO.replace("date_trunc('month', d)", "last_day(d)")


@query(f"""
with t as (select o_orderkey as k, o_orderdate::date as d, strftime(o_orderdate, '%Y-%m') as s, lead(o_orderkey) over w as nxt, lead(strftime(o_orderdate, '%Y-%m')) over w as ns,
                  lag(o_orderkey) over w as prv, lag(strftime(o_orderdate, '%Y-%m')) over w as ps from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
u as (select *, ({MONTH_LO} + {MONTH_HI}) / 2 as mid from t)
select k as o_orderkey, round(case when s = ps then mid end, 6) as eff_start, round(case when s = ns then mid end, 6) as eff_end from u""")
def midpoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one month in a row meet in the middle of the month."""
    rows = temporal.neighbours(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = rows.select("o_orderkey", "next", month.alias("text"), dates.decimal_earliest(month).alias("lo"), dates.decimal_latest(month).alias("hi"))
    out = temporal.split_shared_bounds(rows, "o_orderkey", "next", "text", "text", "lo", "hi")
    return out.select("o_orderkey", F.round("eff_start", 6).alias("eff_start"), F.round("eff_end", 6).alias("eff_end"))


@query("""
select event_id, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then event_type end as event_type
from events window w as (partition by user_id order by ts, event_id)""")
def only_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.only_changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


@query("""
with t as (select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as back from orders)
select o_custkey, cast(max(abs(o_orderkey - coalesce(before, 0))) as bigint) as widest, max(o_orderkey) filter (where back = 1) as last, true as same from t group by o_custkey""")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("keys"))
    coded = keys.select("o_custkey", "keys", codecs.deltas(F.col("keys")).alias("d")).withColumn("back", codecs.running_sums("d"))
    return coded.select("o_custkey", F.array_max(F.transform("d", F.abs)).alias("widest"), F.element_at("back", -1).alias("last"), (F.col("back") == F.col("keys")).alias("same"))


@query("""
with kv as (select event_id, event_type as value from events), c as (select value, count(*) as n, min(event_id) as seen from kv group by value having count(*) > 1)
select 'type' as key, value, row_number() over (order by n desc, seen, value) - 1 as index from c""")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("type"), "event_type").alias("tags"))
    return codecs.tag_tables(rows, "event_id", "tags")[0].select("key", "value", "index")


@query("""
with d as (select strftime(ts, '%Y-%m') as day, event_type as type, count(*) as n from events group by 1, 2)
select day, type, n, n / cast(first_value(n) over (partition by type order by day) as double) as share from d""")
def metric_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("day"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return relational.normalised(monthly, ["type"], "day", "n").select("day", "type", "n", "share")


# ------------------------------------------------------------- functions, a column each
@query("""
with t as (select o_orderkey as k, o_orderdate::date as d, year(o_orderdate) - 2000 - (o_orderkey % 5900) as y, month(o_orderdate) as m, cast(o_orderkey % 10001 as int) as p, cast(o_orderkey % 8027 - 6000 as int) as z from orders),
u as (select *, case when y < 0 then '-' || lpad(cast(-y as varchar), 4, '0') else lpad(cast(y as varchar), 4, '0') end as yt,
             (case when year(d) % 4 = 0 and (year(d) % 100 <> 0 or year(d) % 400 = 0) then 366 else 365 end) as days from t),
v as (select *, yt || '-' || lpad(cast(m as varchar), 2, '0') as mt from u)
select k, yt as year_text, mt as month_text, y * 12 + m - 1 as months, true as months_back, cast(y as bigint) as lenient, m as month_of,
       cast(floor((y + k % 300) / 10.0) - ceil(y / 10.0) + 1 as int) as decades, y * 10000 + m * 100 as sort_key,
       round(year(d) + (month(d) - 1) / 12.0 + (day(d) - 1) / 365.0, 6) as fractional, floor((year(d) + (dayofyear(d) - 0.5) / days) * 100000 + 0.5) / 100000 as decimal,
       strftime(last_day(d), '%Y-%m-%d') as padded, length(yt) <= 5 as is_text,
       cast(case when z <= -3000 then floor((z + 6000) / 3000.0 * 1000 + 0.5) when z <= -1000 then floor(1000 + (z + 3000) / 2000.0 * 1000 + 0.5) when z <= 0 then floor(2000 + (z + 1000) / 1000.0 * 1000 + 0.5)
            else floor(3000 + (1 - sqrt(1 - z / 2026.0)) * 7000 + 0.5) end as int) as slider,
       cast(case when p <= 1000 then floor(-6000 + p / 1000.0 * 3000 + 0.5) when p <= 2000 then floor(-3000 + (p - 1000) / 1000.0 * 2000 + 0.5) when p <= 3000 then floor(-1000 + (p - 2000) / 1000.0 * 1000 + 0.5)
            else floor((1 - pow(1 - (p - 3000) / 7000.0, 2)) * 2026 + 0.5) end as int) as slider_year,
       least(2026, greatest(-6000, z + 50)) as stepped, greatest(cast(floor((z - 200) / 100.0) * 100 as bigint), -6000) as window_lo, least(cast(ceil((z + 200) / 100.0) * 100 as bigint), 2026) as window_hi,
       case when y < -3000 then '-3000' when y > -100 then '-0100' else mt end as clamped, 366 = days as leap, day(last_day(d)) as month_days, dayofyear(d) as day_of_year
from v""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), (F.year(d) - 2000 - k % 5900).alias("y"), F.month(d).alias("m"), F.day(d).alias("day"), F.year(d).cast("bigint").alias("yd"), F.date_format(d, "yyyy-MM-dd").alias("full"), F.date_format(d, "yyyy-MM").alias("ym"),
        (k % 10001).cast("int").alias("p"), (k % 8027 - 6000).cast("int").alias("z"))
    rows = rows.withColumn("yt", dates.year_text(F.col("y"))).withColumn("mt", F.concat("yt", F.format_string("-%02d", F.col("m"))))
    mt, z = F.col("mt"), F.col("z")
    return rows.select(
        "k", F.col("yt").alias("year_text"), mt.alias("month_text"), dates.to_months(mt).alias("months"), (dates.from_months(dates.to_months(mt)) == mt).alias("months_back"), dates.lenient_year(mt).alias("lenient"), dates.month_of(mt).alias("month_of"),
        F.size(dates.decades(F.col("y"), F.col("y") + F.col("k") % 300)).alias("decades"), dates.date_key(dates.sort_key(mt)).alias("sort_key"),
        F.round(dates.fractional_year(dates.start_of(dates.parse_date(F.col("full")))), 6).alias("fractional"), dates.decimal_date(F.col("full")).alias("decimal"), dates.pad_date(F.col("ym"), end=True).alias("padded"),
        dates.is_date_text(mt).alias("is_text"), dates.year_to_slider(z).alias("slider"), dates.slider_to_year(F.col("p")).alias("slider_year"), view.step_year(z, F.lit(50)).alias("stepped"),
        view.local_window(z)["lo"].alias("window_lo"), view.local_window(z)["hi"].alias("window_hi"), view.clamped(mt, F.lit(-3000), F.lit(-100)).alias("clamped"),
        dates.is_leap(F.col("yd")).alias("leap"), dates.month_days(F.col("yd"), F.col("m")).alias("month_days"), dates.day_of_year(F.col("yd"), F.col("m"), F.col("day")).alias("day_of_year"))


@query("""
with t as (select c_custkey as k, c_name as n, c_mktsegment as s, n_name as nation, c_custkey || '-' || c_name as path from customer join nation on c_nationkey = n_nationkey)
select k, cast(k as varchar) as path_id, n as path_name, case lower(nation) when 'britain' then 'united kingdom' else lower(nation) end as country,
       '[' || (k % 4) || '] ' || n || ' ' as prefix, case k % 3 when 0 then 'https://www.openhistoricalmap.org/node/' || k when 1 then 'https://www.openhistoricalmap.org/way/' || k else 'https://www.openhistoricalmap.org/relation/' || k end as link,
       case k % 3 when 0 then 'https://en.wikipedia.org/wiki/en:' || n when 1 then 'https://www.openhistoricalmap.org/relation/' || n end as tag_link,
       '&lt;' || s || ' &amp; ' || n || '&gt;' as html, k % 2 = 0 as ranged, printf('%.4f', k / 7.0) || ' earth-yr; ' || n || ' (' || k || '–present)' as label, 2 as shown, 2 as kept
from t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = text.path_id(F.concat(k.cast("string"), F.lit("-"), n))
    kind = F.when(k % 3 == 0, "n/").when(k % 3 == 1, "w/").otherwise("r/")
    named = F.when(k % 2 == 0, F.concat(n, F.lit(" (1900-1950)"))).otherwise(F.concat(n, F.lit(" (19-50)")))
    tags = F.create_map(F.lit("name"), n, F.lit("name:en"), n, F.lit("name:de"), n, F.lit("start_date:x"), n)
    return rows.select(
        k.alias("k"), path["id"].alias("path_id"), path["name"].alias("path_name"), text.country_name(F.col("n_name")).alias("country"), text.level_prefix((k % 4).cast("string"), n).alias("prefix"),
        text.feature_link(F.concat(kind, k.cast("string"))).alias("link"),
        text.link_of(F.when(k % 3 == 0, "wikipedia").when(k % 3 == 1, "color:id").otherwise("name"), F.when(k % 3 == 0, F.concat(F.lit("en:"), n)).otherwise(n)).alias("tag_link"),
        text.escape_html(F.concat(F.lit("<"), F.col("c_mktsegment"), F.lit(" & "), n, F.lit(">"))).alias("html"), relational.date_range_in_name(named).alias("ranged"),
        text.earth_years_text(k / 7.0, n, k.cast("string"), F.lit(None).cast("string")).alias("label"),
        F.size(text.shown(F.create_map(F.lit("admin_level"), n, F.lit("start_date:x"), n, F.lit("building"), n))).alias("shown"), (F.size(relational.kept_tags(tags)) - 1).alias("kept"))


@query("""
with t as (select c_custkey as k, (c_custkey * 37 % 35999) / 100.0::double - 180 as lon, (c_custkey * 53 % 17999) / 100.0::double - 90 as lat, 1 + c_custkey % 9 as w, 1 + c_custkey % 5 as h from customer)
select k, cast(round_even(lon * (4000000.0::double / 360), 0) as int) as x, cast(round_even(lat * (2000000.0::double / 180), 0) as int) as y, cast(round_even(lon / 1e-5::double, 0) as bigint) as qlon,
       abs(round_even(lon * (4000000.0::double / 360), 0) / (4000000.0::double / 360) - lon) < 0.0001 as back, cast(2 * (w + h) as double) as perimeter, cast(-2 * w * h as double) as twice_area from t""")
def grid_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), ((k * 37 % 35999) / 100.0 - 180).alias("lon"), ((k * 53 % 17999) / 100.0 - 90).alias("lat"), (1.0 + k % 9).alias("w"), (1.0 + k % 5).alias("h"))
    at = codecs.quantize(F.col("lon"), F.col("lat"))
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    zero = F.lit(0.0)
    ring = F.array(corner(zero, zero), corner(zero, F.col("h")), corner(F.col("w"), F.col("h")), corner(F.col("w"), zero))
    return rows.select("k", at["x"].alias("x"), at["y"].alias("y"), codecs.snap(F.col("lon"), F.col("lat"))["qlon"].alias("qlon"), (F.abs(codecs.unquantize(at)["lon"] - F.col("lon")) < 0.0001).alias("back"),
                       F.round(geometry.perimeter(ring), 6).alias("perimeter"), F.round(geometry.shoelace(ring), 6).alias("twice_area"))


@query("""
select p_partkey, case p_partkey % 3 when 0 then p_name else p_name || ', Old' end as name, case when p_partkey % 3 <> 2 then p_size || ' - 1200' end as span,
       case p_partkey % 3 when 0 then 'Snefru, The Pharaoh 900 - 950' when 1 then 'Bela King 900 - 950' end as leader,
       case p_partkey % 3 when 1 then 'First House 900 - 1000' when 2 then p_brand || ' Dynasty 1 - 2' end as dynasty, case p_partkey % 3 when 1 then 'gained 910-920, tail' when 0 then 'herders' end as note from part""")
def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, span = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(" - 1200"))
    title = (F.when(k % 3 == 0, F.concat("p_name", F.lit("., "), span, F.lit(", herders, Snefru, The Pharaoh 900 - 950.")))
             .when(k % 3 == 1, F.concat("p_name", F.lit(", Old, "), span, F.lit(", gained 910-920, Bela King 900 - 950, First House 900 - 1000, Second House 1000 - 1100, tail,.")))
             .otherwise(F.concat("p_name", F.lit(", Old, "), "p_brand", F.lit(" Dynasty 1 - 2"))))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_title(title).alias("t")).select("p_partkey", "t.*")
