"""Graphs, chronologies and metrics over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eonmap.operators import graph
from eonmap.plans import features
from eonmap.plans.driver import query, table
from eonmap.sources import tables


@query("""
with recursive q as (select p_partkey % 157 as small, case when p_partkey % 3 > 0 then 200 + p_size % 23 else (p_partkey * 7) % 157 end as large, p_partkey as r from part
  union all select 200 + p_size % 23, 300 + p_partkey % 5, p_partkey from part where p_partkey % 50 = 0),
p as (select small, large, row_number() over (order by min(r), small, large) as i from q where small <> large group by 1, 2),
w(i, gone, homes) as (select 0::bigint, []::bigint[], []::bigint[] union all
  select w.i + 1, case when ok then list_append(gone, small) else gone end, case when ok then list_append(homes, large) else homes end
  from (select w.*, p.small, p.large, not list_contains(gone, small) and not list_contains(gone, large) as ok from w join p on p.i = w.i + 1) w)
select unnest(gone) as id, unnest(homes) as "into" from (select gone, homes from w order by i desc limit 1)""")
def containment_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that go into others, pair by pair in order: wholes with many parts, chains, and parts of equals."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    part = table(spark, sf_dir, "part")
    own = part.select((k % 157).alias("small"), F.when(k % 3 > 0, 200 + size % 23).otherwise((k * 7) % 157).alias("large"), k.alias("rank"))
    chains = part.where(k % 50 == 0).select((200 + size % 23).alias("small"), (300 + k % 5).alias("large"), k.alias("rank"))
    return graph.contained_into(own.unionByName(chains).where("small <> large"))


GRID = """
p as (select p_partkey as id, p_partkey % 800 as c, p_partkey // 800 as layer, 1000 + 100 * (p_partkey // 800) + 2 * (p_partkey % 20) as s, 1021 + 100 * (p_partkey // 800) + 2 * (p_partkey % 20) + 2 * (p_partkey % 15) as e from part),
n as (select *, c % 40 as x, c // 40 as y, case when c % 3 > 0 then 10000000 + c else id end as node from p)"""


@query(f"""
with recursive {GRID}, edges as (select distinct least(a.node, b.node) as a, greatest(a.node, b.node) as b from n a join n b on ((b.x = a.x + 1 and b.y = a.y) or (b.x = a.x and b.y = a.y + 1)) and a.s < b.e and b.s < a.e where a.node <> b.node),
both_ways as (select a as u, b as v from edges union all select b, a from edges),
o as (select node, row_number() over (order by count(v) desc, node) as i from (select distinct node from n) left join both_ways on u = node group by node),
before as (select o.i, list(p.i) filter (p.i < o.i) as earlier from o left join both_ways on u = o.node left join o p on p.node = v group by o.i),
w(i, c) as (select 0::bigint, []::bigint[] union all
  select w.i + 1, list_append(c, (list_filter(range(0, len(c) + 1), lambda k: not list_contains(list_transform(coalesce(earlier, []), lambda x: c[x]), k)))[1]) from w join before on before.i = w.i + 1)
select 'edge' as kind, a, b from edges union all select 'member', node, id from n
union all select 'colour', node, f.c[o.i] from o, (select c from w order by i desc limit 1) f""")
def map_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as states on a grid, each drawn by four ways that neighbours share; of most cells all are one chronology.

    Edges, members, and colours: the least free one, nodes with most neighbours first."""
    k = F.col("p_partkey")
    cell = k % 800
    x, y = cell % 40, F.floor(cell / 40)
    across = lambda x, y: (y * 100 + x) * 2 + 1
    up = lambda x, y: (y * 100 + x) * 2 + 2
    place = lambda x, y: y * 1000 + x
    grid = spark.range(41 * 21).select((F.col("id") % 41).alias("x"), F.floor(F.col("id") / 41).alias("y"))
    gx, gy = F.col("x"), F.col("y")
    none = F.create_map().cast(tables.TAGS).alias("tags")
    nodes = grid.select(place(gx, gy).alias("id"), (gx * 1.0).alias("lon"), (gy * 1.0).alias("lat"), none)
    ways = grid.where("x < 40").select(across(gx, gy).alias("id"), F.array(place(gx, gy), place(gx + 1, gy)).alias("refs"), none).unionByName(
        grid.where("y < 20").select(up(gx, gy).alias("id"), F.array(place(gx, gy), place(gx, gy + 1)).alias("refs"), none))
    start = 1000 + 100 * F.floor(k / 800) + 2 * (k % 20)
    tags = F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), F.lit("2"), F.lit("name"), F.col("p_name"), F.lit("start_date"), start.cast("string"), F.lit("end_date"), (start + 21 + 2 * (k % 15)).cast("string"))
    side = lambda way: F.struct(F.lit("w").alias("type"), way.alias("ref"), F.lit("outer").alias("role"))
    states = table(spark, sf_dir, "part").select(k.alias("id"), tags.alias("tags"), F.array(side(across(x, y)), side(up(x + 1, y)), side(across(x, y + 1)), side(up(x, y))).alias("members"))
    of_cell = states.where((F.col("id") % 800) % 3 > 0).groupBy((F.col("id") % 800).alias("cell")).agg(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.struct(F.lit("r").alias("type"), i.alias("ref"), F.lit("").alias("role"))).alias("members"))
    chronologies = of_cell.select((10_000_000 + F.col("cell")).alias("id"), F.create_map(F.lit("type"), F.lit("chronology")).alias("tags"), "members")
    out = features.connectivity(tables.materialise(states.unionByName(chronologies)), tables.materialise(tables.way_points(ways, nodes)))
    members = out["nodes"].select(F.lit("member").alias("kind"), F.col("node").alias("a"), F.explode("members").alias("b"))
    colours = out["colours"].select(F.lit("colour").alias("kind"), F.col("node").alias("a"), F.col("colour").cast("bigint").alias("b"))
    return out["edges"].select(F.lit("edge").alias("kind"), "a", "b").unionByName(members).unionByName(colours)


@query("""
select o_orderkey as id, o_custkey as chronology, c_name as name, lag(o_orderkey) over w as prev, lead(o_orderkey) over w as next
from orders join customer on o_custkey = c_custkey window w as (partition by o_custkey order by o_totalprice, o_orderkey)""")
def chronology_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as members of their customer's chronology, cheapest first: where each stands."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("os"))
    members = F.transform("os", lambda o: F.struct(F.lit("r").alias("type"), o["o_orderkey"].alias("ref"), F.lit("").alias("role")))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    relations = rows.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("type"), F.lit("chronology"), F.lit("name"), F.col("c_name")).alias("tags"), members.alias("members"))
    return features.chronology_entries(relations).select("id", F.explode("chronology").alias("e")).select("id", F.col("e.id").alias("chronology"), "e.name", "e.prev", "e.next")


@query("""
with p as (select p_partkey as id, case p_partkey % 4 when 0 then p_brand when 1 then '' else p_name end as name, case when p_partkey % 3 = 0 then p_name end as en from part)
select case id % 2 when 0 then 'r' else 'w' end as ftype, id, name, case when en <> name then en end as name_en from p where regexp_matches(name, '^(?:(Brand#1|.*e).*[0-9a-f])') or regexp_matches(en, '^(?:(Brand#1|.*e).*[0-9a-f])')""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found by a pattern on either name."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, "").otherwise(F.col("p_name"))
    tags = F.map_filter(F.create_map(F.lit("name"), name, F.lit("name:en"), F.when(k % 3 == 0, F.col("p_name"))), lambda _, v: v.isNotNull())
    return features.find_by_name(table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "r").otherwise("w").alias("ftype"), k.alias("id"), tags.alias("tags")), "(Brand#1|.*e).*[0-9a-f]")


@query("""
select c_custkey as id, c_name as name, 'de ' || c_name as de, c_mktsegment as xyz, 'import' as source, 5 as n from customer where c_custkey % 5 > 0""")
def import_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as features of an import: names by language get colons, a fixed tag comes, nameless ones go."""
    k = F.col("c_custkey")
    tags = F.create_map(F.lit("name"), F.when(k % 5 == 0, "").otherwise(F.col("c_name")), F.lit("name_de"), F.concat(F.lit("de "), "c_name"), F.lit("name_xyz"), F.col("c_mktsegment"), F.lit("other"), F.lit("1"))
    out = features.remap(table(spark, sf_dir, "customer").select(k.alias("id"), tags.alias("tags")), {"source": "import"})
    t = F.col("tags")
    return out.select("id", t["name"].alias("name"), t["name:de"].alias("de"), t["name_xyz"].alias("xyz"), t["source"].alias("source"), F.size("tags").alias("n"))


@query("""
with d as (select strftime(ts, '%Y-%m') as date, event_type as type, count(*) as count from events group by 1, 2),
l as (select type, row_number() over (order by arg_max(count, date) desc, type) as "order" from d group by type)
select date, type, count, count / cast(first_value(count) over (partition by type order by date) as double) as share, cast("order" as int) as "order" from d join l using (type)""")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a month by type, against the first month, the types with most in their last month first."""
    monthly = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("date"), F.col("event_type").alias("type")).agg(F.count("*").alias("count"))
    return features.series(monthly).select("date", "type", "count", "share", "order")
