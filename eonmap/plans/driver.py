"""The operators bound to the driver's tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eonmap.functions import codecs, dates, geometry, text
from eonmap.operators import graph, relational, temporal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL if there is any."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day_key(c: str) -> Column:
    return F.unix_date(F.col(c).cast("date")).cast("bigint")


@query("""
with t as (select o_orderkey, case o_orderkey % 3 when 0 then substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)
                  when 1 then substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 7) else strftime(o_orderdate, '%Y-%m-%d') end as s, o_orderdate as d from orders)
select o_orderkey, s as text,
       case o_orderkey % 3 when 0 then year(d) * 10000 + 101 when 1 then year(d) * 10000 + month(d) * 100 + 1 else year(d) * 10000 + month(d) * 100 + day(d) end as first_key,
       case o_orderkey % 3 when 0 then year(d) * 10000 + 1231 when 1 then year(d) * 10000 + month(d) * 100 + day(last_day(d)) else year(d) * 10000 + month(d) * 100 + day(d) end as last_key
from t""")
def partial_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.date_format("o_orderdate", "yyyy-MM-dd")
    short = F.when(F.col("o_orderkey") % 3 == 0, F.substring(s, 1, 4)).when(F.col("o_orderkey") % 3 == 1, F.substring(s, 1, 7)).otherwise(s)
    d = dates.parse_date(F.col("text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", short.alias("text")).select(
        "o_orderkey", "text", dates.date_key(dates.start_of(d)).alias("first_key"), dates.date_key(dates.end_of(d)).alias("last_key"))


@query("""
with t as (select o_orderkey, o_orderdate::date as a, (o_orderdate::date + (o_orderkey % 400)::int) as b from orders)
select o_orderkey, round(case when o_orderkey % 11 = 0 then -1 else
  (year(b) + (month(b) - 1) / 12.0 + (day(b) - 1) / 365.0) - (year(a) + (month(a) - 1) / 12.0 + (day(a) - 1) / 365.0) end, 6) as years from t""")
def range_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 11 != 0, F.date_format(F.date_add(a, (F.col("o_orderkey") % 400).cast("int")), "yyyy-MM-dd"))
    years = dates.duration_years(dates.date_range(F.date_format(a, "yyyy-MM-dd"), end))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.when(years == float("inf"), -1.0).otherwise(years), 6).alias("years"))


def order_ranges(spark: SparkSession, sf_dir: str, days: int = 60) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day_key("o_orderdate").alias("start"), (day_key("o_orderdate") + days).alias("end"))


@query("""
with t as (select o_custkey, o_orderkey, o_orderdate::date - date '1970-01-01' as s from orders)
select a.o_custkey, a.o_orderkey as a, b.o_orderkey as b, cast(a.s as bigint) as a_start, cast(b.s as bigint) as b_start
from t a join t b on a.o_custkey = b.o_custkey and b.s < a.s + 60 and (b.s > a.s or (b.s = a.s and b.o_orderkey > a.o_orderkey))""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.overlap_pairs(order_ranges(spark, sf_dir), ["o_custkey"], "o_orderkey", "start", "end", 60)
    return out.select("o_custkey", "a", "b", F.col("sa").alias("a_start"), F.col("sb").alias("b_start"))


@query("""
select o_orderkey, lag(o_orderkey) over w as prev, lead(o_orderkey) over w as next
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def chrono_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.neighbours(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    return out.select("o_orderkey", "prev", "next")


@query("""
with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_shipdate::date - date '1970-01-01') as d, (o_orderdate::date - date '1970-01-01') as o
           from lineitem join orders on l_orderkey = o_orderkey),
bad as (select * from t where d < o or d + 1 > o + 365),
one as (select l_orderkey, min({'l': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'd': d}) as m from bad group by l_orderkey)
select l_orderkey, m.l as l_linenumber, cast(m.d as bigint) as ship_day from one""")
def member_outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), day_key("l_shipdate").alias("ms"), (day_key("l_shipdate") + 1).alias("me"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), day_key("o_orderdate").alias("ps"), (day_key("o_orderdate") + 365).alias("pe"))
    out = temporal.outside_parent(lines, orders, "key", "pos", "ms", "me", "ps", "pe")
    return out.select(F.col("key").alias("l_orderkey"), F.col("pos.l_linenumber").alias("l_linenumber"), F.col("ms").alias("ship_day"))


@query("""
select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey
  and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-07-01')""")
def undated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1995-07-01'")
    return temporal.undated_members(table(spark, sf_dir, "customer").select("c_custkey"), dated.select(F.col("o_custkey").alias("c_custkey")), None, ["c_custkey"])


@query("""
select lang, min(doc_id) as first_id, max(doc_id) as last_id, count(*) as n, count(*) - 1 as extra from documents group by text, lang having count(*) >= 2""")
def exact_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.duplicates(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id")
    return out.select("lang", F.col("ids")[0].alias("first_id"), F.element_at("ids", -1).alias("last_id"), "n", "extra")


@query("""
with d as (select d.doc_id, d.text, l.doc_id is not null as labelled from documents d left join (select distinct doc_id from labels) l using (doc_id))
select coalesce(min(doc_id) filter (where labelled), min(doc_id)) as keeper, count(*) as n from d group by text""")
def keeper_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labelled, "doc_id", "left")
    return relational.keepers(docs, ["text"], F.col("labelled"), "doc_id").select("keeper", "n")


@query("""
with p as (select distinct l_partkey, l_suppkey from lineitem)
select a.l_suppkey as a, b.l_suppkey as b, count(*) as shared from p a join p b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey
group by 1, 2 having count(*) >= 2""")
def shared_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.shared_key_edges(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", 2)


@query("""
with p as (select distinct l_partkey, l_suppkey from lineitem),
e as (select a.l_suppkey as a, b.l_suppkey as b from p a join p b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey group by 1, 2 having count(*) >= 2),
d as (select node, count(*) as degree from (select a as node from e union all select b from e) group by node)
select degree, count(*) as nodes from d group by degree""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(shared_key_edges(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query("""
with t as (select o_orderkey, year(o_orderdate) - (o_orderkey % 300)::int as lo, year(o_orderdate) as hi from orders),
x as (select o_orderkey, unnest(range(cast(ceil(lo / 10.0) * 10 as int), hi + 1, 10)) as decade from t)
select cast(decade as bigint) as decade, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from x group by 1""")
def decade_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    rows = temporal.expand_decades(table(spark, sf_dir, "orders"), y - F.col("o_orderkey") % 300, y)
    return rows.groupBy("decade").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""
with m as (select *, case when event_type is not distinct from lag(event_type) over w then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts, event_id) as run from m)
select user_id, cast(run as bigint) as run, event_type, count(*) as n, min(ts) as first, max(ts) as last from r group by user_id, run, event_type""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query("""
select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id
  rows between unbounded preceding and current row) as value from events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return temporal.fill_forward(rows, ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "value")


@query("""
select strftime(ts, '%Y-%m-%d') as day, event_type as type, count(*) as n,
       count(*) - lag(count(*)) over (partition by event_type order by strftime(ts, '%Y-%m-%d')) as delta,
       round(100.0 * (count(*) - lag(count(*)) over (partition by event_type order by strftime(ts, '%Y-%m-%d'))) / lag(count(*)) over (partition by event_type order by strftime(ts, '%Y-%m-%d')), 1) as pct
from events group by 1, 2""")
def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return relational.day_over_day(daily, "day", "type", "n").select("day", "type", "n", "delta", "pct")


@query("""
select strftime(ts, '%Y-%m-%d') as day, nullif(count(*) filter (where event_type = 'click'), 0) as click, nullif(count(*) filter (where event_type = 'purchase'), 0) as purchase,
       nullif(count(*) filter (where event_type = 'view'), 0) as view from events group by 1 having count(*) filter (where event_type in ('click', 'purchase', 'view')) > 0""")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "view"))
    daily = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    return relational.to_wide(daily, "day", "type", "n", ["click", "purchase", "view"])


#: Five eras of order years.
ERAS = [(1900, 1993), (1993, 1995), (1995, 1996), (1996, 1998), (1998, 2100)]


@query("""
with eras(lo, hi) as (values (1900, 1993), (1993, 1995), (1995, 1996), (1996, 1998), (1998, 2100)),
o as (select r_name, year(o_orderdate) as y, year(o_orderdate) + 1 + (o_orderkey % 3) as z, o_orderkey % 2 as side
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
t as (select r_name, lo, side, sum(least(z, hi) - greatest(y, lo)) as shared from o join eras on y < hi and lo < z group by 1, 2, 3)
select r_name, lo as era, cast(coalesce(sum(shared) filter (where side = 0), 0) as bigint) as even_years, cast(coalesce(sum(shared) filter (where side = 1), 0) as bigint) as odd_years from t group by 1, 2""")
def region_era_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    eras = spark.createDataFrame(ERAS, "lo int, hi int")
    y = F.year("o_orderdate")
    rows = (table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    rows = rows.select("r_name", y.alias("s"), (y + 1 + F.col("o_orderkey") % 3).alias("e"), (F.col("o_orderkey") % 2).alias("side"))
    shared = temporal.range_join(rows, eras, "s", "e", "lo", "hi")
    even = shared.where("side = 0").groupBy("r_name", F.col("lo").alias("era")).agg(F.sum("shared").alias("even_years"))
    odd = shared.where("side = 1").groupBy("r_name", F.col("lo").alias("era")).agg(F.sum("shared").alias("odd_years"))
    return relational.full_totals(even, odd, ["r_name", "era"], "even_years", "odd_years")


@query("""
with t as (select o_custkey, o_orderdate::date - date '1970-01-01' as s, o_orderdate::date - date '1970-01-01' + 60 as e from orders),
m as (select *, max(e) over (partition by o_custkey order by s, e rows between unbounded preceding and 1 preceding) as top from t),
g as (select *, sum(case when top is null or s > top then 1 else 0 end) over (partition by o_custkey order by s, e rows unbounded preceding) as island from m),
i as (select o_custkey, island, min(s) as s, max(e) as e from g group by 1, 2)
select o_custkey, cast(sum(e - s) as bigint) as covered, cast(max(e) - min(s) - sum(e - s) as bigint) as uncovered from i group by o_custkey""")
def gap_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = order_ranges(spark, sf_dir)
    whole = ranges.groupBy("o_custkey").agg((F.max("end") - F.min("start")).alias("whole"))
    out = temporal.covered_length(ranges, ["o_custkey"], "start", "end").join(whole, "o_custkey")
    return out.select("o_custkey", "covered", (F.col("whole") - F.col("covered")).alias("uncovered"))


@query("select p_partkey, p_name from part where regexp_matches(p_name, '^(?:small|red .*t$|blue)')")
def name_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("tags", F.create_map(F.lit("name"), "p_name"))
    return rows.where(relational.name_matches(F.col("tags"), "small|red .*t$|blue")).select("p_partkey", "p_name")


@query("""
with kv as (select event_id, k as key, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events))
select key, value, n, row_number() over (order by n desc, first_id) as rank from (select key, value, count(*) as n, min(event_id) as first_id from kv group by 1, 2)""")
def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    out = relational.value_counts(rows.withColumn("pair", F.struct("key", "value")), "pair", "event_id")
    return out.select("pair.key", "pair.value", "n", "rank")


@query("""
select l_orderkey, count(*) as n, cast(sum(case when l_linenumber % 2 = 0 then -l_partkey else l_partkey end) as bigint) as total, true as same from lineitem group by l_orderkey""")
def ring_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    rings = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", signed.alias("v")))).alias("r")).select("l_orderkey", F.col("r.v").alias("ring"))
    back = rings.withColumn("back", codecs.varint_to_ring(codecs.ring_to_varint("ring")))
    total = F.aggregate("back", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select("l_orderkey", F.size("back").cast("bigint").alias("n"), total.alias("total"), (F.col("back") == F.col("ring")).alias("same"))


@query("""
select p_partkey, cast(2 * (1 + p_partkey % 7) * (1 + p_partkey % 5) as double) as twice_area,
       cast(1 + p_partkey % 7 as double) as width from part""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = 1.0 + F.col("p_partkey") % 7, 1.0 + F.col("p_partkey") % 5
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    ring = F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h))
    return table(spark, sf_dir, "part").select("p_partkey", geometry.shoelace(ring).alias("twice_area"), F.round(w, 3).alias("width"))


@query("""
select o_orderstatus, o_orderkey, rank from (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderdate, o_orderkey) as rank from orders) where rank <= 10""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.first_k(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], 10).select("o_orderstatus", "o_orderkey", "rank")


@query("select doc_id, trim(split_part(text, ',', 1)) as base from documents")
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.base_name(F.col("text")).alias("base"))
