"""Numbers and pairs at scale: row numbers without one task, pairs of a key's members in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eonmap.sources.tables import materialise

#: Members of a key that one task pairs with as many others.
BLOCK = 1000


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, … in the given order, which must tell all rows apart.

    Rows are dealt by ranges of the order and numbered inside; what stands before a range is a sum
    over the partitions, one row each.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").withColumn(name, number.cast("bigint")).drop("_part", "_before")


def key_pairs(members: DataFrame, key: str, node: str, block: int = BLOCK) -> DataFrame:
    """key, a, b (a < b): pairs of distinct members of each key.

    The members of a large key are cut into blocks, and a row joins by key and pair of blocks, so
    that no task pairs more than one block with another.
    """
    own = members.select(key, node).distinct()
    parts = own.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    own = own.join(parts, key).select(key, node, "_parts", F.pmod(F.xxhash64(node), F.col("_parts")).cast("int").alias("_at"))
    left = own.select(key, F.col(node).alias("_x"), F.col("_at").alias("_lo"), F.explode(F.sequence("_at", F.col("_parts") - 1)).alias("_hi"))
    right = own.select(key, F.col(node).alias("_y"), F.col("_at").alias("_hi"), F.explode(F.sequence(F.lit(0), "_at")).alias("_lo"))
    both = left.join(right, [key, "_lo", "_hi"]).where("_lo < _hi or _x < _y")
    return both.select(key, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def key_neighbours(members: DataFrame, key: Sequence[str], node: str, block: int = BLOCK) -> DataFrame:
    """key, a, bs: for each member of a key lists of those members that come after it; a pair of a key stands in one list.

    Lists hold a block of members at most, and a row joins one block, so that a large key is no single task. Lists are
    several times smaller than rows of pairs; dealt by ``a`` they hold all pairs of a node together.
    """
    own = members.select(*key, F.col(node).alias("a")).distinct()
    parts = own.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).where("_parts > 0")
    own = own.join(parts, list(key)).withColumn("_at", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int"))
    lists = own.groupBy(*key, "_at").agg(F.array_sort(F.collect_list("a")).alias("all"))
    each = own.select(*key, "a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_at"))
    found = each.join(lists, [*key, "_at"]).select(*key, "a", F.filter("all", lambda b: b > F.col("a")).alias("bs"))
    return found.where(F.size("bs") > 0)


def overlapping_neighbours(members: DataFrame, key: str, node: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """key, a, bs: for each range of a member of a key lists of the members with a later start (of equal ones a greater id) whose ranges overlap it.

    Ranges overlap if each starts before the other ends, also empty ones inside another. Members stand in bins of time by
    their start, and are sought in the bins of the earlier range; bins are as wide as ranges are on average, so that
    these are a few. A pair may come from both sides where members have several ranges.
    """
    own = members.select(key, F.col(node).alias("node"), F.col(start).alias("s"), F.col(end).alias("e")).where("s is not null and e is not null").distinct()
    last = own.agg(F.max("s")).first()[0]
    width = own.where("s < e").agg(F.avg(F.least(F.col("e"), F.lit(last) + 1) - F.col("s"))).first()[0] or 1
    bin_of = lambda c: F.floor(c / F.lit(max(float(width), 1.0))).cast("bigint")
    placed = own.withColumn("_bin", bin_of(F.col("s")))
    parts = placed.groupBy(key, "_bin").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    lists = placed.join(parts, [key, "_bin"]).withColumn("_at", F.pmod(F.xxhash64("node", "s"), F.col("_parts")).cast("int"))
    lists = lists.groupBy(key, "_bin", "_at").agg(F.collect_list(F.struct("s", "node", "e")).alias("all"))
    wide = own.where("s < e").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("s")), bin_of(F.least(F.col("e") - 1, F.lit(last))))))
    x = wide.join(lists, [key, "_bin"])
    later = lambda y: ((y["s"] > F.col("s")) | ((y["s"] == F.col("s")) & (y["node"] > F.col("node")))) & (y["s"] < F.col("e")) & (F.col("s") < y["e"]) & (y["node"] != F.col("node"))
    found = x.select(key, F.col("node").alias("a"), F.array_distinct(F.transform(F.filter("all", later), lambda y: y["node"])).alias("bs"))
    return found.where(F.size("bs") > 0)


def neighbour_counts(lists: DataFrame) -> DataFrame:
    """a, b, n: how often each pair stands in the lists (a, bs); all of a node's lists are counted in one place, without a row a pair moved."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.select("a", "bs").repartition(n, "a").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
