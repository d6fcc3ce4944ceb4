"""Joins and sequence operators over dated rows.

Starts and ends are BIGINT keys of half-open ranges; see ``functions.dates``. Interval joins are
equi-joins on a bin of the later start, so that each pair meets once and Spark can hash it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a list that is broadcast.
FEW = 10_000


def _bin(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def overlap_pairs(rows: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of rows of equal keys whose ranges overlap: keys, a, b (the ids, the earlier start first).

    Of an overlapping pair the later start lies in the other's range. So one side is laid out over
    the bins of its range, the other stands in the bin of its start. ``width``: of a bin; about the
    usual length of a range. Ranges are cut at the last start of their keys, which bounds open ends.
    """
    last = rows.groupBy(*keys).agg(F.max(start).alias("_last"), F.min(start).alias("_first"))
    left = rows.join(last, list(keys)).where(F.col(start) < F.col(end)).select(
        *keys, F.col(id_col).alias("a"), F.col(start).alias("sa"), F.col(end).alias("ea"),
        F.explode(F.sequence(_bin(F.greatest(start, "_first"), width), _bin(F.least(F.col(end) - 1, F.greatest("_last", F.col(start))), width))).alias("_bin"))
    right = rows.where(F.col(start) < F.col(end)).select(*keys, F.col(id_col).alias("b"), F.col(start).alias("sb"), F.col(end).alias("eb"), _bin(F.col(start), width).alias("_bin"))
    both = left.join(right, [*keys, "_bin"])
    later = (F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("b") > F.col("a")))
    return both.where(later & (F.col("sb") < F.col("ea"))).select(*keys, "a", "b", "sa", "ea", "sb", "eb")


def range_join(a: DataFrame, b: DataFrame, a_start: str, a_end: str, b_start: str, b_end: str) -> DataFrame:
    """Rows of two tables whose half-open ranges overlap, and ``shared``, the length of the overlap.

    A list ``b`` of ``FEW`` rows or fewer, such as eras, is sent to all executors. A longer one meets
    ``a`` in bins of the whole time, a thousand of them; a pair comes from the bin of the later start.
    """
    shared = F.least(F.col(a_end), F.col(b_end)) - F.greatest(F.col(a_start), F.col(b_start))
    meet = (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end))
    if b.limit(FEW + 1).count() <= FEW:
        return a.join(F.broadcast(b), meet).withColumn("shared", shared)
    lo, hi = b.agg(F.min(b_start).cast("double"), F.max(b_end).cast("double")).first()
    bin_of = lambda c: F.floor((F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) - lo) * 1000 / max(hi - lo, 1e-9)).cast("int")
    laid = lambda df, s, e: df.where(F.col(s) < F.col(e)).withColumn("_bin", F.explode(F.sequence(bin_of(s), bin_of(e))))
    both = laid(a, a_start, a_end).join(laid(b, b_start, b_end), "_bin").where(meet & (F.col("_bin") == F.greatest(bin_of(a_start), bin_of(b_start))))
    return both.drop("_bin").withColumn("shared", shared)


def outside_parent(members: DataFrame, parents: DataFrame, key: str, pos: str, m_start: str, m_end: str, p_start: str, p_end: str) -> DataFrame:
    """The first member, by ``pos``, of each parent that starts before it or ends after it."""
    bad = members.join(parents, key).where((F.col(m_start) < F.col(p_start)) | (F.col(m_end) > F.col(p_end)))
    rest = [c for c in bad.columns if c != key]
    return bad.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_m")).select(key, "_m.*")


def undated_members(members: DataFrame, dated: DataFrame, invalid: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Members without a date; those whose date is invalid are left out before."""
    rest = members.join(invalid, list(key), "left_anti") if invalid is not None else members
    return rest.join(dated, list(key), "left_anti")


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds prev and next: ``value`` of the rows before and after."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("prev", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """Run-length segments: by, run, values, n, and the first and last of the first order column.

    A run ends where a value changes, or where ``ordinal`` (the number of the listing) jumps.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    state = F.struct(*values)
    change = ~state.eqNullSafe(F.lag(state).over(w))
    if ordinal:
        change = change | (F.col(ordinal) != F.lag(ordinal).over(w) + 1)
    marked = rows.withColumn("_new", F.coalesce(change, F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy(*by, "run", *values).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def only_changes(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Nulls each value that is the same as in the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({v: F.when(~F.col(v).eqNullSafe(F.lag(v).over(w)) | (F.row_number().over(w) == 1), F.col(v)) for v in values})


def fill_forward(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Replaces nulls by the last value before: the inverse of ``only_changes``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def state_at(segments: DataFrame, by: Sequence[str], start: str, end: str, at: Column) -> DataFrame:
    """The last segment of each group that covers ``at``, both ends included."""
    alive = segments.where((F.col(start) <= at) & (at <= F.col(end)))
    rest = [c for c in segments.columns if c not in by]
    return alive.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(start)).alias("_s")).select(*by, "_s.*")


def time_slice(rows: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    """Rows that exist at a time; a missing bound is open."""
    return rows.where((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at < F.col(end))))


def split_shared_bounds(rows: DataFrame, id_col: str, next_col: str, start_text: str, end_text: str, earliest: str, latest: str) -> DataFrame:
    """Adds eff_start and eff_end: where a row's end text is its successor's start text, both move to
    the middle between the earliest and latest reading of that text."""
    after = rows.select(F.col(id_col).alias("_n"), F.col(start_text).alias("_ns")).dropDuplicates(["_n"])
    linked = rows.join(after, F.col(next_col) == F.col("_n"), "left")
    hit = F.col(end_text).isNotNull() & (F.col(end_text) == F.col("_ns"))
    middle = (F.col(earliest) + F.col(latest)) / 2
    linked = linked.withColumn("eff_end", F.when(hit, middle)).withColumn("_to", F.when(hit, F.col("_n")))
    moved = linked.where("_to is not null").groupBy("_to").agg(F.max_by(F.col("eff_end"), F.col(id_col)).alias("eff_start"))
    return linked.drop("_n", "_ns", "_to").join(moved.withColumnRenamed("_to", "_t"), F.col(id_col) == F.col("_t"), "left").drop("_t")


def elementary(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """by, lo, hi: the pieces into which all bounds of a group cut its time, where a row is alive.

    Row counts grow with the number of bounds, not of pairs: starts add one and ends take one away.
    """
    marks = rows.where(F.col(start) < F.col(end)).select(*by, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("_m"))
    marks = marks.groupBy(*by, F.col("_m.at").alias("lo")).agg(F.sum("_m.d").alias("_d"))
    w = Window.partitionBy(*by).orderBy("lo")
    out = marks.withColumn("hi", F.lead("lo").over(w)).withColumn("alive", F.sum("_d").over(w))
    return out.where("alive > 0").select(*by, "lo", "hi", "alive")


def islands(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """by, lo, hi: the union of the ranges of each group as ranges that don't touch."""
    w = Window.partitionBy(*by).orderBy("lo")
    pieces = elementary(rows, by, start, end).withColumn("_new", F.when(F.col("lo") == F.lag("hi").over(w), 0).otherwise(1))
    return pieces.withColumn("_island", F.sum("_new").over(w)).groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def covered_length(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """by, covered: length of the union of the ranges of each group."""
    return elementary(rows, by, start, end).groupBy(*by).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))


def first_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_decades(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """A row for each decade from ``lo`` to ``hi``, both included."""
    from eonmap.functions import dates

    return rows.withColumn("decade", F.explode(dates.decades(lo, hi)))
