"""Tag filters, grouping, deduplication and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eonmap.operators.numbering import key_neighbours, neighbour_counts, numbered

# ------------------------------------------------------------- tags
#: Prefixes of keys that don't tell duplicates apart.
LOOSE_PREFIXES = ("wikipedia", "source", "fixme")


def has_any_key(tags: Column, keys: Sequence[str]) -> Column:
    """Whether any key is there, with whatever value."""
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in keys]))


def display_name(tags: Column) -> Column:
    """The English name, or the name, or ''; an empty text counts as missing."""
    return F.coalesce(F.nullif(tags["name:en"], F.lit("")), F.nullif(tags["name"], F.lit("")), F.lit(""))


def kept_tags(tags: Column) -> Column:
    """Tags without the names in other languages than English."""
    return F.map_filter(tags, lambda k, _: ~F.startswith(k, F.lit("name")) | k.isin("name", "name:en"))


def identity_tags(tags: Column) -> Column:
    """Sorted entries of the tags that tell features apart."""
    def keep(k: Column, _: Column) -> Column:
        out = ~F.startswith(k, F.lit(LOOSE_PREFIXES[0]))
        for p in LOOSE_PREFIXES[1:]:
            out = out & ~F.startswith(k, F.lit(p))
        return out

    return F.array_sort(F.map_entries(F.map_filter(tags, keep)))


def admin_boundary(tags: Column, levels: Sequence[str], extra: dict[str, Sequence[str]] | None = None) -> Column:
    """Administrative boundaries of some levels, with other keys of some values if asked for."""
    out = (tags["boundary"] == "administrative") & tags["admin_level"].isin(*levels)
    for k, values in (extra or {}).items():
        out = out & tags[k].isin(*values)
    return F.coalesce(out, F.lit(False))


def name_matches(tags: Column, pattern: str) -> Column:
    """Whether the name or the English name matches from its start."""
    at_start = f"^(?:{pattern})"
    return tags["name"].isNotNull() & (F.coalesce(tags["name"].rlike(at_start), F.lit(False)) | F.coalesce(tags["name:en"].rlike(at_start), F.lit(False)))


def date_range_in_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\(-?\d{3,}--?\d{3,}\)"), F.lit(False))


def split_members(members: Column, any_outer: bool = False) -> dict[str, Column]:
    """Member refs by part: outer and inner ways, and nodes. any_outer: every role but inner is outer."""
    way = F.filter(members, lambda m: m["type"] == "w")
    role = (lambda m: m["role"] != "inner") if any_outer else (lambda m: m["role"].isin("outer", ""))
    ref = lambda ms: F.transform(ms, lambda m: m["ref"])
    return {"outer": ref(F.filter(way, role)), "inner": ref(F.filter(way, lambda m: m["role"] == "inner")),
            "nodes": ref(F.filter(members, lambda m: m["type"] == "n"))}


# ------------------------------------------------------------- groups
def duplicates(rows: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """by, n, extra (n - 1) and ids (ascending) of the groups of two rows or more."""
    return (rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids"))
            .where("n >= 2").withColumn("extra", F.col("n") - 1))


def keepers(rows: DataFrame, by: Sequence[str], preferred: Column, id_col: str) -> DataFrame:
    """by, keeper, n: of each group a preferred row, of these the least id."""
    return rows.withColumn("_p", F.coalesce(preferred, F.lit(False))).groupBy(*by).agg(
        F.min_by(F.col(id_col), F.struct((~F.col("_p")).cast("int").alias("p"), F.col(id_col).alias("i"))).alias("keeper"), F.count("*").alias("n"))


def shared_key_edges(pairs: DataFrame, key: str, node: str, least: int = 1) -> DataFrame:
    """a, b, shared: nodes that share ``least`` keys or more, a < b."""
    return neighbour_counts(key_neighbours(pairs, [key], node)).withColumnRenamed("n", "shared").where(F.col("shared") >= least)


def value_counts(rows: DataFrame, value: str, pos: str | None = None) -> DataFrame:
    """value, n, rank: most frequent first, ties by first appearance (or by value)."""
    tie = F.min(pos) if pos else F.min(value)
    out = rows.groupBy(value).agg(F.count("*").alias("n"), tie.alias("_tie"))
    return numbered(out, [F.desc("n"), F.col("_tie")], "rank").drop("_tie")


# ------------------------------------------------------------- metrics
def to_wide(metrics: DataFrame, date: str, name: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A row a date and a column a metric, names in order; missing ones are null, the last value wins."""
    names = sorted(columns or [r[0] for r in metrics.select(name).distinct().collect()])  # a row a metric
    wide = metrics.groupBy(date).pivot(name, names).agg(F.last(value))
    return wide.select(date, *[F.col(f"`{n}`") for n in names])


def day_over_day(metrics: DataFrame, date: str, name: str, value: str) -> DataFrame:
    """Adds old, delta and pct (one digit; null if the old value is 0 or missing)."""
    w = Window.partitionBy(name).orderBy(date)
    out = metrics.withColumn("old", F.lag(value).over(w))
    out = out.withColumn("delta", F.col(value) - F.col("old"))
    return out.withColumn("pct", F.when(F.col("old") != 0, F.round(100.0 * F.col("delta") / F.col("old"), 1)))


def diff_line(name: Column, old: Column, new: Column) -> Column:
    """'name: old -> new (delta, pct)' of two metric texts; whole numbers stay whole."""
    whole = ~F.contains(old, F.lit(".")) & ~F.contains(new, F.lit("."))
    d = new.cast("double") - old.cast("double")
    delta = F.when(whole, F.format_string("%+d", d.cast("bigint"))).otherwise(F.format_string("%+f", d))
    pct = F.when(old.cast("double") == 0, "N/A").otherwise(F.format_string("%+.1f%%", 100 * d / F.nullif(old.cast("double"), F.lit(0.0))))
    return F.concat(name, F.lit(": "), old, F.lit(" -> "), new, F.lit(" ("), delta, F.lit(", "), pct, F.lit(")"))


def normalised(series: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds share: the value over the first value of its group."""
    first = F.first(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return series.withColumn("share", F.col(value) / F.nullif(first.cast("double"), F.lit(0.0)))


def full_totals(a: DataFrame, b: DataFrame, keys: Sequence[str], a_value: str, b_value: str) -> DataFrame:
    """Totals of two sets side by side; what is missing on one side is 0."""
    return a.join(b, list(keys), "full_outer").fillna(0, [a_value, b_value])
