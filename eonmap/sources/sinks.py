"""Writers: summaries, examples, JSON, tables and the difference of days."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eonmap.operators import relational

#: Examples that are all written, that a sample has, and that a ranked list has; the seed.
FEW, SAMPLE, RANKED, SEED = 5000, 1000, 2500, 2026


def summary(counters: DataFrame, examples: DataFrame) -> DataFrame:
    """type, count: counters by name, then numbers of examples of types without a counter."""
    n = examples.groupBy("type").agg(F.count("*").cast("double").alias("count")).join(counters.select("type"), "type", "left_anti")
    both = counters.select("type", F.col("count").cast("double").alias("count"), F.lit(0).alias("_part")).unionByName(n.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", "type").drop("_part")


def example_lines(examples: DataFrame) -> DataFrame:
    """type, line: 'n/1: text'."""
    return examples.select("type", F.concat("ftype", F.lit("/"), F.col("fid").cast("string"), F.lit(": "), "text").alias("line"))


def sampled(examples: DataFrame, ranked: bool = False, rank: str | None = None) -> DataFrame:
    """All examples of a type with few, else a sample: the first of the ranking, or those with the least hashes."""
    n = examples.groupBy("type").agg(F.count("*").alias("_n"))
    order = F.desc(rank) if ranked and rank else F.xxhash64("ftype", "fid", "text", F.lit(SEED))
    most = RANKED if ranked else SAMPLE
    # the first of each of many shares of a type, and the first of those
    out = examples.join(F.broadcast(n), "type").withColumn("_s", F.pmod(F.xxhash64("ftype", "fid", "text"), F.lit(64)))
    for by in (["type", "_s"], ["type"]):
        w = Window.partitionBy(*by).orderBy(order, "ftype", "fid", "text")
        out = out.withColumn("_i", F.row_number().over(w)).where((F.col("_n") < FEW) | (F.col("_i") <= most))
    return out.drop("_n", "_i", "_s")


def same_sample(by_type: dict[str, list]) -> dict[str, list]:
    """Samples of sorted lists by one seeded generator, types in order: for lists that the driver holds."""
    rng = random.Random(SEED)
    return {t: sorted(xs) if len(xs) < FEW else rng.sample(sorted(xs), SAMPLE) for t, xs in sorted(by_type.items())}


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """One file with a header, for results that a person reads."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path, sep=sep)


def decade_table(coverage: DataFrame, levels: tuple[str, ...] = ("2", "4")) -> DataFrame:
    """year and a column of whole km² for each level."""
    wide = coverage.groupBy(F.col("decade").alias("year")).pivot("level", list(levels)).agg(F.first("km2"))
    return wide.select("year", *[F.format_string("%.0f", F.coalesce(F.col(lv), F.lit(0.0))).alias(f"admin{lv}_km2") for lv in levels]).orderBy("year")


def _covered(uncovered: Column, total: Column) -> Column:
    return F.when(total != 0, F.format_string("%.1f", 100 * (1 - uncovered / total))).otherwise("0.0").alias("coverage_pct")


def gap_by_feature(gap: DataFrame) -> DataFrame:
    """The gap report's rows (``coverage_gap`` with start_date and end_date) as text, the largest gap first."""
    rows = gap.orderBy(F.desc("uncovered"), "id")
    return rows.select("whmid", "name", "start_date", "end_date", F.format_string("%.6f", "earth_years").alias("total_ey"), F.format_string("%.6f", "uncovered").alias("uncovered_ey"), _covered(F.col("uncovered"), F.col("earth_years")))


def gap_by_chronology(totals: DataFrame) -> DataFrame:
    """The report's chronologies (``plans.features.gap_by_chronology``) as text, the largest gap first."""
    rows = totals.orderBy(F.desc("uncovered"), "key")
    return rows.select(F.col("key").alias("whmid"), F.col("name").alias("base_name"), F.col("n").alias("n_segments"), F.format_string("%.6f", "earth_years").alias("total_ey"),
                       F.format_string("%.6f", "uncovered").alias("uncovered_ey"), _covered(F.col("uncovered"), F.col("earth_years")))


def region_table(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """region, era, ours, theirs: totals of both sides, rows with any."""
    return relational.full_totals(ours.withColumnRenamed("earth_years", "ours"), theirs.withColumnRenamed("earth_years", "theirs"), ["region", "era"], "ours", "theirs").where("ours > 0 or theirs > 0").orderBy("region", "era")


def difference(metrics: DataFrame, date: str, name: str, value: str) -> DataFrame:
    """line: what changed on the last day, by the size of the change in percent."""
    days = relational.day_over_day(metrics, date, name, value)
    last = days.agg(F.max(date).alias("_d"))
    rows = days.join(last, F.col(date) == F.col("_d")).where(F.col("old").isNotNull() & (F.col("delta") != 0))
    lines = rows.select(F.abs("pct").alias("_p"), relational.diff_line(F.col(name), F.col("old").cast("string"), F.col(value).cast("string")).alias("line"))
    return lines.orderBy("_p", "line").select("line")


def geojson(rows: DataFrame) -> DataFrame:
    """A GeoJSON feature a row of (tags, geom), with rings closed."""
    closed = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda x: F.array(x["x"], x["y"]))))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), closed.alias("coordinates")).alias("geometry"), F.col("tags").alias("properties"))).alias("value"))
