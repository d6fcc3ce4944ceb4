"""What the viewer asks of its tables: selections, point features, and bounds of the time control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eonmap.functions import dates

#: The time control's limits and first range, half its local window, and the span of
#: years up to which it counts months.
FIRST_YEAR, LAST_YEAR, START_RANGE, HALF_WINDOW, MONTH_SPAN = -6000, 2026, (1500, 1900), 200, 20


def merged_levels(levels: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Rows of several levels; of equal keys the later level's row stays."""
    out = None
    for n, df in enumerate(levels):
        one = df.withColumn("_level", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_level")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_level").alias("_r")).select(key, "_r.*")


def selected(spark: SparkSession, relations: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Relations of a list of ids in its order; unknown ids are left out."""
    wanted = spark.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "pos int, id bigint")
    return relations.join(wanted, "id").orderBy("pos").drop("pos")


def levels_of(relations: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The distinct levels of selected relations, for a view that names none."""
    return relations.where(F.col("id").isin(*ids)).select("admin_level").distinct().orderBy("admin_level")


def successor(relations: DataFrame, id_col: str = "id") -> DataFrame:
    """id, to, date: where a step along the chronology leads, and the date it then shows."""
    after = relations.select(F.col(id_col).alias("to"), F.col("start_date").alias("date"))
    return relations.select(F.col(id_col).alias("id"), "next").join(after, F.col("next") == F.col("to")).select("id", "to", "date")


def shape_of(ways: Column, points: Column) -> Column:
    """Kind of a relation's shape: points stand in only where it has no ways."""
    return F.when(F.size(ways) > 0, "polygon").when(F.size(points) > 0, "point")


def step_year(year: Column, step: int) -> Column:
    """A year on or back within the limits."""
    return F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), year + step))


def widened(lo: Column, hi: Column, year: Column) -> Column:
    """struct(lo, hi): a range that takes in a year outside it."""
    return F.struct(F.least(lo, year).alias("lo"), F.greatest(hi, year).alias("hi"))


def clamped(date: Column, lo: Column, hi: Column) -> Column:
    """A date text pulled into a range of years."""
    y = dates.year_of(date)
    return F.when(y < lo, dates.year_text(lo)).when(y > hi, dates.year_text(hi)).otherwise(date)


def local_window(year: Column) -> Column:
    """struct(lo, hi): whole centuries around a year, within the limits."""
    lo, hi = F.floor((year - HALF_WINDOW) / 100) * 100, F.ceil((year + HALF_WINDOW) / 100) * 100
    return F.struct(F.greatest(lo, F.lit(FIRST_YEAR)).alias("lo"), F.least(hi, F.lit(LAST_YEAR)).alias("hi"))


def slider_value(date: Column, lo: Column, hi: Column) -> Column:
    """Years of a date, or months where the range is short."""
    return F.when(hi - lo <= MONTH_SPAN, dates.to_months(date)).otherwise(dates.year_of(date))


def polygons(kind: Column, coordinates: Column) -> Column:
    """Polygons or multipolygons of GeoJSON text as a geometry, rings without their closing point."""
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    whole = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one)
    ring = lambda r: F.transform(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.transform(whole, lambda p: F.transform(p, ring))
