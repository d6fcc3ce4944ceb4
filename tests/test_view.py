import json

from pyspark.sql import functions as F

from eonmap.plans import features, view
from eonmap.sources import tables


def test_selection(spark):
    rel = spark.createDataFrame([(1, "2", "1900", 3), (3, "4", "1950", 9), (5, "2", None, None)], "id long, admin_level string, start_date string, next long")
    assert [r["id"] for r in view.selected(spark, rel, [5, 8, 1]).collect()] == [5, 1]
    assert [r[0] for r in view.levels_of(rel, [1, 3, 5]).collect()] == ["2", "4"]
    assert [tuple(r) for r in view.successor(rel).collect()] == [(1, 3, "1950")]
    merged = view.merged_levels([rel.select("id", "admin_level"), spark.createDataFrame([(1, "6")], "id long, admin_level string")])
    assert {r["id"]: r["admin_level"] for r in merged.collect()} == {1: "6", 3: "4", 5: "2"}


def test_time_control(spark):
    one = spark.createDataFrame([(1750, "1850-06", 1500, 1700)], "y int, d string, lo int, hi int")
    got = one.select(view.step_year(F.lit(2026), 1), view.widened(F.col("lo"), F.col("hi"), F.col("y")), view.clamped(F.col("d"), F.col("lo"), F.col("hi")), view.local_window(F.col("y")),
                     view.slider_value(F.col("d"), F.lit(1840), F.lit(1860)), view.slider_value(F.col("d"), F.lit(1500), F.lit(1860))).first()
    assert got[0] == 2026 and tuple(got[1]) == (1500, 1750) and got[2] == "1700" and tuple(got[3]) == (1500, 2000) and got[4] == 1850 * 12 + 5 and got[5] == 1850
    kinds = spark.createDataFrame([([1], [2]), ([], [2]), ([], [])], "w array<int>, p array<int>").select(view.shape_of(F.col("w"), F.col("p"))).collect()
    assert [k[0] for k in kinds] == ["polygon", "point", None]


def test_geojson(spark, tmp_path):
    box = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [box]}},
        {"type": "Feature", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[box], [box]]}}]}, indent=1))
    rows = tables.geojson_features(spark, f"file://{tmp_path}/a.json", "struct<name:string>")
    out = features.measured(rows.select("properties.name", view.polygons(F.col("geometry_type"), F.col("coordinates")).alias("geom"))).collect()
    assert {r["name"]: len(r["geom"]) for r in out} == {"A": 1, "B": 2} and all(r["km2"] > 12_000 for r in out)
