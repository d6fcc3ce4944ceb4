"""Equal shapes are worked out once, and copies of a shape are no pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eonmap.operators import temporal
from eonmap.plans import atlas
from eonmap.plans import features as Q
from eonmap.sources import tables


def box(x, y, w=1.0, h=1.0):
    return [[[(float(x), float(y)), (x + w, float(y)), (x + w, y + h), (float(x), y + h)]]]


def areas(spark, rows):
    """(id, level, lo, hi, geom) as measured rows."""
    made = [("r", i, level, float(lo), float(hi), Q.from_geom([[np.array(r) for r in p] for p in g])) for i, level, lo, hi, g in rows]
    return Q.measured(spark.createDataFrame(made, f"ftype string, id bigint, level string, lo double, hi double, geom {Q.GEOM}"))


def counting(path):
    """Adds to a file the number of rows that reach it."""
    def f(columns):
        with open(path, "a") as log:
            log.write(f"{len(columns[0])}\n")
        return [[len(g) for g in columns[0]]]

    return f


def test_equal_shapes_are_worked_out_once(spark, tmp_path):
    rows = areas(spark, [(i, "2", 0, 1, box(i % 3, 0)) for i in range(300)]).select("id", "geom").repartition(7)
    log = tmp_path / "calls"
    out = Q.once_each(rows, ["geom"], counting(str(log)), [("n", "int", pa.int32())]).select("id", "n").collect()
    assert sorted(r["id"] for r in out) == list(range(300)) and {r["n"] for r in out} == {1}
    assert sum(map(int, log.read_text().split())) == 3


def test_small_tables_are_dealt_to_many_tasks(spark):
    rows = areas(spark, [(i, "2", 0, 1, box(i, 0)) for i in range(40)]).coalesce(1).select("id", "geom")
    assert Q.measured(rows).select(F.spark_partition_id()).distinct().count() > 1


def test_runs_go_on_across_lists():
    seen = []
    f = Q.remembered(lambda c: [seen.append(len(c[0])) or [x[0][0].sum() for x in c[0]]])
    a, b = [[np.ones((3, 2))]], [[np.zeros((3, 2))]]
    assert f([[a, a, b]]) == [[6.0, 6.0, 0.0]] and f([[b, b]]) == [[0.0, 0.0]] and f([[]]) == [[]]
    assert seen == [2, 0]


def test_double_coverage_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, str(1 + i % 2), s := int(rng.integers(0, 40)), s + int(rng.integers(0, 30)), box(float(rng.integers(0, 3)) / 2, 0)) for i in range(80)]
    rows = tables.materialise(areas(spark, [*rows, (100, "1", 30, 10, box(0, 0))]))
    pairs = {r["type"]: r["count"] for r in Q.double_coverage_totals(Q.double_coverage(rows)).collect()}
    held = []
    keep = Q.overlaid
    monkeypatch.setattr(Q, "overlaid", lambda p: held.append(p.count()) or keep(p))
    found = {r["type"]: r["count"] for r in Q.double_coverage_totals(Q.double_coverage_by_shape(rows)).collect()}
    assert found == pytest.approx(pairs, abs=2e-6) and len(found) == 2
    assert sum(held) <= 2 * 3


def test_gap_keeps_one_of_equal_pieces(spark, monkeypatch):
    kept = []
    keep = tables.materialise
    monkeypatch.setattr(tables, "materialise", lambda df: kept.append(keep(df)) or kept[-1])
    ours = areas(spark, [(1, "2", 0, 100, box(0, 0)), (2, "2", 0, 10, box(3, 0))]).withColumns({"name": F.lit("x"), "whmid": F.lit("w")})
    theirs = areas(spark, [(i, "2", i, i + 5, box(0, 0, 0.5)) for i in range(50)])
    out = {r["id"]: (r["uncovered"], r["earth_years"]) for r in Q.coverage_gap(ours, theirs).collect()}
    part = theirs.first()["km2"] * 54 / Q.geometry.LAND_KM2
    assert out[1][0] == pytest.approx(out[1][1] - part, abs=1e-12) and out[2][0] == out[2][1]
    assert [t.count() for t in kept if set(t.columns) == {"id", "cell", "b", "blo", "bhi"}] == [1]


def test_clip_cuts_equal_rows_once(spark, monkeypatch):
    cut = []
    keep = atlas.combined
    monkeypatch.setattr(atlas, "combined", lambda p, how: cut.append(p.count()) or keep(p, how))
    rows = areas(spark, [(i, "2", 0, 1, box(i % 2, 0)) for i in range(20)]).select("id", "geom")
    land = areas(spark, [(i, "2", 0, 1, box(0.5, 0)) for i in range(10)]).select("geom")
    out = Q.measured(atlas.clip_to(rows, land)).collect()
    whole = Q.measured(land).first()["km2"] / 2
    assert len(out) == 20 and all(r["km2"] == pytest.approx(whole) for r in out) and cut == [2]


def test_islands(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 6, 9), ("a", 20, 21), ("b", 1, 1), ("b", 3, 4), ("b", 3, 4)], "k string, s int, e int")
    assert sorted(map(tuple, temporal.islands(rows, ["k"], "s", "e").collect())) == [("a", 0, 9), ("a", 20, 21), ("b", 3, 4)]
