"""The quadtree's cells: none too full, every box in all that it touches, each pair of boxes once."""

import numpy as np
from pyspark.sql import functions as F

from eonmap.operators import quadtree as T
from eonmap.plans import features as Q


def boxes(n, seed=3):
    """Most boxes are small and stand in one city; some are as large as continents."""
    rng = np.random.default_rng(seed)
    city = rng.random(n) < 0.8
    at = np.where(city[:, None], 10 + rng.normal(0, 0.02, (n, 2)), rng.uniform(-180, 170, (n, 2)) * (1, 0.45))
    size = np.where(city[:, None], rng.random((n, 2)) * 0.002, rng.random((n, 2)) * rng.choice([0.1, 3, 60], (n, 1)))
    return [(i, [float(x), float(y), float(x + w), float(y + h)]) for i, ((x, y), (w, h)) in enumerate(zip(at, size, strict=True))]


def test_cells_are_not_overfull(spark):
    rows = boxes(20_000)
    df = spark.createDataFrame(rows, "id long, box array<double>").withColumn("geom", F.lit(None).cast(Q.GEOM))
    tree = T.quadtree(df)
    spread = T.with_cells(df.select("id", "box"), tree)
    sizes = [r["count"] for r in spread.groupBy("cell").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 1_000 and sum(sizes) < 12 * len(rows)
    assert len(tree.split) <= T.DEPTH * T.PARTS


def test_pairs_as_by_all_pairs(spark):
    rows = boxes(1_500)
    df = spark.createDataFrame(rows, "id long, box array<double>")
    got = [(r["a_id"], r["b_id"]) for r in Q.meeting(df, df, [], ["id"], ["id"], "a_id < b_id").select("a_id", "b_id").collect()]
    b = np.array([r[1] for r in rows])
    meet = (np.maximum(b[:, None, :2], b[None, :, :2]) <= np.minimum(b[:, None, 2:], b[None, :, 2:])).all(axis=2)
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(np.triu(meet, 1)), strict=True)}


def test_nothing_and_outside(spark):
    none = spark.createDataFrame([], "id long, box array<double>")
    assert Q.meeting(none, none, [], ["id"], ["id"]).count() == 0 and T.quadtree(none).split == frozenset()
    odd = spark.createDataFrame([(1, [-500.0, -300.0, -400.0, -200.0]), (2, [-450.0, -250.0, 500.0, 400.0]), (3, None)], "id long, box array<double>")
    assert [(r["a_id"], r["b_id"]) for r in Q.meeting(odd, odd, [], ["id"], ["id"], "a_id < b_id").collect()] == [(1, 2)]
