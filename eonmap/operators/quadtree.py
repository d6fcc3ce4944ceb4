"""An adaptive quadtree over boxes: cells that are small where boxes stand thick, so that none holds more than a bound.

The tree is made of counts that Spark adds up: a row a fine cell, and from it its ancestors. Only the
cells that are split reach the driver; their number is bounded, since each holds more than the bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the whole world, boxes in a cell that is not split further, and shares of all boxes that a cell may always hold.
DEPTH, LEAST, PARTS = 18, 200, 2_000
#: The world: least longitude and latitude, and the side of the root's square; what lies outside counts to its edge.
WEST, SOUTH, SIDE = -180.0, -180.0, 360.0


@dataclass(frozen=True)
class Quadtree:
    """split: (depth, x, y) of the cells that are cut in four."""

    split: frozenset[tuple[int, int, int]]

    def leaves(self, box: Sequence[float]) -> list[tuple[int, int, int]]:
        """The cells that are not split and that a box (west, south, east, north) touches."""
        out, open_cells = [], [(0, 0, 0)]
        while open_cells:
            cell = open_cells.pop()
            if cell not in self.split:
                out.append(cell)
                continue
            d, x, y = cell
            last = (1 << d + 1) - 1
            x0, y0, x1, y1 = (min(max(int(np.floor((v - low) / SIDE * (1 << d + 1))), 0), last) for v, low in zip(box, (WEST, SOUTH, WEST, SOUTH), strict=True))
            open_cells += [(d + 1, i, j) for i in (2 * x, 2 * x + 1) for j in (2 * y, 2 * y + 1) if x0 <= i <= x1 and y0 <= j <= y1]
        return out


def _place(v: Column, low: float, depth: int) -> Column:
    n = 1 << depth
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / SIDE * n))).cast("int")


def quadtree(boxes: DataFrame, box: str = "box", least: int = LEAST) -> Quadtree:
    """The tree for a table of boxes, by their lower left corners.

    A cell is split if it holds more than ``least`` boxes and more than one in ``PARTS`` of all, down to ``DEPTH``.
    """
    corner = boxes.where(F.col(box).isNotNull()).select(_place(F.col(box)[0], WEST, DEPTH).alias("x"), _place(F.col(box)[1], SOUTH, DEPTH).alias("y"))
    fine = corner.groupBy("x", "y").agg(F.count("*").alias("n"))
    level = lambda v: F.floor(F.col(v) / F.pow(F.lit(2), DEPTH - F.col("d"))).cast("int").alias(v)
    nodes = fine.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1)))).select("n", "d", level("x"), level("y"))
    sums = nodes.groupBy("d", "x", "y").agg(F.sum("n").alias("n"))
    total = sums.where("d = 0").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    full = sums.where(F.col("n") > max(least, total // PARTS)).select("d", "x", "y")  # PARTS cells a level at most
    return Quadtree(frozenset((r["d"], r["x"], r["y"]) for r in full.collect()))


def with_cells(rows: DataFrame, tree: Quadtree, box: str = "box", name: str = "cell") -> DataFrame:
    """A row for each of the tree's cells that a row's box touches, with the cell (d, x, y); rows without a box go."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # the split cells: DEPTH times PARTS at most
    at = rows.columns.index(box)
    kind = pa.list_(pa.struct([("d", pa.int32()), ("x", pa.int32()), ("y", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.leaves(b) if b is not None else [] for b in batch.column(at).to_pylist()]
            cells = pa.array([[{"d": d, "x": x, "y": y} for d, x, y in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "__cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __cells array<struct<d:int,x:int,y:int>>"
    return rows.mapInArrow(work, schema).withColumn(name, F.explode("__cells")).drop("__cells")


def holds(cell: Column, x: Column, y: Column) -> Column:
    """Whether a point's place in the cell's level is the cell."""
    n = F.pow(F.lit(2.0), cell["d"])
    side = lambda v, low: F.greatest(F.lit(0.0), F.least(n - 1, F.floor((v - low) / SIDE * n)))
    return (side(x, WEST) == cell["x"]) & (side(y, SOUTH) == cell["y"])
