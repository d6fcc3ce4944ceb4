"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="eonmap-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the session ends."""
    path = f"{shared_dir(spark)}/eonmap-{name}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    This cuts the lineage: later stages, and tasks run again after an executor is lost, start from
    the stored table. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eonmap-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def materialise_by(df: DataFrame, column: str) -> DataFrame:
    """``materialise``, with rows dealt by a column into as many buckets as shuffles have partitions.

    Later joins on the column read the table where it stands: only their other side is moved.
    """
    spark = df.sparkSession
    name, n = f"eonmap_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when the query has ended, not when the driver next collects garbage.

    What runs again later (a lost executor's tasks, a result read twice) makes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for table in tables:
        path = getattr(table, "stored_at", None) if "stored_at" in vars(table) else None
        if path:
            jvm, context = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(context._jsc.hadoopConfiguration()).delete(hpath, True)
            if "stored_as" in vars(table):
                table.sparkSession.sql(f"drop table if exists {table.stored_as}")


#: A key is hot if it holds more than one of so many of all rows, so that there are fewer hot keys than that.
HOT = 200


def hot_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of stored ``rows`` with ``facts``, of which ``key`` is unique.

    The facts of hot keys, fewer than ``HOT``, are broadcast; the others are joined by a shuffle, in
    which no key stands out.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counts.where(F.col("n") > F.lit(max(rows.count() / HOT, HOT))).select(key).collect()]
    if not hot:
        return rows.join(facts, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key).unionByName(rows.where(~is_hot).join(facts.where(~is_hot), key))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once for each row, however often ``f`` uses it.

    The optimizer may copy a plain column's expression into lambdas and filters, where it would be
    computed again for every element; a lambda's own variable is never replaced.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for a row that is stable under recomputation; equal (id, text) rows share it."""
    return F.xxhash64(doc_id.cast("string"), text)


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) of rows whose sizes sum to ``limit`` at most, one row at least."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1
