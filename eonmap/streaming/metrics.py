"""Daily summaries as a stream: each new file updates the metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eonmap.sources.tables import materialise

SUMMARY = "type string, count double"


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    """date (the folder of the file), type and count of summary files as they come."""
    rows = spark.readStream.schema(SUMMARY).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.summary.csv").csv(folder)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("date"), "type", "count")


def follow(stream: DataFrame, history: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges each batch into the long history table, a folder a date; a metric that comes again is replaced.

    A date's files may come in several batches: what is stored of the date and not in the batch
    stays. Replacing whole folders makes a batch that runs twice harmless.
    """
    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        last = materialise(batch.groupBy("date", "type").agg(F.max("count").alias("count")))
        folder = spark._jvm.org.apache.hadoop.fs.Path(history)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            stored = spark.read.schema(f"{SUMMARY}, date string").parquet(history).join(last.select("date").distinct(), "date", "left_semi")
            last = materialise(last.unionByName(stored.join(last, ["date", "type"], "left_anti").select(*last.columns)))
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(history)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
