"""Event streams: windows, sessions, duplicates and the latest state, as Structured Streaming.

All operators work on batch tables as well.  The time column must be a TIMESTAMP with a watermark;
late rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.session import exists, shared_dir


def source(spark: SparkSession, path: str, ts: str, delay: str) -> DataFrame:
    """A parquet file or directory as a stream, its time column as TIMESTAMP under a watermark."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream watches a directory
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, size: str, *keys: str, slide: str | None = None) -> DataFrame:
    """(start, end, keys..., n): rows per window, sliding with ``slide``."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """(key, start, end, n): runs of rows of a key without a pause of ``gap``."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(df: DataFrame, *keys: str) -> DataFrame:
    """Rows without repetitions of a key within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its result as a table in the shared folder."""
    folder = os.path.join(shared_dir(stream.sparkSession), f"quarrykit-stream-{uuid.uuid4().hex}")
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def latest_state(stream: DataFrame, keys: list[str], order: str, target: str) -> None:
    """Keep a table of the latest row of each key up to date, micro-batch by micro-batch."""
    from quarrykit.operators.tables import one_per_key

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{target}/{number - 1}"
        rows = batch
        if number and exists(spark, old):
            rows = batch.unionByName(spark.read.parquet(old))
        one_per_key(rows, keys, [order], last=True).write.mode("overwrite").parquet(f"{target}/{number}")

    folder = os.path.join(shared_dir(stream.sparkSession), f"quarrykit-stream-{uuid.uuid4().hex}")
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
