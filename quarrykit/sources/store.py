"""Sinks: vector collections, job tables, caches and reports as files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.session import exists


def save_collection(chunks: DataFrame, path: str, collection: str = "collection") -> None:
    """Write chunks partitioned by collection; only the collections that are written are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(collection).parquet(path)


def has_collection(spark: SparkSession, path: str, collection: str, content_hash: str, hashes: DataFrame) -> bool:
    """Whether a collection with this content is stored already (``hashes``: collection, content_hash)."""
    return not hashes.where((F.col("collection") == collection) & (F.col("content_hash") == content_hash)).isEmpty() and exists(spark, path)


def drop_collection(spark: SparkSession, path: str, name: str, collection: str = "collection") -> bool:
    """Remove a stored collection, its folder on any file system; whether there was one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, f"{collection}={name}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def append_jobs(jobs: DataFrame, path: str) -> None:
    """Job states are appended; the latest of each job is read with ``operators.nested.latest``."""
    jobs.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str, ttl_seconds: int | None = None) -> DataFrame:
    """JSON cache entries, those not older than ``ttl_seconds`` by the time of their file."""
    rows = spark.read.schema(schema).json(path)
    if ttl_seconds is None:
        return rows
    age = F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col("_metadata.file_modification_time"))
    return rows.where(age <= ttl_seconds * 1_000_000)


def write_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(sections: dict[str, DataFrame], path: str) -> None:
    """One folder per section with its rows as JSON, and an index of what there is."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(os.path.join(path, name))
    spark = next(iter(sections.values())).sparkSession
    spark.createDataFrame([(n,) for n in sections], "section string").write.mode("overwrite").json(os.path.join(path, "index"))
