"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarrykit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, skew joins, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_quarrykit_sent", False):
        return
    package = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="quarrykit-code-")) / "quarrykit.zip"
    with zipfile.ZipFile(file, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(file))
    context._quarrykit_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the setting is absent."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="quarrykit-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: lineage cut, sizes known.

    For loops whose tables are united round after round; the files stay until the folder is cleared.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"quarrykit-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Partitions for rows that are few in bytes but dear to work on."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, for rows that are few in bytes but dear to work on.

    Adaptive execution sizes partitions by bytes and would put such rows into one task.
    """
    return df.repartition(parts(df.sparkSession), *keys)
