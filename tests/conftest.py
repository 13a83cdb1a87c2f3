from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarrykit.session import session, ship

    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.sql.codegen.wholeStage": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


def hostile(spark, folder: str) -> None:
    """Tables of the given schemas with a row of nulls, some true rows twice, empty strings and an extra column."""
    import os

    from pyspark.sql import functions as F

    for file in sorted(os.listdir(DATA)):
        df = spark.read.parquet(os.path.join(DATA, file))
        some = df.limit(15)
        nulls = df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        blank = df.limit(1).select(*[(F.lit("") if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes])
        rows = some.unionByName(some.limit(5)).unionByName(nulls).unionByName(nulls).unionByName(blank)
        rows.select("*", F.lit("x").alias("_q_extra"), F.lit(1).alias("rank_")).coalesce(1).write.parquet(os.path.join(folder, file))


def emptied(spark, folder: str) -> None:
    import os

    for file in sorted(os.listdir(DATA)):
        spark.read.parquet(os.path.join(DATA, file)).limit(0).coalesce(1).write.parquet(os.path.join(folder, file))


@pytest.fixture(scope="session")
def hostile_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hostile"))
    hostile(spark, folder)
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    emptied(spark, folder)
    return folder
