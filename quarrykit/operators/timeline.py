"""Change histories: active modules, abandoned files, hot spots, velocity, contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_age(df: DataFrame, ts: str, age: str = "age_days") -> DataFrame:
    """Age in whole days against the latest row of the table (one row, broadcast); null times have none."""
    now = df.agg(F.max(ts).alias("_q_now"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.join(F.broadcast(now), F.lit(True)).withColumn(age, F.floor((micros("_q_now") - micros(ts)) / 86_400_000_000).cast("int")).drop("_q_now")


def span(first: Column, last: Column) -> Column:
    """A span of time: years and months where it is longer than a year, else days."""
    days = F.floor((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86_400_000_000)
    years, months = F.floor(days / 365), F.floor((days % 365) / 30)
    return F.when(days > 365, F.concat(years.cast("string"), F.lit("y "), months.cast("string"), F.lit("m"))).otherwise(F.concat(days.cast("string"), F.lit(" days")))


def active_modules(changes: DataFrame, module: str, file: str, recent: int) -> DataFrame:
    """Per module its changes, the recent ones and the number of files (``changes`` has age_days)."""
    return changes.groupBy(F.col(module).alias("module")).agg(F.count("*").alias("changes"), F.count_if(F.col("age_days") <= recent).alias("recent"), F.countDistinct(file).alias("files"))


def abandoned(changes: DataFrame, file: str, days: int) -> DataFrame:
    """Files whose last change is older than ``days``."""
    return changes.groupBy(F.col(file).alias("file")).agg(F.min("age_days").alias("last_days"), F.count("*").alias("changes")).where(F.col("last_days") > days)


def hot_spots(changes: DataFrame, file: str, author: str, n: int) -> DataFrame:
    """The ``n`` files with the most changes, and their authors."""
    return changes.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("changes"), F.countDistinct(author).alias("authors")).orderBy(F.desc("changes"), "file").limit(n)


def velocity(commits: DataFrame, weeks: int = 12) -> DataFrame:
    """Commits per week back from the latest, with zeros, the mean of the weeks that have some, and the trend."""
    spark = commits.sparkSession
    counted = commits.where((F.col("age_days") >= 0) & (F.col("age_days") < 7 * weeks)).groupBy(F.floor(F.col("age_days") / 7).cast("int").alias("week")).agg(F.count("*").alias("n"))
    rows = spark.range(weeks).select(F.col("id").cast("int").alias("week")).join(counted, "week", "left").fillna(0, ["n"])
    all_ = Window.partitionBy(F.lit(1))  # as many rows as weeks
    part = lambda a, b: F.coalesce(F.sum(F.when(F.col("week").between(a, b), F.col("n"))).over(all_), F.lit(0))
    late, early = part(0, 3), part(4, 7)
    trend = F.when(late > early * 1.2, "increasing").when(late < early * 0.8, "decreasing").otherwise("stable")
    return rows.select("week", "n", F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))).over(all_), 4).alias("mean_of_busy_weeks"), trend.alias("trend"))


def contributors(commits: DataFrame, author: str, n: int = 10) -> DataFrame:
    """The top authors with their share in per cent, the running share, and whether they count for the bus factor.

    Shares are rounded to one place before they are summed; authors count while those before them
    have less than 80 per cent.
    """
    total = commits.agg(F.count("*").alias("total"))
    rows = commits.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(n)
    rows = rows.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("commits") * 100.0 / F.col("total"), 1))
    running = F.sum("share").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("commits"), "author").rowsBetween(Window.unboundedPreceding, 0))  # at most n rows
    return rows.withColumn("running", F.round(running, 1)).withColumn("in_bus_factor", F.round(F.col("running") - F.col("share"), 1) < 80).drop("total")
