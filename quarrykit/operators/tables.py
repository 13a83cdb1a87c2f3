"""Small building blocks: first and last row of a key, top rows of a group, dedup, counters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``; nulls are keys too.

    An aggregate with map-side combine, so that a key with a third of all rows is reduced before
    the shuffle.  Rows of equal order are told apart by all their columns.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    comparable = [c for c, t in df.dtypes if c in rest and c not in order and not t.startswith(("map", "variant"))]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in comparable]) if order or comparable else F.lit(0)
    pick = F.max_by if last else F.min_by
    value = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(0)
    out = df.groupBy(*keys).agg(pick(value, rank).alias("_q_v"))
    return out.select(*keys, *[F.col(f"_q_v.`{c}`").alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, group: Iterable[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """All counters at once: one row per column and value, by grouping sets."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    id_ = F.grouping_id(*columns)
    rows = sets.agg(F.count("*").alias(name), id_.alias("_q_g"))
    full = (1 << len(columns)) - 1
    dimension = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        only = full & ~(1 << (len(columns) - 1 - i))
        dimension = F.when(F.col("_q_g") == only, F.lit(c)).otherwise(dimension)
        value = F.when(F.col("_q_g") == only, F.col(c).cast("string")).otherwise(value)
    return rows.select(dimension.alias("dimension"), value.alias("value"), name)


def union_first(parts: list[DataFrame], keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Bag union of rule results, then the first row of each key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return one_per_key(out, keys, order)
