"""Every core query: against its SQL, and on empty and hostile tables."""

from __future__ import annotations

import pytest

from quarrykit.plans.catalog import registries
from tests.compare import spark_rows, sql_rows
from tests.conftest import DATA

QUERIES = {n: f for r in registries() for n, f in r.queries.items()}
SQL = {n: s for r in registries() for n, s in r.sql.items()}
#: Aliases that read the same whole texts as the name without the ending.
SAME = {n for n in QUERIES if n.endswith("_whole") and n.removesuffix("_whole") in QUERIES and n not in ("documented_ratio_whole", "duplicate_bodies_whole")}


@pytest.mark.parametrize("name", sorted(set(SQL) - SAME))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, want = sql_rows(DATA, SQL[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SAME))
def test_empty_tables(spark, empty_dir, name):
    QUERIES[name](spark, empty_dir).collect()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SAME))
def test_nulls_repeats_and_extra_columns(spark, hostile_dir, name):
    QUERIES[name](spark, hostile_dir).collect()
