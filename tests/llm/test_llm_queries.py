"""Every registered query on empty and on hostile tables."""

from __future__ import annotations

import pytest

from quarrykit.llm.queries import registry


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_empty_tables(spark, empty_dir, name):
    assert registry.queries[name](spark, empty_dir).collect() is not None


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_nulls_repeats_and_extra_columns(spark, hostile_dir, name):
    registry.queries[name](spark, hostile_dir).collect()
