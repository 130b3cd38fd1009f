"""Every registered query equals its SQL on the small tables."""

import pytest

from gradeloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= {"m1_text_classifier", "m2_mastery", "m2_item_ratings", "m4_rank_candidates", "m4_assign_candidates", "m5_indexed_vectors"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, same, name):
    same(QUERIES[name](spark, sf), SQL[name])


def test_entry_imports_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "gradeloom.llm.queries", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(QUERIES)
