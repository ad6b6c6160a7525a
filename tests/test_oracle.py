"""Every registered query of the surveillance operators against its SQL."""

from __future__ import annotations

import compare
import pytest

from antibiogram.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == ""


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.registry.queries()[entry.FLAGSHIP](spark, sf_dir).collect()
    assert len(rows) == 5 and all(0 <= r["percent_resistant"] <= 100 for r in rows)
