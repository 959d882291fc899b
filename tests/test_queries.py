"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from compare import DATA, duck_rows, spark_rows

from plotweave.plans import annotation_queries, catalog_queries, raster_queries  # noqa: F401
from plotweave.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    got, want = spark_rows(QUERIES[name](spark, f"{DATA}/sf0.001")), duck_rows(ORACLE_SQL[name], "sf0.001")
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
