"""Queries of the text problems against their SQL on the smallest data."""

import pytest
from conftest import DATA, rows

from tidemark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_duplicate_free(spark):
    for name in ("p4_found", "p5_found", "p7_found", "p9_found", "p10_found"):
        df = Q.QUERIES[name](spark, DATA)
        assert df.count() == df.distinct().count()
