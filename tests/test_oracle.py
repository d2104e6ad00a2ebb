"""Every query with SQL against that SQL on the smallest data; the others must run."""

import pytest
from conftest import DATA, rows

import __spark_entry__ as entry

CORE = {k for k in entry.queries() if not (entry.llm and k in entry.llm.QUERIES)}


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Rolling windows need longer series than the smallest data has.
LONGER = ("pipe_backtest", "pipe_report", "ml05_linear_svm", "ml06_boosted_trees", "ml12_balanced_logit", "evl12_tuned_penalty", "evl11_group_ablation", "evl13_resampled")


@pytest.mark.parametrize("name", sorted(CORE - set(entry.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL give rows, and figures that are numbers; what is right is tested by operator."""
    got = entry.queries()[name](spark, DATA.replace("0.001", "0.01") if name in LONGER else DATA).toPandas()
    assert len(got) and not got.isin([float("inf"), float("-inf")]).any().any()
    if name in LONGER:
        assert not got.isna().any().any()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
