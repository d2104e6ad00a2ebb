import numpy as np
import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.operators import relational as R


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=5000), rng.integers(0, 7, 3000).astype(float), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        for acc in (100, 100_000):
            assert R.exact_quantiles(df, "x", [0.01, 0.5, 0.99], acc) == pytest.approx(np.quantile(x, [0.01, 0.5, 0.99]).tolist())
    assert R.exact_quantiles(df.limit(0), "x", [0.5]) is None


def test_conform_casts_adds_and_defaults(spark):
    s = StructType([StructField("a", LongType()), StructField("b", DoubleType()), StructField("c", StringType())])
    out = R.conform(spark.createDataFrame([("x", "1.5"), ("3", None)], "a string, b string"), s, {"b": 9, "c": "none"})
    assert out.schema == s or [f.dataType for f in out.schema] == [f.dataType for f in s]
    assert [tuple(r) for r in out.collect()] == [(None, 1.5, "none"), (3, 9.0, "none")]


def test_safe_name():
    assert R.safe_name("  Net Profit (€) ") == "net_profit"
