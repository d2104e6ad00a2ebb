import datetime as dt

from tidemark.operators import decide as D
from tidemark.operators import evaluate as E

DAY = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(12)]


def test_significance_chooses_the_stable_source(spark):
    scores = spark.createDataFrame([("k", "volatile", 0.08, 1.0), ("k", "stable", 0.05, 3.0)], "k string, source string, validation_return double, t double")
    pos = spark.createDataFrame([("k", d, "volatile", float(i % 2 == 0)) for i, d in enumerate(DAY)] + [("k", d, "stable", 0.4) for d in DAY], "k string, day date, source string, position double")
    out = D.position_ensemble(scores, pos, ["k"], "day", "t", 1, -1.0).collect()
    assert {r["source"] for r in out} == {"position_ensemble:stable"} and {r["position"] for r in out} == {0.4} and len(out) == 12


def test_pruning_at_the_median(spark):
    rows = [("k", -0.01, 0.1)] * 4 + [("k", 0.02, 0.8)] * 4
    r = D.prune_positions(spark.createDataFrame(rows, "k string, actual double, position double"), ["k"], "position", "actual", [0.5], 0.0).first()
    assert r["quantile"] == 0.5 and abs(r["threshold"] - 0.45) < 1e-12 and r["t_stat"] > r["base_t_stat"]


def test_metrics_without_spread(spark):
    df = spark.createDataFrame([("k", 1, 0.0, 0.0)], "k string, i int, actual double, pred double")
    r = df.groupBy("k").agg(*(v.alias(n) for n, v in E.regression().items())).first()
    assert r["mae"] == 0 and r["nrmse"] == 0
    assert E.diebold_mariano(df, ["k"], "i", "pred").first()["p_value"] == 1.0


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([("k", float(i % 10)) for i in range(500)], "k string, x double")
    r = E.bootstrap_mean(df, ["k"], "x", 400).first()
    assert r["low"] < 4.5 < r["high"] and r["high"] - r["low"] < 1


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", i, (i * 7919 % 101 - 45) / 50) for i in range(400)], "k string, i long, x double")
    got = [E.bootstrap_mean(df.repartition(n), ["k"], "x", 300, row_id=["i"]).first() for n in (1, 5)]
    assert all(abs(got[0][c] - got[1][c]) < 1e-9 for c in ("low", "high", "p_one_sided"))
    assert got[0]["low"] < sum((i * 7919 % 101 - 45) / 50 for i in range(400)) / 400 < got[0]["high"]


def test_draws_are_poisson():
    import numpy as np

    n = E.poisson_draw(np.arange(200_000, dtype=np.uint64), 3)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and abs((n == 0).mean() - 0.3679) < 0.005
