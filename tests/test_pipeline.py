import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import Config, load_config, merge
from tidemark.functions import numbers as N
from tidemark.pipeline import Pipeline


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("windows: {train: 50, step: 5}\nmodel: {alphas: [1, 2]}\n")
    c = load_config(str(f))
    assert (c.windows.train, c.windows.test, c.model.alphas) == (50, 30, (1, 2))
    with pytest.raises(KeyError):
        merge(Config(), {"nothing": 1})


def test_backtest_and_its_reports(spark):
    c = merge(Config(), {"windows": {"train": 40, "validation": 10, "test": 10, "step": 10}})
    p = Pipeline(spark, DATA, c)
    pred = p.backtest().cache()
    assert pred.count() > 0 and pred.count() == pred.select("symbol", "date").distinct().count()
    assert pred.where("q10 > q90 or sigma is null or isnan(pred)").count() == 0
    r = p.report(pred).first()
    assert r["mae"] > 0 and 0 <= r["coverage"] <= 1
    assert p.significance(pred).where("p_value between 0 and 1").count() > 0


def test_features_do_not_see_the_future(spark):
    p = Pipeline(spark, DATA)
    full = p.prepare()
    cut_at = full.frame.agg(F.percentile_approx(F.unix_date("date"), 0.6)).first()[0]
    load = p.tables
    p.tables = lambda: {k: v.where(F.unix_date("date") <= cut_at) if k == "stock" else v for k, v in load().items()}
    part = p.prepare().frame.select("symbol", "date", *[F.round(c, 9).alias(c) for c in full.features])
    same = full.frame.where(F.unix_date("date") <= cut_at).select("symbol", "date", *[F.round(c, 9).alias(c) for c in full.features])
    assert part.count() > 0 and part.exceptAll(same).count() == 0 and same.exceptAll(part).count() == 0


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(N.correlation("a", "b")).first()[0] is None and abs(df.agg(N.correlation("b", "b")).first()[0] - 1) < 1e-12


def test_verbs(spark, tmp_path, capsys):
    cli.main(["prepare", "--data", DATA, "--out", str(tmp_path)])
    assert "prepared" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "prepared")).count() > 0
