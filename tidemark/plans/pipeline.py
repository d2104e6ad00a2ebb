"""Queries of the whole pipeline; iterative or random parts have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.pipeline import CALENDAR, PRICE, Pipeline
from tidemark.plans.registry import register


@register("pipe_prepare")
def pipe_prepare(spark, d):
    return Pipeline(spark, d).prepare().frame


@register("pipe_backtest")
def pipe_backtest(spark, d):
    return Pipeline(spark, d).backtest()


@register("pipe_report")
def pipe_report(spark, d):
    p = Pipeline(spark, d)
    return p.report(p.backtest())


@register("evl11_group_ablation")
def evl11_group_ablation(spark, d):
    return Pipeline(spark, d).ablation()


@register("evl12_tuned_penalty")
def evl12_tuned_penalty(spark, d):
    return Pipeline(spark, d).backtest().groupBy("alpha").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"))


@register("evl13_resampled")
def evl13_resampled(spark, d):
    p = Pipeline(spark, d)
    return p.multiseed(p.backtest())


@register("evl14_audit")
def evl14_audit(spark, d):
    return Pipeline(spark, d).audit()


@register("ml14_information_gain")
def ml14_information_gain(spark, d):
    return Pipeline(spark, d).info_gain()


@register("ml06_boosted_trees")
def ml06_boosted_trees(spark, d):
    p = Pipeline(spark, d).prepare()
    return M.pooled(p.frame.where("target is not null"), "target", PRICE + CALENDAR, "boosting", "date < '2022-01-01'").select("symbol", "date", "target", "prediction")


@register("ml05_linear_svm")
def ml05_linear_svm(spark, d):
    p = Pipeline(spark, d).prepare()
    f = p.frame.where("target is not null").withColumn("up", (F.col("target") > 0).cast("double"))
    return M.pooled(f, "up", PRICE + CALENDAR, "svm", "date < '2022-01-01'").select("symbol", "date", "up", "prediction")


@register("ml12_balanced_logit")
def ml12_balanced_logit(spark, d):
    p = Pipeline(spark, d).prepare()
    f = p.frame.where("target is not null").withColumn("up", (F.col("target") > 0).cast("double"))
    return M.pooled(f, "up", PRICE, "logit", "date < '2022-01-01'").select("symbol", "date", "up", "prediction")
