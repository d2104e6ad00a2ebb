"""Selection among candidate predictions: ensembles, calibration, thresholds and weights, as grids in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.evaluate import mean_t


def candidates(df: DataFrame, keys: list[str], columns: dict[str, str], keep: list[str]) -> DataFrame:
    """Wide predictions in long form: (keys, keep, source, value)."""
    pairs = F.array(*(F.struct(F.lit(n).alias("source"), F.col(c).cast("double").alias("value")) for n, c in columns.items()))
    return df.select(*keys, *keep, F.explode(pairs).alias("_c")).select(*keys, *keep, "_c.*")


def ensembles(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and mean without extremes over the sources of each row."""
    n = F.count("value")
    return long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"),
        F.when(n > 2, (F.sum("value") - F.min("value") - F.max("value")) / (n - 2)).otherwise(F.avg("value")).alias("trimmed"),
    )


def best_by(df: DataFrame, keys: list[str], choice: str, score: str, smallest: bool = True) -> DataFrame:
    """The choice with the best score per key; ties fall to the smaller choice."""
    s = F.col(score) if smallest else -F.col(score)
    return df.groupBy(*keys).agg(F.min(F.struct(s.alias("s"), F.col(choice).alias("c"))).alias("_b")).select(*keys, F.col("_b.c").alias(choice), (F.col("_b.s") if smallest else -F.col("_b.s")).alias(score))


def point_calibration(df: DataFrame, keys: list[str], actual: str, pred: str, scales: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25)) -> DataFrame:
    """Scale with median intercept, or least squares clipped to +-2, whichever has the smallest error."""
    ols = df.groupBy(*keys).agg(F.least(F.greatest(F.regr_slope(actual, pred), F.lit(-2.0)), F.lit(2.0)).alias("_s"), F.regr_intercept(actual, pred).alias("_i"))
    g = df.join(ols, keys).select(*keys, actual, pred, F.explode(F.array(*(F.struct(F.lit(f"shrink_{s:g}").alias("name"), F.lit(s).alias("scale"), F.lit(None).cast("double").alias("fixed")) for s in scales), F.struct(F.lit("identity").alias("name"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("fixed")), F.struct(F.lit("linear").alias("name"), F.col("_s").alias("scale"), F.col("_i").alias("fixed")))).alias("g")).select(*keys, actual, pred, "g.*")
    med = g.groupBy(*keys, "name", "scale", "fixed").agg(F.percentile(F.col(actual) - F.col("scale") * F.col(pred), 0.5).alias("_m")).withColumn("intercept", F.coalesce("fixed", "_m")).drop("_m", "fixed")
    err = g.select(*keys, actual, pred, "name").join(med, [*keys, "name"]).groupBy(*keys, "name", "scale", "intercept").agg(F.avg(F.abs(F.col("scale") * F.col(pred) + F.col("intercept") - F.col(actual))).alias("mae"))
    return err.groupBy(*keys).agg(F.min(F.struct(F.round("mae", 9).alias("mae"), "name", "scale", "intercept")).alias("b")).select(*keys, "b.name", "b.scale", "b.intercept", "b.mae")


def direction_threshold(df: DataFrame, keys: list[str], up: str, signals: list[str], quantiles: int = 33) -> DataFrame:
    """The signal, polarity and quantile threshold with the best accuracy per key."""
    long = candidates(df, keys, {s: s for s in signals}, [up])
    long = long.select(*keys, up, "source", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("polarity"), "value").withColumn("value", F.col("value") * F.col("polarity"))
    qs = [0.02 + 0.96 * i / (quantiles - 1) for i in range(quantiles)]
    grid = long.groupBy(*keys, "source", "polarity").agg(F.array_distinct(F.percentile("value", qs)).alias("t"))
    # Accuracy of all thresholds of a signal in one pass over its rows: a row adds to as many partial means, and is not multiplied.
    right = [F.struct(F.get(F.any_value("t"), F.lit(i)).alias("threshold"), F.avg(((F.col("value") >= F.get("t", F.lit(i))) == F.col(up)).cast("int")).alias("accuracy")) for i in range(quantiles)]
    acc = long.join(grid, [*keys, "source", "polarity"]).groupBy(*keys, "source", "polarity").agg(F.array(*right).alias("a"))
    acc = acc.select(*keys, "source", "polarity", F.explode("a").alias("a")).select(*keys, "source", "polarity", "a.*").where("threshold is not null")
    return acc.groupBy(*keys).agg(F.min(F.struct((-F.round("accuracy", 12)).alias("a"), "source", (-F.col("polarity")).alias("p"), "threshold")).alias("b")).select(*keys, "b.source", (-F.col("b.p")).alias("polarity"), "b.threshold", (-F.col("b.a")).alias("accuracy"))


def score_of(ret: str, metric: str):
    """An aggregate score of returns: 'return', 'tstat' or 'sharpe'."""
    total = F.exp(F.sum(F.log1p(F.col(ret)))) - 1
    return {"return": total, "tstat": mean_t(ret), "sharpe": F.coalesce(F.try_divide(F.avg(ret), F.stddev_pop(ret)), F.lit(0.0)) * 252**0.5}[metric]


def robust_score(df: DataFrame, keys: list[str], order: str, ret: str, metric: str, segments: int, worst_weight: float) -> DataFrame:
    """Base score, mixed with the median and the worst of equal-count segments."""
    s = df.withColumn("_k", F.ntile(segments).over(W.partitionBy(*keys).orderBy(order)))
    part = s.groupBy(*keys, "_k").agg(score_of(ret, metric).alias("_s"))
    seg = part.groupBy(*keys).agg(F.percentile("_s", 0.5).alias("_m"), F.min("_s").alias("worst"), F.avg((F.col("_s") > 0).cast("int")).alias("positive"))
    base = df.groupBy(*keys).agg(score_of(ret, metric).alias("_b"))
    return base.join(seg, keys).select(*keys, ((1 - worst_weight) * (0.5 * F.col("_b") + 0.5 * F.col("_m")) + worst_weight * F.col("worst")).alias("score"), "positive", "worst")


def position_ensemble(scores: DataFrame, positions: DataFrame, keys: list[str], order: str, sort_by: str, k: int, min_return: float) -> DataFrame:
    """Positions of the k best sources per key, weighted by their validation return.

    ``scores``: (keys, source, validation_return, ``sort_by``); ``positions``: (keys, ``order``, source, position).
    """
    w = W.partitionBy(*keys)
    top = scores.where(F.col("validation_return") >= min_return).withColumn("_r", F.row_number().over(w.orderBy(F.desc(sort_by), "source"))).where(F.col("_r") <= k)
    top = top.withColumn("_w", F.greatest("validation_return", F.lit(1e-6))).withColumn("weight", F.col("_w") / F.sum("_w").over(w)).select(*keys, "source", "weight", "_r")
    out = positions.join(top, [*keys, "source"]).groupBy(*keys, order).agg(F.sum(F.col("weight") * F.col("position")).alias("position"), F.sort_array(F.collect_list(F.struct("_r", "source"))).alias("_s"))
    return out.select(*keys, order, "position", F.concat(F.lit("position_ensemble:"), F.concat_ws("|", F.transform("_s", lambda x: x["source"]))).alias("source"))


def prune_positions(df: DataFrame, keys: list[str], position: str, actual: str, quantiles: list[float], min_ratio: float) -> DataFrame:
    """The quantile below which positions are set to 0, where that raises the t statistic of the returns.

    A trial needs a positive threshold, a spread of positions, and ``min_ratio`` of
    the unpruned return where that is positive. Keys for which no trial is better
    are left out.
    """
    q = df.groupBy(*keys).agg(F.percentile(position, quantiles).alias("t"))
    grid = q.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), F.col("t"))).alias("g")).select(*keys, F.col("g.q").alias("quantile"), F.col("g.t").alias("threshold"))
    grid = grid.where("threshold > 0").unionByName(q.select(*keys, F.lit(None).cast("double").alias("quantile"), F.lit(0.0).alias("threshold")))
    kept = F.when(F.col(position) >= F.col("threshold"), F.col(position)).otherwise(0.0)
    trial = df.join(grid, keys).withColumn("_p", kept).withColumn("_r", F.col("_p") * F.col(actual))
    trial = trial.groupBy(*keys, "quantile", "threshold").agg(mean_t("_r").alias("t_stat"), score_of("_r", "return").alias("ret"), F.stddev_pop("_p").alias("_s"))
    base = trial.where("quantile is null").select(*keys, F.col("t_stat").alias("base_t_stat"), F.col("ret").alias("_b"))
    ok = trial.where("quantile is not null and _s > 1e-12").join(base, keys)
    ok = ok.where((F.col("t_stat") > F.col("base_t_stat")) & (F.col("ret") >= F.when(F.col("_b") > 0, F.col("_b") * min_ratio).otherwise(F.col("_b"))))
    return ok.groupBy(*keys).agg(F.min(F.struct((-F.col("t_stat")).alias("s"), "quantile", "threshold", "base_t_stat")).alias("b")).select(*keys, "b.quantile", "b.threshold", (-F.col("b.s")).alias("t_stat"), "b.base_t_stat")
