"""Evaluation metrics, significance tests and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import numbers as N
from tidemark.operators.sequence import by as ordered


#: Distribution of Poisson(1) up to where a double knows no more.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def regression(actual: str = "actual", pred: str = "pred") -> dict[str, Column]:
    """MAE, RMSE, MAPE, R2 and RMSE over the deviation of the actual values."""
    e, a = F.col(pred) - F.col(actual), F.col(actual)
    sse, n = F.sum(e * e), F.count("*")
    return {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(sse / n), "mape": F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(1e-6))),
        "r2": 1 - N.safe_divide(sse, F.var_pop(a) * n), "nrmse": N.safe_divide(F.sqrt(sse / n), F.stddev_pop(a)),
    }


def classification(truth: Column, guess: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and MCC from one pass of counts; 0 where undefined."""
    c = lambda x: F.count_if(x).cast("double")
    tp, fp, fn, tn = c(truth & guess), c(~truth & guess), c(truth & ~guess), c(~truth & ~guess)
    p, r = N.safe_divide(tp, tp + fp), N.safe_divide(tp, tp + fn)
    return {
        "accuracy": N.safe_divide(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": N.safe_divide(2 * tp, 2 * tp + fp + fn),
        "mcc": N.safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def probabilistic(actual: str = "actual", pred: str = "pred", low: str = "q10", high: str = "q90") -> dict[str, Column]:
    """Coverage and width of an 80 % interval, and Gaussian negative log-likelihood."""
    s = F.greatest(F.abs(F.col(high) - F.col(low)) / (2 * 1.2816), F.lit(1e-4))
    e = F.col(pred) - F.col(actual)
    return {
        "coverage": F.avg(((F.col(actual) >= F.col(low)) & (F.col(actual) <= F.col(high))).cast("int")), "width": F.avg(F.abs(F.col(high) - F.col(low))),
        "nll": F.avg(0.5 * F.log(2 * math.pi * s * s) + e * e / (2 * s * s)),
    }


def pinball(actual: str, quantile: str, q: float) -> Column:
    d = F.col(actual) - F.col(quantile)
    return F.avg(F.greatest(d * q, d * (q - 1)))


def information_coefficients(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Correlation, correlation of average ranks, and the first over the deviation of the errors; 0 where undefined."""
    rank = lambda x: F.rank().over(W.partitionBy(*keys).orderBy(x)) + (F.count("*").over(W.partitionBy(*keys, x)) - 1) / 2
    r = df.withColumn("_ra", rank(actual)).withColumn("_rp", rank(pred))
    z = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    out = r.groupBy(*keys).agg(z(N.correlation(actual, pred)).alias("ic"), z(N.correlation("_ra", "_rp")).alias("rank_ic"), F.stddev_pop(F.col(pred) - F.col(actual)).alias("_s"))
    return out.withColumn("icir", N.safe_divide("ic", "_s")).drop("_s")


def strategy(df: DataFrame, keys: list[str], order: str, ret: str, position: str, per_year: int = 252) -> DataFrame:
    """Compounded and annualised return, Sharpe ratio, maximum drawdown, win rate, exposure and turnover per key."""
    w = ordered(keys, [order])
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    s = df.withColumn("_e", F.exp(F.sum(F.log1p(F.col(ret))).over(upto))).withColumn("_t", F.abs(F.col(position) - F.lag(position, 1, 0.0).over(w)))
    s = s.withColumn("_d", F.col("_e") / F.greatest(F.lit(1.0), F.max("_e").over(upto)) - 1)
    total = F.exp(F.sum(F.log1p(F.col(ret))))
    return s.groupBy(*keys).agg(
        (total - 1).alias("cumulative"), (F.pow(total, per_year / F.count("*")) - 1).alias("annualised"),
        (N.safe_divide(F.avg(ret), F.stddev_pop(ret)) * math.sqrt(per_year)).alias("sharpe"), F.min("_d").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"), F.avg((F.col(position) > 0).cast("int")).alias("exposure"), F.avg("_t").alias("turnover"),
    )


def diebold_mariano(df: DataFrame, keys: list[str], order: str, diff: str, lags: int = 5) -> DataFrame:
    """Statistic and p-value of a mean loss difference with Bartlett-weighted autocovariances; (0, 1) below two values."""
    w = W.partitionBy(*keys)
    c = df.where(F.col(diff).isNotNull()).withColumn("_x", F.col(diff) - F.avg(diff).over(w))
    c = c.withColumns({f"_l{k}": F.lag("_x", k).over(ordered(keys, [order])) for k in range(1, lags + 1)})
    n = F.count("*")
    cov = [F.sum(F.col("_x") * F.col(f"_l{k}")) / F.nullif(n - k, F.lit(0)) for k in range(1, lags + 1)]
    var = F.sum(F.col("_x") * F.col("_x")) / n
    for k, g in enumerate(cov, 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(g, F.lit(0.0))
    g = c.groupBy(*keys).agg(n.alias("n"), F.avg(diff).alias("_m"), F.greatest(var, F.lit(1e-12)).alias("_v"))
    g = g.withColumn("dm", F.when(F.col("n") >= 2, F.col("_m") / F.sqrt(F.col("_v") / F.col("n"))).otherwise(0.0))
    return g.withColumn("p_value", F.when(F.col("n") >= 2, N.normal_p_value("dm")).otherwise(1.0)).select(*keys, "n", "dm", "p_value")


def mean_t(x: Column | str) -> Column:
    """Mean over its standard error; 0 below two values or without spread."""
    return F.when(F.count(x) >= 2, N.safe_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))).otherwise(0.0)


def poisson_draw(row: np.ndarray, draw: int) -> np.ndarray:
    """How often each row counts in a draw: Poisson(1), from a hash of the row and the draw alone."""
    with np.errstate(over="ignore"):
        h = row + np.uint64(draw) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(POISSON, u, side="right").astype(float)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 42, row_id: list[str] | None = None) -> DataFrame:
    """Percentile interval of the mean and the share of resampled means at or below 0.

    Poisson bootstrap: every row counts Poisson(1) times in every draw, drawn from a
    hash of the row and the draw, whatever the partition it lies in; without ``row_id`` a
    row goes by its place. Partial
    sums of the draws are all that is shuffled, so a group of any size needs no single task.
    """
    kinds = dict(df.dtypes)

    def sums(batches):
        for p in batches:
            if p.empty:
                continue
            for key, g in p.groupby(keys, sort=False, dropna=False):
                x, row = g[value].to_numpy(dtype=float), g["_row"].to_numpy(dtype=np.int64).view(np.uint64)
                s, n = np.zeros(draws), np.zeros(draws)
                for k in range(draws):
                    c = poisson_draw(row, seed + k)
                    s[k], n[k] = c @ x, c.sum()
                yield pd.DataFrame({k: [v] for k, v in zip(keys, key if isinstance(key, tuple) else (key,), strict=True)} | {"s": [s], "c": [n]})

    part = df.where(F.col(value).isNotNull()).select(*keys, (F.xxhash64(*row_id) if row_id else F.monotonically_increasing_id()).alias("_row"), value).mapInPandas(sums, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", s array<double>, c array<double>")
    long = part.select(*keys, F.posexplode(F.arrays_zip("s", "c")).alias("draw", "x")).groupBy(*keys, "draw").agg((F.sum("x.s") / F.nullif(F.sum("x.c"), F.lit(0.0))).alias("m"))
    return long.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"), F.avg((F.col("m") <= 0).cast("int")).alias("p_one_sided"))


def binned_information(df: DataFrame, keys: list[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information of two columns over rank bins, in nats (a deviation from a nearest-neighbour estimate)."""
    b = df.withColumn("_x", F.ntile(bins).over(ordered(keys, [x]))).withColumn("_y", F.ntile(bins).over(ordered(keys, [y])))
    joint = b.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("n"))
    w = lambda *c: W.partitionBy(*keys, *c)
    joint = joint.withColumn("nx", F.sum("n").over(w("_x"))).withColumn("ny", F.sum("n").over(w("_y"))).withColumn("t", F.sum("n").over(w()))
    return joint.groupBy(*keys).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))
