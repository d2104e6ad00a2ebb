"""Baselines fitted for all groups at once by aggregates and folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge(df: DataFrame, keys: list[str], target: str, features: list[str], alpha: float = 1.0, train: str = "true") -> DataFrame:
    """Ridge regression per group on standardised features: (keys, intercept, coef array).

    The moments of the train rows are one aggregate; the k x k systems are solved in
    Arrow batches, one row per group.
    """
    k = len(features)
    t = df.where(train).select(*keys, F.col(target).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features))).dropna()
    x = [F.col(f"_x{i}") for i in range(k)]
    y = F.col("_y")
    sums = t.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.array(*(F.sum(v) for v in x)).alias("sx"), F.array(*(F.sum(v * y) for v in x)).alias("sxy"),
        F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(k))).alias("sxx"),
    )

    def solve(batches):
        for p in batches:
            icept, coef = [], []
            for n, sy, sx, sxy, sxx in zip(p["n"], p["sy"], p["sx"], p["sxy"], p["sxx"], strict=True):
                mx, my = np.asarray(sx) / n, sy / n
                c = np.asarray(sxx).reshape(k, k) - n * np.outer(mx, mx)
                sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
                sd[sd < 1e-8] = 1.0
                w = np.linalg.solve(c / np.outer(sd, sd) + alpha * np.eye(k), (np.asarray(sxy) - n * mx * my) / sd) / sd
                coef.append(w.tolist())
                icept.append(my - float(w @ mx))
            yield p[keys].assign(intercept=icept, coef=coef)

    kinds = dict(df.dtypes)
    return sums.mapInPandas(solve, ", ".join(f"`{q}` {kinds[q]}" for q in keys) + ", intercept double, coef array<double>")


def window_ridge(rows: DataFrame, keys: list[str], order: str, target: str, features: list[str], alphas: tuple[float, ...], z: float) -> DataFrame:
    """Predictions of the 'val' and 'test' rows of each window by ridge regression on its 'train' rows.

    Of the penalties the one with the smallest mean error on 'val' is taken (ties: the
    first), whose errors there also give the interval. A group is one window of one
    entity, of a size the window settings bound.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "split", order]) + ", alpha double, actual double, pred double, sigma double, q10 double, q90 double, prob double"

    def fit(p):
        x, y, split = np.nan_to_num(p[features].to_numpy(dtype=float)), p[target].to_numpy(dtype=float), p["split"].to_numpy()
        t, v = split == "train", split == "val"
        if t.sum() < 2:
            return p.iloc[:0][[*keys, "split", order]].assign(alpha=0.0, actual=0.0, pred=0.0, sigma=0.0, q10=0.0, q90=0.0, prob=0.0)
        m, s = x[t].mean(axis=0), x[t].std(axis=0)
        s[s < 1e-8] = 1.0
        xs, my = (x - m) / s, y[t].mean()
        best = None
        for a in alphas:
            w = np.linalg.solve(xs[t].T @ xs[t] + a * np.eye(xs.shape[1]), xs[t].T @ (y[t] - my))
            pred = xs @ w + my
            e = (pred - y)[v] if v.any() else (pred - y)[t]
            mae = np.abs(e).mean()
            if best is None or mae < best[0]:
                best = (mae, a, pred, max(float(e.std()), 1e-6))
        _, a, pred, sigma = best
        out = p[[*keys, "split", order]].assign(alpha=float(a), actual=y, pred=pred, sigma=sigma, q10=pred - z * sigma, q90=pred + z * sigma, prob=1 / (1 + np.exp(-np.clip(pred / sigma, -40, 40))))
        return out[~t]

    return rows.select(*keys, "split", order, target, *features).groupBy(*keys).applyInPandas(fit, schema)


def autoregression(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First-order autoregression per group: slope, intercept, and the next value it expects."""
    from tidemark.operators.sequence import by

    t = df.withColumn("_l", F.lag(value).over(by(keys, [order])))
    fit = t.groupBy(*keys).agg(F.regr_slope(value, "_l").alias("slope"), F.regr_intercept(value, "_l").alias("intercept"), F.max_by(value, order).alias("_last"))
    return fit.withColumn("next", F.col("intercept") + F.col("slope") * F.col("_last")).drop("_last")


def ewma_variance(df: DataFrame, keys: list[str], order: str, value: str, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted variance after the last row, as one weighted sum per group."""
    from pyspark.sql import Window as W

    from tidemark.operators.sequence import by

    w = by(keys, [order])
    t = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    weight = F.pow(F.lit(decay), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1 - decay)
    return t.groupBy(*keys).agg(F.sum(weight * F.col(value) * F.col(value)).alias("variance"))


def pooled(df: DataFrame, target: str, features: list[str], kind: str, train: str, seed: int = 7) -> DataFrame:
    """Predictions of the rows outside ``train`` by one Spark ML model fitted on the others.

    ``kind``: 'boosting' (gradient-boosted trees), 'svm' (linear) or 'logit' (classes
    weighted to equal mass). Rows with a null or NaN feature count as 0 in it.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tidemark.functions.numbers import finite

    x = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features")
    data = x.transform(df.withColumns({f"_f{i}": finite(c) for i, c in enumerate(features)})).withColumn("label", F.col(target).cast("double"))
    fit_on = data.where(train)
    if kind == "logit":
        n = fit_on.agg(F.avg("label").alias("p")).first()["p"] or 0.0
        fit_on = fit_on.withColumn("_w", F.when(F.col("label") > 0, 0.5 / max(n, 1e-6)).otherwise(0.5 / max(1 - n, 1e-6)))
    model = {
        "boosting": lambda: GBTRegressor(maxIter=10, maxDepth=3, seed=seed), "svm": lambda: LinearSVC(maxIter=20, regParam=0.01),
        "logit": lambda: LogisticRegression(maxIter=30, regParam=0.01, weightCol="_w"),
    }[kind]()
    if fit_on.isEmpty():
        return data.where(f"not ({train})").withColumn("prediction", F.lit(0.0))
    return model.fit(fit_on).transform(data.where(f"not ({train})"))
