"""Operators over ordered series, always partitioned by entity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import c


def by(keys: list[str], order: list) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def change(x: Column | str, w: WindowSpec, k: int = 1) -> Column:
    return F.try_divide(c(x), F.lag(c(x), k).over(w)) - 1


def log_change(x: Column | str, w: WindowSpec) -> Column:
    return F.log(c(x)) - F.log(F.lag(c(x)).over(w))


def rolling(fn, x: Column | str, w: WindowSpec, n: int) -> Column:
    """An aggregate of the last n rows, null until n values are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c(x)).over(f) == n, fn(c(x)).over(f))


def rsi(df: DataFrame, keys: list[str], order: list, value: str, out: str, n: int = 14) -> DataFrame:
    """Relative strength with simple means of gains and losses; null before n changes and where nothing was lost."""
    w = by(keys, order)
    f = w.rowsBetween(-(n - 1), 0)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    gain, loss = (F.when(F.count("_d").over(f) == n, F.avg(F.greatest(x, F.lit(0.0))).over(f)) for x in (F.col("_d"), -F.col("_d")))
    return d.withColumn("_g", gain).withColumn("_l", loss).withColumn(out, 100 - 100 / (1 + F.try_divide("_g", F.nullif("_l", F.lit(0.0))))).drop("_d", "_g", "_l")


def forward_fill(x: Column | str, w: WindowSpec) -> Column:
    return F.last(c(x), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def backward_fill(x: Column | str, w: WindowSpec) -> Column:
    return F.first(c(x), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def percent_rank(x: Column | str, part: list[str]) -> Column:
    """Rank as a share of the rows, ties at their average; null stays null."""
    w = W.partitionBy(*part)
    ties = F.count("*").over(W.partitionBy(*part, c(x)))
    r = F.rank().over(w.orderBy(c(x).asc_nulls_last())) + (ties - 1) / 2
    return F.when(c(x).isNotNull(), r / F.count(c(x)).over(w))


def _per_series(df: DataFrame, keys: list[str], order: str, out: str, f: Callable[[pd.DataFrame], np.ndarray], *values: str) -> DataFrame:
    """(keys, order, ``out``) with ``f`` of each entity's rows in order; an entity holds at most one row per time."""
    kinds = dict(df.dtypes)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable").reset_index(drop=True)
        r = p[[*keys, order]].copy()
        r[out] = f(p)
        return r

    return df.select(*keys, order, *values).groupBy(*keys).applyInPandas(one, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, order)) + f", `{out}` double")


def ewm(df: DataFrame, keys: list[str], order: str, value: str, halflife: float, out: str) -> DataFrame:
    """Exponentially weighted mean with the weight of the last value 1 - 0.5^(1/halflife), in one pass per entity."""
    return _per_series(df, keys, order, out, lambda p: p[value].astype(float).ewm(halflife=halflife, adjust=False).mean().to_numpy(), value)


def positions(df: DataFrame, keys: list[str], order: str, desired: str, move: str, most: float, turnover: float, limit: float) -> DataFrame:
    """Positions under a cap on size and turnover, unmoved on days the series moves by more than ``limit``; null asks for 0."""

    def fold(p: pd.DataFrame) -> np.ndarray:
        held, out = 0.0, np.zeros(len(p))
        want = np.clip(np.nan_to_num(p[desired].to_numpy(dtype=float)), 0.0, most)
        moves = p[move].to_numpy(dtype=float)
        for i, (w, m) in enumerate(zip(want, moves, strict=True)):
            delta = min(max(w - held, -turnover), turnover)
            if not (m >= limit and delta > 0 or m <= -limit and delta < 0):
                held += delta
            out[i] = held
        return out

    return _per_series(df, keys, order, "position", fold, desired, move)


def drawdown(df: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """Compounded curve and its distance from the running peak."""
    w = by(keys, [order]).rowsBetween(W.unboundedPreceding, 0)
    curve = df.withColumn("equity", F.exp(F.sum(F.log1p(F.col(ret))).over(w)))
    return curve.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)


def lookback(x: Column, w: WindowSpec, n: int) -> Column:
    """The last n values, padded in front with the first of them."""
    a = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    return F.concat(F.array_repeat(F.element_at(a, 1), n - F.size(a)), a)


def rolling_windows(n_rows: int, train: int, val: int, test: int, step: int) -> list[tuple[int, str, int, int]]:
    """(window, split, first row, last row) with rows counted from 1, as many windows as fit."""
    out, start, k = [], 1, 0
    while start + train + val + test - 1 <= n_rows:
        a, b = start + train, start + train + val
        out += [(k, "train", start, a - 1), (k, "val", a, b - 1), (k, "test", b, b + test - 1)]
        start, k = start + step, k + 1
    return out
