"""Numeric and array expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.text import c, let


def clip(x: Column | str, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c(x).isNotNull(), F.least(F.greatest(c(x), F.lit(float(low))), F.lit(float(high))))


def sigmoid(x: Column | str, bound: float | None = None) -> Column:
    return 1 / (1 + F.exp(-(clip(x, -bound, bound) if bound else c(x))))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))


def entropy(weights: Column | str) -> Column:
    return F.aggregate(F.filter(c(weights), lambda w: w > 1e-12), F.lit(0.0), lambda s, w: s - w * F.log(w))


def normal_p_value(z: Column | str) -> Column:
    """Two-sided p-value of a standard normal statistic (Spark has no erfc)."""

    def p(v: pd.Series) -> pd.Series:
        return v.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None)

    return F.pandas_udf(p, DoubleType())(c(z))


def masked_mean(values: Column | str, mask: Column | str) -> Column:
    """Mean of the values whose mask is not 0; null if there is none."""
    kept = F.filter(F.arrays_zip(c(values).alias("v"), c(mask).alias("m")), lambda x: x["m"] != 0)
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["v"].cast("double")), F.size(kept))


def softmax(x: Column | str) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, w: s + w), lambda t: F.transform(e, lambda v: v / t))

    return let(let(F.array_max(c(x)).cast("double"), lambda top: F.transform(c(x), lambda v: F.exp(v.cast("double") - top))), shares)


def arg_top(x: Column | str, k: int) -> Column:
    """(index, value) of the k largest values; ties fall to the smaller index."""
    s = F.transform(c(x), lambda v, i: F.struct((-v).alias("neg"), i.alias("index"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(s), 1, k), lambda v: F.struct(v["index"], v["value"]))


def fit_length(x: Column | str, n: int, pad: Column) -> Column:
    """The last n values, padded in front."""
    short = F.greatest(F.lit(n) - F.size(c(x)), F.lit(0))
    return F.concat(F.array_repeat(pad, short), F.slice(c(x), F.greatest(F.size(c(x)) - n + 1, F.lit(1)), n))


def pack(x: Column | str, digits: int = 6) -> Column:
    return F.concat_ws("|", F.transform(c(x), lambda v: F.round(v.cast("double"), digits).cast("string")))


def unpack(x: Column | str) -> Column:
    return F.transform(F.split(c(x), r"\|"), lambda v: v.try_cast("double"))


def finite(x: Column | str) -> Column:
    """0 for null, NaN and infinities."""
    v = c(x).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows with both values; null where one side has no spread."""
    both = c(a).isNotNull() & c(b).isNotNull()
    x, y = F.when(both, c(a).cast("double")), F.when(both, c(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
