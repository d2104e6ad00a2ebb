"""Cleaning, schema and calendar operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType, StructType


def conform(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` in its order: cast where possible (null where not), missing ones as default or null."""
    defaults = defaults or {}
    cols = []
    for f in schema:
        x = F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            x = F.coalesce(x, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(x.alias(f.name))
    return df.select(*cols)


def business_calendar(df: DataFrame, day: str) -> DataFrame:
    """Mondays to Fridays from the first to the last day of a table."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("z")).select(F.explode(F.sequence("a", "z")).alias("date")).where(F.weekday("date") < 5)


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns that hold none of the ``skip`` parts."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and not any(s in f.name for s in skip)]


def safe_name(name: str) -> str:
    return "_".join("".join(x if x.isalnum() else " " for x in name.lower()).split())


def exact_quantiles(df: DataFrame, column: str, qs: list[float], accuracy: int = 100_000) -> list[float] | None:
    """Linear-interpolated quantiles of a whole column; None for a column without values.

    A mergeable sketch brackets each quantile; the values of the brackets alone, about
    2 / ``accuracy`` of the rows per quantile, are counted and accumulated, and the
    ranks in question read off. No task ever sees all values.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    at = sorted({min(max(p, 0.0), 1.0) for q in qs for p in (q - 2 / accuracy, q + 2 / accuracy)})
    first = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", at, accuracy).alias("a")).first()
    n = first["n"]
    if not n:
        return None
    bound = dict(zip(at, first["a"], strict=True))
    spans = [(bound[min(max(q - 2 / accuracy, 0.0), 1.0)], bound[min(max(q + 2 / accuracy, 0.0), 1.0)]) for q in qs]
    spans = [(first["lo"] if q * n < 4 else a, first["hi"] if (1 - q) * n < 4 else b) for q, (a, b) in zip(qs, spans, strict=True)]
    below = x.agg(*(F.count_if(F.col("x") < a).alias(f"b{i}") for i, (a, _) in enumerate(spans))).first()
    out = []
    for i, (q, (a, b)) in enumerate(zip(qs, spans, strict=True)):
        inside = x.where((F.col("x") >= a) & (F.col("x") <= b)).groupBy("x").count()
        ranked = inside.withColumn("upto", F.sum("count").over(W.orderBy("x")) + below[f"b{i}"])
        pos = q * (n - 1)
        need = (int(pos), min(int(pos) + 1, n - 1))
        r = ranked.agg(*(F.min(F.when(F.col("upto") > k, F.col("x"))).alias(f"k{j}") for j, k in enumerate(need))).first()
        lo, hi = r["k0"], r["k1"] if r["k1"] is not None else x.where(F.col("x") > b).agg(F.min("x")).first()[0]
        out.append(lo + (hi - lo) * (pos - int(pos)))
    return out


def winsorise(df: DataFrame, columns: list[str], low: float, high: float, least: int = 20) -> DataFrame:
    """Columns clipped to their exact quantiles over the whole table, where it has at least ``least`` values."""
    if not 0 < low < high < 1:
        return df
    counts = df.agg(*(F.count(x).alias(x) for x in columns)).first()
    for x in columns:
        if counts[x] >= least:
            a, b = exact_quantiles(df, x, [low, high])
            df = df.withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.lit(a)), F.lit(b))))
    return df


def scale(df: DataFrame, weight: float, skip: tuple[str, ...]) -> DataFrame:
    return df.withColumns({x: F.col(x) * weight for x in numeric_columns(df, skip)})


def mask(df: DataFrame, columns: list[str], arrays: dict[str, Column] | None = None) -> DataFrame:
    """Numeric columns set to 0, and array columns replaced."""
    return df.withColumns({x: F.lit(0.0) for x in columns} | (arrays or {}))


def outer_join(feeds: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of feeds that share their keys only."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.join(f, keys, "full")
    return out


def melt(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(keys, values, "name", "value")
