"""Merging of feeds, rollups of scores, and search over folds and seeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.relational import outer_join


def union_feeds(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of all feeds with the name of theirs; columns a feed lacks are null."""
    out = None
    for name, df in frames.items():
        one = df.withColumn("feed", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def merge_feeds(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of feeds that each have at most one row per key."""
    return outer_join(frames, keys)


def fill_gaps(first: DataFrame, second: DataFrame, period: Column, least: int, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` from periods in which ``first`` has fewer than ``least``; equal keys once, the first feed's row before the second's."""
    a, b = first.withColumn("_p", period).withColumn("_o", F.lit(0)), second.withColumn("_p", period).withColumn("_o", F.lit(1))
    enough = a.groupBy("_p").count().where(F.col("count") >= least).select("_p")
    rows = a.unionByName(b.join(enough, "_p", "left_anti").select(*a.columns))
    rest = [c for c in first.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_o", *rest)).alias("_r")).select(*keys, "_r.*")


def month_end_snapshots(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """(keys, month_end, value): the last value known at every month's end between a key's first and last row."""
    last = df.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day(day).alias("month_end")).agg(F.max_by(value, day).alias(value))
    span = df.groupBy(*keys).agg(F.min(F.last_day(day)).alias("a"), F.max(F.last_day(day)).alias("z"))
    months = span.select(*keys, F.explode(F.sequence(F.trunc("a", "month"), F.trunc("z", "month"), F.expr("interval 1 month"))).alias("m")).select(*keys, F.last_day("m").alias("month_end"))
    w = W.partitionBy(*keys).orderBy("month_end").rowsBetween(W.unboundedPreceding, 0)
    return months.join(last, [*keys, "month_end"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def weigh_prefixes(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Columns whose name begins with a prefix, times its weight; null counts as 0 there."""
    new = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c in df.columns for p, w in weights.items() if c.startswith(p) and abs(w - 1) >= 1e-12}
    return df.withColumns(new) if new else df


def without_prefixes(df: DataFrame, prefixes: list[str]) -> DataFrame:
    return df.drop(*(c for c in df.columns if any(c.startswith(p) for p in prefixes)))


def suspicious_names(names: list[str], tokens: list[str]) -> list[str]:
    """Names that hold a token, whatever the case."""
    pattern = re.compile("|".join(map(re.escape, tokens)), re.IGNORECASE)
    return [n for n in names if pattern.search(n)]


def event_contributions(df: DataFrame, events: str, k: int) -> DataFrame:
    """The k events of the largest mean weight over all rows' arrays of struct(uid, title, weight); an event goes by its uid, else by its title."""
    e = df.select(F.explode(events).alias("e")).select(F.coalesce(F.nullif(F.trim("e.uid"), F.lit("")), F.nullif(F.trim("e.title"), F.lit(""))).alias("key"), F.col("e.weight").cast("double").alias("weight"), F.col("e.title").alias("title"))
    g = e.where("key is not null").groupBy("key").agg(F.min("title").alias("title"), F.avg(F.coalesce("weight", F.lit(0.0))).alias("mean_weight"), F.count("*").alias("count"))
    return g.orderBy(F.desc(F.round("mean_weight", 9)), "key").limit(k)


def folds(df: DataFrame, keys: list[str], order: str, splits: int) -> DataFrame:
    """Rows of expanding folds: (…, fold, part), where fold k trains on all before its test block of n / (splits + 1) rows."""
    w = W.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    size = F.floor(F.col("_n") / (splits + 1))
    start = lambda k: F.col("_n") - (splits - k) * size
    part = lambda k: F.when(F.col("_i") < start(k), "train").when(F.col("_i") < start(k) + size, "test")
    each = F.filter(F.array(*(F.struct(F.lit(k).alias("fold"), part(k).alias("part")) for k in range(splits))), lambda x: x["part"].isNotNull())
    return d.withColumn("_f", F.explode(each)).select(*df.columns, "_f.*")


def select_penalty(df: DataFrame, keys: list[str], order: str, x: str, y: str, penalties: list[float], splits: int = 3) -> DataFrame:
    """The ridge penalty of one regressor with the least mean squared error over expanding folds, per key; ties fall to the smaller.

    A fold's fit needs its sums alone, so all penalties of all folds come from one pass of partial sums.
    """
    f = folds(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, order, splits)
    by = [*keys, "fold"]
    fit = f.where("part = 'train'").groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.covar_pop(x, y) * F.count("*")).alias("_xy"), (F.var_pop(x) * F.count("*")).alias("_xx"))
    fit = fit.withColumn("_a", F.explode(F.array(*map(F.lit, penalties)))).withColumn("_b", F.try_divide("_xy", F.col("_xx") + F.col("_a")))
    e = f.where("part = 'test'").join(fit, by).withColumn("_e", F.col("_my") + F.coalesce("_b", F.lit(0.0)) * (F.col(x) - F.col("_mx")) - F.col(y))
    mse = e.groupBy(*keys, F.col("_a").alias("penalty"), "fold").agg(F.avg(F.col("_e") * F.col("_e")).alias("_s")).groupBy(*keys, "penalty").agg(F.avg("_s").alias("mse"))
    return mse.groupBy(*keys).agg(F.min(F.struct(F.round("mse", 12).alias("mse"), "penalty")).alias("b")).select(*keys, "b.penalty", "b.mse")


def seeded(df: DataFrame, row: Column, seeds: list[int], share: int = 80) -> DataFrame:
    """Each row once for every seed whose draw of rows holds it: ``share`` of a hundred, by arithmetic on the row's number."""
    drawn = F.pmod((row + 1) * F.lit(7919) + F.col("seed") * F.lit(104729) + F.pmod((row + 3) * (F.col("seed") + 11), F.lit(9973)), F.lit(100)) < share
    return df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).where(drawn)
