"""From predictions to positions: signals, trials over a grid, scores, overlays and selection.

Everything is in long form: one row per (key, source, signal, threshold, time), so a grid
of trials is one plan over partial aggregates and windows per trial, and nothing is looped
over on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import numbers as N
from tidemark.operators import sequence
from tidemark.operators.evaluate import mean_t

#: Scores of a series of returns.
METRICS = ("return", "tstat", "significance", "calmar", "balanced", "sharpe")


@dataclass(frozen=True)
class Rules:
    """Bounds of positions and costs. ``turnover`` below ``most`` or a finite ``limit`` make positions depend on the day before."""

    most: float = 1.0
    turnover: float = 1.0
    limit: float = 0.2
    cost: float = 0.002
    floor: float = 0.005
    least_exposure: float = 0.25
    most_exposure: float = 0.7
    target_exposure: float = 0.45
    positive_probability: bool = False
    positive_return: bool = False


def _f(name: str, other: float | None = None) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(other).cast("double")) if other is not None else F.col(name).cast("double")


def signals(keys: list[str], external: str | None = None) -> dict[str, Column]:
    """Signals of a prediction row by name, over columns pred, prob, q10 and q90; ranks are shares within ``keys``, ties at their average."""
    pred, prob = _f("pred", 0.0), _f("prob", 0.5)
    ext = _f(external, 0.0) if external else pred
    width = F.greatest(F.abs(F.coalesce("q90", pred) - F.coalesce("q10", pred)), F.lit(1e-4))
    rank = lambda x: sequence.percent_rank(x, keys)
    up = lambda x: F.greatest(x, F.lit(0.0))
    return {
        "return": pred, "prob": prob, "risk_adjusted": pred / width, "hybrid": up(pred) * up(prob - 0.5), "prob_return": rank(pred) + rank(prob),
        "inv_return": -pred, "inv_prob": -prob, "inv_hybrid": up(-pred) * up(0.5 - prob),
        "external": ext, "external_prob_return": rank(ext) + rank(prob), "external_hybrid": up(ext) * up(prob - 0.5),
        "inv_external": -ext, "inv_external_prob_return": rank(-ext) + rank(1 - prob), "inv_external_hybrid": up(-ext) * up(0.5 - prob),
        "external_position": ext,
    }


def signal_rows(df: DataFrame, keys: list[str], order: str, keep: list[str], names: list[str] | None = None, external: str | None = None) -> DataFrame:
    """(keys, order, keep, signal, value): the signals of every row in long form."""
    of = signals(keys, external)
    names = list(of) if names is None else names
    wide = df.select(*keys, order, *keep, *(of[n].alias(f"_s_{n}") for n in names))
    pairs = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(f"_s_{n}").alias("value")) for n in names))
    return wide.select(*keys, order, *keep, F.explode(pairs).alias("_p")).select(*keys, order, *keep, "_p.*")


def desired(rules: Rules) -> Column:
    """Position asked for by value, threshold and scale, between 0 and the largest, under the filters."""
    p = N.clip((F.col("value") - F.col("threshold")) / F.greatest(F.abs("scale"), F.lit(1e-8)), 0, 1) * rules.most
    if rules.positive_probability:
        p = F.when(F.col("prob") >= 0.5, p).otherwise(0.0)
    if rules.positive_return:
        p = F.when(F.col("pred") >= 0, p).otherwise(0.0)
    return p


def held(df: DataFrame, keys: list[str], order: str, rules: Rules) -> DataFrame:
    """``df`` with position: what is asked for in ``want``, moved by at most the turnover and not against a limit day."""
    if rules.turnover >= rules.most and rules.limit == float("inf"):
        return df.withColumn("position", N.clip(F.coalesce("want", F.lit(0.0)), 0, rules.most))
    got = sequence.positions(df, keys, order, "want", "actual", rules.most, rules.turnover, rules.limit)
    return df.join(got, [*keys, order])


def overlay(position: Column, volatility: Column, last_return: Column, vol_threshold: Column, drop_threshold: Column, scale: Column) -> Column:
    """The position times ``scale`` on days of high volatility or after a fall."""
    risky = (F.abs(F.coalesce(volatility, F.lit(0.0))) >= vol_threshold) | (F.coalesce(last_return, F.lit(0.0)) <= drop_threshold)
    return F.greatest(position * F.when(risky, N.clip(scale, 0, 1)).otherwise(1.0), F.lit(0.0))


def returns(df: DataFrame, keys: list[str], order: str, rules: Rules) -> DataFrame:
    """``df`` with turnover and net return ``r`` of its positions on ``actual``, which counts up to the price limit."""
    w = sequence.by(keys, [order])
    moved = F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w))
    actual = N.clip(F.coalesce("actual", F.lit(0.0)), -rules.limit, rules.limit)
    out = df.withColumn("turnover", F.least(moved, F.lit(min(rules.most, rules.turnover))))
    return out.withColumn("r", F.greatest(F.col("position") * actual - F.col("turnover") * rules.cost, F.lit(-1 + 1e-6)))


def scores(df: DataFrame, keys: list[str], order: str, per_year: int = 252) -> DataFrame:
    """(keys, one column per metric, risk_adjusted, n) of the returns ``r``; a key without rows has no row."""
    w = sequence.by(keys, [order]).rowsBetween(W.unboundedPreceding, 0)
    c = df.withColumn("_e", F.exp(F.sum(F.log1p("r")).over(w)))
    # The first score counts the start as a peak, the risk-adjusted one the first day.
    c = c.withColumn("_d", F.col("_e") / F.greatest(F.lit(1.0), F.max("_e").over(w)) - 1).withColumn("_d1", F.col("_e") / F.max("_e").over(w) - 1)
    down = F.when(F.col("r") < 0, F.col("r"))
    g = c.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("r").alias("m"), mean_t("r").alias("tstat"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("return"),
        (N.safe_divide(F.avg("r"), F.stddev_pop("r")) * per_year**0.5).alias("sharpe"), F.abs(F.min("_d")).alias("dd"), F.min("_d1").alias("dd1"),
        F.coalesce(F.stddev_samp(down), F.stddev_samp("r")).alias("ds"), F.count(down).alias("dn"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"),
    )
    g = g.withColumn("calmar", N.safe_divide(F.pow(1 + F.col("return"), per_year / F.col("n")) - 1, F.col("dd")))
    t, least = F.tanh, F.least(F.col("dd"), F.lit(1.0))
    g = g.withColumn("significance", 0.45 * t(F.col("tstat") / 2) + 0.25 * t(F.col("return") * 3) + 0.2 * t(F.col("sharpe") / 2) + 0.1 * t(F.col("calmar") / 3) - 0.15 * least)
    g = g.withColumn("balanced", 0.4 * t(F.col("sharpe") / 2) + 0.3 * t(F.col("return") * 2) + 0.2 * t(F.col("calmar") / 3) - 0.1 * least)
    spread = F.when(F.col("dn") > 1, F.col("ds")).otherwise(F.col("sd"))
    sortino = N.safe_divide(F.col("m"), spread / per_year**0.5)
    g = g.withColumn("risk_adjusted", F.when(F.col("n") >= 2, 0.45 * F.col("tstat") + 0.35 * t(F.col("return") * 2) + 0.15 * t(sortino / 2) + 0.05 * F.col("dd1")))
    return g.select(*keys, "n", *METRICS, "risk_adjusted")


def thresholds(long: DataFrame, keys: list[str], quantiles: list[float], rules: Rules) -> DataFrame:
    """(keys, signal, quantile, threshold, scale): where signals are cut, one threshold where a signal does not vary."""
    q = long.groupBy(*keys, "signal").agg(F.percentile("value", quantiles).alias("t"), F.greatest(F.stddev_pop("value"), F.lit(rules.floor)).alias("scale"), (F.min("value") < F.max("value")).alias("_v"))
    each = F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), F.col("t").alias("t"))
    q = q.select(*keys, "signal", "scale", F.explode(F.when(F.col("_v"), each).otherwise(F.slice(each, 1, 1))).alias("x"))
    return q.select(*keys, "signal", F.col("x.q").alias("quantile"), F.col("x.t").alias("threshold"), "scale")


def trials(df: DataFrame, keys: list[str], order: str, quantiles: list[float], rules: Rules, names: list[str] | None = None, external: str | None = None) -> DataFrame:
    """(keys, signal, quantile, order, position, turnover, r, threshold, scale): every signal at every threshold, simulated."""
    long = signal_rows(df, keys, order, ["actual", "pred", "prob"], names, external)
    grid = thresholds(long, keys, quantiles, rules)
    t = long.join(grid, [*keys, "signal"]).withColumn("want", desired(rules))
    by = [*keys, "signal", "quantile"]
    return returns(held(t, by, order, rules), by, order, rules)


def search(df: DataFrame, keys: list[str], order: str, quantiles: list[float], rules: Rules, metric: str = "sharpe", names: list[str] | None = None, external: str | None = None,
           segments: int = 4, worst_weight: float = 0.3, least_positive: float = 0.0) -> DataFrame:
    """The best signal and threshold per key, or the fallback where no trial's exposure lies in the band.

    A trial scores by ``metric`` over all rows, mixed with the median and the worst of its
    segments, less what its exposure is off the target and what its share of positive
    segments lacks. Ties fall to the smaller signal, then the smaller quantile.
    """
    t = trials(df, keys, order, quantiles, rules, names, external)
    by = [*keys, "signal", "quantile"]
    seg = scores(t.withColumn("_k", F.ntile(segments).over(sequence.by(by, [order]))), [*by, "_k"], order).groupBy(*by).agg(
        F.percentile(metric, 0.5).alias("_m"), F.min(metric).alias("worst"), F.avg((F.col(metric) > 0).cast("int")).alias("positive"))
    every = scores(t, by, order).join(t.groupBy(*by).agg(F.avg((F.col("position") > 0).cast("int")).alias("exposure"), F.first("threshold").alias("threshold"), F.first("scale").alias("scale")), by).join(seg, by)
    off = 2 * F.abs(F.col("exposure") - rules.target_exposure) + 4 * F.greatest(F.lit(least_positive) - F.col("positive"), F.lit(0.0))
    mixed = (1 - worst_weight) * (0.5 * F.col(metric) + 0.5 * F.col("_m")) + worst_weight * F.col("worst")
    ok = every.where(F.col("exposure").between(rules.least_exposure, rules.most_exposure)).withColumn("score", mixed - off)
    pick = F.struct((-F.round("score", 9)).alias("s"), "signal", "quantile", "threshold", "scale", "exposure", "positive", "worst")
    best = ok.groupBy(*keys).agg(F.min(pick).alias("b")).select(*keys, "b.signal", "b.threshold", "b.scale", (-F.col("b.s")).alias("score"), "b.exposure", "b.positive", "b.worst")
    return fallback(df, keys, order, rules).join(best, keys, "left").select(
        *keys, F.coalesce("signal", "_signal").alias("signal"), F.coalesce("threshold", "_threshold").alias("threshold"), F.coalesce("scale", "_scale").alias("scale"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"), "positive", "worst")


def fallback(df: DataFrame, keys: list[str], order: str, rules: Rules, name: str = "hybrid") -> DataFrame:
    """(keys, _signal, _threshold, _scale) without a search: cut where the target exposure lies."""
    s = signal_rows(df, keys, order, [], [name])
    return s.groupBy(*keys).agg(F.lit(name).alias("_signal"), F.percentile("value", 1 - rules.target_exposure).alias("_threshold"), F.greatest(F.stddev_pop("value"), F.lit(rules.floor)).alias("_scale"))


def apply(df: DataFrame, params: DataFrame, keys: list[str], order: str, rules: Rules) -> DataFrame:
    """``df`` with value, position, turnover and r under each key's signal, threshold and scale."""
    long = signal_rows(df, keys, order, ["actual", "pred", "prob"])
    t = long.join(params.select(*keys, "signal", "threshold", "scale"), [*keys, "signal"]).withColumn("want", desired(rules))
    return returns(held(t, keys, order, rules), keys, order, rules)


def select_source(scored: DataFrame, keys: list[str], preferred: list[str], bonus: float, least_score: float = 0.0, least_positive: float = 0.0) -> DataFrame:
    """The source with the best score per key; preferred ones that are good enough get a bonus. Ties fall to 'main', then by name."""
    liked = F.col("source").isin(preferred) & (F.col("score") >= least_score) & (F.coalesce("positive", F.lit(0.0)) >= least_positive)
    s = scored.withColumn("selection", F.col("score") + F.when(liked, F.lit(bonus)).otherwise(0.0))
    pick = F.struct((-F.round("selection", 9)).alias("s"), (F.col("source") != "main").alias("m"), "source", "score")
    return s.groupBy(*keys).agg(F.min(pick).alias("b")).select(*keys, "b.source", "b.score", (-F.col("b.s")).alias("selection"))


def inverse_candidates(positions: DataFrame, keys: list[str], order: str, rules: Rules, least_return: float = 0.0) -> DataFrame:
    """(keys, order, source, position, actual) with each source's positions turned round, where these vary and return enough."""
    by = [*keys, "source"]
    turned = positions.withColumn("source", F.concat(F.lit("inverse_"), "source")).withColumn("position", N.clip(rules.most - F.col("position"), 0, rules.most))
    good = returns(turned, by, order, rules).groupBy(*by).agg(F.stddev_pop("position").alias("_s"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("_r"))
    good = good.where((F.col("_s") > 1e-12) & (F.col("_r") >= least_return))
    return positions.unionByName(turned.join(good.select(*by), by, "left_semi"))


def overlay_search(df: DataFrame, keys: list[str], order: str, rules: Rules, quantiles: list[float], drops: list[float], scales: list[float], least_ratio: float = 0.85, least_rows: int = 8) -> DataFrame:
    """The overlay per key that raises the risk-adjusted score while keeping ``least_ratio`` of a positive return; keys without one are left out.

    ``df`` has position, actual, volatility and last_return.
    """
    q = df.groupBy(*keys).agg(F.percentile(F.abs(F.coalesce("volatility", F.lit(0.0))), quantiles).alias("v"))
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("drop"), F.lit(s).alias("scale")) for i in range(len(quantiles)) for d in drops for s in scales))
    g = q.select(*keys, "v", F.explode(grid).alias("g")).select(*keys, "g.*", F.get("v", F.col("g.i")).alias("vol"))
    by = [*keys, "i", "drop", "scale"]
    t = df.join(g, keys).withColumn("position", overlay(F.col("position"), F.col("volatility"), F.col("last_return"), F.col("vol"), F.col("drop"), F.col("scale")))
    tried = scores(returns(t, by, order, rules), by, order).join(g, by)
    base = scores(returns(df, keys, order, rules), keys, order).where(F.col("n") >= least_rows).select(*keys, F.col("return").alias("_b"), F.col("risk_adjusted").alias("_s"))
    ok = tried.join(base, keys).where((F.col("return") >= F.when(F.col("_b") > 0, F.col("_b") * least_ratio).otherwise(F.col("_b"))) & (F.col("risk_adjusted") > F.col("_s")))
    pick = F.struct((-F.round("risk_adjusted", 9)).alias("s"), "vol", "drop", "scale")
    return ok.groupBy(*keys).agg(F.min(pick).alias("b")).select(*keys, "b.vol", "b.drop", "b.scale", (-F.col("b.s")).alias("score"))


def actions(position: Column, before: Column) -> Column:
    """What a change of position means."""
    d = position - before
    return F.when(d > 1e-8, "buy_or_add").when(d < -1e-8, "sell_or_reduce").when(position > 1e-8, "hold_long").otherwise("hold_cash")


def direction_candidates(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the logistic of the return, its blend with the probability, and the return over its interval."""
    scale = df.groupBy(*keys).agg(F.percentile(F.abs("pred"), 0.75).alias("_q"), F.stddev_pop("pred").alias("_sd"))
    s = F.when(F.col("_q") > 1e-6, F.col("_q")).otherwise(F.greatest("_sd", F.lit(1e-3)))
    d = df.join(scale, keys).withColumn("return_prob", N.sigmoid(F.col("pred") / s, 12)).drop("_q", "_sd")
    width = F.greatest(F.abs(F.coalesce("q90", "pred") - F.coalesce("q10", "pred")), F.lit(1e-4))
    return d.withColumn("prob_return_blend", 0.55 * F.col("prob") + 0.45 * F.col("return_prob")).withColumn("risk_adjusted_return", F.col("pred") / width)
