"""Queries over ordered series, calendars and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import numbers as N
from tidemark.operators import asof as A
from tidemark.operators import sequence as S
from tidemark.plans import registry as R
from tidemark.plans.registry import define, register
from tidemark.session import load

SYM = ["symbol"]
_W = "OVER (PARTITION BY symbol ORDER BY date)"


def _w():
    return S.by(SYM, ["date"])


def _series(name: str, cols: dict, view=R.bars, sql_view: str = "bars") -> None:
    """Window expressions over one series per symbol, as (Spark column, SQL) pairs."""
    define(name, lambda s, d: view(s, d).select("symbol", "date", *(x[0]().alias(n) for n, x in cols.items())), "SELECT symbol, date, " + ", ".join(f"{x[1]} AS {n}" for n, x in cols.items()) + f" FROM {sql_view}")


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _gated(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} = {n} THEN {fn}({x}) {_frame(n)} END"


_series("win01_returns", {"r1": (lambda: F.round(S.change("close", _w()), 9), f"round(close / lag(close) {_W} - 1, 9)"), "r5": (lambda: F.round(S.change("close", _w(), 5), 9), f"round(close / lag(close, 5) {_W} - 1, 9)")})
_series("win02_log_return", {"r": (lambda: F.round(S.log_change("close", _w()), 9), f"round(ln(close) - ln(lag(close) {_W}), 9)")})
_series("win03_moving_averages", {f"ma{n}": ((lambda n=n: F.round(S.rolling(F.avg, "close", _w(), n), 6)), f"round({_gated('avg', 'close', n)}, 6)") for n in (5, 10, 20)} | {"v10": (lambda: F.round(S.rolling(F.avg, "volume", _w(), 10), 3), f"round({_gated('avg', 'volume', 10)}, 3)")})
_series("win04_rolling_std", {f"s{n}": ((lambda n=n: F.round(S.rolling(F.stddev_samp, "close", _w(), n), 5)), f"round({_gated('stddev_samp', 'close', n)}, 5)") for n in (10, 20)})
_series("win05_bands", {"z": (lambda: F.round(F.try_divide(F.col("close") - S.rolling(F.avg, "close", _w(), 20), F.nullif(F.round(S.rolling(F.stddev_samp, "close", _w(), 20), 7), F.lit(0.0))), 5), f"round((close - {_gated('avg', 'close', 20)}) / nullif(round({_gated('stddev_samp', 'close', 20)}, 7), 0), 5)"), "p": (lambda: F.round(F.try_divide(F.col("close"), S.rolling(F.avg, "close", _w(), 10)), 6), f"round(close / {_gated('avg', 'close', 10)}, 6)")})
_series("win07_difference", {"d": (lambda: F.coalesce(F.round(F.col("close") - F.lag("close").over(_w()), 6), F.lit(0.0)), f"coalesce(round(close - lag(close) {_W}, 6), 0)")})
_series("win09_forward_fill", {"v": (lambda: S.forward_fill("volume", _w()), f"last_value(volume IGNORE NULLS) {_W}")})
_series("win10_fill_both_ways", {"v": (lambda: F.coalesce(S.forward_fill("open", _w()), S.backward_fill("open", _w()), F.lit(0.0)), f"coalesce(last_value(open IGNORE NULLS) {_W}, first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)")})
_series("prj12_fill_zero", {"v": (lambda: F.coalesce(S.forward_fill("amount", _w()), F.lit(0.0)), f"coalesce(last_value(amount IGNORE NULLS) {_W}, 0)")})
_series("win11_lead_target", {f"t{k}": ((lambda k=k: F.round(F.try_divide(F.lead("close", k).over(_w()), F.col("close")) - 1, 9)), f"round(lead(close, {k}) {_W} / close - 1, 9)") for k in (1, 3)})
_series("win12_delay", {"r": (lambda: F.round(F.lag("pct_change", 1, 0.0).over(_w()), 6), f"round(lag(pct_change, 1, 0.0) {_W}, 6)")})
_series("win26_past_return", {"r": (lambda: F.round(F.try_divide(F.lag("close").over(_w()), F.lag("close", 2).over(_w())) - 1, 9), f"round(lag(close) {_W} / lag(close, 2) {_W} - 1, 9)")})
_series("win18_turnover", {"t": (lambda: F.round(N.clip(F.abs(F.col("turnover_rate") - F.lag("turnover_rate", 1, 0.0).over(_w())), 0, 5), 6), f"round(CASE WHEN turnover_rate IS NOT NULL AND lag(turnover_rate, 1, 0.0) {_W} IS NOT NULL THEN least(abs(turnover_rate - lag(turnover_rate, 1, 0.0) {_W}), 5) END, 6)")})
_series("win15_percent_rank", {"p": (lambda: F.round(S.percent_rank("turnover_rate", ["date"]), 9), "round(CASE WHEN turnover_rate IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY turnover_rate NULLS LAST) + (count(*) OVER (PARTITION BY date, turnover_rate) - 1) / 2.0) / count(turnover_rate) OVER (PARTITION BY date) END, 9)")})
_series("win21_segments", {"k": (lambda: F.ntile(5).over(_w()).cast("bigint"), f"ntile(5) {_W}")})
_series("dat10_time_index", {"t": (lambda: F.round((F.row_number().over(_w()) - 1) / F.greatest(F.count("*").over(W.partitionBy("symbol")) - 1, F.lit(1)), 9), f"round((row_number() {_W} - 1) / greatest(count(*) OVER (PARTITION BY symbol) - 1, 1), 9)")})
_series("win16_rank_average", {"r": (lambda: F.rank().over(W.partitionBy("symbol").orderBy("pred")) + (F.count("*").over(W.partitionBy("symbol", "pred")) - 1) / 2, "rank() OVER (PARTITION BY symbol ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, pred) - 1) / 2.0")}, R.preds, "preds")
_series("prj17_targets", {"t": (lambda: F.round("fwd", 9), "round(fwd, 9)"), "up": (lambda: (F.col("fwd") > 0).cast("int"), "(fwd > 0)::INT")}, lambda s, d: R.rets(s, d).where("fwd is not null"), "rets WHERE fwd IS NOT NULL")


@register("win06_rsi14", """WITH x AS (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS c FROM bars),
    y AS (SELECT symbol, date, CASE WHEN count(c) OVER w = 14 THEN avg(greatest(c, 0)) OVER w END AS g, CASE WHEN count(c) OVER w = 14 THEN avg(greatest(-c, 0)) OVER w END AS l
          FROM (SELECT symbol, date, c FROM x) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT symbol, date, round(100 - 100 / (1 + g / nullif(l, 0)), 5) AS rsi FROM y""")  # fmt: skip
def win06_rsi14(spark, d):
    return S.rsi(R.bars(spark, d), SYM, ["date"], "close", "rsi").select("symbol", "date", F.round("rsi", 5).alias("rsi"))




@register("win08_ewm", """WITH RECURSIVE o AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars),
    e AS (SELECT symbol, date, i, close AS m FROM o WHERE i = 1 UNION ALL
          SELECT o.symbol, o.date, o.i, (1 - 0.5 ** (1 / 5.0)) * o.close + 0.5 ** (1 / 5.0) * e.m FROM e JOIN o ON o.symbol = e.symbol AND o.i = e.i + 1)
    SELECT symbol, date, round(m, 5) AS m FROM e""")  # fmt: skip
def win08_ewm(spark, d):
    return S.ewm(R.bars(spark, d), SYM, "date", "close", 5, "m").select("symbol", "date", F.round("m", 5).alias("m"))


@register("win13_14_drawdown", """WITH c AS (SELECT symbol, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY date)) AS equity FROM rets WHERE ret IS NOT NULL)
    SELECT symbol, date, round(equity, 6) AS equity, round(equity / greatest(1.0, max(equity) OVER (PARTITION BY symbol ORDER BY date)) - 1, 6) + 0.0 AS drawdown FROM c""")  # fmt: skip
def win13_14_drawdown(spark, d):
    return S.drawdown(R.rets(spark, d).where("ret is not null"), SYM, "date", "ret").select("symbol", "date", F.round("equity", 6).alias("equity"), (F.round("drawdown", 6) + F.lit(0.0)).alias("drawdown"))


@register("win17_quantiles", "SELECT symbol, round(quantile_cont(pred, 0.1), 9) AS q10, round(quantile_cont(pred, 0.5), 9) AS q50, round(quantile_cont(pred, 0.9), 9) AS q90 FROM preds GROUP BY symbol")
def win17_quantiles(spark, d):
    return R.preds(spark, d).groupBy("symbol").agg(*(F.round(F.percentile("pred", q), 9).alias(n) for q, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))))


@register("win19_positions", """WITH RECURSIVE o AS (SELECT symbol, date, prob, actual, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM preds),
    s AS (SELECT symbol, date, i, actual, least(greatest(2 * prob - 0.6, 0), 0.6) AS want FROM o),
    e AS (SELECT symbol, date, i, CASE WHEN actual >= 0.05 AND least(want, 0.25) > 0 THEN 0.0 ELSE least(want, 0.25) END::DOUBLE AS p FROM s WHERE i = 1 UNION ALL
          SELECT s.symbol, s.date, s.i, CASE WHEN (s.actual >= 0.05 AND greatest(least(s.want - e.p, 0.25), -0.25) > 0) OR (s.actual <= -0.05 AND greatest(least(s.want - e.p, 0.25), -0.25) < 0) THEN e.p
                                             ELSE e.p + greatest(least(s.want - e.p, 0.25), -0.25) END FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)
    SELECT symbol, date, round(p, 6) + 0.0 AS position FROM e""")  # fmt: skip
def win19_positions(spark, d):
    p = R.preds(spark, d).withColumn("want", 2 * F.col("prob") - 0.6)
    return S.positions(p, SYM, "date", "want", "actual", 0.6, 0.25, 0.05).select("symbol", "date", (F.round("position", 6) + F.lit(0.0)).alias("position"))


@register("win20_lookback", """SELECT symbol, date, repeat(round(first_value(close) OVER w * 100)::BIGINT::VARCHAR || '|', (10 - count(*) OVER w)::INT) || array_to_string(list_transform(list(close) OVER w, lambda v: round(v * 100)::BIGINT::VARCHAR), '|') AS x, round((sum(close) OVER w + first_value(close) OVER w * (10 - count(*) OVER w)) / 10, 6) AS m FROM bars
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def win20_lookback(spark, d):
    b = R.bars(spark, d).withColumn("x", S.lookback(F.col("close"), _w(), 10))
    whole = F.concat_ws("|", F.transform("x", lambda v: F.round(v * 100, 0).cast("bigint").cast("string")))
    return b.select("symbol", "date", whole.alias("x"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x"), 6).alias("m"))


_SPLITS = (240, 60, 30, 30)


def _window_rows(spark, d):
    """Rows of each rolling window per symbol: a row's number gives its windows by arithmetic, nothing is joined."""
    train, val, test, step = _SPLITS
    size = train + val + test
    p = R.preds(spark, d).withColumn("rn", F.row_number().over(_w())).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    last = F.floor((F.col("n") - size) / step)
    first = F.greatest(F.ceil((F.col("rn") - size) / step), F.lit(0))
    most = F.least(F.floor((F.col("rn") - 1) / step), last)
    p = p.where(most >= first).withColumn("window_id", F.explode(F.sequence(first.cast("int"), most.cast("int"))))
    at = F.col("rn") - F.col("window_id") * step
    return p.withColumn("split", F.when(at <= train, "train").when(at <= train + val, "val").otherwise("test"))


_WINDOWS_SQL = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM preds),
    ww AS (SELECT o.*, k AS window_id, CASE WHEN rn - k * 30 <= 240 THEN 'train' WHEN rn - k * 30 <= 300 THEN 'val' ELSE 'test' END AS split
           FROM o, generate_series(0, 200) AS g(k) WHERE k * 30 + 330 <= n AND rn > k * 30 AND rn <= k * 30 + 330)"""


@register("win22_rolling_windows", _WINDOWS_SQL + " SELECT symbol, window_id, split, count(*) AS n, min(date) AS d0, max(date) AS d1 FROM ww GROUP BY ALL")
def win22_rolling_windows(spark, d):
    return _window_rows(spark, d).groupBy("symbol", F.col("window_id").cast("bigint").alias("window_id"), "split").agg(F.count("*").alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1"))


@register("prj11_fitted_scaler", _WINDOWS_SQL + """, f AS (SELECT symbol, window_id, avg(pred) AS m, stddev_pop(pred) AS s FROM ww WHERE split = 'train' GROUP BY ALL)
    SELECT ww.symbol, ww.window_id, ww.date, round((pred - m) / CASE WHEN s <= 1e-12 THEN 1 ELSE s END, 6) + 0.0 AS z FROM ww JOIN f ON ww.symbol = f.symbol AND ww.window_id = f.window_id WHERE split = 'test'""")
def prj11_fitted_scaler(spark, d):
    """Rows scaled by the mean and population deviation of the train rows of their window."""
    r = _window_rows(spark, d)
    w = W.partitionBy("symbol", "window_id")
    train = F.when(F.col("split") == "train", F.col("pred"))
    r = r.withColumn("m", F.avg(train).over(w)).withColumn("s", F.stddev_pop(train).over(w)).where("split = 'test'")
    z = (F.col("pred") - F.col("m")) / F.when(F.col("s") <= 1e-12, 1.0).otherwise(F.col("s"))
    return r.select("symbol", F.col("window_id").cast("bigint").alias("window_id"), "date", (F.round(z, 6) + F.lit(0.0)).alias("z"))


@register("win23_autocovariance", "WITH c AS (SELECT symbol, date, actual - avg(actual) OVER (PARTITION BY symbol) AS x FROM preds) SELECT symbol, round(sum(x * x) / count(*), 12) AS g0, round(sum(x * l) / count(*), 12) AS g1 FROM (SELECT symbol, x, lag(x) OVER (PARTITION BY symbol ORDER BY date) AS l FROM c) GROUP BY symbol")
def win23_autocovariance(spark, d):
    c = R.preds(spark, d).withColumn("x", F.col("actual") - F.avg("actual").over(W.partitionBy("symbol")))
    c = c.withColumn("l", F.lag("x").over(_w()))
    return c.groupBy("symbol").agg(F.round(F.sum(F.col("x") * F.col("x")) / F.count("*"), 12).alias("g0"), F.round(F.sum(F.col("x") * F.col("l")) / F.count("*"), 12).alias("g1"))


@register("win24_25_denoised")
def win24_25_denoised(spark, d):
    from tidemark.operators.denoise import causal_denoise

    return causal_denoise(R.bars(spark, d).select("symbol", "date", "close"), SYM, "date", "close")


@register("jon02_asof_macro", "SELECT b.symbol, b.date, m.month, round(m.level, 4) AS level FROM bars b ASOF LEFT JOIN macro m ON b.date >= m.release")
def jon02_asof_macro(spark, d):
    """Quotes with the macro figure released last; the release days are a calendar, so ranges of it are joined by day."""
    m = R.macro(spark, d)
    m = m.withColumn("until", F.coalesce(F.lead("release").over(W.orderBy("release")), F.lit("2100-01-01").cast("date")))
    days = m.select("month", "level", F.explode(F.sequence("release", F.least(F.date_sub("until", 1), F.date_add("release", 20000)))).alias("date"))
    b = R.bars(spark, d).select("symbol", "date")
    return b.join(days, "date", "left").select("symbol", "date", "month", F.round("level", 4).alias("level"))


@register("jon02_asof_by_symbol", "SELECT b.symbol, b.date, f.known, round(f.eps, 4) AS eps FROM bars b ASOF LEFT JOIN (SELECT symbol, known, arg_max(eps, fin_id) FILTER (eps IS NOT NULL) AS eps FROM fin GROUP BY symbol, known) f ON b.symbol = f.symbol AND b.date >= f.known")
def jon02_asof_by_symbol(spark, d):
    f = R.fin(spark, d).groupBy("symbol", F.col("known").alias("date")).agg(F.max_by("eps", F.when(F.col("eps").isNotNull(), F.col("fin_id"))).alias("eps"), F.min("known").alias("known"))
    b = R.bars(spark, d).select("symbol", "date")
    return A.asof_join(b, f, "date", ["symbol"], ["known", "eps"]).select("symbol", "date", "known", F.round("eps", 4).alias("eps"))


@register("jon05_calendar_impulse", """WITH c AS (SELECT g::DATE AS date FROM generate_series((SELECT min(date) FROM stock), (SELECT max(date) FROM stock), INTERVAL 1 DAY) AS t(g) WHERE isodow(g) < 6),
    m AS (SELECT *, level - lag(level) OVER (ORDER BY month) AS step FROM macro)
    SELECT c.date, (m.month IS NOT NULL)::INT AS released, round(coalesce(m.step, 0), 4) AS step FROM c LEFT JOIN m ON c.date = m.release""")  # fmt: skip
def jon05_calendar_impulse(spark, d):
    from tidemark.operators.relational import business_calendar

    cal = business_calendar(load(spark, d, "stock"), "date")
    m = R.macro(spark, d).withColumn("step", F.col("level") - F.lag("level").over(W.orderBy("month")))
    return cal.join(m, cal["date"] == m["release"], "left").select("date", F.col("month").isNotNull().cast("int").alias("released"), F.round(F.coalesce("step", F.lit(0.0)), 4).alias("step"))


@register("jon12_calendar_fill", """WITH c AS (SELECT symbol, g::DATE AS date FROM (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS g FROM bars GROUP BY symbol) WHERE isodow(g) < 6)
    SELECT c.symbol, c.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.date) AS close FROM c LEFT JOIN bars b ON c.symbol = b.symbol AND c.date = b.date""")  # fmt: skip
def jon12_calendar_fill(spark, d):
    b = R.bars(spark, d).select("symbol", "date", "close")
    c = b.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("z")).select("symbol", F.explode(F.sequence("a", "z")).alias("date")).where(F.weekday("date") < 5)
    return c.join(b, ["symbol", "date"], "left").select("symbol", "date", S.forward_fill("close", _w()).alias("close"))


@register("jon14_window_rows", _WINDOWS_SQL + " SELECT symbol, window_id, split, date FROM ww WHERE split <> 'train'")
def jon14_window_rows(spark, d):
    return _window_rows(spark, d).where("split <> 'train'").select("symbol", F.col("window_id").cast("bigint").alias("window_id"), "split", "date")


@register("src24_business_calendar", "SELECT g::DATE AS date FROM generate_series((SELECT min(date) FROM stock), (SELECT max(date) FROM stock), INTERVAL 1 DAY) AS t(g) WHERE isodow(g) < 6")
def src24_business_calendar(spark, d):
    from tidemark.operators.relational import business_calendar

    return business_calendar(load(spark, d, "stock"), "date")


@register("src25_month_ends", "SELECT last_day(g)::DATE AS month_end FROM generate_series((SELECT date_trunc('month', min(date)) FROM stock), (SELECT max(date) FROM stock), INTERVAL 1 MONTH) AS t(g)")
def src25_month_ends(spark, d):
    span = load(spark, d, "stock").agg(F.trunc(F.min("date"), "month").alias("a"), F.max("date").alias("z"))
    return span.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("m")).select(F.last_day("m").alias("month_end"))


