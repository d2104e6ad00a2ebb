"""Queries of models, decisions and evaluation over predictions per symbol."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import numbers as N
from tidemark.operators import decide as D
from tidemark.operators import evaluate as E
from tidemark.operators import models as M
from tidemark.operators import sequence as S
from tidemark.plans import registry as R
from tidemark.plans.registry import register

K = ["symbol"]


def _rounded(g, cols: dict, n: int = 6):
    return g.agg(*((F.round(v, n) + F.lit(0.0)).alias(k) for k, v in cols.items()))


@register("ml01_naive", "SELECT symbol, date, round(pred, 9) AS pred, round(prob, 9) AS prob, round(pred - 1.2816 * s, 9) AS q10, round(pred + 1.2816 * s, 9) AS q90 FROM (SELECT *, stddev_pop(actual - pred) OVER (PARTITION BY symbol) AS s FROM preds)")
def ml01_naive(spark, d):
    p = R.preds(spark, d).withColumn("s", F.stddev_pop(F.col("actual") - F.col("pred")).over(W.partitionBy("symbol")))
    return p.select("symbol", "date", *(F.round(x, 9).alias(n) for n, x in (("pred", F.col("pred")), ("prob", F.col("prob")), ("q10", F.col("pred") - 1.2816 * F.col("s")), ("q90", F.col("pred") + 1.2816 * F.col("s")))))


@register("ml02_ridge", """WITH t AS (SELECT symbol, actual AS y, (pred - avg(pred) OVER w) / CASE WHEN stddev_pop(pred) OVER w < 1e-8 THEN 1 ELSE stddev_pop(pred) OVER w END AS x, stddev_pop(pred) OVER w AS s, avg(pred) OVER w AS m FROM preds WINDOW w AS (PARTITION BY symbol))
    SELECT symbol, round(sum(x * (y - my)) / (sum(x * x) + 1.0) / any_value(CASE WHEN s < 1e-8 THEN 1 ELSE s END), 6) AS slope FROM (SELECT *, avg(y) OVER (PARTITION BY symbol) AS my FROM t) GROUP BY symbol""")  # fmt: skip
def ml02_ridge(spark, d):
    return M.ridge(R.preds(spark, d), K, "actual", ["pred"], 1.0).select("symbol", F.round(F.col("coef")[0], 6).alias("slope"))


@register("ml03_autoregression", "SELECT symbol, round(regr_slope(ret, l), 6) AS slope, round(regr_intercept(ret, l), 9) AS intercept FROM (SELECT symbol, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS l FROM rets) GROUP BY symbol")
def ml03_autoregression(spark, d):
    return M.autoregression(R.rets(spark, d), K, "date", "ret").select("symbol", F.round("slope", 6).alias("slope"), F.round("intercept", 9).alias("intercept"))


@register("ml04_ewma_variance", "SELECT symbol, round(sum(0.94 ** (n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.06 END * ret * ret), 9) AS variance FROM (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL) GROUP BY symbol")
def ml04_ewma_variance(spark, d):
    return M.ewma_variance(R.rets(spark, d), K, "date", "ret").select("symbol", F.round("variance", 9).alias("variance"))


@register("ml15_pinball", "SELECT symbol, round(avg(greatest((actual - q10) * 0.1, (actual - q10) * -0.9)), 6) AS p10, round(avg(greatest((actual - q90) * 0.9, (actual - q90) * -0.1)), 6) AS p90 FROM preds GROUP BY symbol")
def ml15_pinball(spark, d):
    return _rounded(R.preds(spark, d).groupBy("symbol"), {"p10": E.pinball("actual", "q10", 0.1), "p90": E.pinball("actual", "q90", 0.9)})


@register("ml14_binned_information", """WITH b AS (SELECT symbol, ntile(10) OVER (PARTITION BY symbol ORDER BY pred, date) AS x, ntile(10) OVER (PARTITION BY symbol ORDER BY actual, date) AS y FROM preds),
    j AS (SELECT symbol, x, y, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY symbol, x) AS nx, sum(n) OVER (PARTITION BY symbol, y) AS ny, sum(n) OVER (PARTITION BY symbol) AS t FROM j)
    SELECT symbol, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM k GROUP BY symbol""")  # fmt: skip
def ml14_binned_information(spark, d):
    p = R.preds(spark, d).withColumn("px", F.struct("pred", "date")).withColumn("ax", F.struct("actual", "date"))
    return E.binned_information(p, K, "px", "ax").select("symbol", F.round("mi", 6).alias("mi"))


@register("evl01_regression", """SELECT symbol, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e) / greatest(abs(actual), 1e-6)), 4) AS mape, round(1 - coalesce(sum(e * e) / nullif(var_pop(actual) * count(*), 0), 0), 4) + 0.0 AS r2,
    round(coalesce(sqrt(avg(e * e)) / nullif(stddev_pop(actual), 0), 0), 5) AS nrmse FROM (SELECT *, pred - actual AS e FROM preds) GROUP BY symbol""")
def evl01_regression(spark, d):
    m = E.regression()
    return R.preds(spark, d).groupBy("symbol").agg(*((F.round(m[k], n) + F.lit(0.0)).alias(k) for k, n in (("mae", 6), ("rmse", 6), ("mape", 4), ("r2", 4), ("nrmse", 5))))


_CM = "SELECT symbol, count(*) FILTER (t AND g)::DOUBLE AS tp, count(*) FILTER (NOT t AND g)::DOUBLE AS fp, count(*) FILTER (t AND NOT g)::DOUBLE AS fn, count(*) FILTER (NOT t AND NOT g)::DOUBLE AS tn FROM (SELECT symbol, actual > 0 AS t, prob >= 0.5 AS g FROM preds) GROUP BY symbol"


@register("evl02_classification", f"""SELECT symbol, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc FROM ({_CM})""")
def evl02_classification(spark, d):
    return _rounded(R.preds(spark, d).groupBy("symbol"), E.classification(F.col("actual") > 0, F.col("prob") >= 0.5))


@register("evl03_probabilistic", "SELECT symbol, round(avg((actual >= q10 AND actual <= q90)::INT), 6) AS coverage, round(avg(abs(q90 - q10)), 6) AS width, round(avg(0.5 * ln(2 * pi() * s * s) + (pred - actual) ** 2 / (2 * s * s)), 5) AS nll FROM (SELECT *, greatest(abs(q90 - q10) / (2 * 1.2816), 1e-4) AS s FROM preds) GROUP BY symbol")
def evl03_probabilistic(spark, d):
    m = E.probabilistic()
    return R.preds(spark, d).groupBy("symbol").agg(F.round(m["coverage"], 6).alias("coverage"), F.round(m["width"], 6).alias("width"), F.round(m["nll"], 5).alias("nll"))


@register("evl04_strategy", """WITH p AS (SELECT symbol, date, prob AS pos, prob * actual AS r FROM preds), c AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY date)) AS e, abs(pos - lag(pos, 1, 0.0) OVER (PARTITION BY symbol ORDER BY date)) AS t FROM p),
    m AS (SELECT *, e / greatest(1.0, max(e) OVER (PARTITION BY symbol ORDER BY date)) - 1 AS dd FROM c)
    SELECT symbol, round(exp(sum(ln(1 + r))) - 1, 6) + 0.0 AS cumulative, round(pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1, 4) + 0.0 AS annualised, round(coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt(252), 5) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown, round(avg((r > 0)::INT), 6) AS win_rate, round(avg((pos > 0)::INT), 6) AS exposure, round(avg(t), 6) AS turnover FROM m GROUP BY symbol""")
def evl04_strategy(spark, d):
    p = R.preds(spark, d).select("symbol", "date", F.col("prob").alias("pos"), (F.col("prob") * F.col("actual")).alias("r"))
    s = E.strategy(p, K, "date", "r", "pos")
    return s.select("symbol", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("cumulative", 6), ("annualised", 4), ("sharpe", 5), ("max_drawdown", 6), ("win_rate", 6), ("exposure", 6), ("turnover", 6))))


@register("evl05_information", """WITH r AS (SELECT symbol, actual, pred, rank() OVER (PARTITION BY symbol ORDER BY actual) + (count(*) OVER (PARTITION BY symbol, actual) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY symbol ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, pred) - 1) / 2.0 AS rp FROM preds)
    SELECT symbol, round(coalesce(corr(actual, pred), 0), 6) + 0.0 AS ic, round(coalesce(corr(ra, rp), 0), 6) + 0.0 AS rank_ic, round(coalesce(coalesce(corr(actual, pred), 0) / nullif(stddev_pop(pred - actual), 0), 0), 4) + 0.0 AS icir FROM r GROUP BY symbol""")  # fmt: skip
def evl05_information(spark, d):
    return E.information_coefficients(R.preds(spark, d), K).select("symbol", (F.round("ic", 6) + F.lit(0.0)).alias("ic"), (F.round("rank_ic", 6) + F.lit(0.0)).alias("rank_ic"), (F.round("icir", 4) + F.lit(0.0)).alias("icir"))


@register("evl06_horizons", "SELECT symbol, h, round(avg(abs(pred - f)), 6) AS mae, round(avg(((pred >= 0) = (f > 0))::INT), 6) AS direction FROM (SELECT symbol, ret AS pred, 1 AS h, lead(close, 1) OVER w / close - 1 AS f FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date) UNION ALL SELECT symbol, ret, 5, lead(close, 5) OVER w / close - 1 FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE pred IS NOT NULL AND f IS NOT NULL GROUP BY ALL")
def evl06_horizons(spark, d):
    w = S.by(K, ["date"])
    r = R.rets(spark, d).withColumns({f"f{h}": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in (1, 5)})
    r = r.select("symbol", F.col("ret").alias("pred"), F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("f")) for h in (1, 5)))).alias("x")).select("symbol", "pred", "x.*").where("pred is not null and f is not null")
    return r.groupBy("symbol", "h").agg(F.round(F.avg(F.abs(F.col("pred") - F.col("f"))), 6).alias("mae"), F.round(F.avg(((F.col("pred") >= 0) == (F.col("f") > 0)).cast("int")), 6).alias("direction"))


_DIFF = "SELECT symbol, date, abs(pred - actual) - abs(actual) AS d FROM preds"


@register("evl07_diebold_mariano", f"""WITH c AS (SELECT symbol, date, d, d - avg(d) OVER (PARTITION BY symbol) AS x FROM ({_DIFF})), l AS (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3, lag(x, 4) OVER w AS l4, lag(x, 5) OVER w AS l5 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    g AS (SELECT symbol, count(*) AS n, avg(d) AS m, greatest(sum(x * x) / count(*) + 2 * (1 - 1 / 6.0) * coalesce(sum(x * l1) / nullif(count(*) - 1, 0), 0) + 2 * (1 - 2 / 6.0) * coalesce(sum(x * l2) / nullif(count(*) - 2, 0), 0) + 2 * (1 - 3 / 6.0) * coalesce(sum(x * l3) / nullif(count(*) - 3, 0), 0)
      + 2 * (1 - 4 / 6.0) * coalesce(sum(x * l4) / nullif(count(*) - 4, 0), 0) + 2 * (1 - 5 / 6.0) * coalesce(sum(x * l5) / nullif(count(*) - 5, 0), 0), 1e-12) AS v FROM l GROUP BY symbol)
    SELECT symbol, n, round(CASE WHEN n >= 2 THEN m / sqrt(v / n) ELSE 0 END, 5) + 0.0 AS dm FROM g""")
def evl07_diebold_mariano(spark, d):
    p = R.preds(spark, d).withColumn("d", F.abs(F.col("pred") - F.col("actual")) - F.abs("actual"))
    return E.diebold_mariano(p, K, "date", "d").select("symbol", "n", (F.round("dm", 5) + F.lit(0.0)).alias("dm"))


@register("evl08_bootstrap")
def evl08_bootstrap(spark, d):
    return E.bootstrap_mean(R.preds(spark, d).select("symbol", "date", "actual"), K, "actual", 500, row_id=["symbol", "date"])


@register("evl09_mean_t", "SELECT symbol, round(CASE WHEN count(actual) >= 2 THEN coalesce(avg(actual) / nullif(stddev_samp(actual) / sqrt(count(actual)), 0), 0) ELSE 0 END, 5) + 0.0 AS t FROM preds GROUP BY symbol")
def evl09_mean_t(spark, d):
    return _rounded(R.preds(spark, d).groupBy("symbol"), {"t": E.mean_t("actual")}, 5)


@register("evl10_paired_significance", f"SELECT symbol, count(*) AS n, round(avg(d), 6) + 0.0 AS gain, round(avg((d < 0)::INT), 6) AS better FROM ({_DIFF}) GROUP BY symbol")
def evl10_paired_significance(spark, d):
    p = R.preds(spark, d).withColumn("d", F.abs(F.col("pred") - F.col("actual")) - F.abs("actual"))
    return p.groupBy("symbol").agg(F.count("*").alias("n"), (F.round(F.avg("d"), 6) + F.lit(0.0)).alias("gain"), F.round(F.avg((F.col("d") < 0).cast("int")), 6).alias("better"))


_VARIANTS = {"full": "pred", "half": "pred / 2", "zero": "0.0"}


@register("evl11_ablation", " UNION ALL ".join(f"SELECT '{k}' AS variant, round(avg(abs({v} - actual)), 6) AS mae, count(*) AS n FROM preds" for k, v in _VARIANTS.items()))
def evl11_ablation(spark, d):
    """Variants of one prediction scored side by side in one pass."""
    p = R.preds(spark, d).withColumns({k: F.expr(v).cast("double") for k, v in _VARIANTS.items()})
    return D.candidates(p, ["symbol", "date"], {k: k for k in _VARIANTS}, ["actual"]).groupBy(F.col("source").alias("variant")).agg(F.round(F.avg(F.abs(F.col("value") - F.col("actual"))), 6).alias("mae"), F.count("*").alias("n"))


@register("evl13_multi_seed", "SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std, count(*) AS n FROM (SELECT symbol, avg(abs(pred - actual)) AS m FROM preds GROUP BY symbol)")
def evl13_multi_seed(spark, d):
    """Mean and population deviation of a metric over repeated runs, here over symbols."""
    m = R.preds(spark, d).groupBy("symbol").agg(E.regression()["mae"].alias("m"))
    return m.agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_pop("m"), 9).alias("std"), F.count("*").alias("n"))


@register("evl14_leakage_audit", "SELECT count(*) AS late FROM bars b JOIN fin f ON b.symbol = f.symbol AND f.known > b.date AND f.date = b.date")
def evl14_leakage_audit(spark, d):
    """Reports that a naive join on the period day would use before they were known."""
    b, f = R.bars(spark, d).select("symbol", "date"), R.fin(spark, d).select("symbol", "date", "known")
    return b.join(f, ["symbol", "date"]).where(F.col("known") > F.col("date")).agg(F.count("*").alias("late"))


_CAND = "SELECT symbol, date, actual, 'main' AS source, pred AS value FROM preds UNION ALL SELECT symbol, date, actual, 'zero', 0.0 FROM preds UNION ALL SELECT symbol, date, actual, 'half', pred / 2 FROM preds UNION ALL SELECT symbol, date, actual, 'inverse', -pred FROM preds"


def _cand(spark, d):
    p = R.preds(spark, d).withColumns({"main": F.col("pred"), "zero": F.lit(0.0), "half": F.col("pred") / 2, "inverse": -F.col("pred")})
    return D.candidates(p, ["symbol", "date"], {k: k for k in ("main", "zero", "half", "inverse")}, ["actual"])


@register("dec01_candidates", f"SELECT symbol, date, source, round(value, 9) + 0.0 AS value FROM ({_CAND})")
def dec01_candidates(spark, d):
    return _cand(spark, d).select("symbol", "date", "source", (F.round("value", 9) + F.lit(0.0)).alias("value"))


@register("dec02_ensembles", f"SELECT symbol, date, round(avg(value), 9) + 0.0 AS mean, round(median(value), 9) + 0.0 AS median, round((sum(value) - min(value) - max(value)) / 2, 9) + 0.0 AS trimmed FROM ({_CAND}) GROUP BY symbol, date")
def dec02_ensembles(spark, d):
    return D.ensembles(_cand(spark, d), ["symbol", "date"]).select("symbol", "date", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("mean", "median", "trimmed")))


@register("dec03_best_source", f"SELECT symbol, arg_min(source, (m, source)) AS source, min(m) AS mae FROM (SELECT symbol, source, round(avg(abs(value - actual)), 9) AS m FROM ({_CAND}) GROUP BY ALL) GROUP BY symbol")
def dec03_best_source(spark, d):
    m = _cand(spark, d).groupBy("symbol", "source").agg(F.round(F.avg(F.abs(F.col("value") - F.col("actual"))), 9).alias("mae"))
    return D.best_by(m, K, "source", "mae")


@register("dec04_point_calibration", """WITH s AS (SELECT 'shrink_' || x AS name, y AS scale FROM (VALUES ('0', 0.0), ('0.25', 0.25), ('0.5', 0.5), ('0.75', 0.75), ('1', 1.0), ('1.25', 1.25)) AS v(x, y)),
    c AS (SELECT symbol, name, scale::DOUBLE AS scale, quantile_cont(actual - scale * pred, 0.5) AS icept FROM preds, s GROUP BY ALL UNION ALL SELECT DISTINCT symbol, 'identity', 1.0, 0.0 FROM preds
          UNION ALL SELECT symbol, 'linear', least(greatest(regr_slope(actual, pred), -2), 2), regr_intercept(actual, pred) FROM preds GROUP BY symbol),
    e AS (SELECT c.symbol, name, any_value(scale) AS scale, any_value(icept) AS icept, round(avg(abs(scale * pred + icept - actual)), 9) AS mae FROM c JOIN preds ON c.symbol = preds.symbol GROUP BY c.symbol, name)
    SELECT symbol, arg_min(name, (mae, name)) AS name, round(arg_min(scale, (mae, name)), 6) + 0.0 AS scale, round(arg_min(icept, (mae, name)), 7) + 0.0 AS intercept, min(mae) AS mae FROM e GROUP BY symbol""")  # fmt: skip
def dec04_point_calibration(spark, d):
    return D.point_calibration(R.preds(spark, d), K, "actual", "pred").select("symbol", "name", (F.round("scale", 6) + F.lit(0.0)).alias("scale"), (F.round("intercept", 7) + F.lit(0.0)).alias("intercept"), F.round("mae", 9).alias("mae"))


@register("dec05_direction_threshold", """WITH g AS (SELECT symbol, source, p, actual > 0 AS up, v * p AS v FROM (SELECT symbol, actual, 'pred' AS source, pred AS v FROM preds UNION ALL SELECT symbol, actual, 'prob', prob FROM preds), (VALUES (1.0), (-1.0)) AS x(p)),
    q AS (SELECT symbol, source, p, unnest(quantile_cont(v, [0.02 + 0.96 * i / 32 FOR i IN range(0, 33)])) AS t FROM g GROUP BY symbol, source, p) SELECT symbol, max(a) AS accuracy FROM (SELECT g.symbol, g.source, g.p, q.t, round(avg(((v >= t) = up)::INT), 9) AS a FROM g JOIN q ON g.symbol = q.symbol AND g.source = q.source AND g.p = q.p GROUP BY ALL) GROUP BY symbol""")
def dec05_direction_threshold(spark, d):
    p = R.preds(spark, d).withColumn("up", F.col("actual") > 0)
    return D.direction_threshold(p, K, "up", ["pred", "prob"]).select("symbol", F.round("accuracy", 9).alias("accuracy"))


@register("dec08_signals", "SELECT symbol, date, round(p + q, 9) AS hybrid FROM (SELECT symbol, date, (rank() OVER (PARTITION BY symbol ORDER BY pred) + (count(*) OVER (PARTITION BY symbol, pred) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS p, (rank() OVER (PARTITION BY symbol ORDER BY prob) + (count(*) OVER (PARTITION BY symbol, prob) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS q FROM preds)")
def dec08_signals(spark, d):
    return R.preds(spark, d).select("symbol", "date", F.round(S.percent_rank("pred", K) + S.percent_rank("prob", K), 9).alias("hybrid"))


@register("dec14_scores", "SELECT symbol, round(exp(sum(ln(1 + actual))) - 1, 6) + 0.0 AS ret, round(coalesce(avg(actual) / nullif(stddev_pop(actual), 0), 0) * sqrt(252), 5) + 0.0 AS sharpe FROM preds GROUP BY symbol")
def dec14_scores(spark, d):
    return R.preds(spark, d).groupBy("symbol").agg((F.round(D.score_of("actual", "return"), 6) + F.lit(0.0)).alias("ret"), (F.round(D.score_of("actual", "sharpe"), 5) + F.lit(0.0)).alias("sharpe"))


@register("dec15_robust_score", """WITH s AS (SELECT symbol, k, exp(sum(ln(1 + actual))) - 1 AS s FROM (SELECT symbol, actual, ntile(4) OVER (PARTITION BY symbol ORDER BY date) AS k FROM preds) GROUP BY ALL), b AS (SELECT symbol, exp(sum(ln(1 + actual))) - 1 AS b FROM preds GROUP BY symbol)
    SELECT symbol, round(0.7 * (0.5 * any_value(b) + 0.5 * quantile_cont(s, 0.5)) + 0.3 * min(s), 6) + 0.0 AS score, round(avg((s > 0)::INT), 6) AS positive, round(min(s), 6) + 0.0 AS worst FROM s JOIN b USING (symbol) GROUP BY symbol""")  # fmt: skip
def dec15_robust_score(spark, d):
    s = D.robust_score(R.preds(spark, d), K, "date", "actual", "return", 4, 0.3)
    return s.select("symbol", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("score", "positive", "worst")))


@register("dec17_position_ensemble")
def dec17_position_ensemble(spark, d):
    c = _cand(spark, d).withColumn("position", N.clip(0.5 + F.col("value") * 10, 0, 1)).withColumn("r", F.col("position") * F.col("actual"))
    scores = c.groupBy("symbol", "source").agg(D.score_of("r", "return").alias("validation_return"), D.score_of("r", "tstat").alias("t"))
    return D.position_ensemble(scores, c.select("symbol", "date", "source", "position"), K, "date", "t", 2, -1.0)


@register("dec18_pruned_positions")
def dec18_pruned_positions(spark, d):
    return D.prune_positions(R.preds(spark, d), K, "prob", "actual", [0.25, 0.5, 0.75], 0.5)


@register("prj18_calibrated", "SELECT p.symbol, date, round(pred * s + i, 9) AS pred, round(q10 * s + i, 9) AS q10, round(q90 * s + i, 9) AS q90 FROM preds p JOIN (SELECT symbol, least(greatest(regr_slope(actual, pred), -2), 2) AS s, regr_intercept(actual, pred) AS i FROM preds GROUP BY symbol) c ON p.symbol = c.symbol")
def prj18_calibrated(spark, d):
    """Predictions and quantiles scaled by parameters attached per key."""
    p = R.preds(spark, d)
    c = p.groupBy("symbol").agg(F.least(F.greatest(F.regr_slope("actual", "pred"), F.lit(-2.0)), F.lit(2.0)).alias("s"), F.regr_intercept("actual", "pred").alias("i"))
    return p.join(c, "symbol").select("symbol", "date", *(F.round(F.col(x) * F.col("s") + F.col("i"), 9).alias(x) for x in ("pred", "q10", "q90")))


@register("flagship", """WITH m AS (SELECT b.symbol, b.date, b.close, m.level FROM bars b ASOF LEFT JOIN macro m ON b.date >= m.release),
    p AS (SELECT p.symbol, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, round(coalesce(corr(actual, pred), 0), 6) + 0.0 AS ic, round(avg(((prob >= 0.5) = (actual > 0))::INT), 6) AS accuracy FROM preds p GROUP BY p.symbol)
    SELECT p.symbol, n, mae, ic, accuracy, lv.level FROM p JOIN (SELECT symbol, round(avg(coalesce(level, 0)), 4) AS level FROM m GROUP BY symbol) lv ON p.symbol = lv.symbol""")  # fmt: skip
def flagship(spark, d):
    """Quotes with the macro figure known on the day, a naive prediction, and its evaluation, per symbol."""
    m = R.macro(spark, d).withColumn("until", F.coalesce(F.lead("release").over(W.orderBy("release")), F.lit("2100-01-01").cast("date")))
    days = m.select("level", F.explode(F.sequence("release", F.least(F.date_sub("until", 1), F.date_add("release", 20000)))).alias("date"))
    level = R.bars(spark, d).select("symbol", "date").join(days, "date", "left").groupBy("symbol").agg(F.round(F.avg(F.coalesce("level", F.lit(0.0))), 4).alias("level"))
    ok = ((F.col("prob") >= 0.5) == (F.col("actual") > 0)).cast("int")
    p = R.preds(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.round(E.regression()["mae"], 6).alias("mae"), (F.round(F.coalesce(N.correlation("actual", "pred"), F.lit(0.0)), 6) + F.lit(0.0)).alias("ic"), F.round(F.avg(ok), 6).alias("accuracy"))
    return p.join(level, "symbol").select("symbol", "n", "mae", "ic", "accuracy", "level")
