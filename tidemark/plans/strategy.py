"""Queries of the strategy operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import decide as D
from tidemark.operators import sequence as S
from tidemark.operators import strategy as T
from tidemark.plans import registry as R
from tidemark.plans.registry import register

K = ["symbol"]
#: No cap on turnover and no limit days, which SQL can follow without recursion.
FREE = T.Rules(limit=float("inf"), least_exposure=0.05, most_exposure=0.95)
QUANTILES = [0.55, 0.65, 0.75]


def _r(x: str, n: int = 6):
    return (F.round(x, n) + F.lit(0.0)).alias(x)


_RANK = lambda x: f"(rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol)"
_SIGNALS = {
    "return": "pred", "prob": "prob", "risk_adjusted": "pred / greatest(abs(q90 - q10), 1e-4)", "hybrid": "greatest(pred, 0) * greatest(prob - 0.5, 0)", "prob_return": f"{_RANK('pred')} + {_RANK('prob')}",
    "inv_return": "-pred", "inv_prob": "-prob", "inv_hybrid": "greatest(-pred, 0) * greatest(0.5 - prob, 0)", "external": "-pred / 2", "external_prob_return": f"{_RANK('(-pred / 2)')} + {_RANK('prob')}",
    "external_hybrid": "greatest(-pred / 2, 0) * greatest(prob - 0.5, 0)", "inv_external": "pred / 2", "inv_external_prob_return": f"{_RANK('(pred / 2)')} + {_RANK('(1 - prob)')}",
    "inv_external_hybrid": "greatest(pred / 2, 0) * greatest(0.5 - prob, 0)", "external_position": "-pred / 2",
}


@register("dec08_all_signals", "SELECT symbol, date, " + ", ".join(f'round({x}, 9) + 0.0 AS "{n}"' for n, x in _SIGNALS.items()) + " FROM preds")
def dec08_all_signals(spark, d):
    p = R.preds(spark, d).withColumn("ext", -F.col("pred") / 2)
    return p.select("symbol", "date", *((F.round(x, 9) + F.lit(0.0)).alias(n) for n, x in T.signals(K, "ext").items()))


_TRIALS = """WITH l AS (SELECT symbol, date, actual, pred, prob, unnest([struct_pack(signal := 'return', value := pred), struct_pack(signal := 'prob', value := prob), struct_pack(signal := 'hybrid', value := greatest(pred, 0) * greatest(prob - 0.5, 0))], recursive := true) FROM preds),
    g AS (SELECT symbol, signal, unnest(CASE WHEN min(value) < max(value) THEN [0.55, 0.65, 0.75] ELSE [0.55] END) AS quantile, unnest(CASE WHEN min(value) < max(value) THEN quantile_cont(value, [0.55, 0.65, 0.75]) ELSE [min(value)] END) AS threshold, greatest(stddev_pop(value), 0.005) AS scale FROM l GROUP BY symbol, signal),
    p AS (SELECT l.*, quantile, threshold, scale, greatest(0, least(1, (value - threshold) / scale)) AS position FROM l JOIN g USING (symbol, signal)),
    u AS (SELECT *, abs(position - lag(position, 1, 0.0) OVER (PARTITION BY symbol, signal, quantile ORDER BY date)) AS turnover FROM p),
    t AS (SELECT *, greatest(position * actual - turnover * 0.002, -1 + 1e-6) AS r FROM u)"""
_NAMES = ["return", "prob", "hybrid"]


@register("dec09_desired_position", _TRIALS + " SELECT symbol, date, signal, quantile::DOUBLE AS quantile, round(position, 6) + 0.0 AS position FROM t")
def dec09_desired_position(spark, d):
    return T.trials(R.preds(spark, d), K, "date", QUANTILES, FREE, _NAMES).select("symbol", "date", "signal", "quantile", _r("position"))


@register("dec10_simulated_returns", _TRIALS + " SELECT symbol, date, signal, quantile::DOUBLE AS quantile, round(turnover, 6) + 0.0 AS turnover, round(r, 7) + 0.0 AS r FROM t")
def dec10_simulated_returns(spark, d):
    return T.trials(R.preds(spark, d), K, "date", QUANTILES, FREE, _NAMES).select("symbol", "date", "signal", "quantile", _r("turnover"), _r("r", 7))


_RISK = "risk AS (SELECT symbol, date, prob AS position, actual, abs(pred) AS volatility, pred AS last_return FROM preds)"


def _risk(spark, d):
    return R.preds(spark, d).select("symbol", "date", F.col("prob").alias("position"), "actual", F.abs("pred").alias("volatility"), F.col("pred").alias("last_return"))


@register("dec11_overlay", f"WITH {_RISK} SELECT symbol, date, round(position * CASE WHEN volatility >= 0.02 OR last_return <= -0.01 THEN 0.5 ELSE 1 END, 6) + 0.0 AS position FROM risk")
def dec11_overlay(spark, d):
    return _risk(spark, d).withColumn("position", T.overlay(F.col("position"), F.col("volatility"), F.col("last_return"), F.lit(0.02), F.lit(-0.01), F.lit(0.5))).select("symbol", "date", _r("position"))


def _scores_sql(of: str, by: str) -> str:
    """Scores of returns r, ordered by date, per ``by``."""
    return f"""e_{of} AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {by} ORDER BY date)) AS e FROM {of}),
    d_{of} AS (SELECT *, e / greatest(1.0, max(e) OVER (PARTITION BY {by} ORDER BY date)) - 1 AS d, e / max(e) OVER (PARTITION BY {by} ORDER BY date) - 1 AS d1 FROM e_{of}),
    a_{of} AS (SELECT {by}, count(*) AS n, avg(r) AS m, CASE WHEN count(r) >= 2 THEN coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0), 0) ELSE 0 END AS tstat, exp(sum(ln(1 + r))) - 1 AS ret,
              coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt(252) AS sharpe, abs(min(d)) AS dd, min(d1) AS dd1, CASE WHEN count(*) FILTER (r < 0) > 1 THEN stddev_samp(r) FILTER (r < 0) ELSE coalesce(stddev_samp(r), 0) END AS ds FROM d_{of} GROUP BY {by}),
    c_{of} AS (SELECT *, coalesce((pow(1 + ret, 252.0 / n) - 1) / nullif(dd, 0), 0) AS calmar FROM a_{of}),
    s_{of} AS (SELECT *, 0.45 * tanh(tstat / 2) + 0.25 * tanh(ret * 3) + 0.2 * tanh(sharpe / 2) + 0.1 * tanh(calmar / 3) - 0.15 * least(dd, 1) AS significance, 0.4 * tanh(sharpe / 2) + 0.3 * tanh(ret * 2) + 0.2 * tanh(calmar / 3) - 0.1 * least(dd, 1) AS balanced,
              CASE WHEN n >= 2 THEN 0.45 * tstat + 0.35 * tanh(ret * 2) + 0.15 * tanh(coalesce(m / nullif(ds / sqrt(252), 0), 0) / 2) + 0.05 * dd1 END AS risk_adjusted FROM c_{of})"""


@register("dec14_20_scores", f"""WITH x AS (SELECT symbol, date, prob * actual AS r FROM preds), {_scores_sql('x', 'symbol')}
    SELECT symbol, round(ret, 6) + 0.0 AS "return", round(tstat, 5) + 0.0 AS tstat, round(significance, 5) + 0.0 AS significance, round(calmar, 3) + 0.0 AS calmar, round(balanced, 5) + 0.0 AS balanced, round(sharpe, 5) + 0.0 AS sharpe, round(risk_adjusted, 5) + 0.0 AS risk_adjusted FROM s_x""")  # fmt: skip
def dec14_20_scores(spark, d):
    s = T.scores(R.preds(spark, d).select("symbol", "date", (F.col("prob") * F.col("actual")).alias("r")), K, "date")
    return s.select("symbol", _r("return"), _r("tstat", 5), _r("significance", 5), _r("calmar", 3), _r("balanced", 5), _r("sharpe", 5), _r("risk_adjusted", 5))


_SEARCH = f"""{_TRIALS}, {_scores_sql('t', 'symbol, signal, quantile')}, k AS (SELECT *, ntile(4) OVER (PARTITION BY symbol, signal, quantile ORDER BY date) AS seg FROM t), {_scores_sql('k', 'symbol, signal, quantile, seg')},
    sg AS (SELECT symbol, signal, quantile, quantile_cont(sharpe, 0.5) AS med, min(sharpe) AS worst, avg((sharpe > 0)::INT) AS positive FROM s_k GROUP BY ALL),
    ex AS (SELECT symbol, signal, quantile, avg((position > 0)::INT) AS exposure, any_value(threshold) AS threshold, any_value(scale) AS scale FROM t GROUP BY ALL),
    sc AS (SELECT *, round(0.7 * (0.5 * sharpe + 0.5 * med) + 0.3 * worst - 2 * abs(exposure - 0.45), 9) AS score FROM s_t JOIN sg USING (symbol, signal, quantile) JOIN ex USING (symbol, signal, quantile) WHERE exposure BETWEEN 0.05 AND 0.95),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, signal, quantile) = 1),
    fb AS (SELECT symbol, quantile_cont(value, 0.55) AS threshold, greatest(stddev_pop(value), 0.005) AS scale FROM l WHERE signal = 'hybrid' GROUP BY symbol)"""


@register("dec12_strategy_search", _SEARCH + """
    SELECT fb.symbol, coalesce(best.signal, 'hybrid') AS signal, round(coalesce(best.threshold, fb.threshold), 6) + 0.0 AS threshold, round(coalesce(best.scale, fb.scale), 6) + 0.0 AS scale, round(coalesce(best.score, 0), 4) + 0.0 AS score,
      round(coalesce(best.exposure, 0), 6) + 0.0 AS exposure, round(best.positive, 6) + 0.0 AS positive, round(best.worst, 4) + 0.0 AS worst FROM fb LEFT JOIN best ON fb.symbol = best.symbol""")  # fmt: skip
def dec12_strategy_search(spark, d):
    s = T.search(R.preds(spark, d), K, "date", QUANTILES, FREE, "sharpe", _NAMES)
    return s.select("symbol", "signal", _r("threshold"), _r("scale"), _r("score", 4), _r("exposure"), _r("positive"), _r("worst", 4))


@register("dec13_fallback", "SELECT symbol, 'hybrid' AS signal, round(quantile_cont(v, 0.55), 7) AS threshold, round(greatest(stddev_pop(v), 0.005), 7) AS scale FROM (SELECT symbol, greatest(pred, 0) * greatest(prob - 0.5, 0) AS v FROM preds) GROUP BY symbol")
def dec13_fallback(spark, d):
    f = T.fallback(R.preds(spark, d), K, "date", FREE)
    return f.select("symbol", F.col("_signal").alias("signal"), F.round("_threshold", 7).alias("threshold"), F.round("_scale", 7).alias("scale"))


_SOURCES = "(VALUES ('main', 1.0), ('half', 0.5), ('inverse', -1.0)) AS v(source, f)"


def _by_source(spark, d):
    of = F.array(*(F.struct(F.lit(n).alias("source"), F.lit(f).alias("f")) for n, f in (("main", 1.0), ("half", 0.5), ("inverse", -1.0))))
    p = R.preds(spark, d).select("symbol", "date", "actual", "pred", F.explode(of).alias("v")).withColumn("source", F.col("v.source"))
    return p.withColumn("position", F.least(F.greatest(0.5 + 10 * F.col("v.f") * F.col("pred"), F.lit(0.0)), F.lit(1.0))).drop("v")


_POSITIONS = f"""ps AS (SELECT symbol, date, actual, source, greatest(0, least(1, 0.5 + 10 * f * pred)) AS position FROM preds, {_SOURCES})"""
_NET = lambda of, by: f"(SELECT *, greatest(position * actual - abs(position - lag(position, 1, 0.0) OVER (PARTITION BY {by} ORDER BY date)) * 0.002, -1 + 1e-6) AS r FROM {of})"


@register("dec16_source_selection", f"""WITH {_POSITIONS}, x AS {_NET('ps', 'symbol, source')}, {_scores_sql('x', 'symbol, source')},
    sel AS (SELECT symbol, source, significance AS score, round(significance + CASE WHEN source = 'half' AND significance >= 0 THEN 0.05 ELSE 0 END, 9) AS selection FROM s_x)
    SELECT symbol, source, round(score, 5) + 0.0 AS score, round(selection, 5) + 0.0 AS selection FROM sel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY selection DESC, source <> 'main', source) = 1""")  # fmt: skip
def dec16_source_selection(spark, d):
    s = T.scores(T.returns(_by_source(spark, d), ["symbol", "source"], "date", FREE), ["symbol", "source"], "date")
    s = T.select_source(s.select("symbol", "source", F.col("significance").alias("score"), F.lit(1.0).alias("positive")), K, ["half"], 0.05)
    return s.select("symbol", "source", _r("score", 5), _r("selection", 5))


@register("dec19_overlay_search", f"""WITH {_RISK}, q AS (SELECT symbol, quantile_cont(volatility, [0.6, 0.8]) AS v FROM risk GROUP BY symbol), g AS (SELECT symbol, v[i + 1] AS vol, i, dr, sc FROM q, (VALUES (0), (1)) AS a(i), (VALUES (-0.02), (-0.01)) AS b(dr), (VALUES (0.0), (0.5)) AS c(sc)),
    b AS {_NET('risk', 'symbol')}, {_scores_sql('b', 'symbol')},
    o AS (SELECT risk.symbol, date, actual, i, dr, sc, vol, position * CASE WHEN volatility >= vol OR last_return <= dr THEN sc ELSE 1 END AS position FROM risk JOIN g ON risk.symbol = g.symbol), t AS {_NET('o', 'symbol, i, dr, sc')}, {_scores_sql('t', 'symbol, i, dr, sc')},
    ok AS (SELECT s_t.symbol, vol, s_t.dr, s_t.sc, round(s_t.risk_adjusted, 9) AS score FROM s_t JOIN g ON s_t.symbol = g.symbol AND s_t.i = g.i AND s_t.dr = g.dr AND s_t.sc = g.sc JOIN s_b ON s_b.symbol = s_t.symbol
           WHERE s_b.n >= 8 AND s_t.ret >= CASE WHEN s_b.ret > 0 THEN s_b.ret * 0.85 ELSE s_b.ret END AND s_t.risk_adjusted > s_b.risk_adjusted)
    SELECT symbol, round(vol, 6) + 0.0 AS vol, dr::DOUBLE AS "drop", sc::DOUBLE AS scale, round(score, 4) + 0.0 AS score FROM ok QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, vol, dr, sc) = 1""")  # fmt: skip
def dec19_overlay_search(spark, d):
    s = T.overlay_search(_risk(spark, d), K, "date", FREE, [0.6, 0.8], [-0.02, -0.01], [0.0, 0.5])
    return s.select("symbol", _r("vol"), "drop", "scale", _r("score", 4))


@register("dec21_inverse_candidates", f"""WITH {_POSITIONS}, inv AS (SELECT symbol, date, actual, 'inverse_' || source AS source, greatest(0, least(1, 1 - position)) AS position FROM ps), x AS {_NET('inv', 'symbol, source')},
    good AS (SELECT symbol, source FROM x GROUP BY symbol, source HAVING stddev_pop(position) > 1e-12 AND exp(sum(ln(1 + r))) - 1 >= 0)
    SELECT symbol, source, count(*) AS n, round(avg(position), 6) + 0.0 AS position FROM (SELECT * FROM ps UNION ALL SELECT inv.* FROM inv SEMI JOIN good ON inv.symbol = good.symbol AND inv.source = good.source) GROUP BY symbol, source""")  # fmt: skip
def dec21_inverse_candidates(spark, d):
    s = T.inverse_candidates(_by_source(spark, d).select("symbol", "date", "actual", "source", "position"), K, "date", FREE)
    return s.groupBy("symbol", "source").agg(F.count("*").alias("n"), F.avg("position").alias("position")).select("symbol", "source", "n", _r("position"))


@register("dec23_actions", """SELECT symbol, date, CASE WHEN d > 1e-8 THEN 'buy_or_add' WHEN d < -1e-8 THEN 'sell_or_reduce' WHEN p > 1e-8 THEN 'hold_long' ELSE 'hold_cash' END AS action
    FROM (SELECT symbol, date, p, p - lag(p, 1, 0.0) OVER (PARTITION BY symbol ORDER BY date) AS d FROM (SELECT symbol, date, greatest(0, least(1, round(4 * prob - 2))) AS p FROM preds))""")  # fmt: skip
def dec23_actions(spark, d):
    p = R.preds(spark, d).withColumn("p", F.least(F.greatest(F.round(4 * F.col("prob") - 2), F.lit(0.0)), F.lit(1.0)))
    return p.select("symbol", "date", T.actions(F.col("p"), F.lag("p", 1, 0.0).over(S.by(K, ["date"]))).alias("action"))


_DIRECTION = """WITH s AS (SELECT symbol, CASE WHEN quantile_cont(abs(pred), 0.75) > 1e-6 THEN quantile_cont(abs(pred), 0.75) ELSE greatest(stddev_pop(pred), 1e-3) END AS sc FROM preds GROUP BY symbol),
    c AS (SELECT p.*, 1 / (1 + exp(-greatest(-12, least(12, pred / sc)))) AS return_prob, pred / greatest(abs(q90 - q10), 1e-4) AS risk_adjusted_return FROM preds p JOIN s ON p.symbol = s.symbol), b AS (SELECT *, 0.55 * prob + 0.45 * return_prob AS prob_return_blend FROM c)"""


@register("dec07_direction_candidates", _DIRECTION + " SELECT symbol, date, round(return_prob, 8) AS return_prob, round(prob_return_blend, 8) AS prob_return_blend, round(risk_adjusted_return, 7) + 0.0 AS risk_adjusted_return FROM b")
def dec07_direction_candidates(spark, d):
    return T.direction_candidates(R.preds(spark, d), K).select("symbol", "date", F.round("return_prob", 8).alias("return_prob"), F.round("prob_return_blend", 8).alias("prob_return_blend"), _r("risk_adjusted_return", 7))


@register("dec06_direction_source", _DIRECTION + """, o AS (SELECT symbol, actual > 0 AS up, unnest([struct_pack(source := 'prob', value := prob), struct_pack(source := 'return_prob', value := return_prob), struct_pack(source := 'prob_return_blend', value := prob_return_blend)], recursive := true) FROM b),
    m AS (SELECT symbol, source, round(avg(((value >= 0.5) = up)::INT), 9) AS accuracy FROM o GROUP BY symbol, source)
    SELECT symbol, source, accuracy FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY accuracy DESC, source) = 1""")  # fmt: skip
def dec06_direction_source(spark, d):
    p = T.direction_candidates(R.preds(spark, d), K).withColumn("up", F.col("actual") > 0)
    long = D.candidates(p, ["symbol", "date"], {n: n for n in ("prob", "return_prob", "prob_return_blend")}, ["up"])
    m = long.groupBy("symbol", "source").agg(F.round(F.avg(((F.col("value") >= 0.5) == F.col("up")).cast("int")), 9).alias("accuracy"))
    return D.best_by(m, K, "source", "accuracy", smallest=False)


_ENSEMBLE = f"""WITH c AS (SELECT symbol, date, actual, source, greatest(0, least(1, 0.5 + 10 * f * pred)) AS position, greatest(0, least(1, 0.5 + 10 * f * pred)) * actual AS r FROM preds, {_SOURCES}),
    s AS (SELECT symbol, source, exp(sum(ln(1 + r))) - 1 AS ret, CASE WHEN count(r) >= 2 THEN coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0), 0) ELSE 0 END AS t FROM c GROUP BY symbol, source),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(t, 9) DESC, source) AS rn FROM s WHERE ret >= -1), w AS (SELECT symbol, source, rn, greatest(ret, 1e-6) / sum(greatest(ret, 1e-6)) OVER (PARTITION BY symbol) AS weight FROM k WHERE rn <= 2)
    SELECT c.symbol, date, round(sum(weight * position), 6) + 0.0 AS position, 'position_ensemble:' || string_agg(c.source, '|' ORDER BY rn) AS source FROM c JOIN w ON c.symbol = w.symbol AND c.source = w.source GROUP BY c.symbol, date"""


@register("dec17_ensemble", _ENSEMBLE)
def dec17_ensemble(spark, d):
    c = _by_source(spark, d).withColumn("r", F.col("position") * F.col("actual"))
    scores = c.groupBy("symbol", "source").agg(D.score_of("r", "return").alias("validation_return"), F.round(D.score_of("r", "tstat"), 9).alias("t"))
    return D.position_ensemble(scores, c.select("symbol", "date", "source", "position"), K, "date", "t", 2, -1.0).select("symbol", "date", _r("position"), "source")


@register("dec18_pruning", """WITH q AS (SELECT symbol, unnest([0.25, 0.5, 0.75]) AS quantile, unnest(quantile_cont(prob, [0.25, 0.5, 0.75])) AS threshold FROM preds GROUP BY symbol),
    x AS (SELECT p.symbol, quantile, threshold, CASE WHEN prob >= threshold THEN prob ELSE 0 END AS pos, CASE WHEN prob >= threshold THEN prob ELSE 0 END * actual AS r FROM preds p JOIN q ON p.symbol = q.symbol AND threshold > 0),
    t AS (SELECT symbol, quantile, threshold, CASE WHEN count(r) >= 2 THEN coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0), 0) ELSE 0 END AS t, exp(sum(ln(1 + r))) - 1 AS ret, stddev_pop(pos) AS s FROM x GROUP BY ALL),
    b AS (SELECT symbol, CASE WHEN count(*) >= 2 THEN coalesce(avg(prob * actual) / nullif(stddev_samp(prob * actual) / sqrt(count(*)), 0), 0) ELSE 0 END AS bt, exp(sum(ln(1 + prob * actual))) - 1 AS bret FROM preds GROUP BY symbol)
    SELECT symbol, quantile::DOUBLE AS quantile, round(threshold, 6) AS threshold, round(t, 5) + 0.0 AS t_stat, round(bt, 5) + 0.0 AS base_t_stat FROM t JOIN b USING (symbol) WHERE s > 1e-12 AND t > bt AND ret >= CASE WHEN bret > 0 THEN bret * 0.5 ELSE bret END
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC, quantile) = 1""")  # fmt: skip
def dec18_pruning(spark, d):
    s = D.prune_positions(R.preds(spark, d), K, "prob", "actual", [0.25, 0.5, 0.75], 0.5)
    return s.select("symbol", "quantile", F.round("threshold", 6).alias("threshold"), _r("t_stat", 5), _r("base_t_stat", 5))
