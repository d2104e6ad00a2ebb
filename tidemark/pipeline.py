"""From tables to evaluated predictions: features, rolling windows, models, reports.

Each step is a lazy plan over all symbols and windows at once; nothing loops over
symbols, windows or days.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import Config
from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.lineage import cut
from tidemark.operators import bitemporal, dedup, evaluate
from tidemark.operators import models as M
from tidemark.operators import sequence as S
from tidemark.session import load

KEY = ["symbol"]
PRICE = ["ret_1", "ret_5", "ma_ratio", "std_20", "rsi_14", "volume_ratio"]
REPORT = ["fin_eps", "fin_roe", "fin_margin", "fin_leverage"]
MACRO = ["macro_level", "macro_step"]
TEXT = ["text_count", "text_score", "text_notice_ratio"]
CALENDAR = ["known_dow_sin", "known_dow_cos", "known_month_sin", "known_month_cos"]
GROUPS = {"price": PRICE, "report": REPORT, "macro": MACRO, "text": TEXT, "calendar": CALENDAR}

#: Rows a JSON report may have.
REPORT = 100_000


@dataclass
class Prepared:
    """Features by day and symbol, with the names of each group."""

    frame: DataFrame
    groups: dict[str, list[str]] = field(default_factory=lambda: dict(GROUPS))

    @property
    def features(self) -> list[str]:
        return [c for g in self.groups.values() for c in g]


class Pipeline:
    def __init__(self, spark: SparkSession, data: str, config: Config | None = None) -> None:
        self.spark, self.data, self.config = spark, data, config or Config()

    def tables(self) -> dict[str, DataFrame]:
        return {t: load(self.spark, self.data, t) for t in ("stock", "financial", "orders", "documents")}

    def prepare(self) -> Prepared:
        """Prices, reports as known on the day, released macro figures and lagged text rollups on each symbol's days."""
        t, cfg = self.tables(), self.config
        w = S.by(KEY, ["date"])
        b = dedup.keep_least(t["stock"], ["symbol", "date"], "stock_id")
        b = S.rsi(b, KEY, ["date"], "close", "rsi_14").withColumns({
            "ret_1": S.change("close", w), "ret_5": S.change("close", w, 5), "ma_ratio": F.try_divide("close", S.rolling(F.avg, "close", w, 20)),
            "volume_ratio": F.try_divide("volume", S.rolling(F.avg, "volume", w, 10)),
            "target": F.try_divide(F.lead("close", cfg.model.horizon).over(w), F.col("close")) - 1,
        })
        b = b.withColumn("std_20", S.rolling(F.stddev_samp, "ret_1", w, 20))
        known = bitemporal.as_known(b.select("stock_id", "symbol", "date"), t["financial"], "symbol", "date", "fin_id", "date", "disclosure_date", cfg.data.report_lag_days)
        fin = t["financial"].select(F.col("fin_id").alias("_id"), F.col("eps").alias("fin_eps"), F.col("roe").alias("fin_roe"), F.col("net_margin").alias("fin_margin"), F.try_divide("total_liabilities", "total_assets").alias("fin_leverage"))
        b = b.join(known.select("stock_id", "_id").join(fin, "_id").drop("_id"), "stock_id", "left")
        m = t["orders"].groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.avg("o_totalprice").alias("macro_level"))
        order = W.orderBy("month")  # one row a month
        m = m.withColumn("macro_step", F.col("macro_level") - F.lag("macro_level").over(order)).withColumn("a", D.release_day("month", cfg.data.macro_lag_days))
        m = m.withColumn("z", F.date_sub(F.coalesce(F.lead("a").over(order), F.date_add("a", 20000)), 1)).where("a <= z")
        b = b.join(m.select("macro_level", "macro_step", F.explode(F.sequence("a", "z")).alias("date")), "date", "left")
        x = t["documents"].where("date is not null").select(D.add_business_days("date", cfg.data.text_lag_business_days).alias("date"), "text_type", T.keyword_balance("text", ["rose", "上涨", "增长"], ["fell", "下跌", "下降"]).alias("s"))
        x = x.groupBy("date").agg(F.count("*").cast("double").alias("text_count"), F.avg("s").alias("text_score"), F.avg((F.col("text_type") == "notice").cast("double")).alias("text_notice_ratio"))
        b = b.join(x, "date", "left").withColumns({k: v for k, v in D.calendar_features("date").items() if k in CALENDAR})
        p = Prepared(b)
        fill = {c: F.coalesce(S.forward_fill(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), w), F.lit(0.0)) for c in p.features}
        p.frame = b.withColumns(fill).select("symbol", "date", "close", "target", *p.features)
        return p

    def split(self, p: Prepared) -> DataFrame:
        """Rows of every rolling window: window_id and split follow from a row's number, so nothing is joined."""
        c = self.config.windows
        size = c.train + c.validation + c.test
        f = p.frame.where("target is not null").withColumn("_n", F.row_number().over(S.by(KEY, ["date"]))).withColumn("_all", F.count("*").over(W.partitionBy(*KEY)))
        first, last = F.greatest(F.ceil((F.col("_n") - size) / c.step), F.lit(0)), F.least(F.floor((F.col("_n") - 1) / c.step), F.floor((F.col("_all") - size) / c.step))
        f = f.where(last >= first).withColumn("window_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        at = F.col("_n") - F.col("window_id") * c.step
        return f.withColumn("split", F.when(at <= c.train, "train").when(at <= c.train + c.validation, "val").otherwise("test")).drop("_n", "_all")

    def predict(self, rows: DataFrame, features: list[str]) -> DataFrame:
        """Ridge predictions of validation and test rows, with the penalty that does best on validation, and an interval."""
        c = self.config.model
        return M.window_ridge(rows, ["symbol", "window_id"], "date", "target", features, c.alphas, c.quantile_z)

    def backtest(self, p: Prepared | None = None, features: list[str] | None = None) -> DataFrame:
        """Test predictions of all windows, one per symbol and day: that of the earliest window."""
        p = p or self.prepare()
        test = self.predict(self.split(p), features or p.features).where("split = 'test'")
        return test.groupBy("symbol", "date").agg(F.min_by(F.struct("window_id", "alpha", "actual", "pred", "prob", "q10", "q90", "sigma"), "window_id").alias("r")).select("symbol", "date", "r.*")

    def report(self, predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Regression, classification, interval and rank metrics."""
        keys = keys or KEY
        up, guess = F.col("actual") > 0, F.col("prob") >= 0.5
        cols = evaluate.regression() | evaluate.classification(up, guess) | evaluate.probabilistic()
        base = predictions.groupBy(*keys).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in cols.items()))
        return base.join(evaluate.information_coefficients(predictions, keys), keys)

    def ablation(self, p: Prepared | None = None) -> DataFrame:
        """The mean error of the full model and of each model without one group of features."""
        p = p or self.prepare()
        rows = cut(self.split(p))
        out = None
        for name in ("full", *p.groups):
            feats = [c for g, cs in p.groups.items() if g != name for c in cs]
            one = self.predict(rows, feats).where("split = 'test'").agg(F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"), F.count("*").alias("n")).select(F.lit(name if name == "full" else f"no_{name}").alias("variant"), "mae", "n")
            out = one if out is None else out.unionByName(one)
        return out

    def significance(self, predictions: DataFrame) -> DataFrame:
        """The model against predicting nothing, by Diebold-Mariano per symbol."""
        d = predictions.withColumn("d", F.abs(F.col("pred") - F.col("actual")) - F.abs("actual"))
        return evaluate.diebold_mariano(d, KEY, "date", "d")

    def info_gain(self, p: Prepared | None = None, bins: int = 10) -> DataFrame:
        """Binned mutual information of every feature with the target."""
        p = p or self.prepare()
        long = p.frame.where("target is not null").select("date", "symbol", "target", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in p.features))).alias("v")).select("date", "symbol", "target", "v.*")
        long = long.withColumn("x", F.struct("value", "symbol", "date")).withColumn("y", F.struct("target", "symbol", "date"))
        return evaluate.binned_information(long, ["feature"], "x", "y", bins)

    def audit(self, p: Prepared | None = None) -> DataFrame:
        """Per symbol: rows, repeated days, first and last day, and features that equal the target."""
        p = p or self.prepare()
        suspicious = F.array(*(F.when(F.abs(F.coalesce(N.correlation(c, "target"), F.lit(0.0))) > 0.999, F.lit(c)) for c in p.features))
        return p.frame.groupBy("symbol").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("date")).alias("dup"), F.min("date").alias("d0"), F.max("date").alias("d1"), F.array_compact(suspicious).alias("suspicious"))

    def multiseed(self, predictions: DataFrame, seeds: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
        """Mean and population deviation of the mean error over resampled days."""
        e = predictions.select(F.abs(F.col("pred") - F.col("actual")).alias("e"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"), "symbol", "date")
        u = (F.xxhash64("symbol", "date", "seed").bitwiseAND(F.lit(2**52 - 1)) / F.lit(2.0**52))
        weight = F.size(F.filter(F.array(*(F.lit(float(x)) for x in evaluate.POISSON)), lambda x: u >= x))
        runs = e.groupBy("seed").agg((F.sum(F.col("e") * weight) / F.sum(weight)).alias("mae"))
        return runs.agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("std"), F.count("*").alias("n"))

    def save(self, frames: dict[str, DataFrame], path: str) -> None:
        """Tables as Parquet under ``path``."""
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def summary(self, df: DataFrame) -> str:
        """A report as JSON; one of more than ``REPORT`` rows is no report and is refused, not cut."""
        got = df.limit(REPORT + 1).collect()
        if len(got) > REPORT:
            raise ValueError(f"more than {REPORT} rows; save them as a table")
        return json.dumps([r.asDict(True) for r in got], default=str, ensure_ascii=False)
