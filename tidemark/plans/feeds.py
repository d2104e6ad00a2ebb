"""Queries of merged feeds, rollups, folds and seeds, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark import pipeline as P
from tidemark.functions import text as T
from tidemark.lineage import shared_dir
from tidemark.operators import feeds as O
from tidemark.plans import registry as R
from tidemark.plans.registry import register
from tidemark.session import load


def _path(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@register("src03_price_history", "SELECT stock_id AS id, date AS day, symbol, try_cast(close AS DOUBLE) AS close, NULL::DOUBLE AS vwap FROM stock")
def src03_price_history(spark, d):
    s = load(spark, d, "stock").withColumnsRenamed({"stock_id": "id", "date": "day"})
    return s.select("id", "day", "symbol", F.col("close").cast("string").try_cast("double").alias("close"), F.lit(None).cast("double").alias("vwap"))



@register("src05_sentiment_feeds", """SELECT coalesce(e.date, n.date, x.date) AS date, e.n AS posts, n.n AS news, x.n AS docs FROM (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1) e
    FULL JOIN (SELECT fetched_at::DATE AS date, count(*) AS n FROM news WHERE fetched_at IS NOT NULL GROUP BY 1) n ON e.date = n.date FULL JOIN (SELECT date, count(*) AS n FROM documents WHERE date IS NOT NULL GROUP BY date) x ON coalesce(e.date, n.date) = x.date""")  # fmt: skip
def src05_sentiment_feeds(spark, d):
    count = lambda df, day, name: df.groupBy(day.alias("date")).agg(F.count("*").alias(name)).where("date is not null")
    posts, news, docs = load(spark, d, "events"), load(spark, d, "news"), load(spark, d, "documents")
    return O.merge_feeds([count(posts, F.col("ts").cast("date"), "posts"), count(news, F.col("fetched_at").cast("date"), "news"), count(docs, F.col("date"), "docs")], ["date"])


_PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register("src06_macro_feeds", "SELECT date_trunc('month', o_orderdate)::DATE AS month, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority = '{p}'), 4) AS f{p[0]}" for p in _PRIORITY) + " FROM orders WHERE o_orderpriority IN (" + ", ".join(f"'{p}'" for p in _PRIORITY) + ") GROUP BY 1")
def src06_macro_feeds(spark, d):
    """Five feeds, each with its own months, joined by month."""
    o = load(spark, d, "orders").withColumn("month", F.trunc(F.col("o_orderdate").cast("date"), "month"))
    return O.merge_feeds([o.where(F.col("o_orderpriority") == p).groupBy("month").agg(F.round(F.avg("o_totalprice"), 4).alias(f"f{p[0]}")) for p in _PRIORITY], ["month"])


@register("src07_industry", """WITH p AS (SELECT date, avg(close) AS proxy FROM bars GROUP BY date), j AS (SELECT b.symbol, b.date, CASE WHEN b.volume IS NOT NULL THEN b.close ELSE p.proxy END AS level, b.turnover_rate FROM bars b JOIN p ON b.date = p.date)
    SELECT symbol, date, round(level, 6) AS level, last_value(turnover_rate IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS pe FROM j""")  # fmt: skip
def src07_industry(spark, d):
    """The direct level where there is one, else the mean of the members; the ratio carried forward."""
    b = R.bars(spark, d)
    j = b.join(b.groupBy("date").agg(F.avg("close").alias("proxy")), "date")
    w = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return j.select("symbol", "date", F.round(F.when(F.col("volume").isNotNull(), F.col("close")).otherwise(F.col("proxy")), 6).alias("level"), F.last("turnover_rate", ignorenulls=True).over(w).alias("pe"))


@register("src09_month_end_snapshots", """WITH s AS (SELECT symbol, min(last_day(date)) AS a, max(last_day(date)) AS z FROM bars GROUP BY symbol), m AS (SELECT symbol, last_day(g::DATE) AS month_end FROM (SELECT symbol, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH)) AS g FROM s)),
    l AS (SELECT symbol, last_day(date) AS month_end, arg_max(turnover_rate, date) AS v FROM bars WHERE turnover_rate IS NOT NULL GROUP BY ALL)
    SELECT m.symbol, m.month_end, last_value(v IGNORE NULLS) OVER (PARTITION BY m.symbol ORDER BY m.month_end) AS turnover_rate FROM m LEFT JOIN l ON m.symbol = l.symbol AND m.month_end = l.month_end""")  # fmt: skip
def src09_month_end_snapshots(spark, d):
    return O.month_end_snapshots(R.bars(spark, d), ["symbol"], "date", "turnover_rate")


@register("src10_policy_gaps", """WITH a AS (SELECT url, min(title) AS title, fetched_at::DATE AS day FROM policy WHERE url IS NOT NULL AND fetched_at IS NOT NULL GROUP BY ALL), b AS (SELECT url, min(title) AS title, date AS day FROM documents WHERE text_type = 'policy' AND url IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
    e AS (SELECT year(day) AS y FROM a GROUP BY 1 HAVING count(*) >= 60), r AS (SELECT url, title, day, 0 AS o FROM a UNION ALL SELECT url, title, day, 1 FROM b WHERE year(day) NOT IN (SELECT y FROM e))
    SELECT url, title, day FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY o, title NULLS FIRST, day) = 1""")  # fmt: skip
def src10_policy_gaps(spark, d):
    a = load(spark, d, "policy").where("url is not null and fetched_at is not null").groupBy("url", F.col("fetched_at").cast("date").alias("day")).agg(F.min("title").alias("title")).select("url", "title", "day")
    b = load(spark, d, "documents").where("text_type = 'policy' and url is not null and date is not null").groupBy("url", F.col("date").alias("day")).agg(F.min("title").alias("title")).select("url", "title", "day")
    return O.fill_gaps(a, b, F.year("day"), 60, ["url"])


@register("src12_union_of_feeds", """SELECT 'news' AS feed, news_id AS id, title, lang, source_quality_score AS quality FROM news UNION ALL SELECT 'notices', notice_id, title, NULL, NULL FROM notices UNION ALL SELECT 'policy', policy_id, title, NULL, NULL FROM policy""")
def src12_union_of_feeds(spark, d):
    n = load(spark, d, "news").select(F.col("news_id").alias("id"), "title", "lang", F.col("source_quality_score").alias("quality"))
    return O.union_feeds({"news": n, "notices": load(spark, d, "notices").select(F.col("notice_id").alias("id"), "title"), "policy": load(spark, d, "policy").select(F.col("policy_id").alias("id"), "title")})


@register("snk02_json_report", "SELECT symbol, count(*) AS n, round(avg(close), 4) AS close FROM bars GROUP BY symbol")
def snk02_json_report(spark, d):
    """A report written as JSON and read back."""
    r = R.bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("close"), 4).alias("close"))
    r.write.json(path := _path(spark))
    return spark.read.schema(r.schema).json(path)


@register("snk05_saved_tables", "SELECT symbol, date, round(pred, 9) AS pred FROM preds")
def snk05_saved_tables(spark, d):
    """Tables saved side by side under one folder, one of them read back."""
    p = R.preds(spark, d).select("symbol", "date", F.round("pred", 9).alias("pred"))
    P.Pipeline.save(None, {"predictions": p, "reports": p.groupBy("symbol").count()}, path := _path(spark))
    return spark.read.schema(p.schema).parquet(f"{path}/predictions")


@register("prj02_keep_list", "SELECT stock_id, symbol, date, close, volume FROM stock")
def prj02_keep_list(spark, d):
    s = load(spark, d, "stock")
    keep = ["stock_id", "symbol", "date", "close", "volume", "not_there"]
    return s.select(*(c for c in keep if c in s.columns))


@register("prj10_prefix_weights", "SELECT stock_id, coalesce(close, 0) * 0.5 AS macro_close, coalesce(volume, 0) * 2.0 AS industry_volume, amount FROM stock")
def prj10_prefix_weights(spark, d):
    s = load(spark, d, "stock").select("stock_id", F.col("close").alias("macro_close"), F.col("volume").alias("industry_volume"), "amount")
    return O.weigh_prefixes(s, {"macro_": 0.5, "industry_": 2.0, "am": 1.0})


@register("prj19_attached_parameters", "SELECT p.symbol, date, round(s, 7) AS scale, round(t, 7) AS threshold FROM preds p JOIN (SELECT symbol, stddev_pop(pred) AS s, quantile_cont(pred, 0.55) AS t FROM preds GROUP BY symbol) q ON p.symbol = q.symbol")
def prj19_attached_parameters(spark, d):
    p = R.preds(spark, d)
    q = p.groupBy("symbol").agg(F.round(F.stddev_pop("pred"), 7).alias("scale"), F.round(F.percentile("pred", 0.55), 7).alias("threshold"))
    return p.join(q, "symbol").select("symbol", "date", "scale", "threshold")


@register("flt13_without_prefixes", "SELECT n_nationkey, n_name FROM nation")
def flt13_without_prefixes(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_name", F.lit(1).alias("news_proxy_count"), F.lit(2).alias("sentiment_proxy_abs"))
    return O.without_prefixes(n, ["news_proxy_", "sentiment_proxy_"])


@register("flt14_suspicious_names", "SELECT column_name AS name FROM (DESCRIBE SELECT l_orderkey, l_tax AS tax_target, l_discount AS Future_Return_5, l_quantity AS pred_return, l_extendedprice FROM lineitem) WHERE regexp_matches(lower(column_name), 'target|future_return|pred_return|label')")
def flt14_suspicious_names(spark, d):
    x = load(spark, d, "lineitem").select("l_orderkey", F.col("l_tax").alias("tax_target"), F.col("l_discount").alias("Future_Return_5"), F.col("l_quantity").alias("pred_return"), "l_extendedprice")
    return spark.createDataFrame([(n,) for n in O.suspicious_names(x.columns, ["target", "future_return", "pred_return", "label"])], "name string")


@register("set02_column_sets", "SELECT name, 'both' AS part FROM (VALUES ('symbol'), ('date')) AS v(name) UNION ALL SELECT name, 'stock' FROM (VALUES ('stock_id'), ('open'), ('close'), ('high'), ('low'), ('volume'), ('amount'), ('amplitude'), ('pct_change'), ('change'), ('turnover_rate')) AS v(name)")
def set02_column_sets(spark, d):
    """Columns of one table that another has too, and those it has alone."""
    a, b = load(spark, d, "stock").columns, set(load(spark, d, "financial").columns)
    return spark.createDataFrame([(c, "both" if c in b else "stock") for c in a], "name string, part string")


@register("str23_unique_terms", "SELECT DISTINCT lower(trim(publisher, ' ')) AS term FROM news WHERE trim(coalesce(publisher, ''), ' ') <> '' AND lang = 'en'")
def str23_unique_terms(spark, d):
    """Terms trimmed and in lower case, once each; the same rule as for lists on the driver."""
    n = load(spark, d, "news").where("lang = 'en'").select(F.lower(F.trim("publisher")).alias("term"))
    return n.where(F.coalesce("term", F.lit("")) != "").distinct()


@register("lim03_row_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def lim03_row_limit(spark, d):
    from tidemark.operators.dedup import top_per_group

    docs = load(spark, d, "documents").select("doc_id", F.lit(1).alias("one"))
    return top_per_group(docs, ["one"], ["doc_id"], 25).select("doc_id")


@register("jon07_paired", "SELECT p.symbol, count(*) AS n, round(avg(abs(p.pred - p.actual) - abs(v.pred - p.actual)), 7) + 0.0 AS mae_gain, round(avg((p.pred - p.actual) ** 2 - (v.pred - p.actual) ** 2), 8) + 0.0 AS mse_gain FROM preds p JOIN (SELECT symbol, date, lag(pred) OVER (PARTITION BY symbol ORDER BY date) AS pred FROM preds) v ON p.symbol = v.symbol AND p.date = v.date AND v.pred IS NOT NULL GROUP BY p.symbol HAVING count(*) >= 8")
def jon07_paired(spark, d):
    """Two models' predictions of the same days, paired: what the second does better."""
    p = R.preds(spark, d)
    v = p.select("symbol", "date", F.lag("pred").over(W.partitionBy("symbol").orderBy("date")).alias("other")).where("other is not null")
    a, b = F.col("pred") - F.col("actual"), F.col("other") - F.col("actual")
    g = p.join(v, ["symbol", "date"]).groupBy("symbol").agg(F.count("*").alias("n"), (F.round(F.avg(F.abs(a) - F.abs(b)), 7) + F.lit(0.0)).alias("mae_gain"), (F.round(F.avg(a * a - b * b), 8) + F.lit(0.0)).alias("mse_gain"))
    return g.where("n >= 8")


@register("jon13_fitted_statistics", "SELECT stock_id, round((close - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) + 0.0 AS z FROM stock, (SELECT avg(close) AS m, stddev_pop(close) AS s FROM stock WHERE date < DATE '2021-01-01')")
def jon13_fitted_statistics(spark, d):
    """Statistics of the training rows, one row, joined to all rows."""
    s = load(spark, d, "stock").select("stock_id", "date", "close")
    fit = s.where("date < '2021-01-01'").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s"))
    z = (F.col("close") - F.col("m")) / F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s"))
    return s.join(F.broadcast(fit), F.lit(True)).select("stock_id", (F.round(z, 6) + F.lit(0.0)).alias("z"))


_SCORE = "SELECT p_brand AS modality, p_partkey, p_size / 50.0 AS a, (p_size * 7 % 13) / 13.0 AS b FROM part"


@register("agg11_modality_rollup", f"SELECT modality, count(*) AS feature_count, round(avg(a), 8) AS mean_a, round(sum(a), 6) AS sum_a, round(avg(b), 8) AS mean_b, round(sum(b), 6) AS sum_b FROM ({_SCORE}) GROUP BY modality")
def agg11_modality_rollup(spark, d):
    p = load(spark, d, "part").select(F.col("p_brand").alias("modality"), (F.col("p_size") / 50.0).alias("a"), ((F.col("p_size") * 7 % 13) / 13.0).alias("b"))
    return p.groupBy("modality").agg(F.count("*").alias("feature_count"), F.round(F.avg("a"), 8).alias("mean_a"), F.round(F.sum("a"), 6).alias("sum_a"), F.round(F.avg("b"), 8).alias("mean_b"), F.round(F.sum("b"), 6).alias("sum_b"))


_SEEDS = [11, 23, 37, 41, 53]
_DRAWN = "SELECT seed, e FROM (SELECT abs(pred - actual) AS e, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM preds), (VALUES (11), (23), (37), (41), (53)) AS v(seed) WHERE ((i + 1) * 7919 + seed * 104729 + ((i + 3) * (seed + 11)) % 9973) % 100 < 80"


@register("agg12_evl13_seeds", f"SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std, count(*) AS n, round(min(m), 9) AS least, round(max(m), 9) AS most FROM (SELECT seed, avg(e) AS m FROM ({_DRAWN}) GROUP BY seed)")
def agg12_evl13_seeds(spark, d):
    """A metric over runs that each see another draw of rows, by seed: mean, population deviation and range."""
    p = R.preds(spark, d).withColumn("e", F.abs(F.col("pred") - F.col("actual"))).withColumn("i", F.row_number().over(W.partitionBy("symbol").orderBy("date")))
    m = O.seeded(p, F.col("i"), _SEEDS).groupBy("seed").agg(F.avg("e").alias("m"))
    return m.agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_pop("m"), 9).alias("std"), F.count("*").alias("n"), F.round(F.min("m"), 9).alias("least"), F.round(F.max("m"), 9).alias("most"))


@register("agg13_attention_means", "SELECT round(avg(coalesce(list_position(embedding, list_max(embedding)) - 1, 0)), 6) AS peak_lag, round(avg(coalesce(list_max(embedding), 0)::DOUBLE), 6) AS peak_weight FROM embeddings")
def agg13_attention_means(spark, d):
    e = load(spark, d, "embeddings").select((F.array_position("embedding", F.array_max("embedding")) - 1).alias("lag"), F.array_max("embedding").cast("double").alias("peak"))
    return e.agg(F.round(F.avg(F.coalesce("lag", F.lit(0))), 6).alias("peak_lag"), F.round(F.avg(F.coalesce("peak", F.lit(0.0))), 6).alias("peak_weight"))


@register("agg18_modality_weights", "SELECT k AS modality, round(avg(v), 6) AS weight FROM (SELECT unnest(['numeric', 'text', 'cross']) AS k, unnest([prob, abs(pred), 1 - prob]) AS v FROM preds) GROUP BY k")
def agg18_modality_weights(spark, d):
    m = R.preds(spark, d).select(F.explode(F.create_map(F.lit("numeric"), F.col("prob"), F.lit("text"), F.abs("pred"), F.lit("cross"), 1 - F.col("prob"))).alias("modality", "v"))
    return m.groupBy("modality").agg(F.round(F.avg("v"), 6).alias("weight"))


@register("agg15_event_contributions", """SELECT key, title, round(m, 9) AS mean_weight, n AS count FROM (SELECT coalesce(nullif(trim(text_uid, ' '), ''), nullif(trim(title, ' '), '')) AS key, min(title) AS title, avg(coalesce(length(text) / 1000.0, 0)) AS m, count(*) AS n FROM documents WHERE date IS NOT NULL GROUP BY 1 HAVING key IS NOT NULL)
    ORDER BY round(m, 9) DESC, key LIMIT 20""")  # fmt: skip
def agg15_event_contributions(spark, d):
    """The events of the day in one array per day and source, as predictions carry them, ranked by their mean weight."""
    e = F.struct(F.col("text_uid").alias("uid"), "title", (F.length("text") / 1000.0).alias("weight"))
    days = load(spark, d, "documents").where("date is not null").groupBy("date", "source").agg(F.collect_list(e).alias("events"))
    return O.event_contributions(days, "events", 20).select("key", "title", F.round("mean_weight", 9).alias("mean_weight"), "count")


@register("ml07_fold_selection", """WITH o AS (SELECT symbol, date, pred AS x, actual AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM preds),
    f AS (SELECT o.*, k AS fold, CASE WHEN i < n - (3 - k) * (n // 4) THEN 'train' WHEN i < n - (3 - k) * (n // 4) + n // 4 THEN 'test' END AS part FROM o, (VALUES (0), (1), (2)) AS v(k)),
    t AS (SELECT symbol, fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS xy, var_pop(x) * count(*) AS xx FROM f WHERE part = 'train' GROUP BY ALL),
    e AS (SELECT f.symbol, a, f.fold, avg((my + coalesce(xy / nullif(xx + a, 0), 0) * (x - mx) - y) ** 2) AS s FROM f JOIN t ON f.symbol = t.symbol AND f.fold = t.fold, (VALUES (0.001), (0.01), (0.1), (1.0)) AS p(a) WHERE part = 'test' GROUP BY ALL),
    m AS (SELECT symbol, a::DOUBLE AS penalty, round(avg(s), 12) AS mse FROM e GROUP BY ALL)
    SELECT symbol, penalty, round(mse, 9) AS mse FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mse, penalty) = 1""")  # fmt: skip
def ml07_fold_selection(spark, d):
    s = O.select_penalty(R.preds(spark, d), ["symbol"], "date", "pred", "actual", [0.001, 0.01, 0.1, 1.0])
    return s.select("symbol", "penalty", F.round("mse", 9).alias("mse"))


@register("agg04_proxy_by_source", "SELECT date, " + ", ".join(f"round(avg(s) {w}, 8) + 0.0 AS {p}_score, round(avg(abs(s)) {w}, 8) AS {p}_abs, count(*) {w} AS {p}_count, sum(length(text)) {w} AS {p}_len, round(avg((s > 0)::INT) {w}, 8) AS {p}_positive, round(avg((s < 0)::INT) {w}, 8) AS {p}_negative, count(DISTINCT source) {w} AS {p}_sources" for p, w in (("all", "FILTER (true)"), ("news", "FILTER (text_type = 'news')"), ("notice", "FILTER (text_type = 'notice')"), ("policy", "FILTER (text_type = 'policy')")))
          + " FROM (SELECT *, (contains(lower(text), 'rose')::INT + contains(text, '增长')::INT - contains(lower(text), 'fell')::INT - contains(text, '下降')::INT) AS s FROM documents WHERE date IS NOT NULL) GROUP BY date")
def agg04_proxy_by_source(spark, d):
    """Seven aggregates a day over all texts and over each type, in one pass."""
    n = load(spark, d, "documents").where("date is not null").withColumn("s", T.keyword_balance("text", ["rose", "增长"], ["fell", "下降"]))
    out = []
    for p in ("all", "news", "notice", "policy"):
        on = F.lit(True) if p == "all" else F.col("text_type") == p
        of = lambda x, on=on: F.when(on, x)
        s = F.col("s")
        out += [(F.round(F.avg(of(s)), 8) + F.lit(0.0)).alias(f"{p}_score"), F.round(F.avg(of(F.abs(s))), 8).alias(f"{p}_abs"), F.count(of(F.lit(1))).alias(f"{p}_count"), F.sum(of(F.length("text"))).alias(f"{p}_len"),
                F.round(F.avg(of((s > 0).cast("int"))), 8).alias(f"{p}_positive"), F.round(F.avg(of((s < 0).cast("int"))), 8).alias(f"{p}_negative"), F.countDistinct(of(F.col("source"))).alias(f"{p}_sources")]
    return n.groupBy("date").agg(*out)
