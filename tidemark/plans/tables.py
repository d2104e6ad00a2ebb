"""Queries of projections, filters, joins, aggregates, de-duplication and set operations."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import dedup as DD
from tidemark.operators import relational as REL
from tidemark.plans import registry as R
from tidemark.plans.registry import register
from tidemark.plans.scalars import _BLOB, _FP, _KEY, CLASS_RULES, NEGATIVE, POSITIVE
from tidemark.session import load, spread

_HIT = lambda ts: "coalesce(regexp_matches(lower(text), '" + "|".join(ts) + "'), false)::DOUBLE"


@register("prj01_rename", "SELECT stock_id AS id, symbol AS code, close AS price FROM stock")
def prj01_rename(spark, d):
    return load(spark, d, "stock").withColumnsRenamed({"stock_id": "id", "symbol": "code", "close": "price"}).select("id", "code", "price")


@register("prj04_date_coercion", "SELECT news_id, try_cast(date AS DATE) AS day FROM news WHERE regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(date AS DATE) IS NOT NULL")
def prj04_date_coercion(spark, d):
    n = load(spark, d, "news").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return n.select("news_id", F.try_to_date("date", "yyyy-MM-dd").alias("day")).where("day is not null")


@register("prj05_unique_dates", "SELECT stock_id, symbol, date, close FROM bars")
def prj05_unique_dates(spark, d):
    return R.bars(spark, d).select("stock_id", "symbol", "date", "close")


@register("prj06_conform", "SELECT notice_id AS notice_id, coalesce(category, 'none') AS category, NULL::DOUBLE AS quality, try_cast(date AS BIGINT) AS date FROM (SELECT notice_id, category, CASE WHEN regexp_matches(date, '^\\d{1,18}$') THEN date END AS date FROM notices)")
def prj06_conform(spark, d):
    schema = StructType([StructField("notice_id", LongType()), StructField("category", StringType()), StructField("quality", DoubleType()), StructField("date", LongType())])
    return REL.conform(load(spark, d, "notices"), schema, {"category": "none"})


@register("prj07_numeric_columns", "SELECT name, count(v) AS n FROM (UNPIVOT (SELECT eps, bps, revenue, net_profit, roe, gross_margin, net_margin, cash, inventory, parent_equity, operate_profit FROM financial) ON COLUMNS(*) INTO NAME name VALUE v) GROUP BY name")
def prj07_numeric_columns(spark, d):
    f = load(spark, d, "financial")
    names = REL.numeric_columns(f, skip=("fin_id", "total_"))
    return REL.melt(f.select(*names), [], names).groupBy("name").agg(F.count("value").alias("n")).where("n > 0")


@register("prj08_spread_ratio", "SELECT fin_id, round(total_assets - total_liabilities, 4) AS spread, round(total_liabilities / nullif(total_assets, 0), 6) AS ratio, round(coalesce(net_profit / nullif(parent_equity, 0), 0), 6) AS roe FROM financial")
def prj08_spread_ratio(spark, d):
    return load(spark, d, "financial").select("fin_id", F.round(F.col("total_assets") - F.col("total_liabilities"), 4).alias("spread"), F.round(F.try_divide("total_liabilities", "total_assets"), 6).alias("ratio"), F.round(F.coalesce(F.try_divide("net_profit", "parent_equity"), F.lit(0.0)), 6).alias("roe"))


@register("prj09_scaled", "SELECT fin_id, round(eps * 0.5, 6) AS eps, round(roe * 0.5, 6) AS roe FROM financial")
def prj09_scaled(spark, d):
    f = REL.scale(load(spark, d, "financial").select("fin_id", "eps", "roe"), 0.5, ("_id",))
    return f.select("fin_id", F.round("eps", 6).alias("eps"), F.round("roe", 6).alias("roe"))


@register("prj13_static_hash")
def prj13_static_hash(spark, d):
    def scaled(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "big") / (2**32 - 1))

    return load(spark, d, "stock").select("symbol").distinct().select("symbol", F.pandas_udf(scaled, DoubleType())("symbol").alias("static_symbol"))


@register("prj14_winsorised", "WITH q AS (SELECT quantile_cont(pct_change, 0.01) AS a, quantile_cont(pct_change, 0.99) AS b FROM stock) SELECT stock_id, round(CASE WHEN pct_change IS NOT NULL THEN least(greatest(pct_change, a), b) END, 6) AS x FROM stock, q")
def prj14_winsorised(spark, d):
    s = load(spark, d, "stock").select("stock_id", F.col("pct_change").alias("x"))
    return REL.winsorise(s, ["x"], 0.01, 0.99).select("stock_id", F.round("x", 6).alias("x"))


@register("prj15_masked", "SELECT stock_id, close, 0.0::DOUBLE AS volume, 0.0::DOUBLE AS amount FROM stock")
def prj15_masked(spark, d):
    return REL.mask(load(spark, d, "stock").select("stock_id", "close", "volume", "amount"), ["volume", "amount"])


@register("prj16_array_without_type", "SELECT date, count(*) FILTER (text_type <> 'notice') AS n FROM (SELECT date, text_type FROM documents WHERE date IS NOT NULL) GROUP BY date")
def prj16_array_without_type(spark, d):
    """Events of a day without those of one type; no array of a day is built, so a day may hold any number."""
    return load(spark, d, "documents").where("date is not null").groupBy("date").agg(F.count_if(F.col("text_type") != "notice").alias("n"))


@register("prj20_variance_rank", "SELECT name FROM (SELECT name, var_pop(v) AS s FROM (UNPIVOT (SELECT eps, bps, revenue, net_profit, roe, cash, inventory, total_assets FROM financial) ON COLUMNS(*) INTO NAME name VALUE v) GROUP BY name) ORDER BY s DESC, name LIMIT 4")
def prj20_variance_rank(spark, d):
    names = ["eps", "bps", "revenue", "net_profit", "roe", "cash", "inventory", "total_assets"]
    return REL.melt(load(spark, d, "financial").select(*names), [], names).groupBy("name").agg(F.var_pop("value").alias("s")).orderBy(F.desc("s"), "name").limit(4).select("name")


@register("flt01_date_clip", "SELECT doc_id, date FROM documents WHERE date BETWEEN DATE '2021-01-01' - 30 AND DATE '2021-12-31'")
def flt01_date_clip(spark, d):
    return load(spark, d, "documents").select("doc_id", "date").where(F.col("date").between(F.date_sub(F.lit("2021-01-01").cast("date"), 30), F.lit("2021-12-31").cast("date")))


@register("flt02_missing_years", "SELECT y FROM generate_series(2015, 2030) AS g(y) WHERE y NOT IN (SELECT year(date) FROM documents WHERE date IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)")
def flt02_missing_years(spark, d):
    have = load(spark, d, "documents").where("date is not null").groupBy(F.year("date").cast("bigint").alias("y")).count().where("count >= 20")
    return spark.range(2015, 2031).withColumnRenamed("id", "y").join(have, "y", "left_anti")


_QUALITY_SQL = f"SELECT doc_id, date, title, source, url, text_type, length({_BLOB}) AS chars, 4 * {_HIT(['储能', 'storage'])} + 1.5 * {_HIT(POSITIVE)} - {_HIT(NEGATIVE)} + 0.75 * least(length(text) / 240.0, 1.0) AS score, (doc_id * 37 % 101) / 100.0 AS quality FROM documents"


def _scored(spark, d):
    blob = T.blob("title", "text", "text_type")
    score = T.additive_score((4, T.contains_any("text", ["储能", "storage"])), (1.5, T.contains_any("text", POSITIVE)), (-1, T.contains_any("text", NEGATIVE)), (0.75, F.least(F.length("text") / 240.0, F.lit(1.0))))
    docs = spread(load(spark, d, "documents").select("doc_id", "date", "title", "text", "source", "url", "text_type"))
    return docs.select("doc_id", "date", "title", "source", "url", "text_type", F.length(blob).alias("chars"), score.alias("score"), (F.col("doc_id") * 37 % 101 / 100.0).alias("quality"))


@register("flt04_quality_filter", f"SELECT doc_id, round(score, 6) AS score FROM ({_QUALITY_SQL}) WHERE chars >= 120 AND score >= 3 AND quality >= 0.25 AND NOT (source LIKE 'crawl%' AND score < 5)")
def flt04_quality_filter(spark, d):
    return _scored(spark, d).where("chars >= 120 and score >= 3 and quality >= 0.25 and not (source like 'crawl%' and score < 5)").select("doc_id", F.round("score", 6).alias("score"))


@register("flt06_min_keep", f"SELECT doc_id FROM (SELECT *, count(*) FILTER (score >= 6.2) OVER () AS strict FROM ({_QUALITY_SQL})) WHERE (score >= 6.2 OR strict < 500 AND score >= 4) QUALIFY strict >= 500 OR row_number() OVER (ORDER BY quality DESC, round(score, 6) DESC, doc_id) <= 500")
def flt06_min_keep(spark, d):
    """The strict selection, or, where it is smaller than wanted, the best rows of a relaxed one: a report of at most 500 rows."""
    s = _scored(spark, d)
    strict = s.where("score >= 6.2")
    if strict.limit(500).count() >= 500:
        return strict.select("doc_id")
    return s.where("score >= 4").orderBy(F.desc("quality"), F.desc(F.round("score", 6)), "doc_id").limit(500).select("doc_id")


@register("flt07_policy_terms", "SELECT policy_id FROM policy WHERE regexp_matches(title, '通知|规定|Rule|rule|bureau') OR coalesce(regexp_matches(content, '补贴|credits|Article'), false)")
def flt07_policy_terms(spark, d):
    return load(spark, d, "policy").where(F.col("title").rlike("通知|规定|Rule|rule|bureau") | F.coalesce(F.col("content").rlike("补贴|credits|Article"), F.lit(False))).select("policy_id")


@register("flt08_title_and_focus", "SELECT notice_id FROM notices WHERE regexp_matches(title, '公告|notice|Meldung') AND coalesce(regexp_matches(content, '质押|pledged|Stimmrechte'), false)")
def flt08_title_and_focus(spark, d):
    return load(spark, d, "notices").where(F.col("title").rlike("公告|notice|Meldung") & F.coalesce(F.col("content").rlike("质押|pledged|Stimmrechte"), F.lit(False))).select("notice_id")


@register("flt12_type_allow_list", "SELECT doc_id FROM documents WHERE text_type IN ('news', 'policy')")
def flt12_type_allow_list(spark, d):
    return load(spark, d, "documents").where(F.col("text_type").isin("news", "policy")).select("doc_id")


@register("jon01_left_chain", """SELECT b.symbol, b.date, b.close, x.n AS events, y.n AS docs FROM bars b LEFT JOIN (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1) x ON b.date = x.date
    LEFT JOIN (SELECT date, count(*) AS n FROM documents GROUP BY 1) y ON b.date = y.date""")  # fmt: skip
def jon01_left_chain(spark, d):
    x = load(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("events"))
    y = load(spark, d, "documents").groupBy("date").agg(F.count("*").alias("docs"))
    return R.bars(spark, d).select("symbol", "date", "close").join(x, "date", "left").join(y, "date", "left").select("symbol", "date", "close", "events", "docs")


@register("jon03_full_outer", """SELECT coalesce(a.date, b.date) AS date, a.n AS docs, b.v AS volume FROM (SELECT date, count(*) AS n FROM documents WHERE date IS NOT NULL GROUP BY date) a
    FULL JOIN (SELECT date, round(sum(amount), 2) AS v FROM stock GROUP BY date) b ON a.date = b.date""")  # fmt: skip
def jon03_full_outer(spark, d):
    a = load(spark, d, "documents").where("date is not null").groupBy("date").agg(F.count("*").alias("docs"))
    b = load(spark, d, "stock").groupBy("date").agg(F.round(F.sum("amount"), 2).alias("volume"))
    return REL.outer_join([a, b], ["date"])


@register("jon04_source_proxies", "SELECT d.date, n, coalesce(w.m, 0) AS wire FROM (SELECT date, count(*) AS n FROM documents WHERE date IS NOT NULL GROUP BY date) d LEFT JOIN (SELECT date, count(*) AS m FROM documents WHERE source = 'lantern_wire' GROUP BY date) w ON d.date = w.date")
def jon04_source_proxies(spark, d):
    return load(spark, d, "documents").where("date is not null").groupBy("date").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "lantern_wire").alias("wire"))


@register("jon06_inner", "SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def jon06_inner(spark, d):
    return load(spark, d, "orders").select("o_orderkey").join(load(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@register("jon08_semi", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM sources WHERE kind = 'crawl')")
def jon08_semi(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "sources").where("kind = 'crawl'"), "source", "left_semi").select("doc_id")


@register("jon09_anti", "SELECT DISTINCT symbol FROM stock WHERE symbol NOT IN (SELECT symbol FROM financial WHERE symbol IS NOT NULL)")
def jon09_anti(spark, d):
    return load(spark, d, "stock").select("symbol").distinct().join(load(spark, d, "financial"), "symbol", "left_anti")


@register("agg01_text_daily", f"""SELECT date, count(*) AS n, round(avg(score), 9) AS score_mean, round(avg(abs(score)), 9) AS score_abs_mean, round(avg((score > 4)::INT), 9) AS high_ratio, round(avg(chars), 9) AS length_mean, sum(chars)::BIGINT AS length_sum,
    round(avg(quality), 9) AS quality_mean, round(avg((text_type = 'news')::INT), 9) AS news_ratio, round(avg((text_type = 'notice')::INT), 9) AS notice_ratio, count(DISTINCT source) AS source_diversity FROM ({_QUALITY_SQL}) WHERE date IS NOT NULL GROUP BY date""")
def agg01_text_daily(spark, d):
    r = lambda x: F.round(F.avg(x), 9)
    return _scored(spark, d).where("date is not null").groupBy("date").agg(
        F.count("*").alias("n"), r("score").alias("score_mean"), r(F.abs("score")).alias("score_abs_mean"), r((F.col("score") > 4).cast("int")).alias("high_ratio"), r("chars").alias("length_mean"), F.sum("chars").alias("length_sum"),
        r("quality").alias("quality_mean"), r((F.col("text_type") == "news").cast("int")).alias("news_ratio"), r((F.col("text_type") == "notice").cast("int")).alias("notice_ratio"), F.countDistinct("source").alias("source_diversity"))


@register("agg02_lagged_publishers", "SELECT fetched_at::DATE AS date, count(*) AS n, count(DISTINCT coalesce(publisher, '')) AS publishers, count(DISTINCT CASE WHEN trim(publisher) <> '' THEN publisher END) AS named FROM news WHERE lang IN ('en', 'zh') AND fetched_at IS NOT NULL GROUP BY 1")
def agg02_lagged_publishers(spark, d):
    n = load(spark, d, "news").where(F.col("lang").isin("en", "zh") & F.col("fetched_at").isNotNull())
    return n.groupBy(F.col("fetched_at").cast("date").alias("date")).agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("publisher", F.lit(""))).alias("publishers"), F.countDistinct(F.when(F.trim("publisher") != "", F.col("publisher"))).alias("named"))


@register("agg03_policy_daily", f"SELECT date, count(*) AS n, round(avg(score), 6) AS m, round(max(score), 6) AS top, round(sum(quality), 6) AS q FROM ({_QUALITY_SQL}) WHERE text_type = 'policy' AND date IS NOT NULL GROUP BY date")
def agg03_policy_daily(spark, d):
    return _scored(spark, d).where("text_type = 'policy' and date is not null").groupBy("date").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("m"), F.round(F.max("score"), 6).alias("top"), F.round(F.sum("quality"), 6).alias("q"))


@register("agg04_pivot_by_type", "SELECT date, count(*) FILTER (text_type = 'news') AS news, count(*) FILTER (text_type = 'notice') AS notice, count(*) FILTER (text_type = 'policy') AS policy FROM documents WHERE date IS NOT NULL GROUP BY date")
def agg04_pivot_by_type(spark, d):
    return load(spark, d, "documents").where("date is not null").groupBy("date").pivot("text_type", ["news", "notice", "policy"]).count().na.fill(0)


@register("agg05_posts_daily", "SELECT ts::DATE AS date, event_type, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS m FROM events GROUP BY ALL")
def agg05_posts_daily(spark, d):
    return load(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"), F.round(F.avg("value"), 6).alias("m"))


@register("agg06_constituent_proxy", "SELECT date, round(avg(close), 6) AS close, round(sum(volume), 2) AS volume, count(DISTINCT symbol) AS members, round(avg((pct_change > 0)::INT), 6) AS up_ratio FROM bars GROUP BY date")
def agg06_constituent_proxy(spark, d):
    return R.bars(spark, d).groupBy("date").agg(F.round(F.avg("close"), 6).alias("close"), F.round(F.sum("volume"), 2).alias("volume"), F.countDistinct("symbol").alias("members"), F.round(F.avg((F.col("pct_change") > 0).cast("int")), 6).alias("up_ratio"))


@register("agg07_last_non_null", "SELECT symbol, date, arg_max(net_profit, fin_id) FILTER (net_profit IS NOT NULL) AS net_profit FROM financial GROUP BY symbol, date")
def agg07_last_non_null(spark, d):
    return load(spark, d, "financial").groupBy("symbol", "date").agg(F.max_by("net_profit", F.when(F.col("net_profit").isNotNull(), F.col("fin_id"))).alias("net_profit"))


@register("agg08_year_counts", "SELECT year(date) AS y, source, count(*) AS n FROM documents GROUP BY ALL")
def agg08_year_counts(spark, d):
    return load(spark, d, "documents").groupBy(F.year("date").cast("bigint").alias("y"), "source").agg(F.count("*").alias("n"))


@register("agg08_top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 12")
def agg08_top_sources(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


@register("agg09_event_arrays", "SELECT date, string_agg(doc_id::VARCHAR, ',' ORDER BY quality DESC, doc_id) AS ids FROM (SELECT date, doc_id, (doc_id * 37 % 101) / 100.0 AS quality, row_number() OVER (PARTITION BY date ORDER BY (doc_id * 37 % 101) / 100.0 DESC, doc_id) AS rn FROM documents WHERE date IS NOT NULL) WHERE rn <= 8 GROUP BY date")
def agg09_event_arrays(spark, d):
    top = DD.top_per_group(R.corpus(spark, d).where("date is not null").select("date", "doc_id", "quality"), ["date"], [F.desc("quality"), "doc_id"], 8)
    a = top.groupBy("date").agg(F.sort_array(F.collect_list(F.struct((-F.col("quality")).alias("q"), "doc_id"))).alias("a"))
    return a.select("date", F.concat_ws(",", F.transform("a", lambda x: x["doc_id"].cast("string"))).alias("ids"))


@register("agg10_melt_pivot", "SELECT symbol, round(first(v) FILTER (name = 'eps'), 4) AS eps, round(first(v) FILTER (name = 'roe'), 4) AS roe FROM (SELECT symbol, name, max(v) AS v FROM (UNPIVOT (SELECT symbol, eps, roe FROM financial) ON eps, roe INTO NAME name VALUE v) GROUP BY ALL) GROUP BY symbol")
def agg10_melt_pivot(spark, d):
    m = REL.melt(load(spark, d, "financial").select("symbol", "eps", "roe"), ["symbol"], ["eps", "roe"])
    p = m.groupBy("symbol").pivot("name", ["eps", "roe"]).agg(F.max("value"))
    return p.where("eps is not null or roe is not null").select("symbol", F.round("eps", 4).alias("eps"), F.round("roe", 4).alias("roe"))


@register("agg14_value_counts", "SELECT title, count(*) AS n FROM news WHERE title IS NOT NULL GROUP BY title ORDER BY n DESC, title LIMIT 10")
def agg14_value_counts(spark, d):
    return load(spark, d, "news").where("title is not null").groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(10)


@register("agg15_nested_contributions", "SELECT i, round(avg(v), 6) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i ORDER BY m DESC, i LIMIT 10")
def agg15_nested_contributions(spark, d):
    e = load(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m")).orderBy(F.desc("m"), "i").limit(10)


@register("agg16_feature_contribution", "SELECT 'volume' AS feature, round(abs(corr(volume, pct_change)), 6) AS c FROM stock UNION ALL SELECT 'amount', round(abs(corr(amount, pct_change)), 6) FROM stock UNION ALL SELECT 'turnover_rate', round(abs(corr(turnover_rate, pct_change)), 6) FROM stock")
def agg16_feature_contribution(spark, d):
    m = REL.melt(load(spark, d, "stock").select("pct_change", "volume", "amount", "turnover_rate"), ["pct_change"], ["volume", "amount", "turnover_rate"])
    return m.groupBy(F.col("name").alias("feature")).agg(F.round(F.abs(N.correlation("value", "pct_change")), 6).alias("c"))


@register("agg17_duplicate_audit", "SELECT symbol, count(*) AS n, count(*) - count(DISTINCT date) AS dup, min(date) AS d0, max(date) AS d1 FROM stock GROUP BY symbol")
def agg17_duplicate_audit(spark, d):
    return load(spark, d, "stock").groupBy("symbol").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("date")).alias("dup"), F.min("date").alias("d0"), F.max("date").alias("d1"))


_RANK = "round(score, 6) DESC, chars DESC, doc_id"


@register("ddp01_keep_first", f"SELECT doc_id FROM ({_QUALITY_SQL}) QUALIFY row_number() OVER (PARTITION BY date, title, source, url ORDER BY quality DESC, {_RANK}) = 1")
def ddp01_keep_first(spark, d):
    return DD.keep_first(_scored(spark, d), ["date", "title", "source", "url"], [F.desc("quality"), F.desc(F.round("score", 6)), F.desc("chars"), "doc_id"]).select("doc_id")


@register("ddp02_url_key", f"SELECT doc_id FROM (SELECT *, {_KEY} AS k FROM ({_QUALITY_SQL})) QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY quality DESC, {_RANK}) = 1")
def ddp02_url_key(spark, d):
    return DD.keep_first_where_key(_scored(spark, d), T.url_key("url"), "doc_id", [F.desc("quality"), F.desc(F.round("score", 6)), F.desc("chars"), "doc_id"]).select("doc_id")


@register("ddp03_fingerprint_greedy", f"""WITH RECURSIVE f AS (SELECT doc_id, date, {_FP} AS fp, row_number() OVER (PARTITION BY {_FP} ORDER BY length(text) DESC, doc_id) AS i FROM documents WHERE date IS NOT NULL AND title IS NOT NULL AND length({_FP}) >= 8),
    r AS (SELECT fp, i, doc_id, true AS keep, [date] AS kept FROM f WHERE i = 1 UNION ALL
          SELECT f.fp, f.i, f.doc_id, NOT list_bool_or([abs(f.date - x) <= 7 FOR x IN r.kept]), CASE WHEN list_bool_or([abs(f.date - x) <= 7 FOR x IN r.kept]) THEN r.kept ELSE list_append(r.kept, f.date) END FROM r JOIN f ON f.fp = r.fp AND f.i = r.i + 1)
    SELECT doc_id FROM r WHERE keep UNION ALL SELECT doc_id FROM documents WHERE date IS NULL OR title IS NULL OR length({_FP}) < 8""")
def ddp03_fingerprint_greedy(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "date", T.title_fingerprint("title").alias("fp"), F.length("text").alias("chars"))
    return DD.greedy_near_duplicates(docs, "doc_id", "fp", "date", [("chars", True)], 7)


@register("ddp04_near_duplicates")
def ddp04_near_duplicates(spark, d):
    """Class and number of links of every document."""
    return DD.near_duplicates(spread(load(spark, d, "documents").select("doc_id", "text", "date")), "doc_id", "text", "date")


@register("ddp05_content_id", "SELECT text_uid, min(doc_id) AS doc_id FROM documents GROUP BY text_uid")
def ddp05_content_id(spark, d):
    return load(spark, d, "documents").groupBy("text_uid").agg(F.min("doc_id").alias("doc_id"))


@register("ddp06_earliest_window", "SELECT symbol, date, min(stock_id) AS stock_id FROM stock GROUP BY symbol, date")
def ddp06_earliest_window(spark, d):
    return DD.keep_least(load(spark, d, "stock").select("symbol", "date", "stock_id"), ["symbol", "date"], "stock_id")


@register("ddp07_stride", "SELECT symbol, date FROM bars QUALIFY (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) % 5 = 0")
def ddp07_stride(spark, d):
    return R.bars(spark, d).select("symbol", "date").withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("date"))).where("(rn - 1) % 5 = 0").drop("rn")


@register("ddp08_union_distinct", "SELECT DISTINCT date, title, url FROM (SELECT date, title, url FROM news UNION ALL SELECT date, title, url FROM notices UNION ALL SELECT date, title, url FROM policy)")
def ddp08_union_distinct(spark, d):
    return reduce(lambda a, b: a.unionByName(b), (load(spark, d, t).select("date", "title", "url") for t in ("news", "notices", "policy"))).distinct()


@register("lim01_source_day_cap", f"SELECT doc_id FROM ({_QUALITY_SQL}) WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, source ORDER BY quality DESC, {_RANK}) <= 4")
def lim01_source_day_cap(spark, d):
    return DD.top_per_group(_scored(spark, d).where("date is not null"), ["date", "source"], [F.desc("quality"), F.desc(F.round("score", 6)), F.desc("chars"), "doc_id"], 4).select("doc_id")


@register("lim01_class_month_cap", "SELECT doc_id FROM (SELECT doc_id, date, " + "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in CLASS_RULES[::-1]) + " ELSE 'other' END AS k FROM documents WHERE date IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k, date_trunc('month', date) ORDER BY date, doc_id) <= 8")
def lim01_class_month_cap(spark, d):
    docs = load(spark, d, "documents").where("date is not null").select("doc_id", "date", T.last_match("title", CLASS_RULES, "other").alias("k"), F.trunc("date", "month").alias("m"))
    return DD.top_per_group(docs, ["k", "m"], ["date", "doc_id"], 8).select("doc_id")


@register("lim02_top_k", "SELECT symbol, round(sum(amount), 2) AS s FROM bars GROUP BY symbol ORDER BY s DESC, symbol LIMIT 10")
def lim02_top_k(spark, d):
    return R.bars(spark, d).groupBy("symbol").agg(F.round(F.sum("amount"), 2).alias("s")).orderBy(F.desc("s"), "symbol").limit(10)


@register("lim04_first_distinct", f"SELECT source FROM ({_QUALITY_SQL}) GROUP BY source ORDER BY max(quality) DESC, source LIMIT 15")
def lim04_first_distinct(spark, d):
    return R.corpus(spark, d).groupBy("source").agg(F.max("quality").alias("q")).orderBy(F.desc("q"), "source").limit(15).select("source")


@register("srt01_mixed_order", f"SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY date NULLS LAST, quality DESC, doc_id) AS rn FROM ({_QUALITY_SQL})")
def srt01_mixed_order(spark, d):
    return R.corpus(spark, d).select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.col("date").asc_nulls_last(), F.desc("quality"), "doc_id")).cast("bigint").alias("rn"))


@register("set01_union_aligned", "SELECT news_id AS id, title, lang FROM news UNION ALL SELECT notice_id, title, NULL FROM notices UNION ALL SELECT policy_id, title, NULL FROM policy")
def set01_union_aligned(spark, d):
    feeds = [load(spark, d, "news").select(F.col("news_id").alias("id"), "title", "lang"), load(spark, d, "notices").select(F.col("notice_id").alias("id"), "title"), load(spark, d, "policy").select(F.col("policy_id").alias("id"), "title")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


@register("src04_statement_feeds", """SELECT coalesce(a.fin_id, b.fin_id) AS fin_id, a.eps, b.cash, coalesce(a.k, b.k) AS known FROM (SELECT fin_id, eps, disclosure_date AS k FROM financial WHERE eps IS NOT NULL) a
    FULL JOIN (SELECT fin_id, cash, date + 90 AS k FROM financial WHERE cash IS NOT NULL) b ON a.fin_id = b.fin_id""")  # fmt: skip
def src04_statement_feeds(spark, d):
    f = load(spark, d, "financial")
    a = f.where("eps is not null").select("fin_id", "eps", F.col("disclosure_date").alias("ka"))
    b = f.where("cash is not null").select("fin_id", "cash", F.date_add("date", 90).alias("kb"))
    return REL.outer_join([a, b], ["fin_id"]).select("fin_id", "eps", "cash", F.coalesce("ka", "kb").alias("known"))


@register("src08_top_constituents", "SELECT date, round(avg(close), 6) AS close, count(*) AS n FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol ORDER BY sum(amount) DESC, symbol LIMIT 5) GROUP BY date")
def src08_top_constituents(spark, d):
    b = R.bars(spark, d)
    top = b.groupBy("symbol").agg(F.sum("amount").alias("s")).orderBy(F.desc("s"), "symbol").limit(5)
    return b.join(top, "symbol", "left_semi").groupBy("date").agg(F.round(F.avg("close"), 6).alias("close"), F.count("*").alias("n"))


@register("src11_policy_from_text", "SELECT doc_id FROM documents WHERE text_type <> 'policy' AND regexp_matches(text, '通知明确|schedule \\d+|补贴')")
def src11_policy_from_text(spark, d):
    return load(spark, d, "documents").where((F.col("text_type") != "policy") & F.col("text").rlike(r"通知明确|schedule \d+|补贴")).select("doc_id")


@register("src20_enrich_by_url", "SELECT n.news_id, u.longest FROM news n JOIN (SELECT url, max(length(content)) AS longest FROM news WHERE url IS NOT NULL GROUP BY url) u ON n.url = u.url")
def src20_enrich_by_url(spark, d):
    """Each distinct address looked up once, its result joined back to all rows that name it."""
    n = load(spark, d, "news")
    return n.select("news_id", "url").join(n.where("url is not null").groupBy("url").agg(F.max(F.length("content")).alias("longest")), "url").select("news_id", F.col("longest").cast("bigint").alias("longest"))


@register("src21_expired_entries", "SELECT news_id FROM news WHERE fetched_at < (SELECT max(fetched_at) FROM news) - INTERVAL 72 HOUR")
def src21_expired_entries(spark, d):
    n = load(spark, d, "news")
    last = n.agg(F.max("fetched_at")).first()[0]
    return n.where(F.col("fetched_at") < F.lit(last) - F.expr("interval 72 hour")).select("news_id")


@register("src26_predictions_scan", "SELECT symbol, date, round(pred, 9) AS pred FROM preds QUALIFY (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) % 3 = 0")
def src26_predictions_scan(spark, d):
    p = R.preds(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("date"))).where("(rn - 1) % 3 = 0")
    return p.select("symbol", "date", F.round("pred", 9).alias("pred"))


@register("snk04_coverage", "SELECT source, min(date) AS d0, max(date) AS d1, count(*) AS n, count(DISTINCT year(date)) AS years FROM documents GROUP BY source")
def snk04_coverage(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.count("*").alias("n"), F.countDistinct(F.year("date")).alias("years"))


@register("str_window_posts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def str_window_posts(spark, d):
    """Tumbling day windows over the event stream's rows (extension)."""
    e = load(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "users")


@register("str_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 30 MINUTE GROUP BY user_id")
def str_sessions(spark, d):
    """Sessions of a user, 30 minutes apart (extension)."""
    e = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).count()
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"))
