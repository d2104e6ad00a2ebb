"""Registry of queries with their SQL, and the shared views both sides are written over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.operators import dedup, sequence
from tidemark.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def define(name: str, f: Callable, sql: str | None = None) -> None:
    register(name, sql)(f)


#: Views in SQL, in order of dependence.
VIEWS = {
    "bars": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY stock_id) AS rn FROM stock) WHERE rn = 1",
    "rets": "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM bars",
    "fin": """SELECT *, CASE WHEN disclosure_date >= date THEN disclosure_date ELSE date + 90 END AS known FROM financial""",
    "macro": """SELECT month, last_day(month) + 10 + CASE isodow(last_day(month) + 10) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS release, level, n
                FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS level, count(*) AS n FROM orders GROUP BY 1)""",
    "corpus": "SELECT doc_id, date, title, text, lang, source, url, text_type, length(text) AS chars, hash_q(doc_id) AS quality FROM documents",
    "preds": """SELECT symbol, date, ret AS pred, fwd AS actual, 1 / (1 + exp(-greatest(-12, least(12, ret / 0.02)))) AS prob, ret - 0.0256 AS q10, ret + 0.0256 AS q90
                FROM rets WHERE ret IS NOT NULL AND fwd IS NOT NULL""",
}


def with_views(sql: str) -> str:
    need, todo = [], [v for v in VIEWS if v in sql.replace("(", " ").replace(")", " ").replace(",", " ").split()]
    while todo:
        v = todo.pop()
        if v not in need:
            need.append(v)
            todo += [x for x in VIEWS if x != v and x in VIEWS[v].replace("(", " ").replace(")", " ").split()]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need)
    ctes = ctes.replace("hash_q(doc_id)", "(doc_id * 37 % 101) / 100.0")
    if not ctes:
        return sql
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else f"WITH {'RECURSIVE ' if body.upper().startswith('WITH RECURSIVE') else ''}{ctes}, {body[15:]}" if body.upper().startswith("WITH RECURSIVE") else f"WITH {ctes} {body}"


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with one row per symbol and day."""
    return dedup.keep_least(load(spark, d, "stock"), ["symbol", "date"], "stock_id")


def rets(spark: SparkSession, d: str) -> DataFrame:
    w = sequence.by(["symbol"], ["date"])
    return bars(spark, d).withColumn("ret", sequence.change("close", w)).withColumn("fwd", F.try_divide(F.lead("close").over(w), F.col("close")) - 1)


def fin(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "financial").withColumn("known", F.when(F.col("disclosure_date") >= F.col("date"), F.col("disclosure_date")).otherwise(F.date_add("date", 90)))


def macro(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.dates import release_day

    m = load(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.avg("o_totalprice").alias("level"), F.count("*").alias("n"))
    return m.withColumn("release", release_day("month", 10))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("doc_id") * 37 % 101 / 100.0
    return load(spark, d, "documents").select("doc_id", "date", "title", "text", "lang", "source", "url", "text_type", F.length("text").alias("chars"), q.alias("quality"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    r = rets(spark, d).where("ret is not null and fwd is not null")
    return r.select("symbol", "date", F.col("ret").alias("pred"), F.col("fwd").alias("actual"), N.sigmoid(F.col("ret") / 0.02, 12).alias("prob"), (F.col("ret") - 0.0256).alias("q10"), (F.col("ret") + 0.0256).alias("q90"))
