"""Queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bitemporal, timestamps
from tidemark.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stock = load(spark, d, "stock").select("stock_id", "symbol", "date")
    return bitemporal.as_known(stock, load(spark, d, "financial"), "symbol", "date", "fin_id", "date", "disclosure_date").select("stock_id", F.col("_id").alias("fin_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for tbl, key in (("news", "news_id"), ("notices", "notice_id"), ("policy", "policy_id")):
        one = load(spark, d, tbl).select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), "date", "source")
        rows = one if rows is None else rows.unionByName(one)
    return timestamps.normalise(rows, load(spark, d, "sources"), ["tbl", "row_id"], "row_id", "date")


QUERIES = {"p1_found": p1_found, "p6_found": p6_found}

SQL = {
    "p1_found": """
        WITH f AS (SELECT fin_id, symbol, date AS period,
                          CASE WHEN disclosure_date >= date THEN disclosure_date ELSE date + 45 END AS known FROM financial)
        SELECT stock_id, fin_id FROM (
          SELECT s.stock_id, f.fin_id, row_number() OVER (PARTITION BY s.stock_id ORDER BY f.period DESC, f.known DESC, f.fin_id) AS rn
          FROM stock s JOIN f ON s.symbol = f.symbol AND f.known <= s.date) WHERE rn = 1""",
}
