"""Queries of the text problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import boilerplate, capping, leakage, lines, lookalikes, packing, residue, stuffing
from tidemark.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(load(spark, d, "news"), "news_id", "content", "source")[0]


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(load(spark, d, "news"), "news_id", "content", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalikes.same_look_pairs(load(spark, d, "news"), "news_id", ["title", "content"])
    return pairs.select("field", F.col("a").alias("news_id_a"), F.col("b").alias("news_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_classes(load(spark, d, "news"), "news_id", ["title", "content"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for tbl, key in (("news", "news_id"), ("notices", "notice_id")):
        # metadata strings are no cases
        one = load(spark, d, tbl).where("content_level is distinct from 'metadata'").select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), "content")
        rows = one if rows is None else rows.unionByName(one)
    return residue.residue_rows(rows, ["tbl", "row_id"], "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "news").where("content_level = 'body'").select("news_id", "content")
    residual = p7_found(spark, d).where("tbl = 'news'").select(F.col("row_id").alias("news_id"))
    return boilerplate.furniture(pages.join(residual, "news_id", "left_anti"), "news_id", "content")


def _contributors(spark: SparkSession, d: str) -> DataFrame:
    news = load(spark, d, "news").select("news_id", "source", "publisher", "source_quality_score")
    return news.withColumn("contributor", capping.contributor("publisher", "source"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    news = _contributors(spark, d)
    return capping.over_cap(news, "news_id", "contributor", "source_quality_score", share=25, randomness=0).select("news_id")


def p3_sampled(spark: SparkSession, d: str) -> DataFrame:
    news = _contributors(spark, d)
    return news.join(capping.over_cap(news, "news_id", "contributor", "source_quality_score", share=25, randomness=1), "news_id", "left_anti").select("news_id", "contributor")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.octet_length("text").alias("tokens"))
    return packing.pack(docs, "doc_id", "tokens", load(spark, d, "capacities"), "capacity_id", "capacity_tokens")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_packed(spark, d).where("piece = 2").select("capacity_id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    packed = p8_packed(spark, d).groupBy("capacity_id").agg(F.countDistinct("shard", "container").alias("containers"), F.sum("tokens").alias("tokens"))
    caps = load(spark, d, "capacities")
    return packed.join(caps, "capacity_id").select("capacity_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = load(spark, d, "documents"), load(spark, d, "eval_items")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", "lang").select("item_id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(load(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_cleaned": p2_cleaned, "p3_found": p3_found, "p3_sampled": p3_sampled, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found,
    "p7_found": p7_found, "p8_found": p8_found, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found,
}

_FORM = r"lower(regexp_replace(trim(regexp_replace(x, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g'))"
_EXCESS = f"""
    WITH l AS (SELECT news_id, source, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
               FROM news WHERE content IS NOT NULL),
         f AS (SELECT news_id, source, line_no, x, {_FORM} AS form FROM l),
         t AS (SELECT source, count(*) AS total FROM news GROUP BY source),
         e AS (SELECT f.source, form FROM f JOIN t ON f.source = t.source WHERE form <> ''
               GROUP BY f.source, form, total HAVING count(DISTINCT news_id) >= 4 AND count(DISTINCT news_id) * 100 >= total * 5)"""

_WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SQL = {
    "p3_found": f"""
        WITH n AS (SELECT news_id, source_quality_score AS q, source, lower(regexp_replace(publisher, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS pub FROM news),
             r AS (SELECT news_id, row_number() OVER (PARTITION BY CASE WHEN coalesce(pub, '') = '' THEN 's:' || source ELSE 'p:' || pub END
                                                      ORDER BY q DESC NULLS LAST, news_id) AS rn FROM n)
        SELECT news_id FROM r WHERE rn > (SELECT count(*) // 25 FROM news)""",
    "p8_found": """
        SELECT capacity_id, doc_id FROM documents, capacities WHERE strlen(text) > capacity_tokens""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents),
             e AS (SELECT item_id, lang, CASE lang WHEN 'zh' THEN 20 ELSE 50 END AS n, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM eval_items),
             g AS (SELECT item_id, n, substr(t, i, n) AS s FROM (SELECT *, unnest(generate_series(1, length(t) - n + 1)) AS i FROM e)),
             h AS (SELECT doc_id, n, substr(t, i, n) AS s FROM (SELECT doc_id, n, t, unnest(generate_series(1, length(t) - n + 1)) AS i FROM d, (VALUES (20), (50)) AS v(n)))
        SELECT DISTINCT item_id, doc_id FROM g JOIN h ON g.n = h.n AND g.s = h.s""",
    "p2_found": _EXCESS + " SELECT news_id, line_no FROM f JOIN e ON f.source = e.source AND f.form = e.form",
    "p2_cleaned": _EXCESS + """
        SELECT n.news_id, CASE WHEN n.content IS NULL THEN NULL ELSE coalesce(k.content, '') END AS content FROM news n LEFT JOIN (
          SELECT news_id, string_agg(x, chr(10) ORDER BY line_no) AS content FROM f
          WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = f.source AND e.form = f.form) GROUP BY news_id) k ON n.news_id = k.news_id""",
}
