"""Queries over connectors: rows of the test tables are wrapped in a format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import sources as SRC
from tidemark.lineage import shared_dir
from tidemark.plans.registry import register
from tidemark.session import load


def _path(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@register("src01_cached_scan", "SELECT source, kind, lang FROM sources")
def src01_cached_scan(spark, d):
    path = _path(spark)
    SRC.cached(spark, path, lambda: load(spark, d, "sources"), ("source",))
    return SRC.cached(spark, path, lambda: load(spark, d, "sources"), ("source",)).select("source", "kind", "lang")


@register("src02_snk01_csv_round_trip", "SELECT fin_id, symbol, date, eps FROM financial")
def src02_snk01_csv_round_trip(spark, d):
    f = load(spark, d, "financial").select("fin_id", "symbol", "date", "eps")
    SRC.write_csv(f, path := _path(spark))
    return SRC.read_csv(spark, path, f.schema, ("fin_id", "symbol"))


@register("src14_jsonp", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src14_jsonp(spark, d):
    e = load(spark, d, "events").select("event_id", F.concat(F.lit("callback("), "props", F.lit(");")).alias("body"))
    return e.select("event_id", SRC.jsonp("body", "k bigint")["k"].alias("k"))


@register("src15_feed_items", "SELECT policy_id, title, url AS link FROM policy WHERE title IS NOT NULL AND url IS NOT NULL")
def src15_feed_items(spark, d):
    p = load(spark, d, "policy").where("title is not null and url is not null")
    x = p.select("policy_id", F.concat(F.lit("<rss><item><title><![CDATA["), "title", F.lit("]]></title><link>"), "url", F.lit("</link></item></rss>")).alias("xml"))
    return SRC.feed_items(x, "xml", ["title", "link"])


@register("src16_html_body", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents WHERE length(text) > 60 AND NOT regexp_matches(text, '[<>&]') AND regexp_full_match(text, '[\\x{20}-\\x{7E}\\n]*')")
def src16_html_body(spark, d):
    t = load(spark, d, "documents").where((F.length("text") > 60) & ~F.col("text").rlike("[<>&]") & F.col("text").rlike(r"^[\x20-\x7E\n]*$"))
    return t.select("doc_id", SRC.html_body(F.concat(F.lit("<html><nav>Home</nav><p>"), "text", F.lit("</p><script>x()</script></html>"))).alias("body"))


@register("src17_html_rows", "SELECT stock_id, symbol, date::VARCHAR AS day FROM stock")
def src17_html_rows(spark, d):
    s = load(spark, d, "stock").select("stock_id", F.concat(F.lit("<table><tr><td>"), "symbol", F.lit("</td><td>"), F.col("date").cast("string"), F.lit("</td></tr></table>")).alias("html"))
    return SRC.html_rows(s, "stock_id", "html").select("stock_id", F.col("cells")[0].alias("symbol"), F.col("cells")[1].alias("day"))


@register("src18_anchors", "SELECT news_id, url AS href FROM news WHERE url IS NOT NULL AND length(trim(title)) >= 8 AND regexp_full_match(title, '[A-Za-z0-9 .,%-]*')")
def src18_anchors(spark, d):
    n = load(spark, d, "news").where(F.col("url").isNotNull() & F.col("title").rlike("^[A-Za-z0-9 .,%-]*$"))
    a = n.select("news_id", F.concat(F.lit('<div><a class="x" href="'), "url", F.lit('">'), "title", F.lit("</a></div>")).alias("html"))
    return SRC.anchors(a, "html", 8).select("news_id", "href")


@register("src22_lexicon", "SELECT DISTINCT lower(trim(source)) AS word, kind = 'news' AS positive, kind = 'crawl' AS negative FROM sources")
def src22_lexicon(spark, d):
    raw = load(spark, d, "sources").select(F.col("source").alias("Word"), (F.col("kind") == "news").cast("int").alias("Positive"), (F.col("kind") == "crawl").cast("int").alias("Negative"))
    return SRC.lexicon(raw)


@register("snk03_without_arrays", "SELECT vec_id, label FROM embeddings")
def snk03_without_arrays(spark, d):
    e = load(spark, d, "embeddings")
    SRC.write_csv(e, path := _path(spark))
    return SRC.read_csv(spark, path, e.select("vec_id", "label").schema)
