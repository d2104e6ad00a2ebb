"""Queries of corpus scores, filters and aggregates over news and notices, and of greedy near-duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import corpus as C
from tidemark.operators import dedup as DD
from tidemark.plans.registry import register
from tidemark.plans.scalars import _GRAMS
from tidemark.session import load, spread

TERMS = C.Terms(
    company=("grid", "储能"), industry=("power", "电池"), specific=("holdings", "股份"), event=("buyback", "tender", "中标", "回购"), generic=("forecast", "板块"),
    material=("质押", "dividend", "分红", "pledge"), routine=("agenda", "会议"), feed="wire|feed|search", press="wire|berichte?|market", weak="board|rss", forum="board", official="exch|filing|melde|report", periodic="annual|季度",
)
PLUS, MINUS = ["rose", "gained", "stieg", "上涨", "增长"], ["fell", "lost", "schwächer", "下跌", "下降"]
QUALITY = [("portal|gazette", "set", 0.95), ("wire|search", "floor", 0.65), ("board|rss", "cap", 0.35), ("policy|notice|exch", "floor", 0.85), ("report", "floor", 0.8)]


def _rows(spark, d, table: str, key: str):
    """Scored rows of a table; its own quality score, where it has none, follows from the source."""
    n = load(spark, d, table)
    joined = F.lower(F.concat_ws(" ", "source", F.coalesce("publisher", F.lit("")), F.coalesce("url", F.lit(""))))
    own = "source_quality_score" if table == "news" else None
    n = spread(n).select(key, "title", "source", "publisher", F.col("content_level").alias("level"), F.col("fetched_at").cast("date").alias("day"), T.blob("title", "content").alias("blob"), T.quality_score(joined, 0.5, QUALITY).alias("rule"),
                         (F.col(own) if own else F.lit(None).cast("double")).alias("own"))
    score = C.lexicon_scorer(PLUS, MINUS)("blob")
    notice = table == "notices"
    n = n.withColumns({
        "relevance": C.notice_relevance(TERMS) if notice else C.news_relevance(TERMS), "strength": C.event_strength(TERMS, notice), "quality": F.coalesce("own", "rule"), "chars": F.length("blob"), "garbled": T.garbled_ratio("blob"), **score,
        "plus": sum((F.lower("blob").contains(t).cast("int") for t in PLUS), F.lit(0)), "minus": sum((F.lower("blob").contains(t).cast("int") for t in MINUS), F.lit(0)),
    })
    lexicon = F.tanh((F.col("plus") - F.col("minus")) / (1 + F.col("chars") / 120.0))
    kind = F.when(F.col("source").rlike("exch|filing|melde"), "notice").when(F.col("source").rlike("report"), "report").when(F.col("source").rlike("portal|gazette"), "official").otherwise("news")
    return n.withColumn("hybrid", C.hybrid(F.col("positive") - F.col("negative"), lexicon)).withColumn("kind", kind)


def _hit(x: str, *terms: tuple[str, ...]) -> str:
    return f"coalesce(regexp_matches(lower({x}), '{'|'.join(t for p in terms for t in p)}'), false)::DOUBLE"


def _pat(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches(lower({x}), '{pattern}'), false)"


_FULL = "coalesce(lower(level) IN ('body', 'pdf_excerpt'), false)"
_T = TERMS


def _quality_sql(j: str) -> str:
    out = "0.5"
    for pattern, how, value in QUALITY:
        new = {"set": f"{value}", "floor": f"greatest({out}, {value})", "cap": f"least({out}, {value})"}[how]
        out = f"(CASE WHEN regexp_matches({j}, '{pattern}') THEN {new} ELSE {out} END)"
    return out


def _rows_sql(table: str, key: str) -> str:
    notice = table == "notices"
    blob = r"trim(regexp_replace(concat_ws(' ', trim(coalesce(title, ''), ' '), trim(coalesce(content, ''), ' ')), '[\s\x0B]+', ' ', 'g'), ' ')"
    material = f"({_hit('title', _T.material)} + {_hit('blob', _T.material)})"
    relevance = (
        f"3 * {_hit('title', _T.company)} + {_hit('blob', _T.company)} + 2.5 * {_hit('title', _T.material)} + 0.75 * {_hit('blob', _T.material)} + {_FULL}::DOUBLE + 0.75 * {_pat('source', _T.feed)}::DOUBLE + 0.5 * least(length(blob) / 360.0, 1.0) - 2 * ({_hit('title', _T.routine)} > 0 AND {material} = 0)::DOUBLE"
        if notice else
        f"4 * {_hit('title', _T.company)} + 2 * {_hit('blob', _T.company)} + 2 * {_hit('title', _T.industry)} + {_hit('blob', _T.industry)} + 1.5 * {_hit('title', _T.event)} + 0.75 * {_hit('blob', _T.event)} + {_FULL}::DOUBLE + 0.75 * {_pat('source', _T.feed)}::DOUBLE + 0.5 * {_pat('publisher', _T.press)}::DOUBLE"
        f" + 0.75 * least(length(blob) / 240.0, 1.0) - 2 * ({_hit('title', _T.generic)} > 0 AND {_hit('blob', _T.company)} = 0)::DOUBLE - 2.5 * ({_pat('source', _T.weak)} AND {_hit('blob', _T.company)} = 0)::DOUBLE + {_hit('title', _T.company, _T.specific)} - {_pat('source', _T.forum)}::DOUBLE"
    )
    strong, weak = (_T.material, _T.routine) if notice else (_T.event, _T.generic)
    strength = f"greatest(0, least(1, tanh((1.5 * ({_hit('title', _T.company)} + {_hit('blob', _T.company)}) + 2 * ({_hit('title', strong)} + 0.5 * {_hit('blob', strong)}) + 0.5 * least(length(blob) / 500.0, 1.0) - 1.25 * {_hit('title', weak)}) / 4)))"
    hits = lambda ts: " + ".join(f"contains(lower(blob), '{t}')::INT" for t in ts)
    joined = "lower(concat_ws(' ', source, coalesce(publisher, ''), coalesce(url, '')))"
    return f"""(SELECT *, 0.7 * ((plus - minus) / (plus + minus + 1.0)) + 0.3 * tanh((plus - minus) / (1 + chars / 120.0)) AS hybrid, plus / (plus + minus + 1.0) AS positive, minus / (plus + minus + 1.0) AS negative, 1 / (plus + minus + 1.0) AS neutral FROM (
      SELECT *, {relevance} AS relevance, {strength} AS strength, coalesce(own, rule) AS quality, length(blob) AS chars, length(regexp_replace(blob, '[^\\x{{FFFD}}\\x{{0400}}-\\x{{04FF}}]', '', 'g')) / greatest(length(blob), 1) AS garbled, {hits(PLUS)} AS plus, {hits(MINUS)} AS minus,
        CASE WHEN regexp_matches(source, 'exch|filing|melde') THEN 'notice' WHEN regexp_matches(source, 'report') THEN 'report' WHEN regexp_matches(source, 'portal|gazette') THEN 'official' ELSE 'news' END AS kind FROM (
        SELECT {key}, title, source, publisher, content_level AS level, fetched_at::DATE AS day, {blob} AS blob, {_quality_sql(joined)} AS rule, {'NULL::DOUBLE' if notice else 'source_quality_score'} AS own FROM {table})))"""


_NEWS, _NOTICES = _rows_sql("news", "news_id"), _rows_sql("notices", "notice_id")


@register("sco01_news_relevance", f"SELECT news_id, round(relevance, 6) + 0.0 AS relevance, round(strength, 6) + 0.0 AS strength FROM {_NEWS}")
def sco01_news_relevance(spark, d):
    return _rows(spark, d, "news", "news_id").select("news_id", (F.round("relevance", 6) + F.lit(0.0)).alias("relevance"), (F.round("strength", 6) + F.lit(0.0)).alias("strength"))


@register("sco02_notice_relevance", f"SELECT notice_id, round(relevance, 6) + 0.0 AS relevance, round(strength, 6) + 0.0 AS strength FROM {_NOTICES}")
def sco02_notice_relevance(spark, d):
    return _rows(spark, d, "notices", "notice_id").select("notice_id", (F.round("relevance", 6) + F.lit(0.0)).alias("relevance"), (F.round("strength", 6) + F.lit(0.0)).alias("strength"))


@register("sco03_rule_quality", f"SELECT news_id, rule::DOUBLE AS rule FROM {_NEWS}")
def sco03_rule_quality(spark, d):
    return _rows(spark, d, "news", "news_id").select("news_id", "rule")


@register("sco05_hybrid", f"SELECT news_id, round(hybrid, 6) + 0.0 AS hybrid, round(positive, 6) AS positive, round(neutral, 6) AS neutral FROM {_NEWS}")
def sco05_hybrid(spark, d):
    return _rows(spark, d, "news", "news_id").select("news_id", (F.round("hybrid", 6) + F.lit(0.0)).alias("hybrid"), F.round("positive", 6).alias("positive"), F.round("neutral", 6).alias("neutral"))


_R = "round(relevance, 6)"


@register("flt04_news_filter", f"""SELECT news_id FROM {_NEWS} WHERE chars >= 12 AND {_R} >= 3 AND ({_hit('blob', _T.company)} > 0 OR {_R} >= 8)
    AND (NOT {_pat('source', _T.weak)} OR {_hit('title', _T.company, _T.specific)} > 0 OR {_pat('source', _T.official)} OR ({_hit('title', _T.event)} + {_hit('blob', _T.event)} > 0 AND {_R} >= 9.5))
    AND ({_hit('title', _T.generic)} = 0 OR {_hit('blob', _T.company)} > 0 OR {_pat('source', _T.official)}) AND garbled <= 0.02 AND quality >= 0.25""")  # fmt: skip
def flt04_news_filter(spark, d):
    return _rows(spark, d, "news", "news_id").withColumn("relevance", F.round("relevance", 6)).where(C.news_filter(TERMS)).select("news_id")


@register("flt05_notice_filter", f"""SELECT notice_id FROM {_NOTICES} WHERE chars >= 16 AND {_R} >= 2 AND ({_hit('blob', _T.company)} > 0 OR {_hit('title', _T.material)} + {_hit('blob', _T.material)} > 0)
    AND ({_hit('title', _T.routine)} = 0 OR {_hit('title', _T.material)} + {_hit('blob', _T.material)} > 0 OR {_R} >= 4) AND garbled <= 0.02 AND quality >= 0.25
    AND ({_FULL} OR NOT {_pat('title', _T.periodic)}) AND round(strength, 6) >= 0.1 AND ({_FULL} OR {_R} >= 2.5)""")  # fmt: skip
def flt05_notice_filter(spark, d):
    n = _rows(spark, d, "notices", "notice_id").withColumn("relevance", F.round("relevance", 6)).withColumn("strength", F.round("strength", 6))
    return n.where(C.notice_filter(TERMS, least_score=2.0, least_strength=0.1, title_only=2.5)).select("notice_id")


_M = lambda x, n: f"round(coalesce(avg({x}), 0), 9) + 0.0 AS {n}"


@register("agg01_corpus_daily", f"""SELECT day, count(*) AS event_count, {_M('hybrid', 'hybrid_mean')}, {_M('abs(hybrid)', 'hybrid_abs_mean')}, {_M('(hybrid > 0)::INT', 'positive_ratio')}, {_M('(hybrid < 0)::INT', 'negative_ratio')}, {_M('positive', 'positive_mean')}, {_M('negative', 'negative_mean')},
    {_M('neutral', 'neutral_mean')}, sum(plus)::BIGINT AS plus_hits, sum(minus)::BIGINT AS minus_hits, {_M('chars', 'length_mean')}, sum(chars)::BIGINT AS length_sum, {_M('relevance', 'relevance_mean')}, {_M('quality', 'quality_mean')}, {_M('strength', 'strength_mean')}, {_M("(kind = 'official')::INT", 'official_ratio')},
    {_M(f'{_FULL}::INT', 'fulltext_ratio')}, {_M("(kind = 'news')::INT", 'news_ratio')}, {_M("(kind = 'notice')::INT", 'notice_ratio')}, {_M("(kind = 'report')::INT", 'report_ratio')}, count(DISTINCT source) AS source_diversity, count(DISTINCT CASE WHEN trim(publisher) <> '' THEN publisher END) AS publisher_diversity FROM {_NEWS} GROUP BY day""")
def agg01_corpus_daily(spark, d):
    return C.daily(_rows(spark, d, "news", "news_id"))


_PAIRS = f"""g AS (SELECT doc_id, date, text_type, s FROM (SELECT doc_id, date, text_type, {_GRAMS.format('title')} AS s FROM documents WHERE date IS NOT NULL AND title IS NOT NULL) WHERE len(s) >= 8),
    p AS (SELECT a, b, similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE AS similarity FROM g x JOIN g y ON x.doc_id < y.doc_id AND abs(x.date - y.date) <= 14) WHERE similarity >= 0.8)"""


def _titles(spark, d):
    return load(spark, d, "documents").select("doc_id", "date", F.length("text").alias("chars"), T.shingles("title").alias("s"))


@register("jon11_similar_titles", f"WITH {_PAIRS} SELECT a, b, round(similarity, 9) AS similarity FROM p")
def jon11_similar_titles(spark, d):
    """Pairs of titles within two weeks whose runs of three characters agree."""
    return DD.similar_pairs(_titles(spark, d), "doc_id", "s", "date", 14, 0.8).select("a", "b", F.round("similarity", 9).alias("similarity"))


@register("ddp04_greedy_titles", f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS i FROM documents),
    e AS (SELECT x.i AS i, y.i AS j FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) q JOIN o x ON x.doc_id = q.a JOIN o y ON y.doc_id = q.b WHERE y.i < x.i),
    n AS (SELECT i, list(j) AS better, row_number() OVER (ORDER BY i) AS k FROM e GROUP BY i),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT n.k, CASE WHEN len(list_filter(n.better, lambda j: NOT list_contains(r.gone, j))) > 0 THEN list_append(r.gone, n.i) ELSE r.gone END FROM r JOIN n ON n.k = r.k + 1)
    SELECT doc_id FROM o WHERE NOT list_contains((SELECT gone FROM r ORDER BY k DESC LIMIT 1), i)""")  # fmt: skip
def ddp04_greedy_titles(spark, d):
    """Best rank first, a title is dropped if it is like a kept one of the two weeks around."""
    return DD.greedy_similar(_titles(spark, d), "doc_id", "s", "date", [("chars", True)], 14, 0.8)
