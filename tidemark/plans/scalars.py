"""Scalar queries: text, date, number and array expressions over whole tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators.dedup import top_per_group
from tidemark.plans.registry import define, register
from tidemark.session import load, spread

POSITIVE, NEGATIVE = ["rose", "gained", "higher", "approved"], ["fell", "lost", "slid", "delayed"]
POSITIVE_CN, NEGATIVE_CN = ["上涨", "增长", "净买入"], ["下跌", "下降", "净卖出"]
KIND_RULES = [("policy", "policy"), ("notice", "exch|filing|melde"), ("report", "report"), ("crawl", "crawl")]
CLASS_RULES = [("capital", "回购|增持|减持|buy back"), ("operation", "项目|plant|terminal"), ("result", "业务|target|Umsatz")]
CLASS_CODES = {"capital": 1.0, "operation": 2.0, "result": 3.0}
_WS = r"\s+"


def _scalar(name: str, table: str, key: str, cols: dict) -> None:
    """One query of ``key`` and expressions, given as (Spark column, SQL) pairs."""

    def run(spark, d, table=table, key=key, cols=cols):
        rows = load(spark, d, table)
        return (spread(rows) if table == "documents" else rows).select(key, *(x[0]().alias(n) for n, x in cols.items()))

    define(name, run, f"SELECT {key}, " + ", ".join(f"{x[1]} AS {n}" for n, x in cols.items()) + f" FROM {table}")


def _in(terms: list[str], x: str) -> str:
    return f"coalesce(regexp_matches(lower({x}), '{'|'.join(terms)}'), false)::DOUBLE"


_FP = "lower(title)"
for _p, _b in ((r"https?://\S+|www\.\S+", " "), (r"\d{1,4}[年./-]\d{1,2}([月./-]\d{1,2}日?)?", " "), (r"[^\p{L}\p{N}_]+", "")):
    _FP = f"regexp_replace({_FP}, '{_p}', '{_b}', 'g')"
_FP = f"substr(regexp_replace({_FP}, '(快讯|新闻|公告|研报|研究报告|点评|点评报告|摘要)$', ''), 1, 96)"
_KEY = "regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '[?#].*$', ''), '/+$', '')"
_BLOB = rf"trim(regexp_replace(concat_ws(' ', trim(coalesce(title, '')), trim(coalesce(text, '')), trim(coalesce(text_type, ''))), '\s+', ' ', 'g'))"
_GRAMS = r"(SELECT CASE WHEN length(s) >= 3 THEN list_distinct([substr(s, i, 3) FOR i IN range(1, length(s) - 1)]) WHEN length(s) > 0 THEN [s] ELSE []::VARCHAR[] END FROM (SELECT substr(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://\S+|www\.\S+', ' ', 'g'), '\d{{1,4}}[年./-]\d{{1,2}}([月./-]\d{{1,2}}日?)?', ' ', 'g'), '[^\p{{L}}\p{{N}}_]+', '', 'g'), 1, 600) AS s))"
_CASE = lambda x, rules, other: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"

_scalar("str01_blob", "documents", "doc_id", {"blob": (lambda: T.blob("title", "text", "text_type"), _BLOB)})
_scalar("str02_lower_strip_length", "documents", "doc_id", {"t": (lambda: F.lower(F.trim("title")), "lower(trim(title))"), "n": (lambda: F.length(F.trim("title")).cast("bigint"), "length(trim(title))")})
_scalar("str03_compact_truncate", "documents", "doc_id", {"t": (lambda: T.compact("text", 200), rf"substr(trim(regexp_replace(text, '{_WS}', ' ', 'g')), 1, 200)")})
_scalar("str04_title_fingerprint", "documents", "doc_id", {"fp": (lambda: T.title_fingerprint("title"), _FP)})
_scalar("str05_url_key", "documents", "doc_id", {"k": (lambda: T.url_key("url"), _KEY)})
_scalar("str06_garbled_ratio", "news", "news_id", {"r": (lambda: F.round(T.garbled_ratio("content"), 9), r"round(length(regexp_replace(content, '[^\x{FFFD}\x{0400}-\x{04FF}]', '', 'g')) / greatest(length(content), 1), 9)")})
_scalar("str07_strip_tags", "news", "news_id", {"t": (lambda: T.strip_tags("content"), "trim(replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), ' ')")})
_scalar("str08_strip_publisher", "news", "news_id", {"t": (lambda: T.strip_publisher("title"), r"regexp_replace(title, '\s+-\s+[^-]+$', '')")})
_scalar("str09_prefix_title", "documents", "doc_id", {"t": (lambda: F.substring("text", 1, 60), "substr(text, 1, 60)")})
_scalar("str10_content_id", "documents", "doc_id", {"uid": (lambda: T.content_id("date", "text_type", "source", "url", "title"), "sha1(concat_ws('|', coalesce(date::VARCHAR, ''), trim(coalesce(text_type, '')), trim(coalesce(source, '')), trim(coalesce(url, '')), trim(coalesce(title, ''))))")})
_scalar("str11_cache_key", "documents", "doc_id", {"k": (lambda: F.sha2(F.trim("url"), 256), "sha256(trim(url))")})
_scalar("str13_shingles", "documents", "doc_id", {"n": (lambda: F.size(T.shingles("text", most=600)).cast("bigint"), f"len({_GRAMS.format('text')})"),
    "m": (lambda: F.md5(F.array_join(F.array_sort(T.shingles("text", most=600)), "|")), f"md5(array_to_string(list_sort({_GRAMS.format('text')}), '|'))")})
_scalar("str14_jaccard", "documents", "doc_id", {"j": (lambda: F.round(T.jaccard(T.shingles("title", most=600), T.shingles(F.substring("text", 1, 100), most=600)), 9),
    f"round(len(list_intersect({_GRAMS.format('title')}, {_GRAMS.format('substr(text, 1, 100)')})) / greatest(len(list_distinct(list_concat({_GRAMS.format('title')}, {_GRAMS.format('substr(text, 1, 100)')}))), 1), 9)")})
define("str13_shingles_whole", lambda spark, d: spread(load(spark, d, "documents")).select("doc_id", F.size(T.shingles("text")).cast("bigint").alias("n")))
define("str14_jaccard_whole", lambda spark, d: spread(load(spark, d, "documents")).select("doc_id", F.round(T.jaccard(T.shingles("title"), T.shingles("text")), 9).alias("j")))
_HITS = lambda ws, ps: f"(len(list_intersect(regexp_extract_all(lower(text), '[a-z][a-z''\\-]+'), [{', '.join(repr(w) for w in ws)}])) + " + " + ".join(f"contains(lower(text), '{p}')::INT" for p in ps) + ")"
_scalar("str15_lexicon_hits", "documents", "doc_id", {"plus": (lambda: T.lexicon_hits("text", POSITIVE, POSITIVE_CN).cast("bigint"), _HITS(POSITIVE, POSITIVE_CN)), "minus": (lambda: T.lexicon_hits("text", NEGATIVE, NEGATIVE_CN).cast("bigint"), _HITS(NEGATIVE, NEGATIVE_CN))})
_scalar("str16_keyword_balance", "news", "news_id", {"s": (lambda: T.keyword_balance("title", POSITIVE + POSITIVE_CN, NEGATIVE + NEGATIVE_CN).cast("bigint"),
    "(" + " + ".join(f"contains(lower(title), '{t}')::INT" for t in POSITIVE + POSITIVE_CN) + ") - (" + " + ".join(f"contains(lower(title), '{t}')::INT" for t in NEGATIVE + NEGATIVE_CN) + ")")})
_scalar("str17_source_class", "documents", "doc_id", {"k": (lambda: T.first_match("source", KIND_RULES, "news"), _CASE("source", KIND_RULES, "news"))})
_scalar("str18_title_class", "documents", "doc_id", {"k": (lambda: T.last_match("title", CLASS_RULES, "other"), _CASE("title", CLASS_RULES[::-1], "other"))})
_scalar("str19_class_code", "documents", "doc_id", {"k": (lambda: T.codes_of(T.last_match("title", CLASS_RULES, "other"), CLASS_CODES),
    f"CASE {_CASE('title', CLASS_RULES[::-1], 'other')} WHEN 'capital' THEN 1.0 WHEN 'operation' THEN 2.0 WHEN 'result' THEN 3.0 ELSE 0.0 END::DOUBLE")})
_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '')"
_scalar("str20_host_label", "documents", "doc_id", {"p": (lambda: T.host_label("url", {"haiyan": "Haiyan", "ledgerfold": "Ledgerfold"}), f"CASE WHEN contains({_HOST}, 'haiyan') THEN 'Haiyan' WHEN contains({_HOST}, 'ledgerfold') THEN 'Ledgerfold' ELSE {_HOST} END")})
_scalar("flt03_contains_any", "documents", "doc_id", {"hit": (lambda: T.contains_any("text", POSITIVE + POSITIVE_CN), _in(POSITIVE + POSITIVE_CN, "text"))})
_scalar("sco01_relevance", "documents", "doc_id", {"s": (
    lambda: F.round(T.additive_score((4, T.contains_any("title", ["储能", "storage"])), (2, T.contains_any("text", ["储能", "storage"])), (1.5, T.contains_any("title", POSITIVE)), (1, (F.col("text_type") == "news")), (0.75, F.least(F.length("text") / 240.0, F.lit(1.0))), (-2, (T.contains_any("title", ["板块"]) > 0) & (T.contains_any("text", ["储能"]) == 0))), 6),
    f"round(4 * {_in(['储能', 'storage'], 'title')} + 2 * {_in(['储能', 'storage'], 'text')} + 1.5 * {_in(POSITIVE, 'title')} + (text_type = 'news')::DOUBLE + 0.75 * least(length(text) / 240.0, 1.0) - 2 * ({_in(['板块'], 'title')} > 0 AND {_in(['储能'], 'text')} = 0)::DOUBLE, 6)")})
_scalar("sco03_source_quality", "documents", "doc_id", {"q": (
    lambda: T.quality_score(F.concat_ws(" ", "source", F.coalesce("url", F.lit(""))), 0.5, [("portal|gazette", "set", 0.95), ("wire|search", "floor", 0.65), ("board|crawl", "cap", 0.35), ("policy|notice", "floor", 0.85)]),
    "(SELECT CASE WHEN regexp_matches(j, 'policy|notice') THEN greatest(c, 0.85) ELSE c END FROM (SELECT j, CASE WHEN regexp_matches(j, 'board|crawl') THEN least(b, 0.35) ELSE b END AS c FROM (SELECT j, CASE WHEN regexp_matches(j, 'wire|search') THEN greatest(a, 0.65) ELSE a END AS b FROM (SELECT j, CASE WHEN regexp_matches(j, 'portal|gazette') THEN 0.95 ELSE 0.5 END AS a FROM (SELECT concat_ws(' ', source, coalesce(url, '')) AS j)))))::DOUBLE")})
_scalar("sco04_event_strength", "documents", "doc_id", {"s": (
    lambda: F.round(N.clip(F.tanh(T.additive_score((2, T.contains_any("title", POSITIVE + POSITIVE_CN)), (1, T.contains_any("text", POSITIVE + POSITIVE_CN)), (0.5, F.least(F.length("text") / 500.0, F.lit(1.0))), (-1.25, T.contains_any("title", ["板块"]))) / 4), 0, 1), 6),
    f"round(greatest(0, least(1, tanh((2 * {_in(POSITIVE + POSITIVE_CN, 'title')} + {_in(POSITIVE + POSITIVE_CN, 'text')} + 0.5 * least(length(text) / 500.0, 1.0) - 1.25 * {_in(['板块'], 'title')}) / 4))), 6)")})
_LEX = f"({_HITS(POSITIVE, POSITIVE_CN)} - {_HITS(NEGATIVE, NEGATIVE_CN)})"
_scalar("sco05_lexicon_sentiment", "documents", "doc_id", {"s": (
    lambda: F.round(F.tanh((T.lexicon_hits("text", POSITIVE, POSITIVE_CN) - T.lexicon_hits("text", NEGATIVE, NEGATIVE_CN)) / (1 + F.length("text") / 120.0)), 6), f"round(tanh({_LEX} / (1 + length(text) / 120.0)), 6)"),
    "plus": (lambda: (T.lexicon_hits("text", POSITIVE, POSITIVE_CN) > T.lexicon_hits("text", NEGATIVE, NEGATIVE_CN)).cast("double"), f"({_LEX} > 0)::DOUBLE")})

_CJK = lambda p, i: f"regexp_extract(date, '{p}', {i})"
_MD = r"(\d{1,2})月(\d{1,2})日"
_MDX = lambda y: f"try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(regexp_extract(content, '{_MD}', 1), 2, '0') || '-' || lpad(regexp_extract(content, '{_MD}', 2), 2, '0') AS DATE)"
_scalar("dat01_cjk_month", "news", "news_id", {"m": (lambda: D.cjk_month("date"), rf"CASE WHEN regexp_matches(date, '\d{{4}}年\d{{1,2}}月') THEN try_cast({_CJK(r'(\d{4})年(\d{1,2})月', 1)} || '-' || lpad({_CJK(r'(\d{4})年(\d{1,2})月', 2)}, 2, '0') || '-01' AS DATE) END")})
_QP = r"(\d{4})年.{0,4}?第?([一二三四1234])季度"
_scalar("dat02_cjk_quarter_end", "documents", "doc_id", {"q": (lambda: D.cjk_quarter_end("text"), f"CASE WHEN regexp_matches(text, '{_QP}') THEN last_day(make_date(regexp_extract(text, '{_QP}', 1)::INT, translate(regexp_extract(text, '{_QP}', 2), '一二三四', '1234')::INT * 3, 1)) END")})
_DP = r"(\d{4})[年./-](\d{1,2})[月./-](\d{1,2})"
_scalar("dat03_date_in_text", "news", "news_id", {"d": (lambda: D.cjk_date("date"), f"CASE WHEN regexp_matches(date, '{_DP}') THEN try_cast({_CJK(_DP, 1)} || '-' || lpad({_CJK(_DP, 2)}, 2, '0') || '-' || lpad({_CJK(_DP, 3)}, 2, '0') AS DATE) END")})
_scalar("dat04_iso_date", "news", "news_id", {"d": (lambda: F.try_to_date(F.regexp_extract("date", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), r"try_cast(regexp_extract(date, '(\d{4}-\d{2}-\d{2})', 1) AS DATE)")})
_scalar("dat05_month_day", "news", "news_id", {"d": (lambda: D.month_day("content", F.col("fetched_at").cast("date")), f"CASE WHEN regexp_matches(content, '{_MD}') THEN CASE WHEN {_MDX('year(fetched_at)')} > fetched_at::DATE THEN {_MDX('year(fetched_at) - 1')} ELSE {_MDX('year(fetched_at)')} END END")})
_scalar("dat06_epoch", "news", "news_id", {"t": (lambda: F.unix_micros(F.when(F.col("date").rlike(r"^\d{10}$|^\d{13}$"), D.epoch("date"))), r"CASE WHEN regexp_matches(date, '^\d{10}$') THEN date::BIGINT * 1000000 WHEN regexp_matches(date, '^\d{13}$') THEN date::BIGINT * 1000 END")})
_ROLL = lambda x: f"({x} + CASE isodow({x}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::DATE"
_scalar("dat07_release_day", "financial", "fin_id", {"d": (lambda: D.release_day("date", 10), _ROLL("(last_day(date) + 10)"))})
_ADD = lambda n: f"(SELECT max(g)::DATE FROM (SELECT g FROM generate_series(date + 1, date + {2 * n + 5}, INTERVAL 1 DAY) AS t(g) WHERE isodow(g) < 6 ORDER BY g LIMIT {n}))"
_scalar("dat08_add_business_days", "financial", "fin_id", {"d1": (lambda: D.add_business_days("date", 1), _ADD(1)), "d5": (lambda: D.add_business_days("date", 5), _ADD(5)), "d0": (lambda: D.add_business_days("date", 0), _ROLL("date"))})
_scalar("dat09_business_days_between", "financial", "fin_id", {"n": (lambda: D.business_days_between("date", "disclosure_date").cast("bigint"), "CASE WHEN disclosure_date IS NULL THEN NULL WHEN disclosure_date <= date THEN 0 ELSE (SELECT count(*) FROM generate_series(date, disclosure_date - 1, INTERVAL 1 DAY) AS t(g) WHERE isodow(g) < 6) END")})
_PI = "2 * pi()"
_scalar("dat10_calendar_features", "stock", "stock_id", {k: ((lambda k=k: F.round(D.calendar_features("date")[k], 6) + F.lit(0.0)), v) for k, v in {
    "known_dow_sin": f"round(sin({_PI} * (isodow(date) - 1) / 7), 6) + 0.0", "known_month_cos": f"round(cos({_PI} * (month(date) - 1) / 12), 6) + 0.0",
    "known_month_end": "(date = last_day(date))::DOUBLE", "known_quarter_end": "(date = last_day(date) AND month(date) % 3 = 0)::DOUBLE"}.items()})
_scalar("dat12_disclosure_fallback", "financial", "fin_id", {"d": (lambda: F.coalesce("disclosure_date", F.date_add("date", 90)), "coalesce(disclosure_date, date + 90)")})
_scalar("dat13_lagged_availability", "documents", "doc_id", {"d": (lambda: D.add_business_days("date", 1), _ADD(1))})
_scalar("dat14_format", "documents", "doc_id", {"s": (lambda: F.date_format("date", "yyyyMMdd"), "strftime(date, '%Y%m%d')")})
_scalar("mth01_clip", "stock", "stock_id", {"x": (lambda: N.clip("pct_change", -5, 5), "CASE WHEN pct_change IS NOT NULL THEN greatest(-5, least(5, pct_change)) END::DOUBLE")})
_scalar("mth02_sigmoid", "stock", "stock_id", {"x": (lambda: F.round(N.sigmoid("pct_change", 12), 9), "CASE WHEN pct_change IS NOT NULL THEN round(1 / (1 + exp(-greatest(-12, least(12, pct_change)))), 9) END")})
_scalar("mth04_safe_divide", "stock", "stock_id", {"x": (lambda: F.round(N.safe_divide("amount", "volume"), 6), "round(coalesce(amount / nullif(volume, 0), 0), 6)")})
_scalar("mth05_entropy", "embeddings", "vec_id", {"h": (lambda: F.round(N.entropy(N.softmax("embedding")), 6), "(SELECT round(-sum(p * ln(p)), 6) FROM (SELECT exp(v) / sum(exp(v)) OVER () AS p FROM (SELECT unnest(embedding)::DOUBLE AS v)))")})
_scalar("arr01_masked_mean", "embeddings", "vec_id", {"m": (lambda: F.round(N.masked_mean("embedding", F.transform("embedding", lambda v: (v > 0).cast("int"))), 6), "(SELECT round(avg(v::DOUBLE), 6) FROM (SELECT unnest(embedding) AS v) WHERE v > 0)")})
_scalar("arr02_arg_top", "embeddings", "vec_id", {"top": (lambda: F.concat_ws(",", F.transform(N.arg_top("embedding", 10), lambda s: s["index"].cast("string"))), "(SELECT string_agg(i::VARCHAR, ',' ORDER BY v DESC, i) FROM (SELECT v, i FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i) ORDER BY v DESC, i LIMIT 10))")})
_scalar("arr03_softmax_top", "embeddings", "vec_id", {"top": (lambda: F.concat_ws(",", F.transform(N.arg_top(N.softmax("embedding"), 5), lambda s: F.concat_ws(":", s["index"].cast("string"), F.round(s["value"] * 1e6, 0).cast("bigint").cast("string")))), "(SELECT string_agg(i::VARCHAR || ':' || round(p * 1e6)::BIGINT::VARCHAR, ',' ORDER BY p DESC, i) FROM (SELECT i, exp(v) / sum(exp(v)) OVER () AS p FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i) ORDER BY p DESC, i LIMIT 5))"), "w": (lambda: F.round(F.array_max(N.softmax("embedding")), 6), "(SELECT round(max(exp(v)) / sum(exp(v)), 6) FROM (SELECT unnest(embedding)::DOUBLE AS v))")})
_scalar("arr04_score_blend", "embeddings", "vec_id", {"s": (lambda: F.round(F.aggregate(F.zip_with("embedding", F.reverse("embedding"), lambda a, b: 0.5 * a.cast("double") + 0.5 * b.cast("double") / F.array_max(F.transform("embedding", lambda v: F.abs(v))).cast("double")), F.lit(0.0), lambda s, v: s + v), 4),
    "(SELECT round(sum(0.5 * v + 0.5 * v / m), 4) FROM (SELECT v::DOUBLE AS v, max(abs(v)) OVER ()::DOUBLE AS m FROM (SELECT unnest(embedding) AS v)))")})
_scalar("arr05_fit_length", "embeddings", "vec_id", {"n": (lambda: F.size(N.fit_length("embedding", 80, F.lit(0.0).cast("float"))).cast("bigint"), "greatest(len(embedding), 80)"), "last": (lambda: F.element_at(N.fit_length("embedding", 16, F.lit(0.0).cast("float")), 1).cast("double"), "embedding[-16]::DOUBLE")})
_scalar("arr06_pack_unpack", "embeddings", "vec_id", {"p": (lambda: F.concat_ws("|", F.transform(N.unpack(N.pack("embedding", 3)), lambda v: F.round(v * 1000, 0).cast("bigint").cast("string"))), "(SELECT string_agg(round(round(v::DOUBLE, 3) * 1000)::BIGINT::VARCHAR, '|' ORDER BY i) FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i))"), "s": (lambda: F.round(F.aggregate(N.unpack(N.pack("embedding")), F.lit(0.0), lambda s, v: s + v), 4), "(SELECT round(sum(round(v::DOUBLE, 6)), 4) FROM (SELECT unnest(embedding) AS v))")})
_scalar("arr07_finite", "stock", "stock_id", {"v": (lambda: N.finite("volume"), "coalesce(volume, 0)"), "a": (lambda: N.finite("turnover_rate"), "coalesce(turnover_rate, 0)")})
_scalar("jsn01_json", "events", "event_id", {"k": (lambda: F.get_json_object("props", "$.k").try_cast("bigint"), "try_cast(json_extract_string(props, '$.k') AS BIGINT)")})
_scalar("prj03_numeric_coercion", "news", "news_id", {"n": (lambda: F.col("date").try_cast("bigint"), r"CASE WHEN regexp_matches(date, '^\d{1,18}$') THEN date::BIGINT END")})
_scalar("flt09_official_url", "documents", "doc_id", {"hit": (lambda: F.coalesce(T.host_label("url", {}).rlike("portal|gazette|register"), F.lit(False)), f"coalesce(regexp_matches({_HOST}, 'portal|gazette|register'), false)")})
_scalar("flt10_official_source", "documents", "doc_id", {"hit": (lambda: F.lower("source").contains("policy") | F.coalesce(F.lower("url").rlike("portal|gazette"), F.lit(False)), "contains(lower(source), 'policy') OR coalesce(regexp_matches(lower(url), 'portal|gazette'), false)")})
_scalar("flt11_needs_enrichment", "news", "news_id", {"hit": (lambda: F.coalesce(F.length("content"), F.lit(0)) < 400, "coalesce(length(content), 0) < 400")})


@register("str24_join_budget", "SELECT source, (SELECT list_reduce(list_prepend('', list(title ORDER BY doc_id)), lambda a, t: CASE WHEN length(a) + length(t) + 1 <= 400 THEN a || ' ' || t ELSE a END)) AS joined FROM (SELECT source, doc_id, title FROM documents WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 50) GROUP BY source")
def str24_join_budget(spark, d):
    """Of the first 50 titles of a source those that fit into 400 characters, in order: a report per source."""
    t = top_per_group(load(spark, d, "documents").where("title is not null").select("source", "doc_id", "title"), ["source"], ["doc_id"], 50)
    a = t.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "title"))).alias("a"))
    return a.select("source", F.aggregate("a", F.lit(""), lambda s, x: F.when(F.length(s) + F.length(x["title"]) + 1 <= 400, F.concat(s, F.lit(" "), x["title"])).otherwise(s)).alias("joined"))


@register("str22_query_expansion", "SELECT DISTINCT lower(trim(publisher)) || ' ' || y AS q FROM news, generate_series(2019, 2021) AS g(y) WHERE trim(publisher) <> ''")
def str22_query_expansion(spark, d):
    return load(spark, d, "news").select(F.explode(F.transform(F.sequence(F.lit(2019), F.lit(2021)), lambda y: F.concat(F.lower(F.trim("publisher")), F.lit(" "), y.cast("string")))).alias("q")).where("trim(split(q, ' 20')[0]) <> ''").distinct()


@register("str21_archive_pages", "SELECT source, 'https://' || host || '/page/' || p AS url FROM sources, generate_series(1, 5) AS g(p)")
def str21_archive_pages(spark, d):
    return load(spark, d, "sources").select("source", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda p: F.concat(F.lit("https://"), "host", F.lit("/page/"), p.cast("string")))).alias("url"))


@register("dat11_known_future", "SELECT fin_id, k, g::DATE AS day FROM (SELECT fin_id, g, row_number() OVER (PARTITION BY fin_id ORDER BY g) AS k FROM (SELECT fin_id, unnest(generate_series(date + 1, date + 12, INTERVAL 1 DAY)) AS g FROM financial) WHERE isodow(g) < 6) WHERE k <= 3")
def dat11_known_future(spark, d):
    days = F.array(*(F.struct(F.lit(k).alias("k"), D.add_business_days("date", k).alias("day")) for k in (1, 2, 3)))
    return load(spark, d, "financial").select("fin_id", F.explode(days).alias("x")).select("fin_id", "x.*")


