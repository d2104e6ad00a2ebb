"""Text expressions: everything stays inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """``f`` of the value of ``x``, which is evaluated once however often ``f`` uses it, also inside lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def blob(*parts: Column | str) -> Column:
    """Parts trimmed, joined by one blank, inner white space reduced; null counts as empty."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *(F.trim(F.coalesce(c(p), F.lit(""))) for p in parts)), r"\s+", " "))


def compact(x: Column | str, most: int) -> Column:
    """White space reduced and trimmed, cut to ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(c(x), r"\s+", " ")), 1, most)


# What a title fingerprint leaves out, and what stands in its place.
FINGERPRINT = (
    (r"https?://\S+|www\.\S+", " "),
    (r"\d{1,4}[年./-]\d{1,2}([月./-]\d{1,2}日?)?", " "),
    (r"[^\p{L}\p{N}_]+", ""),
    (r"(快讯|新闻|公告|研报|研究报告|点评|点评报告|摘要)$", ""),
)


def title_fingerprint(x: Column | str, most: int = 96) -> Column:
    """Lower case without links, dates, punctuation and a closing kind-of-news word."""
    s = F.lower(c(x))
    for pattern, by in FINGERPRINT:
        s = F.regexp_replace(s, pattern, by)
    return F.substring(s, 1, most)


def url_key(x: Column | str) -> Column:
    """Lower case without query, fragment and closing slashes; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c(x), F.lit("")))), r"[?#].*$", ""), "/+$", "")


def garbled_ratio(x: Column | str) -> Column:
    """Share of replacement characters and Cyrillic letters."""
    return F.regexp_count(c(x), F.lit("[�Ѐ-ӿ]")) / F.greatest(F.length(c(x)), F.lit(1))


def strip_tags(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c(x), "<[^>]+>", " "), "&nbsp;", " "))


def strip_publisher(x: Column | str) -> Column:
    """A title without its closing " - publisher"."""
    return F.regexp_replace(c(x), r"\s+-\s+[^-]+$", "")


def content_id(*parts: Column | str) -> Column:
    """SHA-1 of the trimmed parts joined by '|', null counting as empty."""
    return F.sha1(F.concat_ws("|", *(F.trim(F.coalesce(c(p).cast("string"), F.lit(""))) for p in parts)))


def contains_any(x: Column | str, terms: list[str]) -> Column:
    """1.0 where any of the terms occurs, else 0.0 (also for null and for no terms)."""
    terms = unique_terms(terms)
    if not terms:
        return F.lit(0.0)
    return F.coalesce(F.lower(c(x)).rlike("|".join(re.escape(t) for t in terms)), F.lit(False)).cast("double")


def unique_terms(terms: list[object]) -> list[str]:
    """Terms trimmed and in lower case, without blanks and repeats, in order."""
    return list(dict.fromkeys(t for t in (str(x or "").strip().lower() for x in terms) if t))


def shingles(x: Column | str, n: int = 3, most: int | None = None) -> Column:
    """Distinct runs of n characters of the letters and digits, of the first ``most`` of these if given; a shorter text is its own shingle.

    Links and dates are left out first.
    """
    def grams(p: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.array_join(F.slice(p, i, n), ""))
        return F.when(F.size(p) >= n, F.array_distinct(own)).when(F.size(p) > 0, F.array(F.array_join(p, ""))).otherwise(F.array().cast("array<string>"))

    s = F.lower(c(x))
    for pattern, by in FINGERPRINT[:3]:
        s = F.regexp_replace(s, pattern, by)
    return let(F.regexp_extract_all(s if most is None else F.substring(s, 1, most), F.lit("(?s)(.)"), F.lit(1)), grams)


def word_shingles(x: Column | str, n: int = 5) -> Column:
    """Distinct hashes of the runs of n words of a whole text; a Han character counts as a word, a shorter text as one run."""
    words = F.regexp_extract_all(F.lower(c(x)), F.lit(r"(\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))

    def grams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n))))

    return F.when(F.length(F.trim(c(x))) > 0, let(words, grams)).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two sets; 0 for two empty ones."""

    def of(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        return both / F.greatest(F.size(p["a"]) + F.size(p["b"]) - both, F.lit(1))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def lexicon_hits(x: Column | str, words: list[str], phrases: list[str]) -> Column:
    """Distinct ASCII words of the lexicon in the text, and phrases it contains."""
    s = F.lower(c(x))
    tokens = F.array_distinct(F.regexp_extract_all(s, F.lit(r"([a-z][a-z'\-]+)"), F.lit(1)))
    hits = F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) if words else F.lit(0)
    return reduce(lambda a, p: a + s.contains(p).cast("int"), phrases, hits)


def keyword_balance(x: Column | str, plus: list[str], minus: list[str]) -> Column:
    """Number of the plus terms in the text less that of the minus terms."""
    s = F.lower(c(x))
    count = lambda ts: reduce(lambda a, t: a + s.contains(t).cast("int"), unique_terms(ts), F.lit(0))
    return count(plus) - count(minus)


def first_match(x: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = None
    for label, pattern in rules:
        hit = c(x).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def last_match(x: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the last pattern that matches."""
    return first_match(x, rules[::-1], default)


def codes_of(x: Column | str, table: dict[str, float], default: float = 0.0) -> Column:
    return F.coalesce(*(F.when(c(x) == k, F.lit(v)) for k, v in table.items()), F.lit(default))


def host_label(url: Column | str, known: dict[str, str]) -> Column:
    """A label by the first known domain in the host, else the host without 'www.'."""
    host = F.regexp_replace(F.lower(F.try_parse_url(c(url), F.lit("HOST"))), r"^www\.", "")
    out = F
    for domain, label in known.items():
        out = out.when(host.contains(domain), label)
    return out.otherwise(host) if known else host


def additive_score(*terms: tuple[float, Column]) -> Column:
    """Sum of weights times predicates or measures."""
    return reduce(lambda a, t: a + F.lit(float(t[0])) * t[1].cast("double"), terms, F.lit(0.0))


def quality_score(joined: Column | str, base: float, rules: list[tuple[str, str, float]]) -> Column:
    """A score set, raised or lowered by ordered rules (pattern, 'set' | 'floor' | 'cap', value)."""
    out = F.lit(base)
    for pattern, how, value in rules:
        new = {"set": lambda: F.lit(value), "floor": lambda: F.greatest(out, F.lit(value)), "cap": lambda: F.least(out, F.lit(value))}[how]()  # noqa: B023
        out = F.when(F.coalesce(c(joined).rlike(pattern), F.lit(False)), new).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))
