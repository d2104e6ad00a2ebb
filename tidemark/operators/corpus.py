"""Scores and filters of a corpus of news and notices, and its daily aggregates.

All term lists are parameters; every score is a sum of weighted predicates over columns
title, blob, source, publisher, url, level and type, so a table is scored in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T


@dataclass(frozen=True)
class Terms:
    """What titles, texts and sources are searched for: plain terms, except for the patterns of the last six."""

    company: tuple[str, ...] = ()
    industry: tuple[str, ...] = ()
    specific: tuple[str, ...] = ()
    event: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    material: tuple[str, ...] = ()
    routine: tuple[str, ...] = ()
    feed: str = "wire|portal"
    press: str = "desk|post"
    weak: str = "industry|theme"
    forum: str = "forum|board"
    official: str = "notice|report"
    periodic: str = "annual report|quarterly report"


class SentimentScorer(Protocol):
    """Shares of positive, negative and neutral sentiment of a text, as columns; an encoder can stand behind it."""

    def __call__(self, text: str) -> dict[str, Column]: ...


def lexicon_scorer(plus: list[str], minus: list[str]) -> SentimentScorer:
    """Shares by the terms a text holds, one neutral term added."""

    def score(text: str) -> dict[str, Column]:
        p, m = (sum((F.coalesce(F.lower(text).contains(t), F.lit(False)).cast("double") for t in terms), F.lit(0.0)) for terms in (plus, minus))
        return {"positive": p / (p + m + 1), "negative": m / (p + m + 1), "neutral": F.lit(1.0) / (p + m + 1)}

    return score


def _any(x: str, *terms: tuple[str, ...]) -> Column:
    return T.contains_any(x, [t for part in terms for t in part])


def _matches(x: str, pattern: str) -> Column:
    return F.coalesce(F.lower(x).rlike(pattern), F.lit(False))


def full_text() -> Column:
    return F.coalesce(F.lower("level").isin("body", "pdf_excerpt"), F.lit(False))


def news_relevance(t: Terms) -> Column:
    """Fourteen weighted terms: company, industry and event in title and text, full text, feed, press, length, and what speaks against."""
    company = _any("blob", t.company) > 0
    return T.additive_score(
        (4, _any("title", t.company)), (2, _any("blob", t.company)), (2, _any("title", t.industry)), (1, _any("blob", t.industry)), (1.5, _any("title", t.event)), (0.75, _any("blob", t.event)),
        (1, full_text()), (0.75, _matches("source", t.feed)), (0.5, _matches("publisher", t.press)), (0.75, F.least(F.length("blob") / 240.0, F.lit(1.0))),
        (-2, (_any("title", t.generic) > 0) & ~company), (-2.5, _matches("source", t.weak) & ~company), (1, _any("title", t.company, t.specific)), (-1, _matches("source", t.forum)),
    )


def notice_relevance(t: Terms) -> Column:
    material = _any("title", t.material) + _any("blob", t.material)
    return T.additive_score(
        (3, _any("title", t.company)), (1, _any("blob", t.company)), (2.5, _any("title", t.material)), (0.75, _any("blob", t.material)), (1, full_text()), (0.75, _matches("source", t.feed)),
        (0.5, F.least(F.length("blob") / 360.0, F.lit(1.0))), (-2, (_any("title", t.routine) > 0) & (material == 0)),
    )


def event_strength(t: Terms, notice: bool) -> Column:
    strong, weak = (t.material, t.routine) if notice else (t.event, t.generic)
    raw = 1.5 * (_any("title", t.company) + _any("blob", t.company)) + 2 * (_any("title", strong) + 0.5 * _any("blob", strong)) + 0.5 * F.least(F.length("blob") / 500.0, F.lit(1.0)) - 1.25 * _any("title", weak)
    return N.clip(F.tanh(raw / 4), 0, 1)


def hybrid(sentiment: Column, lexicon: Column) -> Column:
    return 0.7 * sentiment + 0.3 * lexicon


def news_filter(t: Terms, least_chars: int = 12, least_score: float = 3.0, industry_only: float = 8.0, most_garbled: float = 0.02, least_quality: float = 0.25) -> Column:
    """All of seven clauses, over columns relevance, chars, garbled and quality."""
    company = _any("blob", t.company) > 0
    report = _matches("source", t.official)
    event = (_any("title", t.event) + _any("blob", t.event)) > 0
    strict = (_any("title", t.company, t.specific) > 0) | report | (event & (F.col("relevance") >= industry_only + 1.5))
    return (
        (F.col("chars") >= least_chars) & (F.col("relevance") >= least_score) & (company | (F.col("relevance") >= industry_only)) & (~_matches("source", t.weak) | strict)
        & ((_any("title", t.generic) == 0) | company | report) & (F.col("garbled") <= most_garbled) & (F.col("quality") >= least_quality)
    )


def notice_filter(t: Terms, least_chars: int = 16, least_score: float = 4.5, most_garbled: float = 0.02, least_quality: float = 0.25, least_strength: float = 0.0, title_only: float | None = None) -> Column:
    """Six clauses, no routine class, and for titles without text: no periodic report and more relevance."""
    material = (_any("title", t.material) + _any("blob", t.material)) > 0
    routine = _any("title", t.routine) > 0
    whole = full_text()
    return (
        (F.col("chars") >= least_chars) & (F.col("relevance") >= least_score) & ((_any("blob", t.company) > 0) | material) & (~routine | material | (F.col("relevance") >= least_score + 2))
        & (F.col("garbled") <= most_garbled) & (F.col("quality") >= least_quality) & (whole | ~_matches("title", t.periodic)) & (F.col("strength") >= least_strength)
        & (whole | (F.col("relevance") >= (least_score if title_only is None else title_only)))
    )


def daily(events: DataFrame, day: str = "day") -> DataFrame:
    """Twenty-two aggregates a day; means of a day without values are 0. Sums of means are rounded to nine digits."""
    mean = lambda x: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 9) + F.lit(0.0)
    share = lambda x: mean(x.cast("double"))
    h = F.col("hybrid")
    return events.groupBy(day).agg(
        F.count("*").alias("event_count"), mean(h).alias("hybrid_mean"), mean(F.abs(h)).alias("hybrid_abs_mean"), share(h > 0).alias("positive_ratio"), share(h < 0).alias("negative_ratio"),
        mean("positive").alias("positive_mean"), mean("negative").alias("negative_mean"), mean("neutral").alias("neutral_mean"), F.sum("plus").alias("plus_hits"), F.sum("minus").alias("minus_hits"),
        mean("chars").alias("length_mean"), F.sum("chars").alias("length_sum"), mean("relevance").alias("relevance_mean"), mean("quality").alias("quality_mean"), mean("strength").alias("strength_mean"),
        share(F.col("kind") == "official").alias("official_ratio"), share(full_text()).alias("fulltext_ratio"), share(F.col("kind") == "news").alias("news_ratio"), share(F.col("kind") == "notice").alias("notice_ratio"),
        share(F.col("kind") == "report").alias("report_ratio"), F.countDistinct("source").alias("source_diversity"), F.countDistinct(F.when(F.trim("publisher") != "", F.col("publisher"))).alias("publisher_diversity"),
    )
