"""Keyword-stuffed and link-list pages.

Per page the frequencies of its tokens are ranked, and a line is fitted to log
frequency against log rank with SQL windows and regression aggregates.  Slope and
residual of the fit, where the curve ends, and how far the page's mix of tokens
diverges from prose are held against reference curves of the same language and about
the same length.  These come from a labelled sample of prose (``stuffing_prose``), of
which pages of every length are composed; no page of the corpus enters them, so a page
is judged alike whatever stands beside it.  A page with an extreme value is spam if, by
an exact check, more than half of its characters are keywords strung together, links or
tags.

A page's frequency spectrum (how many tokens occur f times) holds the whole ranked
curve in a few rows; that is all that is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.lineage import cut
from tidemark.llm.residue import plain
from tidemark.llm.stuffing_prose import PROSE
from tidemark.llm.text import WORD
from tidemark.session import spread

#: Distances from the reference from which on a value is extreme: of slope, residual, the logarithm of
#: the share of distinct tokens, and divergence (in nats).
EXTREME = {"slope": 0.25, "residual": 0.2, "extent": 0.5, "divergence": 0.25}
#: Share of stuffed characters above which a page is spam.
HALF = 0.5
#: Pages composed for a reference curve, and the longest length (power of two tokens); longer pages are held against that.
COMPOSED, LONGEST = 25, 17
#: Share of a sample's sentences in which a small word stands, by language: a Han character stands in more of them.
SMALL = {"en": 0.07, "de": 0.07, "zh": 0.12}
#: Share of the terms of unclosed lines that come again, and their least number, for keywords strung together.
AGAIN, LEAST_TERMS = 0.6, 8
#: Kinds of token the divergence looks at.
KINDS = ("word", "small", "han", "small han", "number", "stop", "comma", "link", "tag")

_LINK = re.compile(r"(?:https?://|www\.)\S+", re.ASCII | re.IGNORECASE)
_TAG = re.compile(r"#[^\s#]+")
_SENTENCE = re.compile(r"[^!?。]*?(?:[!?。]|[.](?!\d))")
_STOPS = ".!?。"
_HAN_GAP = re.compile(r"[㐀-鿿]\s+(?=[㐀-鿿])")
_ENTRY = re.compile(r"\s*\d{1,4}\s*[.)、:：]\s*\S")
_FIGURES = re.compile(r"\s*(?:\S+\s+){1,8}?(?:[-+−]?\d[\d.,]*\d%?\s*[|;]?\s*){3,}")
_TERM = re.compile(r"[^\W\d_]+")


def read_page(text: str) -> tuple[Counter, list[int], float]:
    """Token frequencies of a page, its number of tokens of each kind, and its stuffed share.

    The stuffed share is that of the non-blank characters that are links, tags, or
    keywords strung together or repeated.  A line belongs to links or tags if more
    than half of its characters do; the words in front of a link go with it.  Lines of
    sentences, numbered entries and rows of figures are neither.  What is left of the
    page is taken together: keywords are strung together where terms that come again
    make up most of it.
    """
    freq: Counter = Counter()
    total = stuffed = links = tags = 0
    loose: list[str] = []
    text = text.lower()
    for line in text.split("\n"):
        size = len("".join(line.split()))
        if not size:
            continue
        total += size
        words = WORD.findall(line)
        freq.update(words)
        linked = _LINK.findall(line) if "://" in line or "www." in line else ()
        tagged = _TAG.findall(line) if "#" in line else ()
        links, tags = links + len(linked), tags + len(tagged)
        if (sum(map(len, linked)) + sum(map(len, tagged))) * 2 > size:
            stuffed += size
        elif not (_prose(line, words) or _ENTRY.match(line) or _FIGURES.fullmatch(line)):
            loose.append(line)
    terms = Counter(t for x in loose for t in _TERM.findall(x))
    again = sum(len(t) * n for t, n in terms.items() if n > 1)
    if sum(terms.values()) >= LEAST_TERMS and again >= AGAIN * sum(len(t) * n for t, n in terms.items()):
        stuffed += sum(len("".join(x.split())) for x in loose)
    return freq, token_kinds(freq, text, links, tags), stuffed / total if total else 0.0


@lru_cache(maxsize=1)
def small_words() -> frozenset[str]:
    """Words that prose cannot do without: those of many sentences of the sample."""
    out = set()
    for lang, text in PROSE.items():
        sentences = text.lower().split("\n")
        of = Counter(w for x in sentences for w in set(WORD.findall(x)) if not w.isdecimal())
        out |= {w for w, k in of.items() if k >= SMALL[lang] * len(sentences)}
    return frozenset(out)


def token_kinds(freq: Counter, text: str, links: int, tags: int) -> list[int]:
    """Tokens of each of ``KINDS``."""
    n: Counter = Counter()
    small = small_words()
    for t, k in freq.items():
        kind = "han" if "㐀" <= t[0] <= "鿿" else "number" if t[0].isdecimal() and t.isdecimal() else "word"
        n[kind if t not in small else "small" if kind == "word" else "small han"] += k
    n["stop"] = sum(map(text.count, ".!?。"))
    n["comma"] = sum(map(text.count, ",、;·|，"))
    n["link"], n["tag"] = links * 5, tags * 5
    return [n[k] for k in KINDS]


def _mix(kinds: list[int]) -> np.ndarray:
    x = np.array(kinds, dtype=float) + 0.5
    return x / x.sum()


@lru_cache(maxsize=1)
def reference() -> list[tuple]:
    """(lang, length, slope, residual, extent, mix) of prose: medians of composed pages, and their mean mix.

    Language "" stands for any other; it has the pages of all alphabets. A length is the
    power of two up to which a page has tokens; short lengths without a composed page
    take the next longer.
    """
    rng = np.random.default_rng(7)
    pages: dict[tuple[str, int], list] = {}
    for lang, text in PROSE.items():
        sentences = [(Counter(WORD.findall(x)), x) for x in text.lower().split("\n")]
        mean = sum(sum(c.values()) for c, _ in sentences) / len(sentences)
        for k in range(LONGEST + 1):
            for _ in range(COMPOSED):
                much = rng.multinomial(max(1, round(2**k * (1 + rng.random()) / mean)), np.full(len(sentences), 1 / len(sentences)))
                freq: Counter = Counter()
                kinds = np.zeros(len(KINDS))
                for m, (c, x) in zip(much, sentences, strict=True):
                    for w, n in c.items():
                        freq[w] += n * int(m)
                    kinds += m * np.array(token_kinds(c, x, 0, 0))
                total = sum(freq.values())
                f, ranks = np.array(sorted({v for v in freq.values() if v}, reverse=True)), []
                spectrum = Counter(v for v in freq.values() if v)
                ranks = np.cumsum([spectrum[v] for v in f])
                slope, residual = np.nan, np.nan
                if len(f) > 1:
                    y, x = np.log(f), np.log(ranks)
                    line = np.polyfit(x, y, 1)
                    slope, residual = line[0], np.sqrt(np.mean((np.polyval(line, x) - y) ** 2))
                length = int(np.log2(max(2, total)))
                one = (slope, residual, np.log(ranks[-1] / total), _mix(kinds))
                for g in (lang,) if lang == "zh" else (lang, ""):
                    pages.setdefault((g, length), []).append(one)
    out = []
    for g in ("", *PROSE):
        have = sorted(n for lang, n in pages if lang == g and any(np.isfinite(p[0]) for p in pages[lang, n]))
        for length in range(LONGEST + 1):
            v = pages[g, min((n for n in have if n >= length), default=have[-1])]
            mid = [float(np.nanmedian([p[i] for p in v])) for i in range(3)]
            out.append((g, length, *mid, [float(q) for q in np.mean([p[3] for p in v], axis=0)]))
    return out


def _prose(line: str, words: list[str]) -> bool:
    """Whether most of a line is sentences: long enough, closed, hardly repeating a word, and not all alike."""
    distinct = len(set(words))
    if distinct < min(0.2 * len(words), 60):
        return False
    if distinct >= (0.35 if "㐀" <= line.lstrip()[0] <= "鿿" else 0.5) * len(words) and line.rstrip()[-1] in _STOPS and len(words) >= 6 * sum(map(line.count, _STOPS)) and not _HAN_GAP.search(line):
        return True
    inside = 0
    for m in _SENTENCE.finditer(line):
        own = WORD.findall(m[0])
        if len(own) >= 6 and len(set(own)) >= 0.6 * len(own) and len(_HAN_GAP.findall(m[0])) < 2:
            inside += len(m[0])
    return inside * 2 > len(line)


def page_measures(pages: DataFrame, row_id: str, text: str, lang: str) -> DataFrame:
    """Per page: _id, language, length class, slope, residual, divergence parts and stuffed share."""
    kind = dict(pages.dtypes)[row_id]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for i, t, g in zip(p["_id"], p["_t"], p["_g"], strict=True):
                t = plain(t)
                freq, kinds, share = read_page(t)
                spectrum = Counter(freq.values())
                n = sum(kinds[:5])
                g = "zh" if (kinds[2] + kinds[3]) * 2 > n else g if g in PROSE and g != "zh" else ""
                out.append((i, g, min(int(np.log2(max(2, n))), LONGEST), [float(k) for k in kinds], sorted(spectrum), [spectrum[f] for f in sorted(spectrum)], share))
            yield pd.DataFrame(out, columns=["_id", "lang", "length", "kinds", "f", "n", "share"])

    base = pages.select(F.col(row_id).alias("_id"), F.col(text).alias("_t"), F.lower(lang).alias("_g")).where("_t is not null and _id is not null")
    return spread(base).mapInPandas(measure, f"_id {kind}, lang string, length int, kinds array<double>, f array<int>, n array<int>, share double")


def curves(pages: DataFrame, row_id: str, text: str, lang: str) -> DataFrame:
    """Per page: _id, language, length, stuffed share, and the distances of slope, residual, extent and divergence from prose.

    Slope and residual are null where all tokens occur equally often.
    """
    m = cut(page_measures(pages, row_id, text, lang).withColumn("_row", F.monotonically_increasing_id()))
    # Rank-frequency curve: the tokens that occur f times end at the rank of all that occur f times or more.
    curve = m.select("_row", F.explode(F.arrays_zip("f", "n")).alias("x")).select("_row", F.col("x.f").alias("f"), F.col("x.n").alias("n"))
    curve = curve.withColumn("rank", F.sum("n").over(W.partitionBy("_row").orderBy(F.col("f").desc())))
    y, x = F.log("f"), F.log("rank")
    fit = curve.groupBy("_row").agg(
        F.regr_slope(y, x).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(y, x) * (1 - F.coalesce(F.regr_r2(y, x), F.lit(0.0))) / F.count("*"))).alias("residual"),
        F.log(F.sum("n") / F.sum(F.col("n") * F.col("f"))).alias("extent"),
    )
    fit = fit.withColumn("residual", F.when(F.col("slope").isNotNull(), F.col("residual")))
    like = pages.sparkSession.createDataFrame(reference(), "lang string, length int, _slope double, _residual double, _extent double, _mix array<double>")
    d = m.join(F.broadcast(like), ["lang", "length"]).join(fit, "_row", "left")  # as many rows as languages of the sample and lengths
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    d = d.withColumn("_p", F.transform("kinds", lambda v: (v + 0.5) / (total(F.col("kinds")) + 0.5 * len(KINDS))))
    far = {c: F.abs(F.col(c) - F.col(f"_{c}")) for c in ("slope", "residual", "extent")}
    far["divergence"] = total(F.zip_with("_p", "_mix", lambda a, b: a * F.log(a / b)))
    return d.select("_id", "lang", "length", "share", *(v.alias(k) for k, v in far.items()))


def extreme() -> Column:
    """Whether a page of :func:`curves` is unlike prose in one of the four."""
    out = F.lit(False)
    for c, bound in EXTREME.items():
        out = out | F.coalesce(F.col(c) > bound, F.lit(False))
    return out


def stuffed_pages(pages: DataFrame, row_id: str, text: str, lang: str) -> DataFrame:
    """(``row_id``) of the pages most of whose characters are keywords, links or tags.

    Null and empty texts are no spam; a language that is missing or not in the sample
    counts by the script of the text; equal pages each count; an empty table gives none.
    A page's verdict depends on nothing but the page.
    """
    return curves(pages, row_id, text, lang).where(extreme()).where(F.col("share") > HALF).select(F.col("_id").alias(row_id))
