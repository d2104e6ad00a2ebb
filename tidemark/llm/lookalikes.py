"""One stored form for text that looks the same.

Look-alike strings and code points are joined by union-find into transitive
classes.  The relations come from the Unicode decompositions that change the
stored form but not the look (width, no-break spaces, ligatures, radicals, signs,
composed accents, Hangul syllables) and from a list of letters shared by alphabets.
A class is known by its spelling in atoms: code points that no relation takes apart,
one for each class of single code points.  Two texts look the same if and only if
their atoms are the same.  In each class the member seen most often in the corpus
represents it, and a multi-pattern automaton rewrites the atoms to representatives,
longest match first; as a representative has the atoms it stands for, rewriting
joins nothing else and leaves what it has written as it is.  Characters without a
visible form are dropped.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.llm.text import BEYOND, Without, char_class, codes
from tidemark.session import spread

# Letters and hyphens of other alphabets and those, below them, that look the same.
# Cyrillic, Greek, Armenian, Cherokee, Latin letters for phonetics and further signs.
TWINS = (
    "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԚԜҮӀ",
    "aeopcyxijshdqwlABEKMHOPCTYXIJSQWYI",
    "οϳνϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ",
    "ojvcABEZHIKMNOPTYXCJ",
    "օսցհոՏՕԼ",
    "ougһnSOL",
    "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎠᏀ",
    "ABCEHJKLMPRSTVWZDG",
    "ɡᴏᴠᴡᴢᴄꜱ‐‑ꓲꓳꓴ",
    "govwzcs--IOU",
)
# Kinds of decomposition that leave the look as it is.
SAME_LOOK = {"", "<wide>", "<narrow>", "<noBreak>", "<compat>"}
# Compatibility forms that do look different: long s, Greek letter variants,
# and the ranges of numbers and letters in brackets or with a full stop.
OTHER_LOOK = set("ſƛϐϑϒϓϔϕϖϰϱϲϴϵϹ")
BRACKETED = ((0x2474, 0x24B5), (0x3200, 0x33FF), (0x1F100, 0x1F1FF))
# Format characters that are seen.
SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def relations() -> list[tuple[str, str]]:
    """Pairs (code point, string) that look the same; Hangul syllables, which compose by rule, are in :func:`atoms` alone."""
    out = [(a, b) for x, y in zip(TWINS[::2], TWINS[1::2], strict=True) for a, b in zip(x, y, strict=True)]
    for cp in range(0xA0, sys.maxunicode + 1):
        if hangul(cp) or 0xD800 <= cp <= 0xDFFF:  # surrogates are no text
            continue
        d = unicodedata.decomposition(chr(cp))
        if not d:
            continue
        parts = d.split()
        kind = parts.pop(0) if parts[0].startswith("<") else ""
        to = "".join(chr(int(x, 16)) for x in parts)
        if kind in SAME_LOOK and chr(cp) not in OTHER_LOOK and not any(a <= cp <= b for a, b in BRACKETED) and not (len(to) > 1 and to[0] == " "):
            out.append((chr(cp), to))
    return out


def hangul(cp: int) -> bool:
    """Whether a code point is a composed Hangul syllable."""
    return 0xAC00 <= cp <= 0xD7A3


def invisible() -> list[int]:
    """Code points without a visible form."""
    cf = [cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) == "Cf" and cp not in SEEN]
    return [*cf, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.root(a)] = self.root(b)

    def groups(self) -> list[list[str]]:
        by = defaultdict(list)
        for x in self.up:
            by[self.root(x)].append(x)
        return list(by.values())


def _nfd(s: str) -> str:
    return unicodedata.normalize("NFD", s)


@lru_cache(maxsize=1)
def atoms() -> dict[str, str]:
    """The spelling in atoms of every code point a relation speaks of, Hangul syllables apart.

    Single code points are joined first. A class of them is spelt as the decomposition
    of that member which has one; spellings are respelt until nothing changes.
    """
    rel = [(a, _nfd(b)) for a, b in relations()]
    same = Classes()
    for a, b in rel:
        if len(b) == 1 and _nfd(a) == a:
            same.join(a, b)
    roots = {x: same.root(x) for x in same.up}
    spelt: dict[str, str] = {}
    for a, b in rel:
        if len(b) > 1:
            a = roots.get(a, a)
            if spelt.setdefault(a, b) != b and _respell(spelt[a], roots, spelt) != _respell(b, roots, spelt):
                raise ValueError(f"two spellings of {a!r}")
    return {x: _respell(_nfd(x), roots, spelt) for x in {*roots, *(a for a, _ in rel), *(x for _, b in rel for x in b)}}


def _respell(s: str, roots: dict[str, str], spelt: dict[str, str]) -> str:
    while True:
        new = _nfd("".join(spelt.get(roots.get(x, x), roots.get(x, x)) for x in s))
        if new == s:
            return s
        s = new


def spelling(x: str) -> str:
    """The atoms of one code point."""
    return _nfd(x) if hangul(ord(x)) else atoms().get(x, x)


def spelt_alike(counts: dict[int, int]) -> dict[str, list[str]]:
    """Per spelling in atoms, the code points of ``counts`` that have it; those with one way to be stored are left out."""
    by = defaultdict(list)
    for cp in sorted(counts):
        x = chr(cp)
        if x in atoms() or hangul(cp):
            by[spelling(x)].append(x)
    return {k: v for k, v in by.items() if v != [k]}


def patterns(counts: dict[int, int], strings: dict[str, int]) -> dict[str, str]:
    """Representatives by spelling in atoms, where these are not the atoms themselves.

    ``counts`` and ``strings`` say how often code points and spellings of several atoms
    are stored. Ties fall to the shorter, then the smaller string.
    """
    out = {}
    for k, members in spelt_alike(counts).items():
        have = {x: counts[ord(x)] for x in members}
        have.setdefault(k, strings.get(k, 0) if len(k) > 1 else counts.get(ord(k), 0))
        rep = min(have, key=lambda s: (-have[s], len(s), s))
        if rep != k:
            out[k] = rep
    return out


class Rewriter:
    """Atoms, and then representatives by an automaton.

    Texts whose characters all stand for themselves, with none that could be part of a
    longer spelling, are left as they are without a closer look.
    """

    def __init__(self, table: dict[str, str]) -> None:
        self.visible = Without(invisible())
        self.to_atoms = {ord(a): b for a, b in atoms().items() if a != b and _nfd(a) == a}
        self.automaton = ahocorasick.Automaton()
        for a, b in table.items():
            self.automaton.add_word(a, (len(a), b))
        self.empty = not table
        if table:
            self.automaton.make_automaton()
        marks = {chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))}
        inside = {x for a in table for x in a[1:]} | marks | {chr(c) for c in range(0x1100, 0x1200)}  # what may belong to the character before
        moved = {c for c, a in atoms().items() if table.get(a, a) != c or a[0] in inside}
        syllables = {chr(c) for c in range(0xAC00, 0xD7A4)} - set(table.values())
        self.trigger = re.compile(char_class(sorted(ord(x) for x in moved | inside | syllables if ord(x) < 0x10000)))

    def spell(self, s: str) -> str:
        """The atoms of a text without invisible characters."""
        s = unicodedata.normalize("NFD", s)
        t = s.translate(self.to_atoms)
        return t if t == s else unicodedata.normalize("NFD", t)

    def __call__(self, s: str) -> str:
        if not s.isascii():
            s = self.visible(s)
        if not (self.trigger.search(s) or BEYOND.search(s)):
            return s
        s = self.spell(s)
        if self.empty:
            return s
        out, done = [], 0
        for end, (n, by) in self.automaton.iter_long(s):
            out += (s[done : end + 1 - n], by)
            done = end + 1
        if not done:
            return s
        out.append(s[done:])
        return "".join(out)


def corpus_table(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The rewriting table of a corpus.

    What comes to the driver is one count per code point, and then one per spelling of
    several atoms that is also stored in another way: some thousand rows whatever the
    size of the corpus.
    """

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        for p in batches:
            for c in columns:
                got = np.bincount(codes("".join(x for x in p[c] if x is not None)))
                n[: len(got)] += got
        at = np.flatnonzero(n)
        yield pd.DataFrame({"cp": at.astype(np.int64), "n": n[at]})

    rows = spread(df.select(*columns))
    got = rows.mapInPandas(tally, "cp bigint, n bigint").groupBy("cp").agg(F.sum("n").alias("n"))
    counts = {r["cp"]: r["n"] for r in got.toLocalIterator() if r["cp"] in related()}
    wanted = sorted(k for k in spelt_alike(counts) if len(k) > 1 and all(counts.get(ord(x), 0) or x not in atoms() for x in k))
    if not wanted:
        return patterns(counts, {})

    def tally_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = dict.fromkeys(wanted, 0)
        last = re.compile(char_class(sorted({ord(k[-1]) for k in wanted})))
        for p in batches:
            for c in columns:
                text = "\0".join(x for x in p[c] if x is not None)
                here = set(last.findall(text))
                for k in wanted:
                    if k[-1] in here:
                        n[k] += text.count(k)
        yield pd.DataFrame({"s": list(n), "n": list(n.values())})

    got = rows.mapInPandas(tally_strings, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return patterns(counts, {r["s"]: r["n"] for r in got.toLocalIterator()})


@lru_cache(maxsize=1)
def related() -> set[int]:
    """Code points a relation speaks of."""
    return {ord(x) for x in atoms()} | set(range(0xAC00, 0xD7A4)) | set(range(0x1100, 0x1200))


def one_form(df: DataFrame, columns: list[str], table: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``columns`` rewritten; null stays null, all other columns pass unchanged."""
    table = corpus_table(df, columns) if table is None else table

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = Rewriter(table)
        for p in batches:
            for c in columns:
                p[c] = [None if x is None else to(x) for x in p[c]]
            yield p

    return spread(df).mapInPandas(rewrite, df.schema)


def stored_forms(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(field, _id, look, raw) of the rows whose field is stored in more than one form by rows that look the same.

    ``look`` and ``raw`` are 128-bit hashes of the one form and of the stored one. Null has no row.
    """
    table = corpus_table(df, columns)
    kind = dict(df.dtypes)[row_id]

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, digest = Rewriter(table), xxhash.xxh3_128_digest
        for p in batches:
            for c in columns:
                has = p[p[c].notna()]
                yield pd.DataFrame({
                    "field": c, "_id": has[row_id],
                    "look": [digest(to(x).encode("utf-8", "surrogatepass")) for x in has[c]],
                    "raw": [digest(x.encode("utf-8", "surrogatepass")) for x in has[c]],
                })

    h = cut(spread(df.select(row_id, *columns)).mapInPandas(hashes, f"field string, _id {kind}, look binary, raw binary"))
    mixed = h.groupBy("field", "look").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x <> y").select("field", "look")
    return cut(h.join(mixed, ["field", "look"]))


def same_look_pairs(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(field, a, b) with a < b: rows whose field looks the same but is stored otherwise.

    Null never matches; equal strings are no pair; an empty table gives none.  Only
    groups with more than one stored form reach a join.  Forms are paired first, one
    row each, and then the rows of two forms: what the joins make is in the result,
    so a form stored by very many rows costs no more than its pairs.
    """
    some = stored_forms(df, row_id, columns)
    forms = cut(some.select("field", "look", "raw").distinct())
    other = forms.withColumnRenamed("raw", "raw2")
    pairs = forms.join(other, ["field", "look"]).where("raw < raw2")
    rows = some.select("field", "raw", "_id")
    out = pairs.join(rows, ["field", "raw"]).withColumnRenamed("_id", "x").join(rows.withColumnsRenamed({"raw": "raw2", "_id": "y"}), ["field", "raw2"])
    return out.where("x <> y").select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def same_look_classes(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(field, ``row_id``, class, links) of every row whose field is also stored in another form.

    A class is named by its least id; links are the rows of the class that store the
    field otherwise. Nothing is paired, so a class may be of any size.
    """
    some = stored_forms(df, row_id, columns)
    forms = cut(some.groupBy("field", "look", "raw").agg(F.count("*").alias("n"), F.min("_id").alias("least")))
    looks = forms.groupBy("field", "look").agg(F.sum("n").alias("all"), F.min("least").alias("class"))
    each = forms.join(looks, ["field", "look"]).select("field", "raw", "class", (F.col("all") - F.col("n")).alias("links"))
    return some.join(each, ["field", "raw"]).select("field", F.col("_id").alias(row_id), "class", "links")
