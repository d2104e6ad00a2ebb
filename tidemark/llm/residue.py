"""Template residue, filler, error pages and script demands.

What is compared are units of a text: its lines, their sentences, neighbouring pairs of
these, and marked spans (between the marks of templates, runs of filling characters) in a
form that leaves out what the slot is called.  All units meet a small labelled table in
partitioned tables of a SimHash, and in tables of their least triples, which no similar
pair can miss; a meeting counts if the similarity of the texts allows it, and labels
spread along such links until no component with a trusted unit grows any more.  A row is
residue if one of its units is in such a component; nothing else makes it one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.llm import residue_terms
from tidemark.llm.lookalikes import TWINS, invisible
from tidemark.llm.text import DIGITS, Without, codes, compatible, gram_hashes, line_form
from tidemark.session import spread

#: Share of common character triples two lines need, tables of the hash, and bits that may differ in these.
SIMILAR, TABLES, MAX_BITS = 0.8, 8, 16
#: Similarity the search below goes down to unless told otherwise: what two links can reach, as one less Jaccard is a metric.
REACH = 2 * SIMILAR - 1
#: Forms a read of the texts looks for; more are looked for in further reads.
FORMS = 2_000
#: Characters searched at once.
CHUNK = 500_000
#: Triples compared at once.
BLOCK = 500_000
#: Forms of spans whose result a task remembers; the others are looked up anew.
SPANS_HELD = 100_000

_visible = Without(invisible())
_TWINS = {ord(a): b for x, y in zip(TWINS[::2], TWINS[1::2], strict=True) for a, b in zip(x, y, strict=True)}
_TWIN_RE = re.compile("[" + "".join(map(chr, _TWINS)) + "]")
_HOST = re.compile(r"(?:https?://)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?:?", re.ASCII)
_DOTTED = re.compile(r"\.[a-z]")
_STOP = re.compile(r"[。!?]+[\"”’»)」』]*|\.+[\"”’»)]*(?= )")
_SPAN = re.compile("|".join(residue_terms.SPANS))
_NAMED = re.compile(r"(\{\{|\{%|\$\{|<%|<<|@@|__|%(?=[^%]+%))(?!\s*$)\W*[^\W\d].*?(\}\}|%\}|\}|%>|>>|@@|__|%)$")
_CAPITALS = re.compile(r"\[(?=[^\W\d_]{4}|[^\W\d_]{2,} )[^\W\d_]{2,}(?: [^\W\d_]{2,})*\]")
_IDENTIFIER = re.compile(r"(?<!\w)[A-Za-z]+(?:_[A-Za-z0-9]+)+(?!\w)")
_HAN_NAME = re.compile(r"([#《【\[](?:请|待|插入)?)[一-鿿]+([#》】\]])")
_INSERT = re.compile(r"(?<=^\[insert )[^\]]+")


def plain(s: str) -> str:
    """Compatibility form without invisible characters and with letters of one alphabet."""
    if s.isascii():
        return s
    s = compatible(_visible(s))
    return s.translate(_TWINS) if _TWIN_RE.search(s) else s


def residue_form(line: str) -> str:
    """A line (in line form) without host names."""
    return " ".join(_HOST.sub("", line).split()) if _DOTTED.search(line) else line


def triples(s: str) -> np.ndarray:
    """Distinct hashes of the runs of three characters, of the whole if it is shorter."""
    c = codes(s)
    return np.unique(gram_hashes(c, min(3, len(c)))) if len(c) else np.zeros(0, dtype=np.uint64)


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text over its character triples, its end included."""
    out = np.zeros(len(texts), dtype=np.int64)
    for at in range(0, len(texts), 4096):
        part = texts[at : at + 4096]
        n = np.array([len(t) for t in part])
        keep = np.flatnonzero(n)
        if not len(keep):
            continue
        grams = gram_hashes(codes("\0\0".join(part) + "\0\0\0\0"), 3)
        starts = (np.cumsum(n + 2) - n - 2)[keep]
        own = np.zeros(len(grams), dtype=bool)
        own[np.repeat(starts, n[keep]) + np.arange(n.sum()) - np.repeat(np.cumsum(n[keep]) - n[keep], n[keep])] = True
        bits = np.unpackbits(grams[own].view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, np.cumsum(n[keep]) - n[keep], axis=0, dtype=np.int32)
        out[at + keep] = np.packbits(sums * 2 > n[keep, None], axis=1).view(np.int64).ravel()
    return out


def seed_forms(seeds: tuple[str, ...]) -> list[str]:
    return sorted({residue_form(line_form(plain(s))) for s in seeds})


def span_form(span: str) -> str:
    """A marked span without the name of its slot.

    Between marks that only templates use, the name is left out whole. In brackets that
    prose uses too, words in capitals (several, or one of four letters or more), names with
    an underscore and what follows "insert" or 请, 待, 插入 are left out; other words stay,
    so that a label in such brackets speaks for its own words. A single brace with one word
    is text.
    """
    if m := _NAMED.match(span):
        return f"{m[1]}a{m[2]}"
    span = _IDENTIFIER.sub("a_a", span)
    if span[0] in "#《【[":
        m = _HAN_NAME.fullmatch(span)
        if m and (len(m[1]) > 1 or span[0] == "#"):
            return f"{m[1]}一{m[2]}"
    if span[0] == "[":
        span = "[name]" if span.isupper() and _CAPITALS.fullmatch(span) else _INSERT.sub("a", span.casefold())
    elif span[0] in "Xx×○□":
        span = span[0] * 2
    return DIGITS.sub("0", " ".join(span.casefold().split()))


def trusted_forms(seeds: tuple[str, ...], spans: tuple[str, ...] = residue_terms.LABELLED_SPANS) -> list[str]:
    """The units of the labelled table."""
    return sorted({*seed_forms(seeds), *(span_form(plain(s)) for s in spans)})


def _similar(a: str, b: str) -> bool:
    x, y = triples(a), triples(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def _table_keys(sim: Column) -> Column:
    width = 64 // TABLES
    return F.array(*(F.concat(F.lit(f"{t}:"), F.shiftrightunsigned(sim, t * width).bitwiseAND(F.lit(2**width - 1)).cast("string")) for t in range(TABLES)))


def _runs(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


class Near:
    """Search for the spans of a text that may be as similar as ``reach`` to one of ``forms``, of any length.

    Of such a span at most (1 - reach) / reach times as many distinct triples are
    unknown as it shares with the form.  Unknown ones are counted by the buckets they
    fall into, which is never too many, so that none is missed.  It also shares ``reach`` of
    the form's triples, hence one of any larger part than the rest: of the rarest in the
    first text that is loaded, which is any choice, but one few texts share.  What passes
    is compared.
    """

    def __init__(self, forms: list[str], reach: float = REACH) -> None:
        self.reach = reach
        self.most = max((len(triples(f)) for f in forms), default=0)
        self.short = {f for f in forms if len(f) < 3}
        self.known = np.zeros(2**20, dtype=bool)
        self.sizes, self.having = [], defaultdict(list)
        self.hashes, self.rare = [np.unique(self._hash(codes(f))) for f in forms if len(f) > 2], None
        self.form_sizes = np.array([len(x) for x in self.hashes], dtype=np.int64)
        every = np.concatenate([*self.hashes, np.zeros(0, dtype=np.uint32)])
        order = np.argsort(every, kind="stable")
        self.triple, self.first = np.unique(every[order], return_index=True)
        self.first, self.forms_of = np.append(self.first, len(every)), np.repeat(np.arange(len(self.hashes)), self.form_sizes)[order]
        for f in forms:
            self.known[self._hash(codes(f)) >> np.uint32(12)] = True
            own = _runs(f)
            for g in own:
                self.having[g].append(len(self.sizes))
            self.sizes.append(len(own))

    @staticmethod
    def _hash(c: np.ndarray) -> np.ndarray:
        return c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)

    def similar(self, unit: str) -> bool:
        """Whether a unit is as similar as ``reach`` to one of the forms."""
        own = _runs(unit)
        shared = Counter(k for g in own if g in self.having for k in self.having[g])
        return any(n >= self.reach * (len(own) + self.sizes[k] - n) - 1e-9 for k, n in shared.items())

    def _choose(self, h: np.ndarray) -> None:
        seen = np.bincount(h >> np.uint32(8), minlength=2**24)
        self.rare = np.zeros(2**24, dtype=bool)
        for x in self.hashes:
            part = len(x) - int(np.ceil(self.reach * len(x) - 1e-9)) + 1
            at = x >> np.uint32(8)
            self.rare[at[np.argsort(seen[at], kind="stable")[:part]]] = True

    def load(self, c: np.ndarray) -> None:
        self.h = h = self._hash(c)
        if self.rare is None:
            self._choose(h)
        self.chosen = np.concatenate(([0], np.cumsum(self.rare[h >> np.uint32(8)])))
        known = self.known[h >> np.uint32(12)]
        self.inside = np.concatenate(([0], np.cumsum(known)))
        self.bits = np.append(np.where(known, np.uint64(0), np.uint64(1) << (h >> np.uint32(6) & np.uint32(63)).astype(np.uint64)), np.uint64(0))

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of the spans [a, b) of the loaded text that may be near."""
        at = np.flatnonzero(b - a >= 3)
        if not len(at):
            return at
        at = at[self.chosen[b[at] - 2] > self.chosen[a[at]]]
        if not len(at):
            return at
        a, b = a[at], b[at] - 2
        unknown = np.bitwise_count(np.bitwise_or.reduceat(self.bits, np.stack((a, b), axis=1).ravel())[::2])
        shared = np.minimum(self.inside[b] - self.inside[a], self.most)
        return at[unknown * self.reach <= (1 - self.reach) * shared + 1e-9]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which spans [a, b) of the loaded text are as similar as ``reach`` to one of the forms.

        By hashes of triples; as two of a form may have one, a triple less will do.
        """
        out = np.zeros(len(a), dtype=bool)
        n, f = b - a - 2, len(self.hashes)
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(n) // BLOCK) > 0) + 1):
            if not len(part):
                continue
            k = n[part]
            pos = np.repeat(a[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            x = np.unique(np.repeat(np.arange(len(part), dtype=np.uint64), k) << np.uint64(32) | self.h[pos])
            unit, h = (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(2**32 - 1)).astype(np.uint32)
            size = np.bincount(unit, minlength=len(part))
            at = np.minimum(np.searchsorted(self.triple, h), len(self.triple) - 1)
            hit = self.triple[at] == h
            unit, at = unit[hit], at[hit]
            many = self.first[at + 1] - self.first[at]
            form = self.forms_of[np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            pair, shared = np.unique(np.repeat(unit, many) * f + form, return_counts=True)
            u = pair // f
            ok = shared + 1 >= self.reach * (size[u] + self.form_sizes[pair % f] - shared - 1)
            out[part[u[ok]]] = True
        return out

    def __call__(self, texts: list[str]) -> set[tuple[int, str]]:
        """(number of the text, unit) of every unit that may be near."""
        out = set()
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        text = "\n".join(texts)
        c = codes(text)
        if len(c) < 3:
            return {(i, t) for i, t in enumerate(texts) if t in self.short}
        self.load(c)
        for a, b in units(text, c):
            if self.short:
                for k in np.flatnonzero(b - a < 3):
                    if text[a[k] : b[k]] in self.short:
                        out.add((int(np.searchsorted(begin, a[k], "right")) - 1, text[a[k] : b[k]]))
            at = self.spans(a, b)
            at = at[self.near(a[at], b[at])]
            for i, x, y in zip(np.searchsorted(begin, a[at], "right") - 1, a[at], b[at], strict=True):
                if self.similar(text[x:y]):
                    out.add((int(i), text[x:y]))
        return out


def units(text: str, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of what is compared in a text of code points ``c``: its lines, their sentences, and neighbouring two of these."""
    breaks = np.flatnonzero(c == 10)
    first, last = np.concatenate(([0], breaks + 1)), np.append(breaks, len(c))
    yield first, last
    a = np.unique(np.concatenate((first, np.array([m.end() for m in _STOP.finditer(text)], dtype=np.int64))))
    a = a[a < len(c)]
    a = a[c[a] != 10]
    line = np.searchsorted(first, a, "right") - 1
    b = np.minimum(np.append(a[1:], len(c)), last[line])
    a = a + (c[a] == 32)
    on = line[1:] == line[:-1]
    several = np.append(on, False) | np.append(False, on)
    yield a[several], b[several]
    yield a[:-1][on], b[1:][on]


def _prefix(s: str) -> np.ndarray:
    """The least triples of a line: of two lines as similar as ``SIMILAR``, these have one in common."""
    x = triples(s)  # in order of the hash
    return x[: len(x) - int(np.ceil(SIMILAR * len(x) - 1e-9)) + 1].view(np.int64)


def labelled_lines(lines: DataFrame, seeds: tuple[str, ...] = residue_terms.LABELLED) -> DataFrame:
    """Of distinct ``lines`` (form, sim), those in a component of near-duplicate links with a seed."""
    return spread_labels(lines, seed_forms(seeds))[0]


def spread_labels(lines: DataFrame, forms: list[str]) -> tuple[DataFrame, int]:
    """Of distinct ``lines`` (form, sim), those linked to ``forms``, and the number of links the farthest needs."""
    spark = lines.sparkSession
    prefix = F.pandas_udf(lambda s: pd.Series([_prefix(x) for x in s]), "array<bigint>")
    keyed = lambda df: df.withColumn("keys", F.concat(_table_keys(F.col("sim")), prefix("form").cast("array<string>")))
    lines = cut(keyed(lines))
    frontier = cut(keyed(spark.createDataFrame(pd.DataFrame({"form": forms, "sim": simhashes(forms)}), "form string, sim bigint")))  # of a size the planner knows
    done, steps = None, 0
    pair_ok = F.pandas_udf(lambda a, b: pd.Series([_similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    while True:
        f = frontier.select(F.col("form").alias("_f"), F.col("sim").alias("_fs"), F.explode("keys").alias("key"))
        rest = lines if done is None else lines.join(done, "form", "left_anti")
        met = rest.select("form", "sim", F.explode("keys").alias("key")).join(f, "key")
        met = met.where(~F.col("key").contains(":") | (F.bit_count(F.col("sim").bitwiseXOR(F.col("_fs"))) <= MAX_BITS)).select("form", "_f").distinct()
        new = met.where(pair_ok("form", "_f")).select("form").distinct()
        new = cut(lines.join(new, "form", "left_semi"))
        if new.isEmpty():
            return (done if done is not None else lines.select("form").limit(0)), steps
        steps += 1
        done = new.select("form") if done is None else cut(done.unionByName(new.select("form")))
        frontier = new


def labelled_table() -> tuple[str, ...]:
    """The trusted lines: those of the table, common wordings, and what servers say of error codes."""
    return (*residue_terms.LABELLED, *residue_terms.COMMON, *residue_terms.status_lines())


def residue_rows(rows: DataFrame, keys: list[str], text: str, seeds: tuple[str, ...] | None = None) -> DataFrame:
    """``keys`` of the rows whose text is residue or contains it, each once.

    Null, empty and blank texts are no cases; equal rows each count; an empty table
    gives none. Of whole texts, lines of any length, their sentences, neighbouring pairs
    of sentences and marked spans are compared. A read keeps the units that may be linked to
    those it looks for, at first the trusted ones; what is linked to them is looked for by
    the next read, ``FORMS`` at a time, until links lead no farther.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", form string"
    source = spread(rows.select(*keys, text).where(F.col(text).isNotNull()))
    hashed = F.pandas_udf(lambda s: pd.Series(simhashes(list(s)), dtype="int64"), "bigint")

    def read(forms: list[str]) -> DataFrame:
        def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = Near(forms, SIMILAR)
            span_known: dict[str, bool] = {}
            for p in batches:
                at, got, part, size = [], [], [], 0
                for i, t in enumerate(p[text]):
                    t = plain(t)
                    for x in {span_form(m[0]) for m in _SPAN.finditer(t)}:
                        ok = span_known.get(x)
                        if ok is None:
                            ok = x in near.short or near.similar(x)
                            if len(span_known) < SPANS_HELD:
                                span_known[x] = ok
                        if ok:
                            at.append(i)
                            got.append(x)
                    t = line_form(t)
                    part.append((i, "\n".join(map(residue_form, t.split("\n"))) if _DOTTED.search(t) else t))
                    size += len(t)
                    if size > CHUNK or i == len(p) - 1:
                        for k, x in near([t for _, t in part]):
                            at.append(part[k][0])
                            got.append(x)
                        part, size = [], 0
                out = p[keys].astype(object).iloc[at].reset_index(drop=True)
                out["form"] = pd.Series(got, dtype=object)
                yield out

        return cut(source.mapInPandas(found, schema))

    known = forms = trusted_forms(labelled_table() if seeds is None else seeds)
    found = None
    while forms:
        now, forms = forms[:FORMS], forms[FORMS:]
        u = read(now)
        bad = cut(spread_labels(cut(u.select("form").distinct().withColumn("sim", hashed("form"))), now)[0])
        rows = u.join(bad, "form", "left_semi").select(*keys).distinct()
        found = rows if found is None else found.unionByName(rows)
        new = {x["form"] for x in bad.toLocalIterator()}.difference(known)
        known, forms = sorted({*known, *new}), forms + sorted(new)
    return found.distinct()
