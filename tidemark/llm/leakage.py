"""Evaluation texts inside a corpus, by winnowing.

Texts are compared by their letters and digits in lower case.  Of every window of
consecutive k-gram hashes the smallest is kept, so two texts that share a run of
window + k - 1 characters share a kept hash inside the run.  The fingerprints of corpus
and items, each with the characters around it that such a run could take in, are joined
by hash, and every hit is extended on the spot.  Fingerprints no item has are left out
before the join by a bit table of fixed size; neither texts nor items are shuffled,
collected or broadcast, and the corpus is read once whatever the number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.llm.sieve import passes, sieve
from tidemark.llm.text import codes, gram_hashes
from tidemark.session import spread

#: Required run, and k-gram length, by language of the item; window = run - k + 1.
RUNS = {"en": (50, 24), "zh": (20, 10)}

_REST = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits of ``text`` in lower case."""
    return _REST.sub("", text.lower())


def winnow(c: np.ndarray, run: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams: in every window the smallest, and its equals."""
    h = gram_hashes(c, k)
    w = run - k + 1
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low, size = h, 1
    while size * 2 <= w:
        low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
    low = np.minimum(low[:n], low[w - size : w - size + n])
    # A k-gram is kept if it is the smallest of some window that holds it, that is, if it equals the
    # largest minimum among those windows.
    i = np.arange(len(h))
    first, last = np.maximum(i - w + 1, 0), np.minimum(i, n - 1)
    levels, size = [low], 1
    while size * 2 <= min(w, n):
        levels.append(np.maximum(levels[-1][: len(levels[-1]) - size], levels[-1][size:]))
        size *= 2
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    top = np.empty(len(h), dtype=np.uint64)
    for q, lv in enumerate(levels):
        m = np.flatnonzero(level == q)
        top[m] = np.maximum(lv[first[m]], lv[last[m] - (1 << q) + 1])
    i = np.flatnonzero(h == top)
    return i, h[i]


def fingerprints(texts: DataFrame, runs: list[tuple[int, int]], table: Broadcast | None = None) -> DataFrame:
    """(run, h, _id, around, at) of the kept k-grams of ``texts`` (_id, _t and, where each has its own, _run).

    ``around`` holds the characters a run of the required length through the k-gram may
    take in, ``at`` the place of the k-gram among them. Equal ones of a text come once.
    """
    kind = dict(texts.dtypes)["_id"]
    own = "_run" in texts.columns

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out: list[tuple] = []
            for i, t, g in zip(p["_id"], p["_t"], p["_run"] if own else [None] * len(p), strict=True):
                s = letters(t)
                c = codes(s)
                for run, k in runs:
                    if g is not None and g != run:
                        continue
                    at, h = winnow(c, run, k)
                    if table is not None:
                        ok = passes(table.value, h)
                        at, h = at[ok], h[ok]
                    got = {(x, s[max(0, q - run + k) : q + run], min(q, run - k)) for q, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)}
                    out += [(run, x, i, a, q) for x, a, q in got]
            yield pd.DataFrame(out, columns=["run", "h", "_id", "around", "at"])

    return texts.mapInPandas(find, f"run int, h bigint, _id {kind}, around string, at int")


def shared_run(a: str, p: int, b: str, q: int) -> int:
    """Length of the run through place p of ``a`` that equals ``b`` around place q."""
    n = 0
    for x, y in zip(a[p:], b[q:], strict=False):
        if x != y:
            break
        n += 1
    for x, y in zip(reversed(a[:p]), reversed(b[:q]), strict=False):
        if x != y:
            break
        n += 1
    return n


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, lang: str, runs: dict[str, tuple[int, int]] = RUNS) -> DataFrame:
    """(``item_id``, ``doc_id``) for every document that shares a long enough run with an item.

    Items in a language without a stated run take that of 'en'. Null texts hold
    nothing, as do texts shorter than the run; equal documents and equal items come
    out by their ids, once each; an empty table on either side gives none.
    """
    lengths = sorted(set(runs.values()))
    other = F.lit(runs["en"][0])
    run = F.coalesce(*(F.when(F.col(lang) == g, F.lit(n)) for g, (n, _) in runs.items()), other)
    held = items.select(F.col(item_id).alias("_id"), F.col(item_text).alias("_t"), run.alias("_run")).where("_t is not null")
    held = cut(fingerprints(held, lengths).withColumnsRenamed({"_id": "_item", "around": "_a", "at": "_p"}))
    texts = spread(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).where(F.col(text).isNotNull()))
    met = fingerprints(texts, lengths, sieve(held.select("h"), "h")).join(held, ["run", "h"])
    long = F.pandas_udf(lambda n, a, p, b, q: pd.Series([shared_run(*x) >= m for m, *x in zip(n, a, p, b, q, strict=True)], dtype=bool), "boolean")
    return met.where(long("run", "around", "at", "_a", "_p")).select(F.col("_item").alias(item_id), F.col("_id").alias(doc_id)).distinct()
