"""Page furniture around the main body, by shallow text blocks.

A block is a non-blank line.  It is described by its words, by its link density (the
share of short entries between separators, and of known menu entries), by the wording
of furniture, by the same of the blocks before and after it, by how many blocks without
a sentence stand together, and by its place among the sentences of the page.  A decision
tree over these features, trained on a small labelled table of pages, tells main body
from the rest.  Its first question is whether the wording of the page is known at all;
where it is not, the rest of the tree has seen the labelled pages with all wording hidden
and asks for structure alone.  Each page is classified on its own: one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm import boilerplate_pages as fixed
from tidemark.llm.residue import plain
from tidemark.llm.text import WORD, line_form
from tidemark.session import spread

#: Bounds of the tree.
MAX_DEPTH, MIN_LEAF = 10, 1
#: Words are not counted beyond.
MANY = 8

_SEPARATOR = re.compile(r"\s*[|·•»/→☰>]\s*|\s+[-–—]\s+|\t+| {2,}|,\s+|、")
_LABEL = re.compile(f"(?:{fixed.LABELS})[:：]?")
_CUE = re.compile(f"(?:{fixed.CUES})")
_MARKED = re.compile(r"[-*•] |0[.)、] |.*(?:\(0 min\)| 0-0)$")
_MENU = re.compile(r"^(?:menu|menü|navigation|导航|菜单)[:：]\s*", re.IGNORECASE)
_END = re.compile(r"[.。!?！？…][\"”’»)）]?$")
_HAN = re.compile("[㐀-鿿]")
_CELL = re.compile(r"[-+−]?[\d.,]+ ?[%％]?")
NAMES = (
    "sentence", "cue", "label", "nav", "teaser", "cells", "marked", "before", "after", "prev_sentence", "next_sentence", "prev_nav", "next_nav",
    "colon", "items", "words", "prev_words", "next_words", "digits", "links", "prev_links", "next_links", "together", "known",
)
FULL = NAMES[:19]
#: What a page of unknown wording is judged by, and bounds of that part of the tree.
STRUCTURE = ("sentence", "cells", "links", "together", "words", "prev_sentence", "next_sentence", "before", "after", "prev_links", "next_links")
STRUCTURE_DEPTH, STRUCTURE_LEAF = 5, 6
#: Words of a link's text at most, and characters of one that is written without blanks.
LINK_WORDS, LINK_CHARS = 3, 6


def _nav_share(entries: list[str]) -> float:
    return sum(x.rstrip(" 0") in fixed.NAV for x in entries) / max(1, len(entries))


def _link_share(entries: list[str]) -> float:
    """Share of the entries of a line that are short enough for the text of a link, and no figures; 0 for a line of one."""
    if len(entries) < 2:
        return 0.0
    return sum(not _CELL.fullmatch(x) and len(x.split()) <= LINK_WORDS and (not _HAN.search(x) or len(x) <= LINK_CHARS) for x in entries) / len(entries)


def blocks(page: str, wording: bool = True) -> tuple[list[int], list[tuple]]:
    """Line numbers (from 1) of the non-blank lines of ``page``, and their features in the order of ``NAMES``.

    Words are counted in three classes: up to 3, up to 7, and more. Without ``wording``
    nothing is known of what menus, labels and notices say.
    """
    numbers, own = [], []
    teaser = 0
    for no, s in enumerate(line_form(plain(page)).split("\n"), 1):
        if not s:
            continue
        size = len(s)
        n = sum(1 for _ in islice(WORD.finditer(s), MANY))
        cue = wording and _CUE.match(s) is not None
        label = wording and size <= 60 and _LABEL.fullmatch(s) is not None
        sentence = n >= 4 and not cue and _END.search(s, max(0, size - 3)) is not None
        nav, n_items, cells, links = 0.0, 1, 0.0, 0.0
        if not (sentence and n >= MANY):
            listed = _MENU.sub("", s) if ":" in s else s
            items = [x for x in (x.strip("[]+() ") for x in _SEPARATOR.split(listed)) if x]
            n_items = len(items)
            if wording:
                nav = _nav_share(items) if n_items > 1 else max(_nav_share(items), _nav_share(listed.split()))
            links = _link_share(items)
            cells = sum(_CELL.fullmatch(x) is not None for x in items[1:]) / (n_items - 1) if n_items > 2 else 0.0
        if label:
            teaser = 1
        elif sentence or cue or nav > 0.5:
            teaser = 0
        numbers.append(no)
        own.append((sentence, cue, label, nav, teaser, cells, _MARKED.match(s) is not None, ":" in s, min(n_items, 4), 0 if n <= 3 else 1 if n <= 7 else 2, "0" in s, links))
    out = []
    known = any(x[1] or x[2] or x[3] > 0.5 for x in own)
    together = _runs([x[0] or x[5] > 0.5 for x in own])
    at = [i for i, x in enumerate(own) if x[0]]
    first, last = (at[0], at[-1]) if at else (len(own), -1)
    edge = (-1, 0, 0, -1, 0, 0, 0, 0, 0, -1, 0, -1)
    for i, x in enumerate(own):
        p, q = own[i - 1] if i else edge, own[i + 1] if i + 1 < len(own) else edge
        out.append((*x[:7], i > first, i < last, p[0], q[0], p[3], q[3], x[7], x[8], x[9], p[9], q[9], x[10], x[11], p[11], q[11], together[i], known))
    return numbers, out


def _runs(body: list[bool]) -> list[int]:
    """Of every line, how many stand together without a line of ``body`` between them, up to four; 0 for a line of body."""
    out, i = [0] * len(body), 0
    while i < len(body):
        j = i
        while j < len(body) and not body[j]:
            j += 1
        out[i:j] = [min(j - i, 4)] * (j - i)
        i = max(j, i + 1)
    return out


def matrix(rows: list[tuple]) -> np.ndarray:
    return np.array(rows, dtype=float).reshape(-1, len(NAMES))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0, most: int = MAX_DEPTH, leaf: int = MIN_LEAF, features: tuple[int, ...] | None = None) -> tuple | float:
    """A tree of Gini splits: the share of main body in a leaf, or (feature, threshold, below, above)."""
    p = y.mean()
    if p in (0.0, 1.0) or depth == most or len(y) < 2 * leaf:
        return float(p)
    best = None
    for k in range(x.shape[1]) if features is None else features:
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], np.cumsum(y[order])
        cut_at = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut_at = cut_at[(cut_at >= leaf) & (cut_at <= len(y) - leaf)]
        if not len(cut_at):
            continue
        a, n = t[cut_at - 1], len(y)
        pa, pb = a / cut_at, (t[-1] - a) / (n - cut_at)
        g = cut_at * pa * (1 - pa) + (n - cut_at) * pb * (1 - pb)
        i = int(np.argmin(g))
        if best is None or g[i] < best[0] - 1e-12:
            best = (g[i], k, (v[cut_at[i] - 1] + v[cut_at[i]]) / 2)
    if best is None:
        return float(p)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth + 1, most, leaf, features), grow(x[~low], y[~low], depth + 1, most, leaf, features)


def score(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, i = todo.pop()
        if isinstance(node, float):
            out[i] = node
        elif len(i):
            low = x[i, node[0]] <= node[1]
            todo += [(node[2], i[low]), (node[3], i[~low])]
    return out


def learn(pages: list[list[str]]) -> tuple | float:
    """The tree of labelled pages, lines marked "+ " or "- "."""
    y = np.concatenate([[x[0] == "+" for x in lines] for lines in pages]).astype(float)
    rows = {w: matrix([f for lines in pages for f in blocks("\n".join(x[2:] for x in lines), w)[1]]) for w in (True, False)}
    at = tuple(map(NAMES.index, STRUCTURE))
    told = (rows[False][:, NAMES.index("sentence")] == 0) | (y == 1)  # a notice that is a sentence is told by its wording alone
    return NAMES.index("known"), 0.5, grow(rows[False][told], y[told], 0, STRUCTURE_DEPTH, STRUCTURE_LEAF, at), grow(rows[True], y, features=tuple(map(NAMES.index, FULL)))


@lru_cache(maxsize=1)
def trained() -> tuple | float:
    """The tree of the labelled pages of this package."""
    return learn([page.split("\n") for page in fixed.PAGES.strip().split("\n\n")])


def furniture(pages: DataFrame, row_id: str, text: str) -> DataFrame:
    """(``row_id``, line_no) of every non-blank line that is not main body.

    Null, empty and blank texts have no line; lines are numbered from 1 with blank
    ones counted; equal pages each count; an empty table gives none.
    """
    tree = trained()

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ids, lines, feats = [], [], []
            for i, t in zip(p[row_id], p[text], strict=True):
                n, f = blocks(t)
                ids += [i] * len(n)
                lines += n
                feats += f
            if lines:
                off = score(tree, matrix(feats)) < 0.5
                yield pd.DataFrame({row_id: np.array(ids)[off], "line_no": np.array(lines, dtype=np.int64)[off]})

    kind = dict(pages.dtypes)[row_id]
    return spread(pages.select(row_id, text).where(pages[text].isNotNull())).mapInPandas(classify, f"`{row_id}` {kind}, line_no bigint")


def main_body(pages: DataFrame, row_id: str, text: str) -> DataFrame:
    """(``row_id``, ``text``): each page's main body lines; null stays null."""
    tree = trained()

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for t in p[text]:
                if t is not None:
                    n, f = blocks(t)
                    lines = t.split("\n")
                    t = "\n".join(lines[k - 1] for k, ok in zip(n, score(tree, matrix(f)) >= 0.5, strict=True) if ok)
                out.append(t)
            yield pd.DataFrame({row_id: p[row_id], text: out})

    kind = dict(pages.dtypes)[row_id]
    return spread(pages.select(row_id, text)).mapInPandas(keep, f"`{row_id}` {kind}, `{text}` string")
