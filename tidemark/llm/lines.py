"""Lines repeated across the documents of one source.

Every content is cut into chunks by its own characters: a rolling hash over the
last ``WINDOW`` characters ends a chunk, and so does a line break, which makes the
chunks of a line the same wherever the line stands; without that, a line shorter than
a chunk would be cut together with its ever different neighbours and never repeat.
Documents are counted per (source, chunk), and the chunks repeated excessively decide
what is cut: a line goes if all its chunks do.  As two excessive chunks may also stand
in a line that is rare as a whole, an exact count of such lines follows.

All counts are partial sums per (source, hash) and all joins go by (source, hash) or
(row, line), so a source with a third of all rows is spread over all tasks, and a line
found in every row collapses before the shuffle.  No text is shuffled to be searched:
the excessive chunks reach the second read as a bit table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.llm.sieve import passes, sieve
from tidemark.llm.text import codes, gram_hashes, line_form, prefix_hashes, spread_bits
from tidemark.session import spread

WINDOW, MEAN_CHUNK = 16, 64
MIN_ROWS, MIN_PERCENT = 4, 5


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, line number (from 1) and hash of every chunk of the non-blank lines of ``texts``.

    The texts are in line form (:func:`line_form`).
    """
    c = codes("\n".join(texts) + "\n")
    ends = np.cumsum([len(t) + 1 for t in texts])
    stop = c == 10
    line_ends = np.flatnonzero(stop)
    line_of = np.cumsum(stop) - stop
    starts = np.concatenate([[0], line_ends[:-1] + 1])
    rolled = gram_hashes(c, WINDOW)
    edge = stop.copy()
    if len(rolled):
        at = np.flatnonzero((rolled >> np.uint64(20)) % np.uint64(MEAN_CHUNK) == 0) + WINDOW  # a chunk ends before this place
        edge_at = at[(at < len(c)) & (at - starts[line_of[np.minimum(at, len(c) - 1)]] >= WINDOW)]
        edge[edge_at] = True
    b = np.flatnonzero(edge)
    a = np.concatenate([[0], b[:-1]])
    a = a + stop[a]  # a line break belongs to no chunk
    if len(b):
        a[0] = 0
    full = b > a
    a, b = a[full], b[full]
    s, inv = prefix_hashes(c)
    with np.errstate(over="ignore"):
        h = ((s[b] - s[a]) * inv[a]) ^ ((b - a).astype(np.uint64) << np.uint64(48))
    text = np.searchsorted(ends, a, side="right")
    first_line = np.concatenate([[0], line_of[ends[:-1]]]) if len(texts) > 1 else np.zeros(1, dtype=np.int64)
    return text, line_of[a] - first_line[text] + 1, h.view(np.int64)


def _excessive(counts: DataFrame, totals: DataFrame, min_rows: int, min_percent: int) -> DataFrame:
    return counts.join(totals, "_src").where((F.col("n") >= min_rows) & (F.col("n") * 100 >= F.col("total") * min_percent))


def _own(h: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Hashes of chunks within their source."""
    names, at = np.unique(source.astype(str), return_inverse=True)
    salt = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names], dtype=np.uint64)
    return spread_bits(h.view(np.uint64) ^ salt[at])


def _chunk_counts(texts: DataFrame) -> DataFrame:
    """(_src, h, n): rows of the source that hold the chunk."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if p.empty:
                continue
            doc, _, h = chunks([line_form(t) for t in p["_t"]])
            each = pd.DataFrame({"doc": doc, "h": h}).drop_duplicates()
            each["_src"] = p["_src"].to_numpy()[each["doc"].to_numpy()]
            each["h"] = _own(each["h"].to_numpy(), each["_src"].to_numpy()).view(np.int64)
            yield each.groupby(["_src", "h"], sort=False).size().reset_index(name="n")

    return texts.select("_src", "_t").mapInPandas(count, "_src string, h bigint, n bigint").groupBy("_src", "h").agg(F.sum("n").alias("n"))


def excessive_lines(rows: DataFrame, row_id: str, text: str, source: str, min_rows: int = MIN_ROWS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(_id, _src, _th, line_no) of every excessive line; ``_th`` is a hash of the text it stands in."""
    base = rows.select(F.col(row_id).alias("_id"), F.coalesce(F.col(source), F.lit("\0")).alias("_src"), F.col(text).alias("_t"))
    totals = cut(base.groupBy("_src").agg(F.count("*").alias("total")))
    texts = spread(base.where(F.col("_t").isNotNull()).withColumn("_th", F.xxhash64("_t")))
    common = cut(_excessive(_chunk_counts(texts), totals, min_rows, min_percent).select("h"))
    table = sieve(common, "h")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            forms = [line_form(t) for t in p["_t"]]
            if not forms:
                continue
            doc, line, h = chunks(forms)
            ok = passes(table.value, _own(h, p["_src"].to_numpy()[doc]))
            each = pd.DataFrame({"doc": doc, "line_no": line, "ok": ok}).groupby(["doc", "line_no"], sort=False)["ok"].all()
            each = each[each].reset_index()
            lines = [f.split("\n") for f in forms]
            at = each["doc"].to_numpy()
            out = pd.DataFrame({"_id": p["_id"].to_numpy()[at], "_src": p["_src"].to_numpy()[at], "_th": p["_th"].to_numpy()[at], "line_no": each["line_no"]})
            out["lh"] = [xxhash.xxh3_128_digest(lines[d][n - 1].encode("utf-8", "surrogatepass")) for d, n in zip(each["doc"], each["line_no"], strict=True)]
            out["first"] = (~each.assign(lh=out["lh"]).duplicated(["doc", "lh"])).astype("int32")
            yield out

    kind = dict(base.dtypes)["_id"]
    found = cut(texts.mapInPandas(candidates, f"_id {kind}, _src string, _th bigint, line_no bigint, lh binary, first int"))
    line_counts = found.groupBy("_src", "lh").agg(F.sum("first").alias("n"))
    excess = cut(_excessive(line_counts, totals, min_rows, min_percent).select("_src", "lh"))
    return found.join(excess, ["_src", "lh"], "left_semi").select("_id", "_src", "_th", "line_no")


def repeated_lines(rows: DataFrame, row_id: str, text: str, source: str, min_rows: int = MIN_ROWS, min_percent: int = MIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Excessive lines as (``row_id``, line_no), and the same with the source and a hash of the text.

    Two lines are the same when their line forms are.  All rows of a source count
    as its rows, also those without text; equal rows each count.  A null source is
    a source of its own; null, empty and blank texts give no line; an empty table
    gives empty results.
    """
    found = excessive_lines(rows, row_id, text, source, min_rows, min_percent)
    return found.select(F.col("_id").alias(row_id), "line_no"), found


def without_repeated_lines(rows: DataFrame, row_id: str, text: str, source: str, min_rows: int = MIN_ROWS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(``row_id``, ``text``): each text without its source's excessive lines; null stays null.

    What is to be cut meets its row by id, source and text, which no group of rows has in common but copies.
    """
    found = repeated_lines(rows, row_id, text, source, min_rows, min_percent)[1]
    gone = found.groupBy("_id", "_src", "_th").agg(F.collect_set("line_no").alias("_gone"))
    base = rows.select(F.col(row_id).alias("_id"), F.coalesce(F.col(source), F.lit("\0")).alias("_src"), F.col(text).alias("_t")).withColumn("_th", F.xxhash64("_t"))
    kept = F.array_join(F.filter(F.split("_t", "\n", -1), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("bigint"))), "\n")
    out = base.join(gone, ["_id", "_src", "_th"], "left").select("_id", F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(kept).alias("_t"))
    return out.select(F.col("_id").alias(row_id), F.col("_t").alias(text))
