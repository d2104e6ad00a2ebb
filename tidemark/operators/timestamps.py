"""Mixed timestamp notations and zones to one UTC instant.

Every value yields an array of all its valid interpretations.  Per source the
records are then decoded in delivery order by Viterbi: an interpretation costs
when it contradicts the order the source states for day and month, when the
field order switches against the record before, and when time jumps backward.
Records are decoded in blocks of about ``BLOCK``, so no task holds all records of one
source, and the path is carried from block to block: each block first says what the
cheapest path from every reading of its first record to every reading of its last one
costs, a few numbers; chained per source these give the readings at all borders, and the
blocks are then decoded between fixed ends. The result is that of one path per source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut

#: Records decoded together, where ids are spread evenly.
BLOCK = 65_536
#: Costs of a path. Contradicting the stated order outweighs everything else in a run.
AGAINST_ORDER, SWITCH, BACKWARD, UNLIKELY = 1e7, 1.0, 0.5, 50.0
EPOCH = date(1970, 1, 1).toordinal()
DAY = 86_400_000_000

# Zone abbreviations with their usual offset in minutes.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "GST": 240, "PKT": 300, "IST": 330, "ICT": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "BRT": -180,
}
# Month names by their first letters, English and German.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10,
    "nov": 11, "dec": 12, "dez": 12,
}
ORDERS = {"ymd": 0, "mdy": 1, "dmy": 2}

_TIME = r"(?:[T,\s]*(?P<ap1>上午|下午|凌晨|早上|中午|晚上)?\s*(?P<h>\d{1,2})\s*[:时點点]\s*(?P<mi>\d{1,2})\s*(?:分|[:分]\s*(?P<s>\d{1,2})秒?(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap2>[AaPp]\.?[Mm]\.?)?(?:\s*(?:Uhr|uhr))?)?"
_ZONE = r"(?:\s*\(?(?P<z>Z|z|(?:UTC|GMT)?\s?[+\-−]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})\)?)?"
_YMD = re.compile(r"(?P<y>\d{4})\s*(?P<sep>[-/.年])\s*(?P<m>\d{1,2})\s*[-/.月]\s*(?P<d>\d{1,2})\s*日?" + _TIME + _ZONE)
_SHORT = re.compile(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})" + _TIME + _ZONE)
_NAMED = re.compile(r"(?:[^\W\d]+\.?,?\s+)?(?:(?P<d>\d{1,2})(?:st|nd|rd|th)?\.?\s+(?P<m>[^\W\d]{3,})\.?|(?P<m2>[^\W\d]{3,})\.?\s+(?P<d2>\d{1,2})(?:st|nd|rd|th)?),?\s+(?P<y>\d{4})" + _TIME + _ZONE)
_STAMP = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?" + _ZONE)


def _clock(g: dict[str, str | None]) -> int | None:
    """Microseconds since midnight, or None for a time of day that does not exist."""
    if g["h"] is None:
        return 0
    h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    half = (g.get("ap2") or "").lower().replace(".", "") or {"上午": "am", "凌晨": "am", "早上": "am", "下午": "pm", "晚上": "pm", "中午": "pm"}.get(g.get("ap1") or "", "")
    if half:
        if h == 12:
            h = 0 if half == "am" else 12
        elif half == "pm" and h < 12:
            h += 12
    if h > 23 or mi > 59 or s > 59:
        return None
    return ((h * 60 + mi) * 60 + s) * 1_000_000 + int(((g.get("f") or "") + "000000")[:6])


def _offset(z: str) -> int | None:
    """Offset of a stated zone in minutes; None when the name is unknown."""
    z = z.upper().replace("−", "-").replace(" ", "")
    if z in ZONES:
        return ZONES[z]
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", z):
        return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0))
    return None


def _local(y: int, m: int, d: int, us: int | None) -> int | None:
    try:
        return None if us is None or y < 1 else (date(y, m, d).toordinal() - EPOCH) * DAY + us
    except ValueError:
        return None


@lru_cache(maxsize=200_000)
def _hour_offset(tz: str, hour: int) -> int:
    return 0 if not tz else int(ZoneInfo(tz).utcoffset(datetime(1970, 1, 1) + timedelta(hours=hour)).total_seconds())


def _to_utc(local: int, tz: str) -> int:
    """UTC of a local time: the earlier of two instants, the offset before a change for none (fold 0)."""
    quarter, rest = divmod(local, 900_000_000)
    if _hour_offset(tz, quarter // 4) == _hour_offset(tz, quarter // 4 + 1):  # no change of offset near
        return local - _hour_offset(tz, quarter // 4) * 1_000_000
    at = datetime(1970, 1, 1) + timedelta(microseconds=local)
    return local - int(ZoneInfo(tz).utcoffset(at).total_seconds()) * 1_000_000


def interpretations(text: str | None, tz: str, stated: int = -1) -> list[tuple[int, int, bool]]:
    """All valid readings of ``text``: (UTC microseconds, field order or -1, unlikely).

    A year of two digits is read in front only where the source doesn't state that it stands behind.

    Empty for null, for strings without a full calendar day and for days or times
    that do not exist.
    """
    if text is None:
        return []
    s = text.strip()
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s).strip()
    if not s or not s[-1].isalnum() and s[-1] not in "日分秒.)":
        return []
    if s.isdigit():
        if len(s) in (8, 14):
            us = _clock({"h": s[8:10], "mi": s[10:12], "s": s[12:14]}) if len(s) == 14 else 0
            at = _local(int(s[:4]), int(s[4:6]), int(s[6:8]), us)
            return [] if at is None else [(_to_utc(at, tz), -1, False)]
        n = len(s)
        if n < 9 or n > 20:
            return []
        v = int(s)
        return [(v * 1_000_000 if n <= 11 else v * 1000 if n <= 13 else v if n <= 17 else v // 1000, -1, False)]
    days: list[tuple[int, int, int, int, bool]] = []
    if (m := _YMD.fullmatch(s)) or (m := _STAMP.fullmatch(s)):
        g = m.groupdict()
        days.append((int(g["y"]), int(g["m"]), int(g["d"]), -1, False))
    elif m := _SHORT.fullmatch(s):
        g = m.groupdict()
        a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
        y = c if len(g["c"]) == 4 else 2000 + c
        days += [(y, b, a, ORDERS["dmy"], False), (y, a, b, ORDERS["mdy"], False)]
        if len(g["c"]) == 2 and stated in (-1, ORDERS["ymd"]):
            days.append((2000 + a, b, c, ORDERS["ymd"], True))
    elif m := _NAMED.fullmatch(s):
        g = m.groupdict()
        month = MONTHS.get((g["m"] or g["m2"])[:3].lower())
        if month is None:
            return []
        days.append((int(g["y"]), month, int(g["d"] or g["d2"]), -1, False))
    else:
        return []
    us = _clock(g)
    shift = None
    if g["z"]:
        shift = _offset(g["z"])
        if shift is None:
            return []
    out: dict[int, tuple[int, int, bool]] = {}
    for y, mo, d, order, rare in days:
        at = _local(y, mo, d, us)
        if at is not None:
            utc = _to_utc(at, tz) if shift is None else at - shift * 60_000_000
            out.setdefault(utc, (utc, order, rare))
    return list(out.values())


def viterbi(instants: list[np.ndarray], orders: list[np.ndarray], rare: list[np.ndarray], stated: int) -> np.ndarray:
    """The cheapest path through the interpretations of consecutive records.

    Ties fall to the earlier interpretation of the array. ``stated`` is the field
    order the source states, -1 for none.
    """
    n = len(instants)
    pick = np.zeros(n, dtype=np.int64)
    cost, back = None, []
    prev_t = prev_o = None
    for i in range(n):
        t, o = instants[i], orders[i]
        own = [(AGAINST_ORDER if x >= 0 and stated >= 0 and x != stated else 0.0) + (UNLIKELY if r else 0.0) for x, r in zip(o, rare[i], strict=True)]
        if cost is None:
            cost, b = own, [0] * len(own)
        else:
            new, b = [], []
            for k in range(len(own)):
                best, at = None, 0
                for j in range(len(cost)):
                    c = cost[j] + (SWITCH if o[k] >= 0 and prev_o[j] >= 0 and o[k] != prev_o[j] else 0.0) + (BACKWARD if t[k] < prev_t[j] else 0.0)
                    if best is None or c < best:
                        best, at = c, j
                new.append(best + own[k])
                b.append(at)
            cost = new
        back.append(b)
        prev_t, prev_o = t, o
    k = int(np.argmin(cost)) if n else 0
    for i in range(n - 1, -1, -1):
        pick[i] = instants[i][k]
        k = back[i][k]
    return pick


def _own(orders: np.ndarray, rare: np.ndarray, stated: int) -> list[float]:
    return [(AGAINST_ORDER if x >= 0 and stated >= 0 and x != stated else 0.0) + (UNLIKELY if r else 0.0) for x, r in zip(orders, rare, strict=True)]


def _step(cost: list[float], t0: np.ndarray, o0: np.ndarray, t1: np.ndarray, o1: np.ndarray) -> list[tuple[float, int]]:
    """Per reading of a record, the cheapest way into it from those of the record before, and from which; ties fall to the earlier."""
    out = []
    for k in range(len(t1)):
        best, at = float("inf"), 0
        for j, c in enumerate(cost):
            x = c + (SWITCH if o1[k] >= 0 and o0[j] >= 0 and o1[k] != o0[j] else 0.0) + (BACKWARD if t1[k] < t0[j] else 0.0)
            if x < best:
                best, at = x, j
        out.append((best, at))
    return out


def border_costs(instants: list, orders: list, rare: list, stated: int) -> list[list[float]]:
    """Cost of the cheapest path from each reading of the first record to each of the last, own costs included.

    A record with one reading cuts a path in two, so only the runs at both ends are followed where there is one.
    """
    n = len(instants)
    alone = [i for i in range(n) if len(instants[i]) == 1]

    def run(a: int, b: int) -> list[list[float]]:
        rows = []
        for f in range(len(instants[a])):
            own = _own(orders[a], rare[a], stated)
            cost = [c if k == f else float("inf") for k, c in enumerate(own)]
            for i in range(a + 1, b + 1):
                into = _step(cost, instants[i - 1], orders[i - 1], instants[i], orders[i])
                cost = [x + c for (x, _), c in zip(into, _own(orders[i], rare[i], stated), strict=True)]
            rows.append(cost)
        return rows

    if not alone:
        return run(0, n - 1)
    first, last = run(0, alone[0]), run(alone[-1], n - 1)
    return [[x[0] + y for y in last[0]] for x in first]


def border_path(blocks: list[tuple]) -> list[tuple[int, int]]:
    """The readings (of the first and of the last record) of every block of a source, in order, on the cheapest path.

    A block is (instants and orders of its first record, of its last, costs between them).
    """
    cost: list[float] = []
    back: list[list[tuple[int, int]]] = []  # per reading of the last record: reading of the first, and of the last of the block before
    before = None
    for t0, o0, t1, o1, m in blocks:
        into = [(0.0, 0)] * len(t0) if before is None else _step(cost, *before, t0, o0)
        new, ways = [], []
        for k in range(len(t1)):
            c, f = min((into[f][0] + m[f][k], f) for f in range(len(t0)))
            new.append(c)
            ways.append((f, into[f][1]))
        cost, before = new, (t1, o1)
        back.append(ways)
    out = []
    k = int(np.argmin(cost)) if cost else 0
    for ways in reversed(back):
        f, prev = ways[k]
        out.append((f, k))
        k = prev
    return out[::-1]


def normalise(records: DataFrame, sources: DataFrame, keys: list[str], order_by: str, value: str, source: str = "source", block: int = BLOCK) -> DataFrame:
    """(``keys``..., utc_us) for every record whose ``value`` names an instant.

    ``sources`` gives tz and date_order by source.  A source that is null or not
    listed counts as UTC without a stated order, where Viterbi alone decides.
    Null and unreadable values are left out; equal records each count; an empty
    table gives an empty result.  ``order_by`` is an integer column of ``keys``.
    """
    known = sources.select(F.col("source").alias("_s"), F.col("tz").alias("_tz"), F.col("date_order").alias("_ord")).where("_s is not null").dropDuplicates(["_s"])
    rows = records.select(*keys, F.col(value).alias("_v"), F.col(source).alias("_src")).where("_v is not null")
    rows = rows.join(known, rows["_src"] == known["_s"], "left").drop("_s")
    order_code = F.coalesce(*(F.when(F.col("_ord") == k, F.lit(v)) for k, v in ORDERS.items()), F.lit(-1)).cast("int")
    rows = rows.select(*keys, "_v", "_src", F.coalesce("_tz", F.lit("")).alias("_tz"), order_code.alias("_stated"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [interpretations(*x) for x in zip(p["_v"], p["_tz"], p["_stated"], strict=True)]
            out = p.drop(columns=["_v", "_tz"])
            out["at"], out["ord"], out["rare"] = [[x[0] for x in g] for g in got], [[x[1] for x in g] for g in got], [[int(x[2]) for x in g] for g in got]
            yield out[[bool(g) for g in got]]

    kinds = dict(records.dtypes)
    base = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    read_rows = cut(rows.mapInPandas(read, f"{base}, _src string, _stated int, at array<bigint>, ord array<int>, rare array<int>"))
    others = [k for k in keys if k != order_by]
    span = read_rows.groupBy(*others, "_src").agg(F.min(order_by).alias("_lo"), F.max(order_by).alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest(F.ceil((F.col("_hi").cast("double") - F.col("_lo") + 1) * block / F.col("_n")), F.lit(1)).cast("double")
    span = span.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(others)), F.col("_src").alias("_s"), "_lo", width.alias("_w"))
    same = F.col("_src").eqNullSafe(F.col("_s"))
    for i, k in enumerate(others):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    read_rows = read_rows.join(span, same).withColumn("_block", F.floor((F.col(order_by).cast("double") - F.col("_lo")) / F.col("_w"))).select(*keys, "_src", "_stated", "at", "ord", "rare", "_block")
    by = [*others, "_src", "_block"]
    by_schema = ", ".join(f"`{k}` {kinds[k]}" for k in others) + (", " if others else "") + "_src string, _block bigint"

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order_by, kind="stable")
        at, od, ra = p["at"].tolist(), p["ord"].tolist(), p["rare"].tolist()
        m = border_costs(at, od, ra, int(p["_stated"].iloc[0]))
        out = p[by].iloc[:1].copy()
        for name, v in (("t0", at[0]), ("o0", od[0]), ("t1", at[-1]), ("o1", od[-1]), ("m", [x for r in m for x in r])):
            out[name] = [list(v)]
        return out

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_block", kind="stable")
        blocks = [(t0, o0, t1, o1, np.asarray(m).reshape(len(t0), len(t1))) for t0, o0, t1, o1, m in zip(p["t0"], p["o0"], p["t1"], p["o1"], p["m"], strict=True)]
        out = p[by].copy()
        out["first"], out["last"] = zip(*border_path(blocks), strict=True)
        return out

    def decode(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order_by, kind="stable")
        out = p[keys].copy()
        at, od, ra = p["at"].tolist(), p["ord"].tolist(), p["rare"].tolist()
        for place, k in ((0, p["first"].iloc[0]), (-1, p["last"].iloc[0])):  # the ends are settled; a block of one record has one end
            if len(at[place]) > 1:
                at[place], od[place], ra[place] = [at[place][k]], [od[place][k]], [ra[place][k]]
        many = np.array([len(x) for x in at]) > 1
        utc = np.fromiter((a[0] for a in at), dtype=np.int64, count=len(p))
        if many.any():  # a path forks only between records with one reading; those runs are decoded with one record on either side
            near = many | np.roll(many, 1) & (np.arange(len(p)) > 0) | np.roll(many, -1) & (np.arange(len(p)) < len(p) - 1)
            i = np.flatnonzero(near)
            for run in np.split(i, np.flatnonzero(np.diff(i) > 1) + 1):
                utc[run] = viterbi([at[x] for x in run], [od[x] for x in run], [ra[x] for x in run], int(p["_stated"].iloc[0]))
        out["utc_us"] = utc
        return out

    found = read_rows.groupBy(*by).applyInPandas(ends, by_schema + ", t0 array<bigint>, o0 array<int>, t1 array<bigint>, o1 array<int>, m array<double>")
    chosen = found.groupBy(*others, "_src").applyInPandas(chain, by_schema + ", first int, last int")
    chosen = chosen.withColumnsRenamed({k: f"_c{i}" for i, k in enumerate(by)})
    met = read_rows["_block"] == chosen[f"_c{len(by) - 1}"]
    for i, k in enumerate(by[:-1]):
        met = met & read_rows[k].eqNullSafe(chosen[f"_c{i}"])
    settled = read_rows.join(chosen, met).select(*keys, "_src", "_stated", "at", "ord", "rare", "_block", "first", "last")
    return settled.groupBy(*by).applyInPandas(decode, f"{base}, utc_us bigint")
