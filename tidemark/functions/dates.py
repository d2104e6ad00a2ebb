"""Calendar expressions; business days are Monday to Friday."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import c


def roll_forward(d: Column | str) -> Column:
    """A weekend day moved to Monday."""
    return F.date_add(c(d), F.greatest(F.lit(0), F.when(F.weekday(c(d)) >= 5, 7 - F.weekday(c(d))).otherwise(0)).cast("int"))


def add_business_days(d: Column | str, n: int) -> Column:
    """The n-th business day after ``d``; n = 0 rolls a weekend forward."""
    if n == 0:
        return roll_forward(d)
    wd = F.weekday(c(d))
    back, day = F.greatest(wd - 4, F.lit(0)), F.least(wd, F.lit(4))
    return F.date_add(F.date_sub(c(d), back), (F.lit(n) + 2 * F.floor((day + n) / 5)).cast("int"))


def business_days_between(a: Column | str, b: Column | str) -> Column:
    """Business days in [a, b), 0 where a is not before b."""
    days = F.datediff(c(b), c(a))
    full, rest = F.floor(days / 7), days % 7
    wd = F.weekday(c(a))
    tail = F.greatest(F.lit(0), F.least(wd + rest, F.lit(5)) - F.least(wd, F.lit(5))) + F.greatest(F.lit(0), wd + rest - 7)
    return F.when(days <= 0, 0).otherwise(full * 5 + tail).cast("int")


def release_day(month: Column | str, lag_days: int) -> Column:
    """The last day of the month, plus a lag, on a business day."""
    return roll_forward(F.date_add(F.last_day(c(month)), lag_days))


def calendar_features(d: Column | str) -> dict[str, Column]:
    """Cyclic day of week and month, and month- and quarter-end flags."""
    turn = lambda x, n: 2 * math.pi * x / n
    wd, mo = F.weekday(c(d)), F.month(c(d)) - 1
    end = c(d) == F.last_day(c(d))
    return {
        "known_dow_sin": F.sin(turn(wd, 7)), "known_dow_cos": F.cos(turn(wd, 7)), "known_month_sin": F.sin(turn(mo, 12)), "known_month_cos": F.cos(turn(mo, 12)),
        "known_month_end": end.cast("double"), "known_quarter_end": (end & (F.month(c(d)) % 3 == 0)).cast("double"),
    }


def cjk_date(x: Column | str) -> Column:
    """The first full year-month-day in a text, in Chinese or with separators."""
    p = r"(\d{4})[年./-](\d{1,2})[月./-](\d{1,2})"
    g = lambda i: F.regexp_extract(c(x), p, i)
    return F.when(g(1) != "", F.try_to_date(F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0")), "yyyy-MM-dd"))


def cjk_month(x: Column | str) -> Column:
    """First day of the first 'year月month' in a text."""
    p = r"(\d{4})年(\d{1,2})月"
    g = lambda i: F.regexp_extract(c(x), p, i)
    return F.when(g(1) != "", F.try_to_date(F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lit("01")), "yyyy-MM-dd"))


def cjk_quarter_end(x: Column | str) -> Column:
    """Last day of the first 'year ... quarter n' in a text."""
    p = r"(\d{4})年.{0,4}?第?([一二三四1234])季度"
    q = F.translate(F.regexp_extract(c(x), p, 2), "一二三四", "1234")
    y = F.regexp_extract(c(x), p, 1)
    return F.when(y != "", F.last_day(F.make_date(y.cast("int"), q.cast("int") * 3, F.lit(1))))


def month_day(x: Column | str, as_of: Column | str) -> Column:
    """'month月day日' in the year of ``as_of``, or the year before where that would lie ahead."""
    p = r"(\d{1,2})月(\d{1,2})日"
    g = lambda i: F.lpad(F.regexp_extract(c(x), p, i), 2, "0")
    at = lambda y: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), g(1), g(2)), "yyyy-MM-dd")
    y = F.year(c(as_of))
    return F.when(F.regexp_extract(c(x), p, 1) != "", F.when(at(y) > c(as_of), at(y - 1)).otherwise(at(y)))


def epoch(x: Column | str) -> Column:
    """A UTC timestamp from a count of seconds or milliseconds, told apart by size."""
    n = c(x).try_cast("bigint")
    return F.when(n < 100_000_000_000, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n))
