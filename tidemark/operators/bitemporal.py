"""Attributes as known at event time, by bitemporal rectangles.

Every version of a fact has a valid time (the period it speaks of) and a
recorded time (when it became known).  For one entity the plane valid x recorded
is split into disjoint rectangles; inside a rectangle exactly one version is
current: the latest period at or before the valid time that was known by then,
in its latest known version.  Rectangles are indexed by a grid of cells, and an
event is located by an equi-join on (entity, cell) and a containment test, so
neither side is ever sorted or collected per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Days a grid cell spans on either axis. A report period is about this long.
CELL_DAYS = 64
FOREVER = 2**31 - 1


def known_from(period: Column, disclosed: Column, lag_days: int = 45) -> Column:
    """The day a figure became known: its disclosure day, or ``period`` + ``lag_days``
    where that is null or impossible (before the end of the period)."""
    return F.when(disclosed >= period, disclosed).otherwise(F.date_add(period, lag_days))


def rectangles(versions: DataFrame, entity: str, version_id: str, period: str, known: str) -> DataFrame:
    """Disjoint current-version rectangles: (_e, _id, v_lo, v_hi, r_lo, r_hi), half-open, in days.

    Versions without entity, period or known day are never current.  Repeated
    rows and ties (same entity, period and known day) fall to the smallest id.
    The array of first-known days per entity is bounded by the number of
    distinct period days of the calendar, whatever the number of rows.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    v = (
        versions.select(F.col(entity).alias("_e"), day(period).alias("p"), day(known).alias("k"), F.col(version_id).alias("_id"))
        .where("_e is not null and p is not null and k is not null and _id is not null")
        .groupBy("_e", "p", "k")
        .agg(F.min("_id").alias("_id"))
        .withColumn("k_end", F.lead("k", 1, FOREVER).over(W.partitionBy("_e", "p").orderBy("k")))
    )
    firsts = v.groupBy("_e", "p").agg(F.min("k").alias("k")).groupBy("_e").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("firsts"))
    # As recorded time passes, the valid interval that opens at p is cut ever shorter by later
    # periods that become known: (r, hi) says that from day r on it ends at hi.
    steps = F.aggregate(
        F.filter("firsts", lambda x: x["p"] > F.col("p")),
        F.array(F.struct(F.lit(-FOREVER).alias("r"), F.lit(FOREVER).alias("hi"))),
        lambda acc, x: F.when(x["p"] < F.element_at(acc, -1)["hi"], F.concat(acc, F.array(F.struct(x["k"].alias("r"), x["p"].alias("hi"))))).otherwise(acc),
    )
    spans = F.transform(
        F.col("steps"),
        lambda s, i: F.struct(
            F.greatest(F.col("k"), s["r"]).alias("r_lo"),
            F.least(F.col("k_end"), F.coalesce(F.get(F.col("steps"), i + 1)["r"], F.lit(FOREVER))).alias("r_hi"),
            s["hi"].alias("v_hi"),
        ),
    )
    return (
        v.join(firsts, "_e")
        .select("_e", "_id", "p", "k", "k_end", steps.alias("steps"))
        .select("_e", "_id", F.col("p").alias("v_lo"), F.explode(F.filter(spans, lambda x: x["r_lo"] < x["r_hi"])).alias("x"))
        .select("_e", "_id", "v_lo", "x.v_hi", "x.r_lo", "x.r_hi")
        .where("v_lo < v_hi")
    )


def locate(
    events: DataFrame, rects: DataFrame, entity: str, valid_day: str, recorded_day: str | None = None, cell_days: int = CELL_DAYS, cells: DataFrame | None = None
) -> DataFrame:
    """Each event with ``_id`` of the version current at its point; events in no rectangle are left out.

    ``recorded_day=None`` means the event asks with the knowledge of its own day;
    then all points lie on the diagonal and only cells on it are indexed.  Grid
    cells outside the span of the events are not produced.
    """
    e = events.withColumn("_v", F.unix_date(F.col(valid_day).cast("date"))).withColumn("_r", F.unix_date(F.col(recorded_day or valid_day).cast("date")))
    e = e.where(F.col(entity).isNotNull() & F.col("_v").isNotNull() & F.col("_r").isNotNull())
    cell = lambda c: F.floor(F.col(c) / cell_days).cast("int")
    span = e.agg(*(f(cell(c)).alias(n) for f, c, n in ((F.min, "_v", "v0"), (F.max, "_v", "v1"), (F.min, "_r", "r0"), (F.max, "_r", "r1")))).first()
    if span["v0"] is None:
        span = {"v0": 0, "v1": 0, "r0": 0, "r1": 0}
    low = lambda c, least: F.greatest(cell(c), F.lit(least))
    high = lambda c, most: F.least(F.floor((F.col(c) - 1) / cell_days).cast("int"), F.lit(most))
    if recorded_day is None:
        lo, hi = F.greatest(low("v_lo", span["v0"]), low("r_lo", span["r0"])), F.least(high("v_hi", span["v1"]), high("r_hi", span["r1"]))
        grid = rects.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_cv", F.explode(F.sequence("_lo", "_hi"))).withColumn("_cr", F.col("_cv"))
    else:
        grid = (
            rects.withColumn("_a", low("v_lo", span["v0"])).withColumn("_b", high("v_hi", span["v1"]))
            .withColumn("_c", low("r_lo", span["r0"])).withColumn("_d", high("r_hi", span["r1"])).where("_a <= _b and _c <= _d")
            .withColumn("_cv", F.explode(F.sequence("_a", "_b"))).withColumn("_cr", F.explode(F.sequence("_c", "_d")))
        )
    grid = grid.select("_e", "_id", "v_lo", "v_hi", "r_lo", "r_hi", "_cv", "_cr")
    e = e.withColumn("_cv", cell("_v")).withColumn("_cr", cell("_r"))
    hit = (e[entity] == grid["_e"]) & (e["_cv"] == grid["_cv"]) & (e["_cr"] == grid["_cr"]) & (e["_v"] >= grid["v_lo"]) & (e["_v"] < grid["v_hi"]) & (e["_r"] >= grid["r_lo"]) & (e["_r"] < grid["r_hi"])
    return e.join(grid, hit).select(*(e[c] for c in events.columns), grid["_id"])


def as_known(events: DataFrame, versions: DataFrame, entity: str, event_day: str, version_id: str, period: str, disclosed: str, lag_days: int = 45) -> DataFrame:
    """``events`` with ``_id`` of the version of the same entity that was known on the event's day.

    Defined for odd input: null entity or day on either side never matches; equal
    rows of ``events`` each count; of equal versions the smallest id holds; an
    empty table on either side gives no row; only the named columns are read, so
    other columns of the same name on both sides do no harm.
    """
    v = versions.select(version_id, entity, period, known_from(F.col(period), F.col(disclosed), lag_days).alias("_known"))
    return locate(events, rectangles(v, entity, version_id, period, "_known"), entity, event_day)
