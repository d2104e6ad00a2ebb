"""As-of alignment of slow facts to a calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tie: str | None = None, days: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` at or before its ``on``.

    One sort of the union of both sides, no pair is built. Rows of ``right`` with
    equal keys fall to the largest ``tie``. Null keys match nothing.
    With ``days`` a value older than that many days does not count.
    """
    kinds = dict(left.dtypes)
    l = left.select(*by, on, F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(on, *values).alias("v")).schema["v"].dataType).alias("_v"), F.lit(None).cast("string").alias("_tie"))
    r = right.where(F.col(on).isNotNull()).select(*by, F.col(on).cast(kinds[on]).alias(on), F.lit(0).alias("_left"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), F.struct(on, *values).alias("_v"), F.lpad(F.col(tie).cast("string"), 24, "0").alias("_tie") if tie else F.lit("").alias("_tie"))
    w = W.partitionBy(*by).orderBy(F.col(on).asc_nulls_first(), "_left", "_tie").rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(on).isNotNull(), F.last("_v", ignorenulls=True).over(w))
    if days is not None:
        known = F.when(F.datediff(F.col(on), known[on]) <= days, known)
    out = l.unionByName(r).withColumn("_known", known).where("_left = 1")
    return out.select("_row.*", *(F.col("_known")[v].alias(v) for v in values))
