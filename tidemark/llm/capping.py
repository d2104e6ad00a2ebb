"""Caps for contributors that bring most of the records.

Quality-weighted reservoir sampling without replacement: every record draws an
exponential key scaled by its score, ``-E / weight``, and each contributor keeps
its cap-size largest keys.  ``randomness`` scales the draw: 1 samples, and at 0,
the limit, the keys follow the score alone and ties the id, which gives the fixed
selection of the best.

No contributor is ever sorted in one task.  Only contributors above the cap are
ordered at all, fewer than ``share`` of them; their records are range-partitioned
by (contributor, key, id), counts per partition say where each cap falls, and just
the partition it falls into is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.lineage import cut

# White space as str.strip() takes it.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def contributor(publisher: str, source: str) -> Column:
    """The publisher, trimmed and in lower case; the source, kept apart, where there is none."""
    name = F.lower(F.regexp_replace(publisher, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("p:"), name)).otherwise(F.concat(F.lit("s:"), F.coalesce(F.col(source), F.lit(""))))


def sampling_key(row_id: str, score: str, randomness: float, seed: int) -> Column:
    """Larger keys are kept. Null and NaN scores come last; a score at or below 0 has hardly any weight."""
    q = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    if not randomness:
        return q
    u = (F.xxhash64(F.col(row_id), F.lit(seed)).bitwiseAND(F.lit(2**52 - 1)) + F.lit(1)) / F.lit(2.0**52 + 1)
    return F.log(u) * randomness / F.greatest(q, F.lit(1e-9))


def over_cap(rows: DataFrame, row_id: str, by: str, score: str, share: int | None = None, cap: int | None = None, randomness: float = 1.0, seed: int = 7) -> DataFrame:
    """(``row_id``, ``by``) of the records to drop.

    A contributor keeps ``cap`` records or, with ``share``, floor(records / share).
    A null contributor is one of its own; equal records with different ids each
    count; an empty table drops nothing.
    """
    base = rows.select(F.col(row_id).alias("_id"), F.coalesce(F.col(by), F.lit("\0")).alias("_by"), sampling_key(row_id, score, randomness, seed).alias("_key"))
    sizes = cut(base.groupBy("_by").agg(F.count("*").alias("n")))
    if cap is None:
        cap = (sizes.agg(F.sum("n")).first()[0] or 0) // share
    large = sizes.where(F.col("n") > cap).select("_by")
    if share:  # each has more than a share-th of all records, so there are fewer than `share`
        large = F.broadcast(large)
    order = ["_by", F.col("_key").desc_nulls_last(), "_id"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(base.join(large, "_by").repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_by", "_part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(W.partitionBy("_by").orderBy("_part")) - F.col("n"))
    parts = cut(parts.where(F.col("before") + F.col("n") > cap))  # at most one row per contributor and partition
    beyond = ranged.join(parts, ["_by", "_part"])
    rank = F.row_number().over(W.partitionBy("_by", "_part").orderBy(F.col("_key").desc_nulls_last(), "_id"))
    edge = beyond.where(F.col("before") < cap).withColumn("_rank", rank).where(F.col("before") + F.col("_rank") > cap)
    out = beyond.where(F.col("before") >= cap).select("_id", "_by").unionByName(edge.select("_id", "_by"))
    return out.select(F.col("_id").alias(row_id), F.when(F.col("_by") != "\0", F.col("_by")).alias(by))
