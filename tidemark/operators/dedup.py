"""Deterministic and greedy de-duplication, and per-group limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import word_shingles
from tidemark.lineage import cut


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the order given; the order must end in a unique column."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_least(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The row with the least ``tie`` of each key, by partial aggregation and without a sort."""
    rest = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), tie).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def keep_first_where_key(df: DataFrame, key: Column, row_id: str, order: list) -> DataFrame:
    """Keep-first by ``key`` where it is not empty; rows with an empty key all stay."""
    return keep_first(df.withColumn("_key", F.when(key != "", key).otherwise(F.concat(F.lit("\0"), F.col(row_id).cast("string")))), ["_key"], order).drop("_key")


def top_per_group(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group; k <= 0 means all. Spark limits each task's groups before the shuffle."""
    if k <= 0:
        return df
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def greedy_near_duplicates(df: DataFrame, row_id: str, fingerprint: str, day: str, rank: list[tuple[str, bool]], window_days: int, least: int = 8) -> DataFrame:
    """Ids of the rows kept when, best rank first, a row is dropped if a kept row of its fingerprint lies within the window.

    ``rank`` lists (column, descending). Rows whose fingerprint is shorter than
    ``least`` all stay. Of the rows of one fingerprint and day only the best ranked can
    be kept, as all lie equally far from any other; the fold of a fingerprint thus
    never holds more entries than the calendar has days.
    """
    short = (F.length(fingerprint) < least) | F.col(fingerprint).isNull() | F.col(day).isNull()
    stay = df.where(short).select(row_id)
    keys = [(-F.unix_date(x) if dict(df.dtypes)[x] == "date" else -F.col(x)) if desc else F.col(x) for x, desc in rank]
    entry = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col(row_id).alias("id"), F.unix_date(day).alias("d"))
    best = df.where(~short).groupBy(fingerprint, day).agg(F.min(entry).alias("_e"))
    groups = best.groupBy(fingerprint).agg(F.sort_array(F.collect_list("_e")).alias("_s"))
    kind = dict(df.dtypes)[row_id]
    fold = F.aggregate(
        "_s",
        F.array().cast(f"array<struct<id:{kind},d:int>>"),
        lambda kept, x: F.when(F.exists(kept, lambda y: F.abs(y["d"] - x["d"]) <= window_days), kept).otherwise(F.concat(kept, F.array(F.struct(x["id"].alias("id"), x["d"].alias("d"))))),
    )
    return stay.unionByName(groups.select(F.explode(fold).alias("e")).select(F.col("e.id").alias(row_id)))


def similar_pairs(df: DataFrame, row_id: str, shingles: str, day: str, window_days: int, threshold: float) -> DataFrame:
    """(a, b) with a < b: rows within the window whose shingle sets have at least the Jaccard similarity.

    Prefix filter: with shingles in order of rarity, two sets this similar share one
    among their first |x| - ceil(t |x|) + 1. Frequent shingles are thus hardly ever
    joined on. Rows with equal sets are joined by one representative per (set, day).
    """
    sets = cut(df.select(F.col(row_id).alias("id"), F.col(shingles).alias("s"), F.unix_date(day).alias("d")).where((F.size("s") >= 8) & F.col("d").isNotNull()))
    rarity = sets.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    ranked = sets.select("id", "d", F.explode("s").alias("g")).join(rarity, "g").groupBy("id", "d").agg(F.sort_array(F.collect_list(F.struct("n", (F.col("g") if dict(sets.dtypes)["s"] == "array<bigint>" else F.xxhash64("g")).alias("h")))).alias("x"))
    ranked = cut(ranked.select("id", "d", F.transform("x", lambda v: v["h"]).alias("h")))
    size = F.size("h")
    prefix = ranked.select("id", "d", size.alias("n"), F.explode(F.slice("h", F.lit(1), size - F.ceil(size * threshold).cast("int") + 1)).alias("g"), (F.floor(F.col("d") / (window_days + 1))).alias("b"))
    a = prefix.select(F.col("id").alias("a"), F.col("d").alias("da"), F.col("n").alias("na"), "g", "b")
    b = prefix.select(F.col("id").alias("b_"), F.col("d").alias("db"), F.col("n").alias("nb"), "g", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    near = (F.abs(F.col("da") - F.col("db")) <= window_days) & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    cand = a.join(b, ["g", "b"]).where((F.col("a") < F.col("b_")) & near).select("a", "b_").distinct()
    x, y = ranked.select(F.col("id").alias("a"), F.col("h").alias("ha")), ranked.select(F.col("id").alias("b_"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    sim = both / (F.size("ha") + F.size("hb") - both)
    return cand.join(x, "a").join(y, "b_").withColumn("similarity", sim).where(F.col("similarity") >= threshold).select("a", F.col("b_").alias("b"), "similarity")


def greedy_similar(df: DataFrame, row_id: str, shingles: str, day: str, rank: list[tuple[str, bool]], window_days: int, threshold: float) -> DataFrame:
    """Ids of the rows kept when, best rank first, a row is dropped if one that is kept is similar to it and within the window.

    ``rank`` lists (column, descending); ties fall to the smaller id. Rows of fewer than
    eight shingles or without a day all stay. The pairs are settled in rounds: a row that
    has no better one left to wait for is kept, and those like it are dropped; each round
    settles the heads of all chains at once, so there are as many as the longest chain of
    ever worse similar rows has links, and each is cut.
    """
    kinds = dict(df.dtypes)
    key = F.struct(*((-F.unix_date(x) if kinds[x] == "date" else -F.col(x) if desc else F.col(x)).alias(f"k{i}") for i, (x, desc) in enumerate(rank)), F.col(row_id).alias("id"))
    of = df.select(F.col(row_id).alias("_i"), key.alias("_k"))
    pairs = similar_pairs(df, row_id, shingles, day, window_days, threshold).select("a", "b")
    pairs = pairs.join(of.withColumnsRenamed({"_i": "a", "_k": "ka"}), "a").join(of.withColumnsRenamed({"_i": "b", "_k": "kb"}), "b")
    first = F.col("ka") < F.col("kb")
    edges = cut(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")))
    gone = None
    while not edges.isEmpty():
        heads = edges.select("better").distinct().join(edges.select(F.col("worse").alias("better")), "better", "left_anti")
        now = cut(edges.join(heads, "better", "left_semi").select("worse").distinct())
        gone = now if gone is None else gone.unionByName(now)
        left = edges.join(now, "worse", "left_anti").join(now.withColumnRenamed("worse", "better"), "better", "left_anti")
        edges = cut(left.select("better", "worse"))
    kept = df.select(row_id)
    return kept if gone is None else kept.join(gone.withColumnRenamed("worse", row_id), row_id, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest id reachable over ``edges`` (a, b), for every id that has one.

    Labels travel along edges and are shortened by following them to their own label,
    so a chain of n links takes about log n rounds; each round is cut.
    """
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("class")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "class"), "to").groupBy("id").agg(F.min("class").alias("_n"))
        step = labels.join(near, "id").select("id", F.least("class", "_n").alias("class"))
        hop = step.join(labels.select(F.col("id").alias("class"), F.col("class").alias("_h")), "class", "left")
        new = cut(hop.select("id", F.least("class", F.coalesce("_h", "class")).alias("class")))
        if new.join(labels.withColumnRenamed("class", "_o"), "id").where("class <> _o").isEmpty():
            return new
        labels = new


#: Stands for a missing day: farther from any other than a window reaches.
UNDATED = -100_000_000


def near_duplicates(df: DataFrame, row_id: str, text: str, day: str, window_days: int = 14, threshold: float = 0.8) -> DataFrame:
    """(``row_id``, class, links): near-duplicate classes of whole texts close in time.

    Texts are compared by their runs of five words. Equal texts of one day are one class
    from the start and are compared once; a row's links are the other texts its own
    is similar to within the window. Texts without a day are compared with each other
    alone. Rows without text, and texts of fewer than eight runs without an equal one
    of their day, are classes of their own; a class is named by its smallest id.
    """
    kind = dict(df.dtypes)[row_id]
    base = df.select(F.col(row_id).alias("id"), F.col(text).alias("t"), F.col(day).cast("date").alias("d"))
    base = cut(base.select("id", "d", F.when(F.col("t").isNotNull(), F.sha2("t", 256)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))).alias("h"), "t"))
    reps = base.groupBy("h", "d").agg(F.min("id").alias("rep"))
    some = base.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").where("t is not null")
    some = some.withColumn("d", F.coalesce("d", F.date_from_unix_date(F.lit(UNDATED))))
    pairs = cut(similar_pairs(some.withColumn("s", word_shingles("t")), "id", "s", "d", window_days, threshold))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = components(pairs).withColumnRenamed("id", "rep")
    own = base.select("id", "h", "d").join(reps.select("h", F.col("d").alias("_d"), "rep"), "h").where("d <=> _d")
    out = own.join(named, "rep", "left").join(links, "rep", "left")
    return out.select(F.col("id").alias(row_id), F.coalesce("class", "rep").cast(kind).alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
