import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import capping as C

SCHEMA = "id long, who string, q double, _by string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(r["id"] for r in C.over_cap(df, "id", "who", "q", **kw).collect())


def test_best_are_kept(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None]), r.choice([None, float("nan"), 0.1, 0.5, 0.5, 0.9, -1.0])) for i in range(500)]
    by = defaultdict(list)
    for i, w, q in rows:
        by[w].append((0 if q is not None and q == q else 1, -(q if q is not None and q == q else 0), i))
    want = sorted(x[2] for v in by.values() for x in sorted(v)[500 // 25 :])
    assert run(spark, rows, share=25, randomness=0) == want
    assert run(spark, [], share=25, randomness=0) == [] and run(spark, [(1, "a", 0.5)], share=25, randomness=0) == [1]


def test_sample_keeps_the_largest_keys_and_prefers_quality(spark):
    rows = [(i, "a", 1.0 if i % 2 else 0.1) for i in range(4000)]
    gone = set(run(spark, rows, cap=400))
    keys = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).select("id", C.sampling_key("id", "q", 1.0, 7).alias("k")).orderBy(F.desc("k")).limit(400)
    kept = {r["id"] for r in keys.collect()}
    assert gone == {i for i, *_ in rows} - kept
    assert sum(i % 2 for i in kept) > 300


def test_contributor_names(spark):
    df = spark.createDataFrame([(" 　Foo BAR\xa0", "s"), ("", "s"), (None, "s"), ("\t", None), ("s", "x")], "p string, s string")
    assert [r[0] for r in df.select(C.contributor("p", "s")).collect()] == ["p:foo bar", "s:s", "s:s", "s:", "p:s"]


def test_inclusion_follows_the_scores(spark):
    """Kept shares over many contributors against the exact probabilities of drawing without replacement by weight."""
    weights, cap, n = [1.0, 2.0, 3.0, 4.0, 8.0], 2, 20_000
    exact = [0.0] * len(weights)
    total = sum(weights)
    for i, a in enumerate(weights):  # the first drawn, then the second of the rest
        exact[i] += a / total
        for j, b in enumerate(weights):
            if i != j:
                exact[j] += a / total * b / (total - a)
    rows = spark.range(n * len(weights)).select("id", (F.col("id") % n).cast("string").alias("who"), F.get(F.array(*map(F.lit, weights)), (F.col("id") / n).cast("int")).alias("q"))
    dropped = C.over_cap(rows, "id", "who", "q", cap=cap, randomness=1.0, seed=5)
    kept = {x["q"]: x["n"] for x in rows.join(dropped, "id", "left_anti").groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert sum(kept.values()) == cap * n
    assert all(abs(kept[w] / n - p) < 0.015 for w, p in zip(weights, exact, strict=True))
