import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import packing as P


def test_pieces_fit_and_are_whole(spark):
    r = random.Random(3)
    sizes = [r.choice([0, 1, 5, 64, 65, 100, 128, 129, 1000]) if r.random() < 0.3 else r.randint(1, 60) for _ in range(900)]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)] + [(None, 3, 1), (901, None, 1), (5, 10, 1)], "id long, n int, piece int")
    caps = spark.createDataFrame([(1, 64), (2, 1000), (3, None), (4, 0)], "c int, cap int")
    out = P.pack(df, "id", "n", caps, "c", "cap", shard=200)
    full = out.groupBy("c", "shard", "container").agg(F.sum("tokens").alias("t")).collect()
    assert all(x["t"] <= {1: 64, 2: 1000}[x["c"]] for x in full)
    per = {(x["c"], x["id"]): (x["t"], x["k"]) for x in out.groupBy("c", "id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k")).collect()}
    for c, cap in ((1, 64), (2, 1000)):
        for i, n in enumerate(sizes):
            if i != 5:
                assert per[c, i] == (n, max(1, -(-n // cap)))
        assert per[c, 5][0] == sizes[5] + 10
    assert P.pack(df.limit(0), "id", "n", caps, "c", "cap").count() == 0
    assert P.pack(df, "id", "n", caps.limit(0), "c", "cap").count() == 0


def test_sum_of_squares_rule():
    """Each place is the one with the smallest sum of squared counts, by trying them all."""
    r = random.Random(1)
    b, mine, cap = P.Bins(20), {}, 20
    for _ in range(300):
        size = r.randint(1, 20)
        counts = np.bincount([g for g in mine.values() if g], minlength=21)
        best = None
        for g in sorted({g for g in mine.values() if g >= size} | {cap}):
            c = counts.copy()
            if g != cap:
                c[g] -= 1
            if g - size:
                c[g - size] += 1
            s = int((c[1:] ** 2).sum())
            best = min(best, s) if best is not None else s
        at = b.place(size)
        mine[at] = mine.get(at, cap) - size
        counts = np.bincount([g for g in mine.values() if g], minlength=21)
        assert int((counts[1:] ** 2).sum()) == best and min(mine.values()) >= 0


def test_close_to_the_bound():
    sizes = np.random.default_rng(1).integers(1, 600, 5000)
    _, _, tokens, box = P.pack_shard(sizes, 1000)
    assert box.max() + 1 <= 1.01 * -(-tokens.sum() // 1000)
