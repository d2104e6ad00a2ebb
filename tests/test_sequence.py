import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.operators import asof, dedup, denoise
from tidemark.operators import sequence as S


def col(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_percent_rank_with_ties(spark):
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate([1, 2, 2, 5, 9, 9, 10])], "i int, k string, v int")
    assert col(df.withColumn("p", F.round(S.percent_rank("v", ["k"]), 6)), "p", "i") == [0.142857, 0.357143, 0.357143, 0.571429, 0.785714, 0.785714, 1.0]


def test_position_fold(spark):
    want, move = [0.5, 0.5, 0.1, 0.65, 0, 0.3], [0.01, 0.2, -0.2, 0, 0.05, 0]
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(want, move, strict=True))], "k string, i int, d double, m double")
    got = col(S.positions(df, ["k"], "i", "d", "m", 0.65, 0.2, 0.198), "position", "i")
    assert got == pytest.approx([0.2, 0.2, 0.2, 0.4, 0.2, 0.3])


def test_asof(spark):
    left = spark.createDataFrame([("k", 1), ("k", 3), ("k", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 0, "a"), ("k", 2, "b"), ("k", 5, "c"), ("k", None, "d")], "k string, t int, v string")
    assert col(asof.asof_join(left, right, "t", ["k"], ["v"]), "v", "t") == ["a", "b", "c"]


def test_drawdown(spark):
    df = spark.createDataFrame([("k", i, r) for i, r in enumerate([0.01, -0.02, 0.03, -0.05, 0.01])], "k string, i int, r double")
    assert min(col(S.drawdown(df, ["k"], "i", "r"), "drawdown", "i")) == pytest.approx(-0.05)


def test_business_days(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(30)]
    df = spark.createDataFrame(days, "d date")
    got = df.select("d", *(D.add_business_days("d", n).alias(f"n{n}") for n in (0, 1, 2, 5, 7)), D.business_days_between("d", F.lit("2024-01-20").cast("date")).alias("b")).collect()
    for r in got:
        d = np.datetime64(r["d"])
        for n in (1, 2, 5, 7):
            assert np.datetime64(r[f"n{n}"]) == np.busday_offset(d, n, roll="backward")
        assert np.datetime64(r["n0"]) == np.busday_offset(d, 0, roll="forward")
        assert r["b"] == max(0, np.busday_count(d, np.datetime64("2024-01-20")))


def test_ewm_and_lookback_do_not_see_the_future(spark):
    x = np.random.default_rng(1).normal(size=40).cumsum()
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    a = 1 - 0.5 ** (1 / 5)
    want = [x[0]]
    for v in x[1:]:
        want.append(a * v + (1 - a) * want[-1])
    full = col(S.ewm(df, ["k"], "i", "x", 5, "m"), "m", "i")
    assert full == pytest.approx(want)
    assert col(S.ewm(df.where("i < 20"), ["k"], "i", "x", 5, "m"), "m", "i") == pytest.approx(full[:20])
    den = col(denoise.causal_denoise(df, ["k"], "i", "x", 32, 5, 16), "x_denoised", "i")
    assert col(denoise.causal_denoise(df.where("i < 31"), ["k"], "i", "x", 32, 5, 16), "x_denoised", "i") == pytest.approx(den[:31])


def test_wavelet_round_trip():
    x = np.random.default_rng(2).normal(size=64)
    g = denoise.DB4[::-1] * (-1) ** np.arange(8)
    assert denoise._back(denoise._step(x, denoise.DB4), denoise._step(x, g), denoise.DB4, g) == pytest.approx(x)


def test_greedy_chain_keeps_first_and_last(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, "same title", d, 30), (2, "same title", d + dt.timedelta(5), 20), (3, "same title", d + dt.timedelta(10), 10), (4, "short", d, 1), (5, None, d, 1), (6, "same title", None, 1)]
    df = spark.createDataFrame(rows, "id long, fp string, day date, q int")
    assert sorted(r["id"] for r in dedup.greedy_near_duplicates(df, "id", "fp", "day", [("q", True)], 7).collect()) == [1, 3, 4, 5, 6]


def test_similar_pairs_against_brute_force(spark):
    import random

    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(60):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            s[r.randrange(40)] = r.choice("abcdefgh")
        t = "".join(s)
        rows.append((i, sorted({t[k : k + 3] for k in range(38)}), dt.date(2024, 1, 1) + dt.timedelta(r.randint(0, 40))))
    df = spark.createDataFrame(rows, "id long, s array<string>, day date")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs((a[2] - b[2]).days) <= 14 and len(set(a[1]) & set(b[1])) >= 0.7 * len(set(a[1]) | set(b[1]))}
    got = {(x["a"], x["b"]) for x in dedup.similar_pairs(df, "id", "s", "day", 14, 0.7).collect()}
    assert got == want


def test_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", float(i * 7 % 11)) for i in range(50)], "i int, k string, v double")
    f = lambda x: sorted((r["i"], r["p"]) for r in x.withColumn("p", S.percent_rank("v", ["k"])).collect())
    assert f(df.repartition(1)) == f(df.repartition(8))


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    r = df.select(N.entropy(N.softmax("x")).alias("h"), N.arg_top("x", 2).alias("t"), N.fit_length("x", 5, F.lit(0.0)).alias("f"), N.fit_length("x", 2, F.lit(0.0)).alias("g"), N.unpack(N.pack("x")).alias("u")).first()
    assert [t["index"] for t in r["t"]] == [2, 1] and r["f"] == [0, 0, 1, 2, 3] and r["g"] == [2, 3] and r["u"] == [1, 2, 3] and 0.8 < r["h"] < 0.9
