import datetime as dt

import numpy as np
import pytest

from tidemark.operators import timestamps as T


def us(*a):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "tz", "want"),
    [
        ("2019-03-31 02:10:22,000", "Europe/Berlin", us(2019, 3, 31, 1, 10, 22)),  # skipped: the offset before
        ("2019-10-27 02:30", "Europe/Berlin", us(2019, 10, 27, 0, 30)),  # twice: the earlier
        ("2023年12月8日 上午12:50", "Asia/Shanghai", us(2023, 12, 7, 16, 50)),
        ("2023年12月8日 下午12:05", "Asia/Shanghai", us(2023, 12, 8, 4, 5)),
        ("Feb 3, 2019 10:03 PM", "America/New_York", us(2019, 2, 4, 3, 3)),
        ("22. März 2019, 11:13 Uhr", "Europe/Berlin", us(2019, 3, 22, 10, 13)),
        ("Tue, 12 Feb 2019 21:05:14 -0500", "Asia/Tokyo", us(2019, 2, 13, 2, 5, 14)),
        ("20190208T161256Z", "Asia/Tokyo", us(2019, 2, 8, 16, 12, 56)),
        ("2019-02-15 18:50:34 CET", "UTC", us(2019, 2, 15, 17, 50, 34)),
        ("２０１９-02-15", "UTC", us(2019, 2, 15)),
        ("1549736406", "Asia/Tokyo", 1549736406_000000),
        ("1549736406484", "Asia/Tokyo", 1549736406_484000),
        ("1549736406484123", "Asia/Tokyo", 1549736406_484123),
        ("20190214", "Asia/Tokyo", us(2019, 2, 13, 15)),
        ("20190204102634", "UTC", us(2019, 2, 4, 10, 26, 34)),
        ("10 January 2019", "UTC", us(2019, 1, 10)),
    ],
)
def test_one_reading(text, tz, want):
    assert [x[0] for x in T.interpretations(text, tz)] == [want]


@pytest.mark.parametrize("text", [None, "", " ", "-", "n/a", "13:45", "昨天 10:30", "2023-02-30 10:15", "2024-13-05T08:00:00", "31/11/2023 09:00", "0000-00-00", "2019-01-01 25:00", "x" * 100_000])
def test_no_reading(text):
    assert T.interpretations(text, "UTC", 2) == []


def test_order_decides_and_viterbi_without_one(spark):
    sources = spark.createDataFrame([("us", "UTC", "mdy"), ("eu", "UTC", "dmy"), ("us", "UTC", "mdy")], "source string, tz string, date_order string")
    data = [(1, "us", "02/05/2019"), (2, "eu", "02/05/2019"), (3, "us", "26/01/2019"), (4, "who", "03/04/2019"), (5, "who", "25/04/2019"), (6, "who", "05/05/2019"), (7, None, "2019-01-01"), (8, "us", None), (1, "us", "02/05/2019")]
    df = spark.createDataFrame(data, "id long, source string, date string").withColumn("utc_us_x", __import__("pyspark").sql.functions.lit(1))
    got = sorted((r["id"], r["utc_us"]) for r in T.normalise(df, sources, ["id"], "id", "date").collect())
    assert got == [(1, us(2019, 2, 5)), (1, us(2019, 2, 5)), (2, us(2019, 5, 2)), (3, us(2019, 1, 26)), (4, us(2019, 4, 3)), (5, us(2019, 4, 25)), (6, us(2019, 5, 5)), (7, us(2019, 1, 1))]
    assert T.normalise(df.limit(0), sources, ["id"], "id", "date").count() == 0


def test_viterbi_is_the_cheapest_path():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 6
        at = [rng.integers(0, 50, k) for k in rng.integers(1, 4, n)]
        od = [rng.integers(-1, 3, len(a)) for a in at]
        ra = [rng.integers(0, 2, len(a)) for a in at]

        def cost(path, at=at, od=od, ra=ra):
            c = 0.0
            for i, k in enumerate(path):
                c += (T.AGAINST_ORDER if od[i][k] >= 0 and od[i][k] != 1 else 0) + (T.UNLIKELY if ra[i][k] else 0)
                if i:
                    j = path[i - 1]
                    c += (T.SWITCH if od[i][k] >= 0 and od[i - 1][j] >= 0 and od[i][k] != od[i - 1][j] else 0) + (T.BACKWARD if at[i][k] < at[i - 1][j] else 0)
            return c

        best = min(cost(p) for p in itertools.product(*(range(len(a)) for a in at)))
        got = T.viterbi(at, od, ra, 1)
        assert min(cost(p) for p in itertools.product(*(range(len(a)) for a in at)) if all(at[i][k] == got[i] for i, k in enumerate(p))) == pytest.approx(best)


def test_path_does_not_depend_on_blocks(spark):
    """Records without a stated order, most of them ambiguous: blocks of any size give the path of one block, with ids in a row and ids far apart."""
    import random

    r = random.Random(6)
    day, rows = dt.date(2021, 1, 1), []
    for i in range(160):
        day += dt.timedelta(days=r.choice([0, 1, 1, 2, 5]))
        v = f"{day.day:02d}/{day.month:02d}/{day.year}" if i % 80 < 50 else f"{day.month:02d}/{day.day:02d}/{day.year}"
        if day.day > 12 and r.random() < 0.8:  # keep runs of ambiguous days long
            day = day.replace(day=r.randint(1, 12))
            v = f"{day.day:02d}/{day.month:02d}/{day.year}"
        rows.append((i, v))
    sources = spark.createDataFrame([("s", "UTC", None)], "source string, tz string, date_order string")

    def run(ids, block):
        df = spark.createDataFrame([(ids(i), v, "s") for i, v in rows] + [(ids(i), v, None) for i, v in rows[:30]], "id long, date string, source string")
        got = T.normalise(df, sources, ["id", "source"], "id", "date", block=block).collect()
        return {(x["id"], x["source"]): x["utc_us"] for x in got}

    whole = run(lambda i: i, 10**9)
    assert len(whole) == 190
    for block in (1, 3, 16):
        assert run(lambda i: i, block) == whole
    far = run(lambda i: i * 10**12 + i % 7, 16)
    assert {(k[0] // 10**12, k[1]): v for k, v in far.items()} == whole
