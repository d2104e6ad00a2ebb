import datetime as dt
import random

from tidemark.operators import bitemporal as B

D0 = dt.date(2020, 1, 1)
E = "id long, who string, day date, extra string"
V = "fid long, who string, period date, told date, extra int"


def brute(events, facts):
    out = []
    for i, who, day, _ in events:
        best = None
        for f, w, p, told, _ in facts:
            if None in (w, p, day, who) or w != who:
                continue
            known = told if told is not None and told >= p else p + dt.timedelta(45)
            if known <= day:
                key = (p, known, -f)
                best = max(best, (key, f)) if best else (key, f)
        if best:
            out.append((i, best[1]))
    return sorted(out)


def run(spark, events, facts):
    df = B.as_known(spark.createDataFrame(events, E), spark.createDataFrame(facts, V), "who", "day", "fid", "period", "told")
    assert df.columns == ["id", "who", "day", "extra", "_id"]
    return sorted((r["id"], r["_id"]) for r in df.collect())


def test_random_histories(spark):
    r = random.Random(1)
    day = lambda a, b: D0 + dt.timedelta(r.randint(a, b))
    facts = [(i, r.choice("abc"), day(0, 40) if i % 2 else D0 + dt.timedelta(90 * r.randint(0, 9)), day(-50, 900) if r.random() < 0.8 else None, 1) for i in range(400)]
    events = [(i, r.choice("abcd"), day(-20, 1000), "x") for i in range(600)]
    assert run(spark, events, facts) == brute(events, facts)


def test_nulls_ties_repeats_and_clashing_names(spark):
    p = dt.date(2020, 3, 31)
    facts = [(2, "a", p, None, 1), (1, "a", p, None, 2), (3, "a", None, p, 1), (4, None, p, p, 1), (5, "a", p, dt.date(2019, 1, 1), 1)]
    events = [(1, "a", p, "x"), (2, "a", p + dt.timedelta(45), "x"), (2, "a", p + dt.timedelta(45), "x"), (3, None, p, "x"), (4, "a", None, "x")]
    assert run(spark, events, facts) == [(2, 1), (2, 1)]


def test_empty(spark):
    assert run(spark, [], [(1, "a", D0, None, 1)]) == []
    assert run(spark, [(1, "a", D0, "x")], []) == []


def test_two_time_axes(spark):
    facts = spark.createDataFrame([(1, "a", D0, D0), (2, "a", D0, D0 + dt.timedelta(10)), (3, "a", D0 + dt.timedelta(100), D0 + dt.timedelta(120))], "fid long, who string, period date, known date")
    rects = B.rectangles(facts, "who", "fid", "period", "known")
    ev = [(1, "a", D0 + dt.timedelta(5), D0 + dt.timedelta(5)), (2, "a", D0 + dt.timedelta(5), D0 + dt.timedelta(50)), (3, "a", D0 + dt.timedelta(300), D0 + dt.timedelta(119)), (4, "a", D0 + dt.timedelta(99), D0 + dt.timedelta(500)), (5, "a", D0 + dt.timedelta(100), D0 + dt.timedelta(500))]
    got = B.locate(spark.createDataFrame(ev, "id long, who string, v date, r date"), rects, "who", "v", "r")
    assert sorted((x["id"], x["_id"]) for x in got.collect()) == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 3)]
    r = rects.collect()
    for i, a in enumerate(r):  # disjoint
        for b in r[i + 1 :]:
            assert a.v_hi <= b.v_lo or b.v_hi <= a.v_lo or a.r_hi <= b.r_lo or b.r_hi <= a.r_lo
