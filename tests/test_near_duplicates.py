import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators import dedup as D

DAY = dt.date(2024, 1, 1)


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_classes_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(10)]
    rows = []
    for i in range(120):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(60)] = "other"
        rows.append((i, " ".join(w), DAY + dt.timedelta(r.randint(0, 40)), "x"))
    rows += [(200, None, DAY, "x"), (201, "", DAY, "x"), (202, "too short", DAY, "x"), (203, rows[0][1], None, "x")]
    up = {i: i for i, *_ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = defaultdict(set)
    for i, t, d, _ in rows:
        for j, u, e, _ in rows:
            if i < j and t and u and d and e and abs((d - e).days) <= 14 and len(t.split()) > 12 and len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u)):
                if (t, d) != (u, e):
                    links[i].add((u, e)), links[j].add((t, d))
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "id long, t string, d date, class string")
    got = {x["id"]: (x["class"], x["links"]) for x in D.near_duplicates(df, "id", "t", "d").collect()}
    assert got == {i: (root(i), len(links[i])) for i, *_ in rows}
    assert D.near_duplicates(df.limit(0), "id", "t", "d").count() == 0


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {x["id"]: x["class"] for x in D.components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_undated_copies_are_compared(spark):
    w = [f"w{i}" for i in range(60)]
    near = [*w[:30], "other", *w[31:]]
    rows = [(1, " ".join(w), None), (2, " ".join(w), None), (3, " ".join(near), None), (4, " ".join(w), DAY), (5, None, None), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, t string, d date")
    assert sorted(map(tuple, D.near_duplicates(df, "id", "t", "d").collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (5, 5, 0), (6, 6, 0)]


def test_greedy_keeps_both_ends_of_a_chain(spark):
    """A is like B, B like C, A not like C: the best ranked A is kept, B goes, C stays as what it is like is gone."""
    import random

    from tidemark.operators import dedup as DD

    def jaccard(x, y):
        return len(x & y) / len(x | y)

    r = random.Random(4)
    sets = {1: set(range(20)), 2: set(range(2, 22)), 3: set(range(4, 24)), 4: set(range(100, 105)), 5: set(range(100, 105)), 6: set(range(20))}
    days = {1: "2024-01-01", 2: "2024-01-02", 3: "2024-01-03", 4: "2024-01-01", 5: "2024-01-01", 6: "2024-06-01"}
    for i in range(10, 90):
        a = r.randint(0, 60)
        sets[i], days[i] = set(range(a, a + 20)), f"2024-02-{r.randint(1, 28):02d}"
    rank = {i: r.randint(0, 5) for i in sets} | {1: 9, 2: 8, 3: 7}
    rows = [(i, sorted(f"g{x}" for x in s), days[i], rank[i]) for i, s in sets.items()] + [(200, None, "2024-01-01", 1), (201, sorted(f"g{x}" for x in range(20)), None, 1)]
    df = spark.createDataFrame(rows, "id long, s array<string>, d string, q int").withColumn("d", F.col("d").cast("date"))
    got = sorted(x["id"] for x in DD.greedy_similar(df, "id", "s", "d", [("q", True)], 14, 0.8).collect())
    day = lambda i: dt.date.fromisoformat(days[i]).toordinal()
    kept = []
    for i in sorted(sets, key=lambda i: (-rank[i], i)):
        if len(sets[i]) < 8 or not any(len(sets[j]) >= 8 and abs(day(i) - day(j)) <= 14 and jaccard(sets[i], sets[j]) >= 0.8 for j in kept):
            kept.append(i)
    assert got == sorted([*kept, 200, 201]) and 1 in got and 2 not in got and 3 in got
    assert DD.greedy_similar(df.limit(0), "id", "s", "d", [("q", True)], 14, 0.8).count() == 0
