import random
from collections import defaultdict

from tidemark.llm import lines as L
from tidemark.llm.text import line_form

SCHEMA = "id long, t string, src string, lh int, _src string"


def brute(rows, least=4, percent=5):
    n, docs = defaultdict(int), defaultdict(set)
    for i, (_, t, s) in enumerate(rows):
        n[s] += 1
        for f in set(line_form(t).split("\n")) - {""} if t is not None else ():
            docs[s, f].add(i)
    out = []
    for i, t, s in rows:
        for k, f in enumerate(line_form(t).split("\n"), 1) if t is not None else ():
            if f and len(docs[s, f]) >= least and len(docs[s, f]) * 100 >= percent * n[s]:
                out.append((i, k))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA)
    found, _ = L.repeated_lines(df, "id", "t", "src")
    return sorted((r["id"], r["line_no"]) for r in found.collect()), df


def test_against_brute_force(spark):
    r = random.Random(2)
    stock = ["Read by {} readers", "未经授权不得转载", "a" * 300, "Share THIS  now", "x", "Straße {}", "long " * 60]
    rows = []
    for i in range(300):
        body = [r.choice(stock).format(r.randint(1, 99)) if r.random() < 0.5 else f"{''.join(r.choice('abcdefghij ') for _ in range(r.randint(1, 200)))}" for _ in range(r.randint(0, 6))]
        sep = r.choice(["\n", "\r\n", "\n\n", " \xa0\n　"])
        rows.append((i, sep.join(body).upper() if r.random() < 0.2 else sep.join(body), r.choice(["a", "a", "a", "b", "c"])))
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, " \n\t\n", "b"), (1003, None, None), (3, "x\nx", "b")]
    got, df = run(spark, rows)
    assert got == brute(rows)
    clean = {r["id"]: r["t"] for r in L.without_repeated_lines(df.where("id < 300"), "id", "t", "src").collect()}
    gone = defaultdict(set)
    for i, k in brute([x for x in rows if x[0] < 300]):
        gone[i].add(k)
    single = {i: t for i, t, s in rows if i < 300 and i != 3}
    assert all(clean[i] == "\n".join(x for k, x in enumerate(t.split("\n"), 1) if k not in gone[i]) for i, t in single.items())


def test_threshold_is_inclusive_and_empty_table(spark):
    assert len(run(spark, [(i, "same line", "a") for i in range(4)] + [(i, None, "a") for i in range(4, 80)])[0]) == 4
    assert run(spark, [(i, "same line", "a") for i in range(4)] + [(i, None, "a") for i in range(4, 81)])[0] == []
    assert run(spark, [])[0] == []


def test_very_long_line(spark):
    assert run(spark, [(i, "word " * 50_000, "a") for i in range(4)])[0] == [(i, 1) for i in range(4)]
