import random

from tidemark.llm import stuffing as S

PROSE = ["The plant in {} will add {} lines for {} and is due to start next year.", "Management of {} kept its guidance of {} million, citing {} costs and late permits.", "Two suppliers in {} told traders that {} orders for {} would ship a week late."]
TERMS = ["penny shares", "top broker", "hot tips", "margin loan", "grid fund", "cheap solar"]


def article(r, n):
    return "\n".join(r.choice(PROSE).format(r.choice(["Tarn", "Quenby", "Mirrin"]), r.randint(1, 999), r.choice(["cable", "glass", "steel"])) for _ in range(n))


def spam(r, kind):
    if kind == 0:
        return ", ".join(r.choice(TERMS) for _ in range(120))
    if kind == 1:
        return "\n".join(f"{r.choice(TERMS)} » http://www.site{r.randint(1, 999)}.example/p/{r.randint(1, 99999)}" for _ in range(30))
    if kind == 2:
        return " ".join("#" + r.choice(TERMS).replace(" ", "") for _ in range(80))
    return "\n".join(f"{' '.join(r.sample(TERMS, 4))} {r.randint(1, 999)}W sale" for _ in range(25))


def test_spam_among_articles(spark):
    r = random.Random(1)
    rows = [(i, article(r, r.randint(4, 20)), "en", "x") for i in range(200)]
    rows += [(1000 + i, article(r, 1) + "\n" + spam(r, i % 4), "en", "x") for i in range(12)]
    rows += [(2000, article(r, 12) + "\n" + spam(r, 1)[:200], "EN", "x"), (2001, article(r, 3) + "\n" + "\n".join(f"QX{i} Halbeck {r.choice('ABC')} {i}.5 -0.3% {i * 77}" for i in range(30)), None, "x")]
    rows += [(2002, article(r, 2) + "\n" + "\n".join(f"{i}. Halbeck Grid: notice of dividend no. {i}" for i in range(1, 30)), "en", "x"), (3000, None, "en", "x"), (3001, "", "en", "x"), (3002, " \n", None, "x"), (1000, rows[200][1], "en", "x")]
    df = spark.createDataFrame(rows, "id long, t string, lang string, share string")
    got = sorted(x["id"] for x in S.stuffed_pages(df, "id", "t", "lang").collect())
    assert got == sorted([*range(1000, 1012), 1000])
    assert S.stuffed_pages(df.limit(0), "id", "t", "lang").count() == 0


def test_share_counts_characters():
    half = "The plant in Tarn will add lines for cable and is due to start soon.\n"
    link = "http://www.x.example/" + "a" * 20
    n = len("".join(half.split()))
    assert abs(S.read_page(half + link)[2] - len(link) / (n + len(link))) < 1e-9
    assert S.read_page("")[2] == 0 and S.read_page("word " * 30_000)[2] == 1


def test_spam_in_small_classes_and_in_the_majority(spark):
    """A stuffed page alone in its length or language, one kind of spam in most of a class, and pages without any prose."""
    r = random.Random(3)
    prose = [(i, article(r, r.randint(4, 20)), "en") for i in range(60)]
    alone = [(100, "\n".join(spam(r, 0) for _ in range(40)), "en"), (101, spam(r, 1), "fr"), (102, "#☂☂☂☂ " * 50, "en")]
    most = [(200 + i, spam(r, 0), "en") for i in range(90)]
    get = lambda rows: sorted(x["id"] for x in S.stuffed_pages(spark.createDataFrame(rows, "id long, t string, lang string"), "id", "t", "lang").collect())
    assert get(prose + alone) == [100, 101, 102]
    assert get(prose + most) == [i for i, *_ in most]
    assert get(most[:5]) == [i for i, *_ in most[:5]]
    assert get(prose) == []


def test_verdict_does_not_depend_on_other_pages(spark):
    """The same pages come out alone, few at a time, among as many others and among many."""
    r = random.Random(9)
    bad = [(1000 + i, article(r, 1) + "\n" + spam(r, i % 4), "en") for i in range(24)]
    good = [(i, article(r, r.randint(4, 20)), "en") for i in range(200)]
    get = lambda rows: {x["id"] for x in S.stuffed_pages(spark.createDataFrame(rows, "id long, t string, lang string"), "id", "t", "lang").collect()}
    want = {i for i, *_ in bad}
    assert get(bad) == want and get(bad + good[:24]) == want and get(bad + good) == want
    assert get(bad[:1]) == {1000} and get(bad[:3]) == {1000, 1001, 1002}


def test_curves_tell_prose_from_stuffing_by_themselves(spark):
    """Without the exact check: few pages of prose are extreme, all stuffed pages are."""
    r = random.Random(11)
    rows = [(1000 + i, spam(r, i % 4), "en") for i in range(40)]
    sample = S.PROSE["en"].split("\n")
    rows += [(i, " ".join(r.sample(sample, r.randint(8, 30))), "en") for i in range(200)]
    d = S.curves(spark.createDataFrame(rows, "id long, t string, lang string"), "id", "t", "lang").select("_id", S.extreme().alias("x")).collect()
    assert all(x["x"] for x in d if x["_id"] >= 1000)
    assert sum(x["x"] for x in d if x["_id"] < 1000) <= 10


def test_reference_has_every_language_and_length():
    ref = {(g, n): x for g, n, *x in S.reference()}
    assert set(ref) == {(g, n) for g in ("", "en", "de", "zh") for n in range(S.LONGEST + 1)}
    assert all(v[0] < 0 <= v[1] and v[2] <= 0 and abs(sum(v[3]) - 1) < 1e-9 for v in ref.values())
