import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from tidemark.llm import lookalikes as K

SAME = [
    ["Café Müller fi 3", "Café Müller fi 3", "Ｃａｆé Müller ﬁ ３", "Ca​fé Müller fi 3", "Саfé Müller fi 3", "Café Mü­ller fi 3"],
    ["工口日目，规模", "⼯⼝⽇⽬，规模", "工口日目,规模"],
    ["5 K Å", "5 K Å", "5 K Å"],
    ["wait…", "wait..."],
]
OTHER = ["Café Müller fi 3 ".strip() + "²", "Cafe Müller fi 3", "café Müller fi 3", "Café Müller\nfi 3", "①", "1", "km2", "km²", "", " ", "x" * 50_000]
SCHEMA = "id long, title string, content string, look string"


def test_pairs(spark):
    texts = [t for g in SAME for t in g] + OTHER + [None, SAME[0][0]]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], SCHEMA)
    group = {t: k for k, g in enumerate(SAME) for t in g}
    want = {("title", i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a in group and b in group and group[a] == group[b] and a != b}
    got = K.same_look_pairs(df, "id", ["title", "content"])
    assert {tuple(r) for r in got.collect()} == want
    assert K.same_look_pairs(df.limit(0), "id", ["title"]).count() == 0


def test_one_form_keeps_other_columns_and_is_stable(spark):
    df = spark.createDataFrame([(i, t, t, "x") for i, t in enumerate(t for g in SAME for t in g)], SCHEMA)
    once = K.one_form(df, ["title"]).orderBy("id").collect()
    assert [r["content"] for r in once] == [t for g in SAME for t in g]
    forms = [r["title"] for r in once]
    at = 0
    for g in SAME:
        assert len(set(forms[at : at + len(g)])) == 1
        at += len(g)
    table = K.corpus_table(df, ["title"])
    assert all(K.Rewriter(table)(f) == f for f in forms)


def test_classes_are_transitive():
    c = K.Classes()
    c.join("a", "b"), c.join("c", "d"), c.join("b", "c")
    assert sorted(c.groups()[0]) == ["a", "b", "c", "d"]


def test_stored_forms_of_accents_in_several_scripts(spark):
    """Composed, decomposed and half-composed sentences, and marks in another order, all meet."""
    base = ["Tiếng Việt có nhiều dấu thanh điệu", "한국어 문장을 정규화한다", "Café naïve über ạ̈", "ガギグ が パ", "Νέα της ημέρας ώρα"]
    rows = []
    for k, t in enumerate(base):
        d = unicodedata.normalize("NFD", t)
        forms = {unicodedata.normalize("NFC", t), d, unicodedata.normalize("NFC", d[: len(d) // 2]) + d[len(d) // 2 :]}
        rows += [(k * 10 + i, f) for i, f in enumerate(sorted(forms))]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r["a"], r["b"]) for r in K.same_look_pairs(df, "id", ["t"]).collect()}
    assert got == {(i, j) for (i, _), (j, _) in itertools.combinations(rows, 2) if i // 10 == j // 10}
    assert len(got) == 15


def test_same_form_if_and_only_if_same_atoms():
    """Random strings of related characters, under tables in which any member may be the representative."""
    r = random.Random(3)
    alphabet = "aｅéẹ́̈fiﬁﬀﬃl.…ＡАΑÅÅ가각ᄀ각ｶﾞガガ ​ 　IVⅣ-‐"
    for _ in range(20):
        counts = {ord(c): r.randint(1, 99) for c in alphabet}
        table = K.patterns(counts, {k: r.randint(1, 99) for k in K.spelt_alike(counts) if len(k) > 1})
        to, visible = K.Rewriter(table), K.Without(K.invisible())
        by_atoms, by_form = {}, {}
        for _ in range(1500):
            s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 6)))
            a, f = to.spell(visible(s)), to(s)
            assert to(f) == f and to.spell(f) == a
            assert by_atoms.setdefault(a, f) == f and by_form.setdefault(f, a) == a


def test_representative_is_the_most_frequent_member(spark):
    composed, spelt = "\u00e9", "e\u0301"
    df = spark.createDataFrame([(1, "ﬁ ﬁ ﬁ fi f i i i i i f f f f"), (2, f"caf{composed} {composed} {spelt} e e e")], "id long, t string")
    table = K.corpus_table(df, ["t"])
    assert table["fi"] == "ﬁ"  # 3 ligatures against one spelt out, however frequent f and i are
    assert table[spelt] == composed
    more = spark.createDataFrame([(1, f"ﬁ fi fi {composed} {spelt} {spelt}")], "id long, t string")
    table = K.corpus_table(more, ["t"])
    assert "fi" not in table and spelt not in table


def test_one_variant_among_very_many_equal_rows(spark):
    many = spark.range(100_000).select("id", F.lit("Same title \u00e9").alias("t")).union(spark.createDataFrame([(100_000, "Same title e\u0301")], "id long, t string"))
    pairs = K.same_look_pairs(many, "id", ["t"])
    assert pairs.count() == 100_000 and pairs.where("b = 100000").count() == 100_000
    got = K.same_look_classes(many, "id", ["t"])
    assert got.count() == 100_001 and got.where("class = 0").count() == 100_001
    assert got.where("id = 100000 and links = 100000").count() == 1 and got.where("links = 1").count() == 100_000
    assert K.same_look_classes(many.limit(0), "id", ["t"]).count() == 0


def test_letters_of_many_alphabets(spark):
    rows = [(0, "HOME Show"), (1, "ᎻΟМЕ Ѕһоw"), (2, "HΟМᎬ Տhօᴡ"), (3, "HOME show")]
    got = {(r["a"], r["b"]) for r in K.same_look_pairs(spark.createDataFrame(rows, "id long, t string"), "id", ["t"]).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}
