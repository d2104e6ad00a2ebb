import pages_other_wording as other

from tidemark.llm import boilerplate as B
from tidemark.llm import boilerplate_pages as P

PAGE = """Menu: Home | Bonds | Funds

Halbeck Grid said revenue rose 3.1 percent to 40.2 million in the quarter.
Outlook: Tarnmouth
Two suppliers confirmed that orders placed before May 3 would ship late.
Halbeck Grid Q2 | 31.4 | 28.8 | -2.7%
THIS IS NOT INVESTMENT ADVICE.
Related stories
- Halbeck Grid to buy back 4.1 million shares
Registered office: 3 Quay Street, Tarnmouth\r"""


def test_lines(spark):
    df = spark.createDataFrame([(1, PAGE, 5), (2, None, 5), (3, "", 5), (4, " \n　", 5), (5, "One sentence that is long enough to be one. " * 5000, 5), (1, PAGE, 5)], "id long, t string, line_no int")
    got = sorted((r["id"], r["line_no"]) for r in B.furniture(df, "id", "t").collect())
    assert got == sorted([(1, k) for k in (1, 7, 8, 9, 10)] * 2)
    assert B.furniture(df.limit(0), "id", "t").count() == 0
    body = {r["id"]: r["t"] for r in B.main_body(df, "id", "t").collect()}
    assert body[1].count("\n") == 3 and body[2] is None and body[3] == ""


def test_held_out_pages():
    """Each labelled page classified by a tree that has not seen it nor its neighbours in the table."""
    pages = [p.split("\n") for p in P.PAGES.strip().split("\n\n")]
    right = total = 0
    for k in range(5):
        x, y = [], []
        for i, p in enumerate(pages):
            if i % 5 != k:
                x += B.blocks("\n".join(s[2:] for s in p))[1]
                y += [s[0] == "+" for s in p]
        tree = B.grow(B.matrix(x), __import__("numpy").array(y, dtype=float))
        for i, p in enumerate(pages):
            if i % 5 == k:
                guess = B.score(tree, B.matrix(B.blocks("\n".join(s[2:] for s in p))[1])) >= 0.5
                right += sum(g == (s[0] == "+") for g, s in zip(guess, p, strict=True))
                total += len(p)
    assert right / total > 0.9


def test_long_lists_have_their_features():
    """Menus, tables and long runs of few words count as such at any length."""
    entries = sorted(P.NAV)[:30]
    page = "Halbeck Grid said revenue rose 3.1 percent to 40.2 million in the quarter.\n" + " | ".join(entries) + "\nHalbeck Grid | " + " | ".join(["31.4"] * 40) + "\n" + "x" * 130
    f = [dict(zip(B.NAMES, x, strict=True)) for x in B.blocks(page)[1]]
    assert f[1]["nav"] == 1 and f[1]["items"] == 4 and f[0]["next_nav"] == 1 and f[2]["prev_nav"] == 1
    assert f[2]["cells"] == 1 and f[2]["nav"] == 0 and f[3]["words"] == 0


def test_pages_of_other_wording():
    """Menus, labels, teasers and footers whose words the lists do not hold are told by structure."""
    tree, right, found, body, kept = B.trained(), 0, 0, 0, 0
    for page in other.PAGES.strip().split("\n\n"):
        lines = page.split("\n")
        off = B.score(tree, B.matrix(B.blocks("\n".join(x[2:] for x in lines))[1])) < 0.5
        for x, k in zip(lines, off, strict=True):
            found, right = found + (x[0] == "-"), right + (x[0] == "-" and k)
            body, kept = body + (x[0] == "+"), kept + (x[0] == "+" and not k)
    assert right >= 0.9 * found and kept >= 0.9 * body


def test_lines_that_stand_together():
    assert B._runs([True, False, False, True, False]) == [0, 2, 2, 0, 1]
    assert B._runs([]) == [] and B._runs([False] * 9) == [4] * 9
    assert B._link_share(["a b", "c"]) == 1 and B._link_share(["a"]) == 0 and B._link_share(["x", "1.5", "2"]) == 1 / 3
