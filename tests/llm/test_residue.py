import random

import numpy as np

from tidemark.llm import residue as R

CASES = [
    "404 Not Found\nThe page you asked for has moved or no longer exists.", "PLEASE ENABLE JAVASCRIPT TO CONTINUE READING.", "  请启用ＪavaScript后继续浏览", "A fine text with {{company}} left in.",
    "Shares rose ${amount} on Monday.", "TBD\nTBD", "Lorem ipsum dolor sit amet, ut labor.", "Long article.\nSorry, something went wrong (code 93). Try again later.\nMore of it.", "XX股份有限公司于XX年XX月XX日召开XX会议",
    "www.x.example: Access denied. Reference #99.3 — contact the site owner if you think this is wrong.", "rose [TK] percent", "40.0%s%", "Sorry, something went wrong (code 4). Try again later!",
]
CLEAN = [
    None, "", " \n", "Of the 9 filings [2], 7 used the {short} form [sic], it said.", "Page not found notices sent to 764 couriers cost Halbeck 2.2 million.", "Its outage page returned error 503 to 31 customers.",
    "Halbeck rewrote its app in JavaScript and cut 28 jobs.", "青原重工招聘JavaScript工程师12名。", "【21570603】青原重工", "10% of 5 [3]", "word " * 30_000, "#1 in sales", "二〇二〇年",
]


def test_cases(spark):
    rows = [("a", i, t, "x") for i, t in enumerate(CASES + CLEAN)] + [("a", 0, CASES[0], "x")]
    df = spark.createDataFrame(rows, "tbl string, id long, t string, form string")
    got = sorted(r["id"] for r in R.residue_rows(df, ["tbl", "id"], "t").collect())
    assert sorted(set(got)) == list(range(len(CASES)))
    assert R.residue_rows(df.limit(0), ["tbl", "id"], "t").count() == 0


def test_labels_spread_along_links(spark):
    """A line like a labelled one, and one like that in turn, are found; a line like neither is not."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    steps = [" ".join(words)]
    for k in range(3):
        w = steps[-1].split()
        w[k * 4] = f"other{k}"
        steps.append(" ".join(w))
    lines = [*steps, "nothing alike in this one at all", "short"]
    df = spark.createDataFrame([(s, int(h)) for s, h in zip(lines, R.simhashes(lines), strict=True)], "form string, sim long")
    got = {r["form"] for r in R.labelled_lines(df, (steps[0],)).collect()}
    want, todo = set(), [steps[0]]
    while todo:
        a = todo.pop()
        for b in lines:
            if b not in want and R._similar(a, b) and bin((int(R.simhashes([a])[0]) ^ int(R.simhashes([b])[0])) & (2**64 - 1)).count("1") <= R.MAX_BITS:
                want.add(b)
                todo.append(b)
    assert got == want and steps[0] in got and "short" not in got


def test_simhash_is_near_for_near_texts():
    r = random.Random(1)
    far, near = [], []
    for _ in range(200):
        t = "".join(r.choice("abcdefghijklmnop ") for _ in range(80))
        u = t[:40] + "#" + t[41:]
        v = "".join(r.choice("abcdefghijklmnop ") for _ in range(80))
        a, b, c = (int(x) for x in R.simhashes([t, u, v]))
        near.append(bin((a ^ b) & (2**64 - 1)).count("1"))
        far.append(bin((a ^ c) & (2**64 - 1)).count("1"))
    assert np.mean(near) < 12 < 26 < np.mean(far)
    assert R.simhashes(["", "a"])[0] == 0


def test_no_similar_line_is_missed(spark):
    """Lines at the bound of similarity whose SimHashes share no table, or differ in more bits than allowed, are found."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    seed = "".join(r.choice(letters) for _ in range(60)).strip()
    far = []
    own = int(R.simhashes([seed])[0]) & (2**64 - 1)
    while len(far) < 5:
        t = list(seed)
        for _ in range(2):
            t[r.randrange(len(t))] = r.choice(letters[:-1])
        t = "".join(t)
        sim = int(R.simhashes([t])[0]) & (2**64 - 1)
        apart = all((own >> 8 * k) & 255 != (sim >> 8 * k) & 255 for k in range(8)) or bin(own ^ sim).count("1") > R.MAX_BITS
        if R._similar(seed, t) and apart and t not in far:
            far.append(t)
    df = spark.createDataFrame([(s, int(h)) for s, h in zip(far, R.simhashes(far), strict=True)], "form string, sim long")
    assert {x["form"] for x in R.labelled_lines(df, (seed,)).collect()} == set(far)


def test_lines_of_any_length_and_many_links(spark):
    """Filler repeated at length, an error with a long URL, and a chain of links whose ends have little in common."""
    words = [f"{a}{b}{a}" for a in "bdfgkmnprst" for b in "aeiou"]
    chain = [" ".join(words[k * 2 : k * 2 + 22]) for k in range(6)]
    assert all(R._similar(a, b) for a, b in zip(chain, chain[1:], strict=False)) and not R._similar(chain[0], chain[2])
    texts = ["测试数据，请勿理会，" * 40, "Hier steht Ihr Text. " * 50, "https://www.x.example/" + "a" * 300 + " 503 Service Unavailable", *chain]
    clean = ["An article of some length. " * 40, "a" * 500, "请读者理会数据，" * 40]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "id long, t string")
    got = sorted(x["id"] for x in R.residue_rows(df, ["id"], "t", (*R.residue_terms.LABELLED, chain[0])).collect())
    assert got == list(range(len(texts)))


def test_reach_misses_no_line():
    r = random.Random(7)
    seeds = R.seed_forms(R.residue_terms.LABELLED)
    near, lines = R.Near(seeds), []
    for s in seeds * 20:
        t = list(s)
        for _ in range(r.randint(0, len(t) // 8)):
            t[r.randrange(len(t))] = r.choice("abcxyz的了 ")
        lines.append("".join(t) * r.choice([1, 1, 5]))
    lines = [" ".join(x.split()) for x in lines]
    want = {x for x in lines if any(len(np.intersect1d(a := R.triples(x), b := R.triples(y))) >= R.REACH * len(np.union1d(a, b)) for y in seeds)}
    assert len(want) > 300 and want <= {x for _, x in near(["\n".join(lines)])}


def test_residue_within_a_line(spark):
    inside = [
        "Please enable JavaScript to continue reading. The board of Halbeck met on Monday and left the dividend unchanged.", "青原重工今日公告回购股份。请启用JavaScript后继续浏览。公司股价上涨。",
        "Revenue rose 3.1 percent. Sorry, something went wrong (code 93). Try again later. Costs fell.", "Die Aktie stieg. Bitte aktivieren Sie JavaScript, um fortzufahren.\nEnde",
    ]
    clean = ["Halbeck said users had to enable JavaScript before they could go on reading. Costs fell. Sales rose 2.5 percent.", "Its page was down. Customers saw error 503 for an hour! It is back."]
    df = spark.createDataFrame(list(enumerate(inside + clean)), "id long, t string")
    assert sorted(x["id"] for x in R.residue_rows(df, ["id"], "t").collect()) == list(range(len(inside)))


def test_marked_spans_are_units(spark):
    """Slots of any name meet the labelled span of their marks; the same brackets around words of a text do not."""
    slots = [
        "Sales of {% ticker %} rose.", "Output at @@site@@ fell.", "Dear {{ user.first_name }}, shares rose.", "{customer_name} said so.", "停工10天XX万元，影响产量。", "Die Firma Blindtext Blindtext wuchs.", "rose [PERCENTAGE HERE] in May",
        "于【请填写日期】召开", "<%= title %> fell", "the %QUARTER% figures", "In [insert quarter] it rose",
    ]
    clean = ["the set { 3.0, 4.0 } of prices", "used the {short} form [sic]", "[SIC] x", "【21570603】号", "《红楼梦》再版", "up 5% and 6% [2]", "型号ModelXX型", "[he] said", "{a} or {b}"]
    df = spark.createDataFrame(list(enumerate(slots + clean)), "id long, t string")
    assert sorted(x["id"] for x in R.residue_rows(df, ["id"], "t").collect()) == list(range(len(slots)))


# Messages in wordings that are not in the labelled table, written after it.
OTHER_WORDING = (
    "Sorry, the page you were looking for could not be found.", "Error 404: Page Not Found", "HTTP Error 503: The service is unavailable", "Error 502 (Bad Gateway)!!", "404 — Not Found", "The requested URL /a/b was not found on this server.",
    "This website requires JavaScript to be enabled.", "You must enable JavaScript to run this app.", "Please enable JavaScript to view the content.", "JavaScript must be enabled in order to view this site.", "Please enable JavaScript in your web browser.",
    "It seems JavaScript is disabled in your browser.", "We've detected that JavaScript is disabled in your browser.", "Enable JavaScript and cookies to continue reading", "Checking your browser before accessing example.com", "Please verify that you are a human.", "An error occurred while processing your request. Please try again.",
    "抱歉，您访问的页面不存在。", "对不起，您访问的页面不存在", "服务器繁忙，请稍后重试", "请启用JavaScript后访问此页面", "您的浏览器已禁用JavaScript，请启用后刷新页面", "系统维护中，请稍后再访问",
    "Die angeforderte Seite konnte nicht gefunden werden.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es erneut.", "Bitte aktivieren Sie JavaScript in Ihrem Browser", "JavaScript ist in Ihrem Browser deaktiviert!", "Um diese Seite anzuzeigen, aktivieren Sie bitte JavaScript.",
)
REPORTS = (
    "Users who had JavaScript disabled could not open the page, Halbeck said.", "The page could not be found for two hours on Monday, costing the firm sales.", "The regulator denied access to the site on Friday.", "Halbeck moved its error pages to a new server.",
    "公司回应称页面不存在的问题已经修复。", "该网站要求用户启用脚本，引发投诉。", "Die Seite war am Montag zwei Stunden lang nicht erreichbar.", "The service was unavailable in May, and 503 errors rose.",
)


def test_held_out_wordings(spark):
    """How far the labelled table reaches beyond its own wordings, at a similarity of 0.8; no report on such a message is taken."""
    df = spark.createDataFrame(list(enumerate(OTHER_WORDING + REPORTS)), "id long, t string")
    got = {x["id"] for x in R.residue_rows(df, ["id"], "t").collect()}
    assert not any(i >= len(OTHER_WORDING) for i in got)
    print("held out", len(got), len(OTHER_WORDING), [OTHER_WORDING[i] for i in range(len(OTHER_WORDING)) if i not in got])
    assert len(got) >= 0.4 * len(OTHER_WORDING)
