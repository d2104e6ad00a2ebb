import re

import __spark_entry__ as entry


def grams(t):
    s = re.sub(r"[\W]+", "", t.lower())
    return {s[i : i + 3] for i in range(len(s) - 2)} or ({s} if s else set())


def test_whole_texts_against_brute_force(spark, tmp_path):
    texts = ["".join(chr(97 + (i * i + i // 7) % 26) for i in range(2000)), "x" * 700 + " the end differs", "回购公告" + "青原重工𠀀𠀁" * 90 + "结束", "ab", "", "..."]
    rows = [(i, "the end differs, 结束", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, j = ({r[0]: r[1] for r in entry.queries()[q](spark, str(tmp_path)).collect()} for q in ("str13_shingles_whole", "str14_jaccard_whole"))
    assert n == {i: len(grams(t)) for i, _, t in rows}
    assert j == {i: round(len(grams(t) & grams(x)) / len(grams(t) | grams(x)), 9) for i, x, t in rows}
