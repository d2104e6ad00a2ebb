import datetime as dt

import __spark_entry__ as entry


def test_busy_day_counts_all_its_events(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(i, day, "notice" if i % 4 == 0 else None if i % 4 == 1 else "news") for i in range(200)] + [(900, dt.date(2024, 1, 2), "notice"), (901, None, "news")]
    spark.createDataFrame(rows, "doc_id long, date date, text_type string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["date"]: r["n"] for r in entry.queries()["prj16_array_without_type"](spark, str(tmp_path)).collect()}
    assert got == {day: 100, dt.date(2024, 1, 2): 0}
