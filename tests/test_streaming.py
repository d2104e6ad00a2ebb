from conftest import DATA
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.session import load


def test_daily_rollup_equals_the_batch(spark, tmp_path):
    events = load(spark, DATA, "events")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.daily_rollup(stream, "ts", ["event_type"], "value", "60 days").writeStream.format("memory").queryName("rollup").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.col("ts").cast("date").alias("d"), "event_type").count()
    got = spark.table("rollup").select(F.col("window.start").cast("date").alias("d"), "event_type", F.col("n").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
