"""Session factory and table loading."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC and adaptive execution."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in base.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the session was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Table ``table`` of the data directory; timestamps stay zone-less."""
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over enough partitions for a CPU-bound stage.

    Only inputs that arrive in far fewer splits than there are cores (one small
    file, say) are moved; at scale the scan has more splits than cores and the
    frame is returned as it is.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 <= want else df
