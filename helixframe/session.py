"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("helixframe")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | more
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; columns and filters are pruned by the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
