"""Spark session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All timestamps are UTC; adaptive execution picks join sides by measured size
# and splits skewed shuffle partitions, so no operator carries broadcast hints
# for data tables.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "bellwether",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME, **(extra or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
