"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="bellwether-")
    spark.conf.set(SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """df, written as Parquet and read back, so that what reads it starts from files and not from its plan.

    With most, no file holds more rows. A task reads whole small files up to a size on disk, each counted with
    spark.sql.files.openCostInBytes, so it also bounds the rows of a task where they pack well.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
