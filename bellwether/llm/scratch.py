"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Arrow batches are cut by bytes as well as by rows, so that very long texts
# do not make very large batches.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Unset, a local session gets a temporary folder of its own; on a cluster that
    would be a folder only one machine sees, so it is an error there.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="bellwether-")
    spark.conf.set(SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> SparkSession:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
