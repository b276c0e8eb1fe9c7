"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session takes one inside its warehouse; on a
    cluster that is an error, as executors need not share any other folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, whose table goes when this process ends with its session still up."""
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


@atexit.register
def clean() -> None:
    """Delete the tables written so far; no plan may read them any more."""
    session = SparkSession.getActiveSession() if _PATHS else None
    if session is not None and session.sparkContext._jsc is not None:
        for path in _PATHS:
            remove(session, path)
        _PATHS.clear()


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later plans start from files, not from lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by materialize() once no plan reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
