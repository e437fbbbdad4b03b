"""Cutting the lineage of iterative plans, and tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(sc: SparkContext) -> str:
    """The session's checkpoint folder. Where spark.checkpoint.dir names none, a local session (tests) gets one of this machine; a cluster gets an error."""
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodeline-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back; smaller than checkpoint() for wide rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark.sparkContext)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """stored() in as many buckets of the key as there are shuffle partitions, so that what is grouped by it is read without a shuffle. Only while it is written is it a named table."""
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark.sparkContext)}/{name}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.stored_path = path
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return out


def forget(df: DataFrame) -> None:
    """Deletes what stored() or bucketed() has written for df; nothing that reads it may run afterwards."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, for what isn't written by Spark's own writers; only where that is a mounted file system."""
    folder = shared_folder(spark.sparkContext)
    if ":" in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder} is no folder of a mounted file system")
    return f"{'/' + folder.removeprefix('file:').lstrip('/')}/{name}-{uuid.uuid4().hex}"
