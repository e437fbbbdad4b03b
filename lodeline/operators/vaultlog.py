"""A vault of rules as an append-only log: batches of new rules, and compacted states that say which batches they hold.

A writer adds a folder of its own and touches no other, so writers never meet: none waits and none is lost. A reader takes the state that holds most batches and merges
the others in the order of their times.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .memory import upserted

NEW = "name string, category string, rule string, confidence double, source string, created_at string"
STATE = "id string, " + NEW
#: Batches after which the lineage of a merge is cut.
CUT = 8


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of folders that may not be there yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _placed(df: DataFrame, path: str, at: str) -> None:
    """Writes df beside path and puts it in its place as a whole, so that no reader sees a part of it."""
    sc = df.sparkSession.sparkContext
    new = f"{path}/new/{uuid.uuid4().hex}"
    df.write.parquet(new)
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{at}")
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(folder.getParent())
    if not fs.rename(sc._jvm.org.apache.hadoop.fs.Path(new), folder):
        raise OSError(f"{folder} couldn't be put in its place")


def append(path: str, rules: DataFrame) -> str:
    """Adds rules (name, category, rule, confidence, source, created_at) to the log as a batch, whose id it gives."""
    batch = uuid.uuid4().hex
    own = rules.select(*(F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in NEW.split(", ")), F.lit(time.time_ns()).alias("at"))
    _placed(own, path, f"log/batch={batch}")
    return batch


def _base(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The compacted state that holds most batches, and these (batch)."""
    covers = _read(spark, f"{path}/covers", "batch string, snapshot string")
    best = covers.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "snapshot").first()
    if best is None:
        return spark.createDataFrame([], STATE), covers.select("batch")
    return spark.read.schema(STATE).parquet(f"{path}/states/{best.snapshot}"), covers.where(F.col("snapshot") == best.snapshot).select("batch")


def current(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The vault with all batches merged as memory.upserted() does, and the batches that no state held yet, in the order of their times."""
    state, held = _base(spark, path)
    log = _read(spark, f"{path}/log", NEW + ", at long, batch string").join(held, "batch", "left_anti")
    order = [r.batch for r in log.groupBy("batch").agg(F.min("at").alias("at")).orderBy("at", "batch").collect()]  # a row for each batch since the last compaction
    for k, batch in enumerate(order):
        state = upserted(state, log.where(F.col("batch") == batch).drop("batch", "at"))
        state = cut(state) if k % CUT == CUT - 1 else state
    return state, order


def compact(spark: SparkSession, path: str) -> str:
    """Stores the vault as a state and then, as the commit, which batches it holds; its id. Batches that come meanwhile are not among them and are merged by readers."""
    _, held = _base(spark, path)
    state, order = current(spark, path)
    snapshot = uuid.uuid4().hex
    _placed(state, path, f"states/{snapshot}")
    batches = held.union(spark.createDataFrame([(b,) for b in order], "batch string"))
    _placed(batches.coalesce(1), path, f"covers/snapshot={snapshot}")
    return snapshot
