"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import bucketed, cut, forget, stored  # noqa: F401

#: A null doc_id sorts after every other id.
NULL_ID = 2**63 - 1
#: White space of all word rules: \x20 and \x09-\x0D, which is also what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes and rows up to which a table is broadcast, once both have been counted.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1_000_000


def bounded(df: DataFrame, width: int = 64) -> DataFrame:
    """df, to be broadcast if its rows, `width` bytes each or so, are few enough by count; else as it is, so that joins shuffle."""
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // width)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def crc_fold(column: str, by: int):
    """crc32 of an id as text, modulo by; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by, F.lit(0))


def sliced(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about `most` bytes each; a longer item stands alone."""
    start, size = 0, 0
    for i, x in enumerate(items):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)
