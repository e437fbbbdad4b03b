"""Trees of hashes, stored level by level, and what changed between two of them.

Two runs' trees are compared from the root: of each level only nodes below differing ones are read, and at the end only files below differing leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import _told

#: Nodes named in a filter that reaches the scan; more are joined.
NAMED = 1000


def depth_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/about").first().depth


def save(files: DataFrame, path: str, depth: int | None = None, like: str | None = None) -> str | None:
    """Stores the tree of files (path, size, mtime) below path; gives its root's hash, which is discovery.fingerprint()'s of that depth (none without files).

    depth: levels below the root, sixteen nodes below each; none: leaves of about 256 files. like: a stored tree whose depth is taken, as only such can be compared.
    """
    spark = files.sparkSession
    if like is not None:
        depth = depth_of(spark, like)
    elif depth is None:
        n, depth = files.count(), 0
        while 16**depth * 256 < n:
            depth += 1
    row = F.sha2(F.concat(*map(_told, ("path", "size", "mtime"))), 256)
    own = files.select("path", row.alias("h"), F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, depth).alias("at"))
    own.repartitionByRange("at").sortWithinPartitions("at").write.mode("overwrite").parquet(f"{path}/files")
    level = spark.read.parquet(f"{path}/files").select("at", "h")
    for d in range(depth, -1, -1):
        at = F.substring("at", 1, d)
        node = level.groupBy(at.alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
        node.select("at", F.substring("at", 1, max(d - 1, 0)).alias("up"), "h").repartitionByRange("at").sortWithinPartitions("at").write.mode("overwrite").parquet(f"{path}/levels/level={d}")
        level = spark.read.parquet(f"{path}/levels/level={d}").select("at", "h")
    spark.range(1).select(F.lit(depth).alias("depth")).write.mode("overwrite").parquet(f"{path}/about")
    root = level.first()
    return root.h if root else None


def _below(rows: DataFrame, column: str, nodes: DataFrame, n: int) -> DataFrame:
    """The rows whose column is one of n nodes (at): by a filter that reaches the scan while they are few, else by a join."""
    if n <= NAMED:
        return rows.where(F.col(column).isin([r.at for r in nodes.collect()])) if n else rows.limit(0)
    return rows.join(nodes.select(F.col("at").alias(column)), column, "left_semi")


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b (key, h) joined on key, as key, old, new, where h differs or one has no such row."""
    return a.select(key, F.col("h").alias("old")).join(b.select(key, F.col("h").alias("new")), key, "full").where("NOT (old <=> new)")


def differing_leaves(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, int]:
    """The leaves (at) whose hash differs between two stored trees of one depth, and how many there are."""
    from ..plans.lineage import cut

    depth = depth_of(spark, old)
    if depth != depth_of(spark, new):
        raise ValueError("trees of different depths can't be compared; save() takes the depth of another by like")
    nodes, n = spark.createDataFrame([("",)], "at string"), 1
    for d in range(depth + 1):
        a, b = (spark.read.parquet(f"{p}/levels/level={d}") for p in (old, new))
        nodes = cut(_differing(*(_below(x, "up", nodes, n) for x in (a, b)), "at").select("at"))
        n = nodes.count()
        if not n:
            break
    return nodes, n


def changed(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(path, change): files that are added, removed or changed from the stored tree old to new. Of repeated rows of a path all count; a null path is one like others."""
    nodes, n = differing_leaves(spark, old, new)

    def rows(path: str) -> DataFrame:
        # A null path gets a key of its own.
        own = _below(spark.read.parquet(f"{path}/files"), "at", nodes, n).select(F.coalesce(F.concat(F.lit("="), "path"), F.lit("-")).alias("key"), "h")
        return own.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("h"))

    kind: Column = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    found = _differing(rows(old), rows(new), "key")
    return found.select(F.when(F.col("key") != "-", F.substr("key", F.lit(2))).alias("path"), kind.alias("change"))
