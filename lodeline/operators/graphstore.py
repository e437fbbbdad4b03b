"""A stored graph whose joins need no shuffle: nodes bucketed by id, edges by source and once more by destination, partitioned by type.

Fans, degrees, hubs and what is looked up by id come from buckets of one number, read side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import LOGICAL, Graph


@dataclass(frozen=True)
class Store:
    """Tables NAME_nodes, NAME_by_src and NAME_by_dst."""

    spark: SparkSession
    name: str

    def nodes(self) -> DataFrame:
        return self.spark.table(f"{self.name}_nodes")

    def by_src(self, types: tuple[str, ...] | None = None) -> DataFrame:
        return self._edges("by_src", types)

    def by_dst(self, types: tuple[str, ...] | None = None) -> DataFrame:
        return self._edges("by_dst", types)

    def _edges(self, how: str, types: tuple[str, ...] | None) -> DataFrame:
        e = self.spark.table(f"{self.name}_{how}")
        return e if types is None else e.where(F.col("type").isin(*types))  # only these partitions are read

    def graph(self) -> Graph:
        return Graph(self.nodes().select("id", "type", "name", "path", "fqn"), self.by_src().select("src", "dst", "type", "confidence", "method"))

    def drop(self) -> None:
        for how in ("nodes", "by_src", "by_dst"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{how}")


def save(g: Graph, name: str, path: str, buckets: int | None = None) -> Store:
    """Stores a graph as tables of that name, with their files below path; buckets: as many as shuffle partitions if none are given.

    Each bucket is written by one task, so that a type of edges has `buckets` files at most.
    """
    spark = g.nodes.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df, how, key, by in ((g.nodes, "nodes", "id", ()), (g.edges, "by_src", "src", ("type",)), (g.edges, "by_dst", "dst", ("type",))):
        w = df.repartition(n, key).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{path}/{how}")
        (w.partitionBy(*by) if by else w).saveAsTable(f"{name}_{how}")
    return Store(spark, name)


def degrees(s: Store) -> DataFrame:
    """graph.degrees() from a store: two counts by bucket and a join of buckets."""
    ins = s.by_dst().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    outs = s.by_src().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    zero = F.lit(0).cast("long")
    return s.nodes().select("id", "type", "path").join(ins, "id", "left").join(outs, "id", "left").select("id", "type", "path", F.coalesce("n_in", zero).alias("n_in"), F.coalesce("n_out", zero).alias("n_out"))


def hub_scores(s: Store) -> DataFrame:
    """graph.hub_scores() from a store: distinct neighbours are told apart within a bucket."""
    ins = s.by_dst(LOGICAL).select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    outs = s.by_src(LOGICAL).select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    zero = F.lit(0).cast("long")
    both = ins.join(outs, "id", "full").select("id", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))
    return both.withColumn("score", F.col("fan_in") * 2 + F.col("fan_out"))


def cross_types(s: Store, types: tuple[str, ...] = LOGICAL) -> DataFrame:
    """(src_type, type, dst_type, n): edges by the types of both ends. The source's type comes by bucket; only the pairs that are left are shuffled to the destination's bucket."""
    own = s.nodes().select("id", F.col("type").alias("own"))
    e = s.by_src(types).join(own.withColumnsRenamed({"id": "src", "own": "src_type"}), "src").groupBy("dst", "type", "src_type").agg(F.count(F.lit(1)).alias("k"))
    return e.join(own.withColumnsRenamed({"id": "dst", "own": "dst_type"}), "dst").groupBy("src_type", "type", "dst_type").agg(F.sum("k").alias("n"))
