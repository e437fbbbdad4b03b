"""A lexical index: postings of terms by block of documents, with what bounds a block's scores, stored by bucket of terms.

A query reads the buckets of its own terms only, and of these first the blocks' bounds. Blocks that can't reach the best scores found are not opened.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import term_list, terms
from .lexical import idf

#: Buckets of terms, and documents of a block.
BUCKETS, BLOCK = 64, 4096
#: Blocks of a bucket whose postings one task is dealt.
TASK_BLOCKS = 32


@dataclass(frozen=True)
class Index:
    """Where an index lies, and what was counted for it."""

    path: str
    n: int
    avg_len: float
    buckets: int

    def postings(self, spark: SparkSession, words: list[str]) -> DataFrame:
        """(bucket, term, block, n, max_tf, min_len, ids, tfs, lens) of the words: only their buckets' files are read."""
        own = spark.range(1).select(*(_bucket(F.lit(w), self.buckets) for w in words)).first() if words else ()
        return spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(*set(own)) & F.col("term").isin(*words) if words else F.lit(False))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, len, terms) of docs, terms an array of (term, tf): sorted, a document's equal terms lie together, so that they are counted in its own row."""
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.sort_array(term_list(F.col(text))).alias("w"))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)))
    own = own.select("id", "w", F.greatest(F.size("w"), F.lit(0)).alias("n"), F.filter(at, lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))).alias("starts"))
    each = F.transform("starts", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("starts", k + 1), F.col("n")) - i).alias("tf")))
    return own.select("id", F.size("w").alias("len"), F.when(F.col("n") > 0, each).alias("terms"))


def build(docs: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK, id_column: str = "id", text: str = "text") -> Index:
    """Indexes docs (id, text), whose ids are distinct longs, below path, in one pass over the text and one shuffle, of the postings.

    A block is a set of about `block` documents by the hash of their id, so that no posting list of a term is gathered whole; a null text has no terms. A task has one bucket of
    TASK_BLOCKS blocks, about. The lengths are observed in the stage that shuffles.
    """
    spark, seen = docs.sparkSession, Observation()
    n = docs.count()
    blocks = max(1, -(-n // block))
    parts = -(-blocks // TASK_BLOCKS)
    counted = _counted(docs, id_column, text).observe(seen, F.avg("len").alias("avg"))
    each = counted.select("id", "len", F.explode_outer("terms").alias("x")).where("x IS NOT NULL").select("id", "len", "x.term", "x.tf")
    number = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    each = each.select("*", _bucket(F.col("term"), buckets).alias("bucket"), F.pmod(number, F.lit(parts)).alias("part")).repartition(buckets * parts, "bucket", "part")
    held = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))
    rows = each.groupBy("bucket", "part", "term", number.alias("block"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), held.alias("p"))
    rows = rows.select("bucket", "term", "block", "n", "max_tf", "min_len", *(F.col(f"p.{c}").alias(f"{c}s") for c in ("id", "tf", "len")))
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    found = {"n": n, "avg_len": float(seen.get["avg"] or 0.0), "buckets": buckets}
    spark.createDataFrame([(json.dumps(found),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return Index(path, **found)


def load(spark: SparkSession, path: str) -> Index:
    return Index(path, **json.loads(spark.read.text(f"{path}/about").first()[0]))


def _saturated(tf: Column, length: Column, avg: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(avg, 1.0)))


def top(index: Index, spark: SparkSession, query: str, k: int = 50, ranked_by: str = "idf", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the k best documents with a score above 0, best first, ties by id: the sum of the query's terms' idf (`idf`), or BM25 (`bm25`).

    The bounds of all blocks come first, without their postings: a term adds at most its idf, times what its greatest count in the shortest document would give. The blocks of
    the greatest bounds that hold k documents are scored; their k-th score is a floor, and of the others only those whose bound reaches it are opened. The result is exact.
    """
    words = spark.range(1).select(terms(F.lit(query)).alias("t")).first().t
    read = index.postings(spark, words)
    df = read.groupBy("term").agg(F.sum("n").alias("df"))
    weights = {r.term: r.w for r in df.select("term", idf(F.lit(float(index.n)), F.col("df")).alias("w")).collect()}  # a row for each term of the query
    none = spark.createDataFrame([], "id long, score double")
    if not weights:
        return none
    weight = reduce(lambda a, x: F.when(F.col("term") == x[0], F.lit(x[1])).otherwise(a), weights.items(), F.lit(0.0))
    most = F.lit(1.0) if ranked_by == "idf" else _saturated(F.col("max_tf"), F.col("min_len"), index.avg_len, k1, b)
    bounds = read.groupBy("block").agg(F.sum(weight * most).alias("bound"), F.max("n").alias("n"))
    first, held = [], 0
    for r in bounds.orderBy(F.desc("bound"), "block").limit(k).collect():  # a block has a document at least
        first.append(r.block)
        held += r.n
        if held >= k:
            break

    def scored(blocks: DataFrame) -> DataFrame:
        each = blocks.select(weight.alias("w"), "term", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
        part = F.col("w") if ranked_by == "idf" else F.col("w") * _saturated(F.col("p.tfs"), F.col("p.lens"), index.avg_len, k1, b)
        by_term = each.groupBy(F.col("p.ids").alias("id")).agg(*(F.sum(F.when(F.col("term") == w, part)).alias(f"s{i}") for i, w in enumerate(words)))
        total = reduce(add, (F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(words))))  # in the order of the query's terms, so that sums don't depend on the rows'
        return by_term.select("id", F.round(total, 6).alias("score")).where("score > 0")

    floor = scored(read.where(F.col("block").isin(*first))).orderBy(F.desc("score"), "id").limit(k).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).first()
    worth = bounds.where(F.col("bound") >= floor.s - 1e-6).select("block") if floor.n == k else bounds.select("block")
    return scored(read.join(worth, "block", "left_semi")).orderBy(F.desc("score"), "id").limit(k)
