"""Lexical relevance: terms, inverse document frequency, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import term_list, terms
from ..plans.lineage import cut


def idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))"""
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def term_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) of docs; terms of a document are distinct, so that counting rows is enough."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))  # n is one row


def lexical_scores(docs: DataFrame, query: str, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, score): the sum of the idf of the query's terms that a document has; 0 for none; 1 for all documents if the query has no term.

    Only the query's terms are counted: one pass over the text gives flags, which cost no shuffle but for their sums.
    """
    words = docs.sparkSession.range(1).select(terms(F.lit(query)).alias("t")).first().t
    if not words:
        return docs.select(id_column, F.lit(1.0).alias("score"))
    own = docs.select(id_column, terms(F.col(text)).alias("t"))
    flags = cut(own.select(id_column, *(F.array_contains("t", w).cast("byte").alias(f"f{i}") for i, w in enumerate(words))))  # a few bytes a row, so that the text is read once
    sums = flags.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"f{i}").alias(f"df{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        score = score + F.col(f"f{i}") * idf(F.col("n"), F.coalesce(f"df{i}", F.lit(0)))
    return flags.crossJoin(F.broadcast(sums)).select(id_column, F.round(score, 6).alias("score"))  # sums is one row


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, score) with term frequencies and length normalisation."""
    words = docs.sparkSession.range(1).select(terms(F.lit(query)).alias("t")).first().t
    own = docs.select(id_column, term_list(F.col(text)).alias("w")).select(id_column, F.size("w").alias("len"), *((F.size("w") - F.size(F.array_remove("w", x))).alias(f"f{i}") for i, x in enumerate(words)))
    own = cut(own)  # a few counts a row, so that the text is read once
    sums = own.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        tf = F.col(f"f{i}")
        score = score + idf(F.col("n"), F.col(f"df{i}")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.greatest(F.col("avg"), F.lit(1.0))))
    return own.crossJoin(F.broadcast(sums)).select(id_column, score.alias("score"))


def top_seeds(scores: DataFrame, top: int = 50, id_column: str = "id") -> DataFrame:
    return scores.where("score > 0").orderBy(F.desc("score"), id_column).limit(top)


def path_scores(node_scores: DataFrame) -> DataFrame:
    """The best score over a file's entities, from (path, score)."""
    return node_scores.groupBy("path").agg(F.max("score").alias("score"))


def file_scores(files: DataFrame, scores: DataFrame) -> DataFrame:
    """Each file's (path) score from scores (path, score): of the same path, else the best whose path ends with the file's or the other way round, else 0.

    Suffixes are enumerated and joined by equality; there is no nested loop.
    """

    def suffixes(df: DataFrame, *cols: str) -> DataFrame:
        parts = F.split("path", "/")
        return df.select("path", *cols, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))

    best = scores.groupBy("path").agg(F.max("score").alias("score"))
    exact = files.join(best, "path", "left")
    a = suffixes(files).join(best.select(F.col("path").alias("key"), "score"), "key")
    b = suffixes(best, "score").select(F.col("key").alias("path"), "score").join(files, "path", "left_semi")
    loose = a.select("path", "score").union(b.select("path", "score")).groupBy("path").agg(F.max("score").alias("loose"))
    return exact.join(loose, "path", "left").select("path", F.coalesce("score", "loose", F.lit(0.0)).alias("score"))
