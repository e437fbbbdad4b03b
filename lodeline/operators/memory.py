"""A vault of rules: upsert, and patterns that it doesn't hold yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(vault: DataFrame, new: DataFrame) -> DataFrame:
    """vault with new rules (name, category, rule, confidence, source, created_at) merged in.

    By category and name a rule's text, confidence and source are replaced if the text differs; else by category and text a missing name is
    filled and the confidence raised; else the rule is added. Ids of added rules are hashes, so a rerun gives the same vault. Of new rules with one
    key the most confident counts.
    """
    named = new.where("name IS NOT NULL").groupBy("category", "name").agg(F.max_by(F.struct("rule", "confidence", "source", "created_at"), F.struct("confidence", "rule")).alias("u"))
    v = vault.join(named, ["category", "name"], "left")
    differs = F.col("u").isNotNull() & (F.col("u.rule") != F.col("rule"))
    fields = ("rule", "confidence", "source")
    v = v.select("id", "name", "category", *(F.when(differs, F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) for c in fields), "created_at")
    rest = new.join(vault.where("name IS NOT NULL").select("category", "name"), ["category", "name"], "left_anti")
    texts = rest.groupBy("category", "rule").agg(F.max_by(F.struct("name", "confidence", "source", "created_at"), F.struct("confidence", F.coalesce("name", F.lit("")))).alias("t"))
    merged = v.join(texts.select("category", "rule", F.col("t.name").alias("tn"), F.col("t.confidence").alias("tc")), ["category", "rule"], "left")
    merged = merged.select("id", F.coalesce("name", "tn").alias("name"), "category", "rule", F.greatest("confidence", "tc").alias("confidence"), "source", "created_at")
    added = texts.join(vault.select("category", "rule"), ["category", "rule"], "left_anti")
    key = F.concat_ws("|", "category", F.coalesce("t.name", F.lit("")), "rule")
    added = added.select(F.concat(F.lit("rule_"), F.substring(F.sha2(key, 256), 1, 12)).alias("id"), F.col("t.name").alias("name"), "category", "rule", F.col("t.confidence").alias("confidence"), F.col("t.source").alias("source"), F.col("t.created_at").alias("created_at"))
    return merged.unionByName(added)


def unknown_patterns(patterns: DataFrame, vault: DataFrame) -> DataFrame:
    """Patterns (category, name, description, ...) that the vault has neither by category and name nor, for its unnamed rules, by text."""
    by_name = vault.where("name IS NOT NULL").select("category", "name")
    by_text = vault.where("name IS NULL").select(F.col("rule").alias("description"))
    return patterns.join(by_name, ["category", "name"], "left_anti").join(by_text, "description", "left_anti")


def too_long(vault: DataFrame, most: dict[str, int]) -> DataFrame:
    """Rules with a text over its cap: {column: characters}."""
    cond = F.lit(False)
    for c, n in most.items():
        cond = cond | (F.coalesce(F.length(c), F.lit(0)) > n)
    return vault.where(cond)
