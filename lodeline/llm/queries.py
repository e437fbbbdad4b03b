"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, audit, chat, decontam, langid, lines, lm, packing, quality, simhash, substring, suffix, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id that its links reach."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that a smaller doc_id has too, counted, and a digest of the rest."""
    return suffix.digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base rules and whether its distribution is near its language's."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's formatted text, read back."""
    return chat.digest(spark, table(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of every document and benchmark item that reaches the similarity."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that a smaller doc_id has too, counted, and a digest of the rest."""
    return substring.digest(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from four folds in five."""
    return langid.identified(table(spark, sf_dir, "documents"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likelihood under the hidden Markov model, and under unigrams."""
    return lm.likelihoods(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity and its offending sentences, learnt from two folds in three."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their text, in the bins they are packed into."""
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, grouped and linked, digested."""
    return align.digest(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in ten documents or more, digested."""
    return lines.digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_suffix_array, op3_quality, op4_chat, op5_substring, op6_langid, op7_decontamination, op8_hmm, op9_toxicity, op10_packing, op11_alignment, op12_line_dedup, op13_filter_audit)}
ORACLES: dict[str, str] = {"op2_suffix_array": suffix.ORACLE, "op3_quality": quality.ORACLE, "op4_chat": chat.ORACLE, "op5_substring": substring.ORACLE, "op12_line_dedup": lines.ORACLE, "op13_filter_audit": audit.ORACLE}
