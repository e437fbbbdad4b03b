"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame;
all but the last return the columns of docs, whatever they are besides doc_id and text. What holds for all of them: a null text is empty,
a null doc_id is kept and counts as greater than any other, repeated rows are each judged, ties go to the smaller doc_id, an empty
table gives an empty table, and texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import common, decontam, packing, simhash, substring, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go. The model learns from labelled rows of the documents table; without labels of both kinds all stay."""
    return toxicity.accepted(docs, common.table(spark, sf_dir, "labels"), common.table(spark, sf_dir, "documents"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest doc_id stays: texts whose five-word shingles have a Dice similarity of 0.8 or more,
    A-Z in lower case and without ASCII punctuation. Empty and null texts are one group. Rows of one doc_id with texts of their own are each judged; of rows with one doc_id and text one stays."""
    return simhash.first_texts(docs, measure="dice", plain=True)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document with a smaller doc_id has too go, the others stand joined by blanks; texts without such words stay as they are. n_chars, if there, follows."""
    r = substring.without_repeats(docs, keep=tuple(docs.columns), prefix="__")
    text = F.when(F.col("__n_removed") > 0, F.col("__kept_text")).otherwise(F.col("text"))
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return r.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their bins: a document's texts, in the order of piece, are its text; packing.sequences() puts bins together."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: The toxicity model can't be expressed in SQL; the tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again. What a stage wrote goes once the next has been written."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        done = common.stored(stage(spark, docs, sf_dir))
        if k:
            common.forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
