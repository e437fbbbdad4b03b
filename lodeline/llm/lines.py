"""Line dedup in DataFrame functions only: lines whose key stands in many documents go from every document.

Normalised lines are exploded and hashed, distinct documents are counted by hash, and what stays of a document is put together by position.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, stored

#: Documents from which on a line goes, and code points that its key has at least.
DOCUMENTS, LEAST = 10, 1
#: Frequent lines that may be broadcast: those that stand in one line in HOT or more, of which there are HOT at most.
HOT = 1 << 16
BLANK = " \t\n\x0b\x0c\r"


def key(line: Column) -> Column:
    """A line without white space (\\x20, \\x09-\\x0D) at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() changes other letters too
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_counts(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """(h, g, documents, lines): the hashes of keys of `least` code points or more that stand in `documents` documents or more, and how many lines have them.

    A key's hash has 128 bits. Rows of one doc_id are one document, rows without a doc_id together another.
    """
    lines = _hashed(docs, least).groupBy("h", "g", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("lines")).where(F.col("documents") >= documents)


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, tid, pos, h, g) of every line that may go; tid: a hash of the text, 128 bits with the doc_id's own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("tid"), F.posexplode(_lines(text)).alias("pos", "line"))
    each = each.select("doc_id", "tid", "pos", key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return each.select("doc_id", "tid", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def without_common_lines(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text and more) with __n_lines, __n_dropped and __kept_text: the lines whose key stands in fewer than `documents` documents, or is
    shorter than `least` code points, joined by \\n.

    A null or empty text is one empty line; its kept text is empty. A null doc_id is kept; rows without one count as one document together, and so do rows of one
    doc_id. Repeated rows each come back, with all their columns. An empty table gives none.

    Lines that are found in very many documents are met by a broadcast of at most HOT hashes, the others by a shuffle in which none has more
    than 1 / HOT of all lines. A document's lines never leave it: what is shuffled for them is 36 bytes each.
    """
    frequent = stored(line_counts(docs, documents, least))
    total = frequent.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    often = F.col("lines") * HOT > total
    hot, rest = (frequent.where(c).select("h", "g", F.lit(True).alias("hot")) for c in (often, ~often))
    lines = _hashed(docs, least).join(F.broadcast(hot), ["h", "g"], "left")
    # Lines that are settled travel under keys of their own, so that none meets another.
    lines = lines.withColumns({"jh": F.when(F.col("hot"), F.xxhash64("tid", "pos")).otherwise(F.col("h")), "jg": F.when(F.col("hot"), F.col("doc_id")).otherwise(F.col("g"))})
    met = lines.join(rest.select(F.col("h").alias("jh"), F.col("g").alias("jg"), F.lit(True).alias("met")), ["jh", "jg"], "left")
    going = met.where("hot OR met").select("doc_id", "tid", "pos")
    # Of rows with one doc_id and text only one set of positions is made.
    going = going.groupBy(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid")).agg(F.collect_set("pos").alias("__pos"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("__doc")) & (F.xxhash64(text) == F.col("__tid"))
    joined = docs.join(going, own, "left").withColumn("__n_lines", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    # array_except works with a hash set; the lines are bound once, in an array of one, not cut anew for each position.
    kept = F.transform(F.array(_lines(text)), lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("__pos")), lambda i: F.get(all_, i)), "\n"))[0]
    out = joined.withColumn("__n_dropped", F.greatest(F.size("__pos"), F.lit(0)).cast("long")).withColumn("__kept_text", F.when(F.col("__n_dropped") > 0, kept).otherwise(text))
    return out.drop("__doc", "__tid", "__pos")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents."""
    own = without_common_lines(docs.select("doc_id", "text"))
    return own.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs) AS x),
common AS (SELECT key FROM lines WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS})
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY l.doc_id
"""
