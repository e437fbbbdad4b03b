"""Variable-capacity best-fit packing of token sequences.

Texts are cut into pieces of the largest size at most, and each piece travels, with its text, to a group by a hash of its content; a group
holds about `group_tokens` tokens, whatever the cluster's partitions are.
Within a group pieces go from long to short, each to the open bin that it leaves least room in. Where none fits, the
permitted size opens whose cost per token is least, given what is left to fill it; at the end every
bin shrinks to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded, cut

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens, in tokens.
OVERHEAD = 64
GROUP_TOKENS = 1 << 20
#: Rows of one doc_id and text that may go to one group; more are spread.
SAME = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each length, none over the largest capacity, and the size of each bin."""
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    rest = int(lengths.sum())
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened: list[tuple[int, int]] = []  # (room left, bin)
    used: list[int] = []
    given: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        rest -= n
        at = bisect_left(opened, (n, -1))
        if at < len(opened):
            room, b = opened.pop(at)
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / min(c, n + rest), -c))
            b = len(used)
            used.append(0)
            given.append(room)
        bins[i], offset[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(opened, (room - n, b))
    fitted = np.array([sizes[bisect_left(sizes, u)] for u in used], np.int64)
    return bins, offset, fitted


def pieces(text: bytes, most: int) -> list[tuple[int, int, bytes]]:
    """(start, length, text) of the pieces of a text: `most` tokens each, the last with the rest and the end token. The texts, joined, are the text."""
    n = len(text.split()) + 1
    if n <= most:
        return [(0, n, text)]
    at = [0]
    for i, m in enumerate(_WORD.finditer(text)):
        if i and not i % most:
            at.append(m.start())
    if (n - 1) % most == 0:  # the end token stands alone
        at.append(len(text))
    return [(k * most, min(most, n - k * most), text[a:b]) for k, (a, b) in enumerate(zip(at, [*at[1:], len(text)], strict=True))]


_PIECES = "doc_id long, key long, row long, piece int, start long, length long, ends boolean, text string"
PLACED = "doc_id long, piece int, start long, length long, ends boolean, bin_id long, bin_capacity long, bin_offset long, text string"


def packed_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The packed pieces of docs (doc_id, text): doc_id, piece, start, length (tokens), ends, bin_id, bin_capacity, bin_offset, text.

    A token is a word or a text's end; `ends` marks the piece that has the end. A document over the largest capacity is cut into pieces of that size and a rest; `text` holds a
    piece's words with the white space around them, so that a document's texts in the order of `piece` are its text. Null text is empty and
    has the end token only; a null doc_id is kept; no rows give no rows. Repeated rows are packed as often as they come. Bins depend on
    the rows alone, not on where they lie, but for rows that come over SAME times.
    """
    most = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(x.split()) + 1 for x in blobs(b, "text")], pa.int64())], ["key", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, x in enumerate(blobs(b, "text")):
                own = pieces(x, most)
                out += [(i, k, *p, k == len(own) - 1) for k, p in enumerate(own)]
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("key").take(at), b.column("row").take(at), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[5] for x in out], pa.bool_()), pa.array([x[4] for x in out], pa.binary()).cast(pa.string())], ["doc_id", "key", "row", "piece", "start", "length", "ends", "text"])

    counted = cut(rows.select("key", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("n")))
    groups = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // group_tokens))
    often = bounded(counted.where(F.col("times") > SAME).select("key", F.lit(True).alias("often")))
    cut_up = rows.select("doc_id", "key", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(split, _PIECES).join(often, "key", "left")
    group = F.pmod(F.xxhash64("key", "piece", F.when(F.col("often"), F.col("row")).otherwise(F.lit(0).cast("long"))), F.lit(groups))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("key", "piece", "row")])
        bins, offset, fitted = best_fit(t.column("length").to_numpy(), capacities, overhead)
        where = {"bin_id": t.column("group").to_numpy() * (1 << 32) + bins, "bin_capacity": fitted[bins], "bin_offset": offset}
        own = [t.column(c) for c in ("doc_id", "piece", "start", "length", "ends")]
        return pa.Table.from_arrays([*own, *map(pa.array, where.values()), t.column("text")], ["doc_id", "piece", "start", "length", "ends", *where, "text"])

    return cut_up.select("doc_id", "key", "row", "piece", "start", "length", "ends", "text", group.alias("group")).groupBy("group").applyInArrow(run, PLACED)


def sequences(placed: DataFrame, end: str = "<|end|>") -> DataFrame:
    """(bin_id, bin_capacity, n_tokens, doc_ids, sequence) of packed pieces: a bin's words joined by blanks, `end` after each document. A bin is bounded by the largest capacity."""
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    p = placed.withColumn("said", F.concat_ws(" ", F.when(words != "", words), F.when(F.col("ends"), end)))
    bins = p.groupBy("bin_id", "bin_capacity").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "said"))).alias("x"))
    return bins.select("bin_id", "bin_capacity", "n_tokens", F.transform("x", lambda x: x.doc_id).alias("doc_ids"), F.array_join(F.transform("x", lambda x: x.said), " ").alias("sequence"))
