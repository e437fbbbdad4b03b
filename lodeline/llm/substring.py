"""Substring dedup on words by super-k-mer partitioning; sorting decides the windows of a bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .windows import WINDOW, Kind, gram_hashes, repeated

#: Words in a gram of the minimiser.
GRAM = 4


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxh3_64_intdigest(word)
        return h


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def _split(texts: list[bytes]):
    words = [x.split() for x in texts]
    flat = [w for ws in words for w in ws]
    sizes = np.array([len(ws) for ws in words], np.int64)
    units = np.fromiter(map(_Hashes().__getitem__, flat), np.uint64, len(flat))
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    end = np.cumsum(length + 1) - 1
    return units, sizes, b" ".join(flat), end - length, end


def _solve(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = [x.split(b" ") for x in strings]
    sizes = np.array([len(ws) for ws in words], np.int64)
    flat = [w for ws in words for w in ws]
    ids = np.fromiter(map(_Ids().__getitem__, flat), np.int32, len(flat))
    first = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    doc = np.repeat(docs, count)
    value = gram_hashes(ids.astype(np.uint64), WINDOW)[at]
    order = np.argsort(value)
    at_s, value = at[order], value[order]
    new = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    size = np.diff(np.r_[new, len(value)])
    group = np.repeat(np.arange(len(new)), size)
    # Exactly: the words of each window are those of its group's first; a clash of hashes gets groups of its own.
    rows = np.flatnonzero(np.repeat(size > 1, size))
    lead = at_s[new][group]
    same = np.ones(len(order), bool)
    for i in range(0, len(rows), 1 << 16):
        r = rows[i : i + (1 << 16)]
        span = np.arange(WINDOW)
        same[r] = (ids[at_s[r][:, None] + span] == ids[lead[r][:, None] + span]).all(axis=1)
    if not same.all():
        extra: dict[bytes, int] = {}
        for r in np.flatnonzero(~same):
            group[r] = extra.setdefault(ids[at_s[r] : at_s[r] + WINDOW].tobytes(), len(new) + len(extra))
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[order]) if not same.all() else least.__setitem__(slice(None), np.minimum.reduceat(doc[order], new))
    hit = np.empty(len(order), bool)
    hit[order] = least[group] < doc[order]
    at = np.flatnonzero(hit)
    string = np.repeat(np.arange(len(strings)), count)[at]
    return string, at - (np.cumsum(count) - count)[string]


WORDS = Kind(_split, GRAM, lambda x: x.count(b" ") + 1, _solve)


def _apply(texts: list[bytes], spans: list[np.ndarray]) -> list[pa.Array]:
    n, gone, kept = [], [], []
    for text, s in zip(texts, spans, strict=True):
        words = text.split()
        n.append(len(words))
        gone.append(int((s[:, 1] - s[:, 0]).sum()))
        if len(s):
            edges = [0, *s.ravel().tolist(), len(words)]
            words = [w for a, e in zip(edges[::2], edges[1::2], strict=True) for w in words[a:e]]
        kept.append(b" ".join(words))
    return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


def without_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """docs' `keep` columns with n_words, n_removed and kept_text (kept words joined by one space), whose names begin with `prefix`.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id, judged
    on the input. Null text has no words; a null doc_id counts as larger than any other; rows
    with one doc_id don't take from each other, and each keeps its own row. No rows give no rows.
    """
    return repeated(docs, WORDS, _apply, list(keep), f"{prefix}n_words long, {prefix}n_removed long, {prefix}kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for digest() over documents.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(50) AS t(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
