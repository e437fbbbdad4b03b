"""Suffix-array dedup on UTF-8 bytes.

Stretches of text that may recur across documents are found by minimiser (windows.py). Each task sorts those of its own texts by a suffix array,
settles what they have in common, and sends the rest as sorted strings to buckets, which hold all strings around the same minimisers. There the strings
of each few tasks, SHARD bytes or more, are a shard with a suffix array of its own, and the arrays are merged by binary search over their sorted distinct windows. Larsson-Sadakane refinement sorts
positions by ever longer prefixes, up to 50 bytes, and touches only groups that are still tied; Kasai's common prefixes, taken
over all strings in step, tell which neighbours share 50 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import WINDOW, Kind, repeated

#: Bytes in a gram of the minimiser.
GRAM = 24
#: Bits of a position in one suffix array: rank, next rank and position share a 64-bit sort key.
POSITION = 21
MOST = (1 << POSITION) - 2
#: Bytes of strings from which on a suffix array ends with the strings of the task that sent them.
SHARD = 1 << 18
#: Positions that follow one another in a lane of the common prefixes.
LANE = 256


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of text (uint8, at most MOST) sorted by their first `depth` bytes, the group rank of each, and whether it was tied before the last refinement."""
    n = len(text)
    assert n <= MOST
    bits, low = np.uint64(POSITION), np.uint64((1 << POSITION) - 1)
    # As many characters as fit beside a position, in the bits that this text's alphabet takes; 0 is past the end.
    there = np.bincount(text, minlength=256) > 0
    code = (np.cumsum(there) * there).astype(np.uint64)
    width = max(1, int(there.sum()).bit_length())
    known = min((64 - POSITION) // width, depth)
    t = np.zeros(n + known, np.uint64)
    t[:n] = code[text]
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key = (key << np.uint64(width)) | t[j : n + j]
    packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    new = _changes(packed >> bits)
    rank = np.zeros(n + depth, np.int32)  # past the end: 0; others from 1
    rank[sa] = np.maximum.accumulate(np.where(new[:-1], np.arange(1, n + 1, dtype=np.int32), 0))
    tied = np.flatnonzero(~(new[:-1] & new[1:]))
    last = sa[tied]
    while known < depth and len(tied):
        step = min(known, depth - known)
        s = last = sa[tied]
        packed = np.sort(((rank[s] - 1).astype(np.uint64) << np.uint64(2 * POSITION)) | (rank[s + step].astype(np.uint64) << bits) | s.astype(np.uint64))
        s = (packed & low).astype(np.int64)
        new = _changes(packed >> bits)
        sa[tied] = s
        rank[s] = np.maximum.accumulate(np.where(new[:-1], tied + 1, 0))
        tied = tied[~(new[:-1] & new[1:])]
        known += step
    close = np.zeros(n, bool)
    close[last if known >= depth else sa[tied]] = True
    return sa, rank[:n], close


def _changes(value: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, and True at the end."""
    out = np.ones(len(value) + 1, bool)
    np.not_equal(value[1:], value[:-1], out=out[1:-1])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Kasai: the common prefix, up to `most`, of each position in order (sorted suffixes, not all of them) with the one before it.

    Positions that follow one another in the text make a lane, and all lanes advance in step; each position begins with the last one's prefix less
    one where the suffix after that one's neighbour is in order too and still precedes it.
    """
    n = len(text)
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    lcp = np.zeros(len(order), np.int64)
    at = np.sort(order)
    new = np.r_[True, at[1:] != at[:-1] + 1] if len(at) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    begin = np.flatnonzero(since % LANE == 0)
    size = np.diff(np.r_[begin, len(at)])
    lanes = np.argsort(-size, kind="stable")
    first, left = at[begin][lanes], size[lanes]
    h, before = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)
    for t in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -t, "left"))
        i = first[:live] + t
        p = place[i]
        j = np.where(p > 0, order[p - 1], -1)
        follow = place[before[:live] + 1]
        ok = (before[:live] >= 0) & (follow >= 0) & (follow < p)
        g = np.where(ok & (j >= 0), np.maximum(h[:live] - 1, 0), 0)
        open_ = np.flatnonzero((j >= 0) & (g < most))
        while len(open_):
            a, b = i[open_] + g[open_], j[open_] + g[open_]
            same = (a < n) & (b < n)
            same[same] = text[a[same]] == text[b[same]]
            open_ = open_[same]
            g[open_] += 1
            open_ = open_[g[open_] < most]
        lcp[p] = g
        h[:live], before[:live] = g, j
    return lcp


@dataclass
class Shard:
    """One suffix array: the sorted window starts, the group of each, where groups begin, the least document of each group, and each position's document."""

    order: np.ndarray
    group: np.ndarray
    heads: np.ndarray
    least: np.ndarray
    doc: np.ndarray


def shard(text: np.ndarray, size: np.ndarray, docs: np.ndarray) -> Shard:
    """Of text, which is pieces of the given sizes and documents one after the other."""
    window = np.ones(len(text), bool)  # all but the last of a piece
    ends = np.cumsum(size)
    for k in range(1, WINDOW):
        window[np.maximum(ends - k, ends - size)] = False
    window[ends[size < WINDOW] - 1] = False
    doc = np.repeat(docs, size)
    sa, _, close = suffix_array(text)
    order = sa[window[sa]]
    new = np.ones(len(order), bool)
    among = np.flatnonzero(close[order])
    new[among] = common_prefixes(text, order[among]) < WINDOW
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], heads) if len(heads) else docs[:0]
    return Shard(order, np.cumsum(new) - 1, heads, least, doc)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, so that comparing numbers compares them; zeros past the end."""
    padded = np.zeros(len(text) + WINDOW + 14, np.uint8)
    padded[: len(text)] = text
    out = padded[: len(text) + WINDOW + 7].astype(np.uint64)
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : len(out) + k]
    return out


def search(words: np.ndarray, sorted_at: np.ndarray, at: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the windows at `at` among those at sorted_at: where each belongs, and whether it stands there. Eight bytes at a time; head: the first eight at sorted_at, where they are known."""
    whole, rest = divmod(WINDOW, 8)
    head, own = words[sorted_at] if head is None else head, words[at]
    lo, hi = np.searchsorted(head, own, "left"), np.searchsorted(head, own, "right")
    live = np.flatnonzero(lo < hi)
    for c in range(1, whole + (rest > 0)):
        if not len(live):
            break
        mask = np.uint64(2**64 - 1) if c < whole else np.uint64((2**64 - 1) << (64 - 8 * rest) & (2**64 - 1))
        own = words[at[live] + 8 * c] & mask
        bounds = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                v = words[sorted_at[mid] + 8 * c] & mask
                up = v <= own[open_] if right else v < own[open_]
                a[open_[up]] = mid[up] + 1
                b[open_[~up]] = mid[~up]
                open_ = open_[a[open_] < b[open_]]
            bounds.append(a)
        lo[live], hi[live] = bounds
        live = live[bounds[0] < bounds[1]]
    met = np.zeros(len(at), bool)
    met[live] = True
    return lo, met


def merge(words: np.ndarray, shards: list[tuple[int, Shard]]) -> None:
    """Gives each group of the shards (offset in the text, shard) the least document that any of them has for its window."""
    places, entry, best, head, own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    for base, x in shards:
        at = base + x.order[x.heads]
        where, met = search(words, places, at, head) if len(places) else (np.zeros(len(at), np.int64), np.zeros(len(at), bool))
        mine = np.empty(len(at), np.int64)
        mine[met] = entry[where[met]]
        best[mine[met]] = np.minimum(best[mine[met]], x.least[met])
        mine[~met] = len(best) + np.arange((~met).sum())
        best = np.r_[best, x.least[~met]]
        more = where[~met]
        places, entry, head = np.insert(places, more, at[~met]), np.insert(entry, more, mine[~met]), np.insert(head, more, words[at[~met]])
        own.append(mine)
    for (_, x), mine in zip(shards, own, strict=True):
        x.least = best[mine]


def solve(strings: list[bytes], docs: np.ndarray, source: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that a string of a smaller document has too, in order. source, in order: the task that sent each string; without it all came from one."""
    step = MOST // 2  # a string longer than this is cut, the pieces overlapping by what makes every window whole in one of them
    string, offset, pieces = np.arange(len(strings)), np.zeros(len(strings), np.int64), strings
    if max(map(len, strings), default=0) > step:
        cut = [(i, a, x[a : a + step + WINDOW - 1]) for i, x in enumerate(strings) for a in range(0, max(1, len(x) - WINDOW + 1), step)]
        string, offset, pieces = np.array([p[0] for p in cut]), np.array([p[1] for p in cut]), [p[2] for p in cut]
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.r_[0, np.cumsum(size)]
    sent = None if source is None else source[string]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    shards, lo = [], 0
    while lo < len(pieces):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + MOST, "right")) - 1)
        if source is not None:
            enough = min(int(np.searchsorted(begin, begin[lo] + SHARD)), len(pieces)) - 1
            hi = min(hi, int(np.searchsorted(sent, sent[enough], "right")))
        shards.append((int(begin[lo]), shard(text[begin[lo] : begin[hi]], size[lo:hi], docs[string[lo:hi]])))
        lo = hi
    if len(shards) > 1:
        merge(words_at(text), shards)
    hit = np.zeros(len(text), bool)
    for base, x in shards:
        hit[base + x.order[x.least[x.group] < x.doc[x.order]]] = True
    at = np.flatnonzero(hit)
    piece = np.repeat(np.arange(len(pieces)), np.diff(np.searchsorted(at, begin)))
    return string[piece], at - begin[piece] + offset[piece]


def _split(texts: list[bytes]):
    flat = b"".join(texts)
    at = np.arange(len(flat) + 1)
    return np.frombuffer(flat, np.uint8).astype(np.uint64), np.array([len(x) for x in texts], np.int64), flat, at[:-1], at[1:]


BYTES = Kind(_split, GRAM, len, solve, ordered=True)


def _apply(texts: list[bytes], spans: list[np.ndarray]) -> list[pa.Array]:
    kept = []
    for text, s in zip(texts, spans, strict=True):
        edges = [0, *s.ravel().tolist(), len(text)]
        kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)))
    gone = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
    return [pa.array([len(x) for x in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary())]


def without_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `keep` columns with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary).

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id, judged on the
    input; matches never cross documents. Null text is empty; a null doc_id counts as larger than any other;
    rows with one doc_id don't take from each other. No rows give no rows.
    """
    return repeated(docs, BYTES, _apply, list(keep), "n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for digest() over documents: bytes as pairs of hex digits.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE doc_id > least),
new AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM new) GROUP BY doc_id, k),
told AS (SELECT doc_id, sum(e - b) AS n, count(*) AS k, string_agg(piece, '' ORDER BY b) AS pieces, max(e) AS last
    FROM (SELECT doc_id, b, e, substr(x, 2 * before + 1, 2 * (b - before)) AS piece FROM (SELECT span.*, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM span) JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
    sha256(unhex(concat(pieces, substr(x, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN told USING (doc_id)
"""
