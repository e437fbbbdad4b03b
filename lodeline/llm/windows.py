"""Runs of units (words or bytes) that recur across documents, found by super-k-mer partitioning.

A window is WINDOW consecutive units of one document; its minimiser is the smallest hash of the grams in it.
Equal windows have equal minimisers, so they meet wherever windows are dealt by minimiser, and
consecutive windows with one minimiser travel as one packed string.

1. Every document gives its minimisers. One that two documents of a task hold is known to be shared at once; others
   meet in buckets. Those of one document only can't belong to a shared window; they end here.
2. Documents are joined with their shared minimisers and give the packed strings around them. Windows that a task holds
   twice are decided before the shuffle, so that a passage in a third of all rows travels once a task.
3. A bucket decides its windows exactly (the caller's solver) and gives back spans. A minimiser of very many documents would
   make one bucket large, as the strings around it differ where the passage ends: its windows are dealt by their own hashes of 128 bits.
4. Spans are joined with the documents and taken out.

Buckets are counted from the bytes of text, one a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, blobs, shuffle_partitions, sliced, stored

WINDOW = 50
#: Bytes of text worked on at once; the arrays over them take some 60 times as much.
STEP = 1 << 19
#: Bytes of text for each bucket.
BUCKET = 8 << 20
#: Documents from which on a minimiser's windows are dealt by themselves, at least; and the bytes of text for each such document,
#: so that at most 2**20 minimisers are told to all tasks (there are 8 bytes or more for each that a document has).
HOT, HOT_SHARE = 4096, 1 << 23
#: Bytes of packed strings that a task holds back before it writes them.
HOLD = 12 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def gram_hashes(u: np.ndarray, m: int) -> np.ndarray:
    """A hash for each m consecutive units; hashes of powers of two are joined, overlapping for other m."""
    h, size = mix(u), 1
    while size * 2 <= m:
        h = h[:-size] * _A + (h[size:] ^ (h[size:] >> np.uint64(31))) * _B
        size *= 2
    if size < m:
        d = m - size
        h = h[:-d] * _A + (h[d:] ^ (h[d:] >> np.uint64(31))) * _B
    return mix(h)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


@dataclass(frozen=True)
class Kind:
    """What a unit is. split: texts to (units as uint64, units per text, bytes to cut strings from, where each unit begins there, and ends)."""

    split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]
    gram: int
    #: How many units a string has.
    units: Callable[[bytes], int]
    #: (strings, document of each; where strings are kept in order also the task that sent each) -> (string, offset) of the windows that a smaller document has, in order.
    solve: Callable[..., tuple[np.ndarray, np.ndarray]]
    #: Whether strings are kept in order: tasks then settle what their texts share by the solver, and merge sorted runs of strings; else equal strings meet in a table.
    ordered: bool = False


def super_kmers(units: np.ndarray, sizes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: (text, first unit over all texts, windows, mixed minimiser)."""
    none = np.zeros(0, np.int64)
    if len(units) < WINDOW or not (sizes >= WINDOW).any():
        return none, none, none, none.astype(np.uint64)
    least = sliding_min(gram_hashes(units, gram), WINDOW - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[text])
    value = least[at]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])])
    return text[at[first]], at[first], np.diff(np.r_[first, len(at)]), mix(value[first])


def _ranges(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of a batch that have about STEP bytes of text together."""
    return sliced([range(n or 0) for n in pa.compute.binary_length(b.column("text")).to_pylist()], STEP)


def _place(value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and a key of 64 bits that names the minimiser: bucket, then 32 of its own bits."""
    part = ((value >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    return part, (part.astype(np.uint64) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))


def _grouped(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(by[rows[0]]), rows


def _packed(**arrays: np.ndarray | bytes) -> bytes:
    out = b"".join(len(x := (v if isinstance(v, bytes) else v.tobytes())).to_bytes(8, "little") + x for v in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(out)


def _unpacked(blob: bytes, *kinds: type | None) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        x = raw[at + 8 : at + 8 + n]
        out.append(x if k is None else np.frombuffer(x, k))
        at += 8 + n
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, sorted, those that touch or overlap as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # The running end within a document: shift documents apart so that one accumulate does for all.
    gap = np.int64(max(int(end.max()), 0) + 1)
    rank = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) * gap
    reach = np.maximum.accumulate(end + rank)
    new = np.flatnonzero(np.r_[True, (start + rank)[1:] > reach[:-1]])
    new = np.union1d(new, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))
    stop = np.r_[new[1:], len(doc)] - 1
    return doc[new], start[new], (reach - rank)[stop]


def window_hashes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the window that starts at each unit."""
    return gram_hashes(units, WINDOW), gram_hashes(units * _B ^ _C, WINDOW)


def _span_rows(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(did, tid, spans) of documents given as rows of ids (did, tid)."""
    doc, start, end = merged(doc, start, end)
    pairs = np.stack([start, end], axis=1).astype(np.int64)
    for d, rows in _grouped(doc):
        yield int(ids[d, 0]), int(ids[d, 1]), pairs[rows].tobytes()


def _routed(rows: list[tuple[int, int, bytes]], parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows of (did, tid, data), packed for the bucket of each document: as many rows as buckets, not as documents."""
    if not rows:
        return
    ids = np.array([x[:2] for x in rows], np.int64)
    for p, r in _grouped((mix((ids[:, 0] ^ (ids[:, 1] & SLOTS)).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)):
        data = [rows[i][2] for i in r.tolist()]
        yield p, _packed(ids=ids[r], size=np.array([len(x) for x in data], np.int64), data=b"".join(data))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (did, tid, data) for each document of a task's buckets, the data of its rows put together."""
    held: dict[tuple[int, int], list[bytes]] = {}
    for b in batches:
        for pack in b.column("pack").to_pylist():
            ids, size, data = _unpacked(pack, np.int64, np.int64, None)
            stop = np.cumsum(size).tolist()
            for (did, tid), n, e in zip(ids.reshape(-1, 2).tolist(), size.tolist(), stop, strict=True):
                held.setdefault((did, tid), []).append(data[e - n : e])
    keys = list(held)
    for i in range(0, len(keys), 5000):
        part = keys[i : i + 5000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([k[1] for k in part]), pa.array([b"".join(held.pop(k)) for k in part], pa.binary())], ["did", "tid", "data"])


def _by_document(key: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(did, slot, keys) for each row of ids that doc names."""
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return [(int(ids[doc[s], 0]), int(ids[doc[s], 1]) & SLOTS, key[s:e].tobytes()) for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False)]


def _anchors(kind: Kind, parts: int):
    """Kind 0: for a bucket, the minimisers that one document of the task has, with it, and those that several have. Kind 1: the latter told to these documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        ids: list[tuple[int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            key, doc, table = np.concatenate(keys), np.concatenate(docs), np.array(ids, np.int64).reshape(-1, 2)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
            key, doc = key[new], doc[new]
            rows: list[tuple] = []
            if len(key):
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                size = np.diff(np.r_[first, len(key)])
                did = table[doc, 0]
                several = np.minimum.reduceat(did, first) != np.maximum.reduceat(did, first)
                many = np.repeat(several, size)
                rows += [(1, p, x) for p, x in _routed(_by_document(key[many], doc[many], table), parts)]
                key_s, size_s = key[first[several]], size[several].astype(np.uint32)
                key_1, doc_1 = key[~many], doc[~many]
                order = np.argsort(doc_1, kind="stable")
                key_1, doc_1 = key_1[order], doc_1[order]
                alone = dict(_grouped((key_1 >> np.uint64(32)).astype(np.int64)))
                shared = dict(_grouped((key_s >> np.uint64(32)).astype(np.int64)))
                none = np.zeros(0, np.int64)
                for p in sorted({*alone, *shared}):
                    r, q = alone.get(p, none), shared.get(p, none)
                    own, n = np.unique(doc_1[r], return_counts=True)
                    rows.append((0, p, _packed(keys=key_1[r].astype(np.uint32), n=n.astype(np.uint32), dids=table[own, 0], slots=(table[own, 1] & SLOTS).astype(np.uint16), several=key_s[q].astype(np.uint32), size=size_s[q])))
            for x in (keys, docs, ids):
                x.clear()
            held = 0
            return _pack_rows(rows)

        for b in batches:
            dids, tids = b.column("did").to_pylist(), b.column("tid").to_pylist()
            for lo, hi in _ranges(b):
                units, sizes, *_ = kind.split(blobs(b.slice(lo, hi - lo), "text"))
                text, _, _, value = super_kmers(units, sizes, kind.gram)
                keys.append(_place(value, parts)[1])
                docs.append(text + len(ids))
                ids += zip(dids[lo:hi], tids[lo:hi], strict=True)
                held += 16 * len(text)
                if held > HOLD:
                    yield flush()
        if ids:
            yield flush()

    return run


def _shared(parts: int, hot: int):
    """Kind 1: the keys that two documents or more have, by document. Kind 3: keys of `hot` documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, ids, several, sizes, base = [], [], [], [], [], 0
        for b in batches:
            told = []
            for kind, part, pack in zip(b.column("kind").to_pylist(), b.column("part").to_pylist(), b.column("pack").to_pylist(), strict=True):
                if kind:
                    told.append((1, part, pack))
                    continue
                k, n, d, s, more, size = _unpacked(pack, np.uint32, np.uint32, np.int64, np.uint16, np.uint32, np.uint32)
                over = np.uint64(part) << np.uint64(32)
                keys.append(over | k.astype(np.uint64))
                docs.append(np.repeat(np.arange(len(d)) + base, n))
                base += len(d)
                ids.append(np.stack([d, s.astype(np.int64)], axis=1))
                several.append(over | more.astype(np.uint64))
                sizes.append(size.astype(np.int64))
            if told:
                yield _pack_rows(told)
        if not keys:
            return
        key, doc, table = np.concatenate(keys), np.concatenate(docs), np.concatenate(ids)
        more, size = np.concatenate(several), np.concatenate(sizes)
        del keys, docs, ids, several, sizes
        every, at = np.unique(np.r_[key, more], return_inverse=True)
        did = table[doc, 0]
        least, most = np.full(len(every), NULL_ID), np.full(len(every), np.iinfo(np.int64).min)
        np.minimum.at(least, at[: len(key)], did)
        np.maximum.at(most, at[: len(key)], did)
        shared = least < most
        shared[at[len(key) :]] = True
        times = np.bincount(at, weights=np.r_[np.ones(len(key)), size], minlength=len(every))
        keep = shared[at[: len(key)]]
        yield _pack_rows([(1, p, x) for p, x in _routed(_by_document(key[keep], doc[keep], table), parts)])
        if (often := every[times >= hot]).size:
            yield _pack_rows([(3, 0, often.tobytes())])

    return run


#: kind 0: for a bucket of minimisers; 1: for a bucket of documents; 2: windows for a bucket of their hashes; 3: keys for the driver.
_PACKS = "kind int, part int, pack binary"
#: A document's slot, the last bits of its text's hash: texts of one id lie apart.
SLOTS = 0xFFFF


def _pack_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "part", "pack"])


def _hits(one: np.ndarray, two: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows given by two hashes and their document: which a smaller document has too, and which to keep for others (the smallest document's)."""
    order = np.lexsort((did, two, one))
    o, t, d = one[order], two[order], did[order]
    first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])])
    later = d > np.repeat(d[first], np.diff(np.r_[first, len(d)]))
    return order[later], order[~later]


def _cut_out(kind: Kind, parts: int, hot: np.ndarray):
    """The packed strings around shared minimisers, and the windows of hot ones, but for what the task itself decides: those are spans already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        seen: dict[bytes, int] = {}
        strings: list[bytes] = []
        about: list[tuple[int, int, int, int]] = []  # row of ids, first unit, windows, bucket
        gone: list[np.ndarray] = []  # (row of ids, first unit, end)
        alone: list[tuple[np.ndarray, ...]] = []  # of windows: two hashes, row of ids, first unit
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = np.array(ids, np.int64).reshape(-1, 2)
            rows: list[tuple] = []
            if alone:
                one, two, row, at = (np.concatenate([x[i] for x in alone]) for i in range(4))
                later, kept = _hits(one, two, table[row, 0])
                gone.append(np.stack([row[later], at[later], at[later] + WINDOW], axis=1))
                for p, r in _grouped((one[kept] % np.uint64(parts)).astype(np.int64)):
                    r = kept[r]
                    own, doc = np.unique(row[r], return_inverse=True)
                    rows.append((2, p, _packed(ids=table[own], doc=doc.astype(np.uint32), one=one[r], two=two[r], at=at[r].astype(np.int64))))
            if about:
                a = np.array(about, np.int64)
                for p, r in _grouped(a[:, 3]):
                    if kind.ordered:
                        r, same = _sorted([strings[i] for i in r.tolist()], r)
                        least = np.minimum.reduceat(table[a[r, 0], 0], np.flatnonzero(np.diff(same, prepend=-1)))[same]
                        later = r[table[a[r, 0], 0] > least]
                        gone.append(np.stack([a[later, 0], a[later, 1], a[later, 1] + a[later, 2] + WINDOW - 1], axis=1))
                        r = r[table[a[r, 0], 0] == least]
                    own, doc = np.unique(a[r, 0], return_inverse=True)
                    content = [strings[i] for i in r]
                    rows.append((0, p, _packed(ids=table[own], doc=doc.astype(np.uint32), start=a[r, 1], size=np.array([len(x) for x in content], np.int32), content=b"".join(content))))
            if gone:
                g = np.concatenate(gone)
                rows += [(1, p, x) for p, x in _routed(list(_span_rows(table, g[:, 0], g[:, 1], g[:, 2])), parts)]
            for x in (ids, strings, about, gone, alone):
                x.clear()
            seen.clear()
            held = 0
            for i in range(0, len(rows), 2000):
                yield _pack_rows(rows[i : i + 2000])

        for b in batches:
            dids, tids = b.column("did").to_pylist(), b.column("tid").to_pylist()
            for lo, hi in _ranges(b):
                shared = b.column("keys").slice(lo, hi - lo).to_pylist()
                units, sizes, content, begin, end = kind.split(blobs(b.slice(lo, hi - lo), "text"))
                text, first, count, value = super_kmers(units, sizes, kind.gram)
                part, key = _place(value, parts)
                offset, base = np.cumsum(sizes) - sizes, len(ids)
                ids += zip(dids[lo:hi], tids[lo:hi], strict=True)
                held += 100 * (hi - lo)
                here, stop = np.searchsorted(text, np.arange(hi - lo)), np.searchsorted(text, np.arange(hi - lo), "right")
                wanted = np.zeros(len(text), bool)
                for t in np.flatnonzero(stop > here).tolist():
                    wanted[here[t] : stop[t]] = np.isin(key[here[t] : stop[t]], np.frombuffer(shared[t], np.uint64))
                if len(hot) and (often := wanted & np.isin(key, hot)).any():
                    wanted &= ~often
                    at = np.repeat(first[often] - (np.cumsum(count[often]) - count[often]), count[often]) + np.arange(count[often].sum())
                    doc = np.repeat(text[often], count[often])
                    one, two = window_hashes(units)
                    alone.append((one[at], two[at], base + doc, at - offset[doc]))
                    held += 64 * len(at)
                rows = np.flatnonzero(wanted)
                if kind.ordered and len(rows):
                    _, at, times = np.unique(key[rows], return_inverse=True, return_counts=True)
                    first, count, some = first.copy(), count.copy(), rows[times[at] > 1]
                    if len(some):  # only what has a minimiser in common can be equal
                        first[some], count[some], hit, doc = _met(kind, content, begin, end, len(units), text[some], first[some], count[some], np.array(dids[lo:hi], np.int64), offset)
                        gone.append(np.stack([base + doc, hit, hit + WINDOW], axis=1))
                    rows = rows[count[rows] > 0]
                    last = first[rows] + count[rows] + WINDOW - 2
                    own = [content[s:e] for s, e in zip(begin[first[rows]].tolist(), end[last].tolist(), strict=True)]
                    strings += own
                    about += zip((base + text[rows]).tolist(), (first[rows] - offset[text[rows]]).tolist(), count[rows].tolist(), part[rows].tolist(), strict=True)
                    held += sum(map(len, own)) + 100 * len(own)
                elif len(rows):
                    last = first[rows] + count[rows] + WINDOW - 2
                    took = []
                    for s, e, t, u, n, p in zip(begin[first[rows]].tolist(), end[last].tolist(), text[rows].tolist(), (first[rows] - offset[text[rows]]).tolist(), count[rows].tolist(), part[rows].tolist(), strict=True):
                        x, doc = content[s:e], base + t
                        i = seen.get(x)
                        if i is not None and ids[about[i][0]][0] != dids[lo + t]:
                            if dids[lo + t] > ids[about[i][0]][0]:
                                took.append((doc, u, u + n + WINDOW - 1))
                                continue
                            d, v, m, _ = about[i]
                            took.append((d, v, v + m + WINDOW - 1))
                            about[i] = (doc, u, n, p)
                            continue
                        if i is None:
                            seen[x] = len(strings)
                        strings.append(x)
                        about.append((doc, u, n, p))
                        held += len(x) + 100
                    if took:
                        gone.append(np.array(took, np.int64))
                if held > HOLD:
                    yield from flush()
        yield from flush()

    return run


def _sorted(strings: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows in the order of their strings, and a number for each that equal strings share. Strings that come as sorted runs are merged: the sort gallops through them by binary search."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    new = np.fromiter((strings[a] != strings[b] for a, b in zip(order, order[1:], strict=False)), bool, max(len(order) - 1, 0))
    return rows[order], np.cumsum(np.r_[False, new])


def _met(kind: Kind, content: bytes, begin: np.ndarray, end: np.ndarray, n: int, text: np.ndarray, first: np.ndarray, count: np.ndarray, did: np.ndarray, offset: np.ndarray):
    """What the solver says of the stretches of text that runs of windows make up: the runs cut to the windows that no smaller document of these texts has
    (count 0: none), the others' starts in their texts, and their texts."""
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (first[1:] != first[:-1] + count[:-1])])
    stop = np.r_[new[1:], len(first)] - 1
    strings = [content[s:e] for s, e in zip(begin[first[new]].tolist(), end[first[stop] + count[stop] + WINDOW - 2].tolist(), strict=True)]
    free = np.ones(n + 1, bool)
    string, hits = kind.solve(strings, did[text[new]])
    free[first[new][string] + hits] = False
    hit = np.flatnonzero(~free)
    doc = np.searchsorted(offset, hit, "right") - 1  # the last text that begins at or before; empty ones have no windows
    places = np.flatnonzero(free)
    lo, hi = np.searchsorted(places, first), np.searchsorted(places, first + count) - 1
    left = hi >= lo
    begins = places[np.minimum(lo, len(places) - 1)]
    return begins, np.where(left, places[hi] - begins + 1, 0), hit - offset[doc], doc


def _decide(kind: Kind, parts: int):
    """The spans of a task's buckets, packed for the buckets of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[bytes] = []
        alone: list[bytes] = []
        for b in batches:
            told = []
            for k, p, x in zip(b.column("kind").to_pylist(), b.column("part").to_pylist(), b.column("pack").to_pylist(), strict=True):
                if k == 1:
                    told.append((1, p, x))
                else:
                    (alone if k else packs).append(x)
            if told:
                yield _pack_rows(told)
        for solve, own in ((_bucket, packs), (_windows, alone)):
            if own:
                yield _pack_rows([(1, p, x) for p, x in _routed(solve(kind, own), parts)])

    return run


def _windows(kind: Kind, packs: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(did, tid, spans) of windows given by their hashes."""
    ids, parts, base = [], [], 0
    for p in packs:
        own, doc, one, two, at = _unpacked(p, np.int64, np.uint32, np.uint64, np.uint64, np.int64)
        ids.append(own.reshape(-1, 2))
        parts.append((doc.astype(np.int64) + base, one, two, at))
        base += len(ids[-1])
    table = np.concatenate(ids)
    doc, one, two, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    later, _ = _hits(one, two, table[doc, 0])
    return list(_span_rows(table, doc[later], at[later], at[later] + WINDOW))


def _bucket(kind: Kind, packs: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(did, tid, spans) of one bucket. Equal strings are decided once: only the smallest document's is looked into."""
    ids, docs, starts, strings, sent, base = [], [], [], [], [], 0
    for k, p in enumerate(packs):
        own, doc, start, size, content = _unpacked(p, np.int64, np.uint32, np.int64, np.int32, None)
        ids.append(own.reshape(-1, 2))
        docs.append(doc.astype(np.int64) + base)
        base += len(ids[-1])
        starts.append(start)
        sent.append(np.full(len(start), k))
        stop = np.cumsum(size).tolist()
        strings += [content[e - n : e] for n, e in zip(size.tolist(), stop, strict=True)]
    table, doc, start = np.concatenate(ids), np.concatenate(docs), np.concatenate(starts)
    did = table[doc, 0]
    if kind.ordered:
        order, number = _sorted(strings, np.arange(len(strings)))
        same = np.empty(len(strings), np.int64)
        same[order] = number
    else:
        seen: dict[bytes, int] = {}
        same = np.fromiter((seen.setdefault(x, len(seen)) for x in strings), np.int64, len(strings))
    least = np.full(int(same.max()) + 1, NULL_ID)
    np.minimum.at(least, same, did)
    later = np.flatnonzero(did > least[same])
    windows = np.array([kind.units(strings[i]) for i in later.tolist()], np.int64)
    lead = np.flatnonzero(did == least[same])  # several rows or places of the smallest document may have a string
    lead = lead[np.argsort(same[lead], kind="stable")]
    first = np.flatnonzero(np.diff(same[lead], prepend=-1))
    if kind.ordered:  # each task's strings lie together
        by = np.argsort(np.concatenate(sent)[lead[first]], kind="stable")
        string, offset = kind.solve([strings[i] for i in lead[first[by]].tolist()], did[lead[first[by]]], np.concatenate(sent)[lead[first[by]]])
        string = by[string]
    else:
        string, offset = kind.solve([strings[i] for i in lead[first].tolist()], did[lead[first]])
    # Every row of a string has its hits.
    size = np.diff(np.r_[first, len(lead)])[string]
    row = lead[np.repeat(first[string], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    at = start[row] + np.repeat(offset, size)
    return list(_span_rows(table, np.r_[doc[later], doc[row]], np.r_[start[later], at], np.r_[start[later] + windows, at + WINDOW]))


def repeated(docs: DataFrame, kind: Kind, apply: Callable, keep: list[str], schema: str) -> DataFrame:
    """docs' `keep` columns and what `apply(texts, spans)` makes of each text and its (n, 2) spans in units.

    The text is shuffled once, by document, for both joins.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET))
    own = [F.col(f"own{i}") if c != "doc_id" or docs.schema[c].dataType != T.LongType() else F.when(F.col("slot") % 2 == 0, F.col("did")) for i, c in enumerate(keep)]
    own = [c.alias(f"keep{i}") for i, c in enumerate(own)]
    # Without columns of its own the second join takes the same exchange of the text as the first; an id that was null is told by the hash's last bit.
    tid = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), tid.alias("tid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"own{i}") for i, c in enumerate(keep) if c != "doc_id" or docs.schema[c].dataType != T.LongType()))
    base = base.withColumn("slot", F.col("tid").bitwiseAND(F.lit(SLOTS)))
    found = base.select("did", "tid", "text").mapInArrow(_anchors(kind, n), _PACKS).repartitionById(n, "part")
    found = stored(found.mapInArrow(_shared(n, max(HOT, size // HOT_SHARE)), _PACKS))
    hot = np.sort(np.frombuffer(b"".join(r.pack for r in found.where("kind = 3").select("pack").collect()), np.uint64))
    gathered = "did long, tid long, data binary"
    by_doc = found.where("kind = 1").repartitionById(n, "part").mapInArrow(_gathered, gathered).select("did", F.col("tid").alias("slot"), F.col("data").alias("keys"))
    near = base.join(by_doc, ["did", "slot"]).select("did", "tid", "text", "keys")
    spans = near.mapInArrow(_cut_out(kind, n, hot), _PACKS).repartitionById(n, "part").mapInArrow(_decide(kind, n), _PACKS)
    by_doc = spans.repartitionById(n, "part").mapInArrow(_gathered, gathered).groupBy("did", F.col("tid").bitwiseAND(F.lit(SLOTS)).alias("slot")).agg(F.collect_list(F.struct("tid", F.col("data").alias("spans"))).alias("spans"))
    whole = base.join(by_doc, ["did", "slot"], "left").select("text", F.transform(F.filter("spans", lambda s: s.tid == F.col("tid")), lambda s: s.spans).alias("spans"), *own)
    kept = [f for f in docs.select(*keep).schema]
    out = T.StructType([T.StructField(f"keep{i}", f.dataType) for i, f in enumerate(kept)] + list(T._parse_datatype_string(schema)))
    names = out.names[len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = apply(blobs(b, "text"), [_joined(x) for x in b.column("spans").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(f"keep{i}") for i in range(len(keep))] + made, [f"keep{i}" for i in range(len(keep))] + names)

    return whole.mapInArrow(run, out).toDF(*keep, *names)


def _joined(spans: list[bytes] | None) -> np.ndarray:
    if not spans:
        return np.zeros((0, 2), np.int64)
    a = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    _, s, e = merged(np.zeros(len(a), np.int64), a[:, 0], a[:, 1])
    return np.stack([s, e], axis=1)
