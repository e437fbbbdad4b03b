"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints that stand in one block are stored as bit planes: word w of plane b holds bit b of
64 fingerprints. A query is compared with 64 fingerprints at a time; carry-save counters add one
plane after the other, and a word is abandoned once all its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import blobs, bounded, cut
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
BITS = 64
#: Parts of a fingerprint. Two fingerprints within the radius agree on all parts but `radius` at least.
PARTS = 4
#: A block with more members is cut into chunks, and pairs of chunks are compared in tasks of their own.
CHUNK = 4096
#: Rows compared at once.
ROWS = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of `text`, A-Z lower-cased: a bit is 1 if set in over half the XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint) of every row of docs (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in blobs(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def compare(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), first[i] <= i < j < last[i], of fps (uint64) that differ in `radius` bits or fewer."""
    n = len(fps)
    width = -(-n // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # (64, width)
    rows = np.flatnonzero(last > np.arange(n) + 1)
    begin, end = (rows + 1) >> 6, ((last[rows] - 1) >> 6) + 1
    cells = end - begin
    found_i, found_j = [], []
    stop = np.cumsum(cells)
    ones = np.uint64(2**64 - 1)
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(stop, (stop[done - 1] if done else 0) + (1 << 18), "right")))
        part = slice(done, upto)
        done = upto
        q = np.repeat(rows[part], cells[part])
        w = np.arange(len(q)) - np.repeat(np.cumsum(cells[part]) - cells[part], cells[part]) + np.repeat(begin[part], cells[part])
        low = np.clip(q + 1 - w * 64, 0, 64).astype(np.uint64)  # lanes below are no partners
        high = np.clip(last[q] - w * 64, 0, 64).astype(np.uint64)
        full = np.uint64(64)
        live = np.where(low < full, ones << np.minimum(low, np.uint64(63)), np.uint64(0)) & np.where(high > 0, ones >> np.minimum(full - high, np.uint64(63)), np.uint64(0))
        over = ~live
        count = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]  # the planes of the counters
        for b in range(BITS):
            carry = planes[b][w] ^ np.where((fps[q] >> np.uint64(b)) & np.uint64(1), ones, np.uint64(0))
            for k in range(len(count)):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry | _above(count, radius)
            if b % 8 == 7:
                keep = over != ones
                if not keep.any():
                    q = q[:0]
                    break
                if keep.sum() < 0.7 * len(q):
                    q, w, over, count = q[keep], w[keep], over[keep], [c[keep] for c in count]
        if len(q):
            lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            found_i.append(q[at])
            found_j.append(w[at] * 64 + lane)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, read over its planes, is above the radius."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], np.uint64(2**64 - 1))
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member that each of n members reaches over the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join the fingerprints within the radius to components, from reps (fp, rep), fp distinct.

    Fingerprints meet in a block for every choice of PARTS - radius parts on which they agree. Blocks over
    CHUNK members are cut into chunks by a hash and compared chunk against chunk. Each block
    gives a spanning star for each of its groups, never all pairs.
    """
    size = BITS // PARTS
    assert radius < PARTS, "more parts are needed for this radius"

    def key(parts: tuple[int, ...]):
        mask = sum(((1 << size) - 1) << (p * size) for p in parts)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))

    choices = list(combinations(range(PARTS), PARTS - radius))
    rows = reps.select("fp", "rep", F.posexplode(F.array(*map(key, choices))).alias("choice", "block"))
    sizes = rows.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    met = rows.join(sizes, ["choice", "block"]).withColumn("m", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.select(F.xxhash64("choice", "block", F.least("c", "other"), F.greatest("c", "other")).alias("at"), "choice", "block", F.least("c", "other").alias("x"), F.greatest("c", "other").alias("y"), "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def solve(a: np.ndarray) -> pa.RecordBatch | None:
            new = np.r_[True, (a[1:, :4] != a[:-1, :4]).any(axis=1)] if len(a) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            last = np.r_[starts[1:], len(a)][group]
            i, j = compare(np.ascontiguousarray(a[:, 4]).view(np.uint64), starts[group], last, radius)
            if not len(i):
                return None
            label = _stars(i, j, len(a))
            at = np.flatnonzero(label != np.arange(len(a)))
            return pa.RecordBatch.from_arrays([pa.array(a[at, 5]), pa.array(a[label[at], 5])], ["a", "b"])

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "block", "x", "y", "fp", "rep")], axis=1))
            rows += b.num_rows
            if rows >= ROWS:
                a = np.concatenate(held)
                change = np.flatnonzero((a[1:, :4] != a[:-1, :4]).any(axis=1))
                if len(change):
                    if (out := solve(a[: change[-1] + 1])) is not None:
                        yield out
                    a = a[change[-1] + 1 :]
                held, rows = [a], len(a)
        if held and (out := solve(np.concatenate(held))) is not None:
            yield out

    return pairs.repartition("at").sortWithinPartitions("choice", "block", "x", "y").drop("at").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Fingerprints link at `radius` differing bits or fewer; component_id is the smallest doc_id reachable.
    Null or empty texts have fingerprint zero and are linked like any other. Repeated rows come back as often
    as they are given; a row without a doc_id gets its group's id. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, shingle))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(reps.where("rep IS NOT NULL"), radius))
    groups = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies: shingles of five words, similarity of their sets.
COPY_SHINGLE = 5
SIMILARITY = 0.8
#: Of sets a and b: what they share against both together (Jaccard), or twice that against their sizes (Dice).
MEASURES = ("jaccard", "dice")
#: The radius within which the fingerprints of such texts lie: at a Jaccard similarity of 0.8 they differ in 10 bits on average with a deviation of 3, at a Dice similarity
#: of 0.8 in 13 with a deviation of 3.3. Texts of up to SHORT shingles, whose fingerprints scatter more, are decided by their sets whatever these are.
COPY_RADIUS = {"jaccard": 22, "dice": 27}
SHORT = 40
#: Bands of two minima each: texts of a Jaccard similarity of 0.8 share one of 8 with a probability of 0.9997, texts of a Dice similarity of 0.8 one of 14.
BANDS, ROWS_PER_BAND = {"jaccard": 8, "dice": 14}, 2
#: Bands up to which each phase compares; from the second on only blocks whose members the phases before have not brought together.
PHASES = (4,)
#: Members, and shingles of all members, of a block that is compared as one.
COPY_CHUNK, COPY_SHINGLES = 1024, 1 << 21
_MULTIPLY = np.random.default_rng(5).integers(1, 2**63, max(BANDS.values()) * ROWS_PER_BAND, dtype=np.uint64) | np.uint64(1)
#: A-Z in lower case and other ASCII signs but digits as blanks; letters beyond ASCII stay as they are.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: bytes, shingle: int = COPY_SHINGLE, plain: bool = False) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted. plain: of its words without ASCII punctuation, unless it has nothing else."""
    words = (plain and text.translate(_PLAIN).split()) or text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)), np.uint64, len(words) - shingle + 1))


def _set_id(h: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(h.tobytes(), 1)).view(np.int64)) if len(h) else 0


def _sketch(h: np.ndarray, bands: int) -> tuple[int, list[int]]:
    """Of a set of shingles: its SimHash and its band keys."""
    if not len(h):
        return 0, [0] * bands
    multiply = _MULTIPLY[: bands * ROWS_PER_BAND]
    ones, least = np.zeros(BITS, np.int64), np.full(len(multiply), np.uint64(2**64 - 1))
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
        x = part[None] * multiply[:, None]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    fp = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]
    keys = [xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(bands, ROWS_PER_BAND))]
    return int(fp), np.array(keys, np.uint64).view(np.int64).tolist()


#: Pairs and shared hashes whose sets are intersected at once.
PAIRS, COLUMNS = 1 << 13, 1 << 13


def _shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members the sets of each pair share: hashes that stand in several sets become bits, slice by slice."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros(len(i), np.int64)
    for lo in range(0, int(several.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        bits = np.zeros((len(sets), COLUMNS // 8), np.uint8)
        at = column[part] - lo
        np.bitwise_or.at(bits, (owner[part], at >> 3), (1 << (at & 7)).astype(np.uint8))
        words = bits.view(np.uint64)
        for k in range(0, len(i), PAIRS):
            both[k : k + PAIRS] += np.bitwise_count(words[i[k : k + PAIRS]] & words[j[k : k + PAIRS]]).sum(axis=1, dtype=np.int64)
    return both


def _verified(fps: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, band: int, chunk: np.ndarray, group: np.ndarray, radius: int, similarity: float, dice: bool) -> list[tuple[int, int]]:
    """Stars that span the groups of a block: pairs within the radius whose sets are similar enough.

    A pair is decided once: in the first band that it shares, where two chunks meet only across them, and if it isn't of one group yet.
    """
    n = len(fps)
    sizes = np.array([len(x) for x in sets], np.int64)
    i, j = compare(fps, np.zeros(n, np.int64), np.full(n, n), radius)
    if len(short := np.flatnonzero(sizes <= SHORT)) > 1:
        a, b = compare(np.zeros(len(short), np.uint64), np.zeros(len(short), np.int64), np.full(len(short), len(short)), 1)
        both = np.unique(np.r_[i * n + j, short[a] * n + short[b]])
        i, j = both // n, both % n
    least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = (2 * least >= similarity * (least + most) if dice else least >= similarity * most) & (group[i] != group[j])
    if chunk.min() != chunk.max():
        keep &= chunk[i] != chunk[j]
    for b in range(band):
        keep &= bands[i, b] != bands[j, b]
    i, j = i[keep], j[keep]
    both = _shared_counts(sets, i, j)
    linked = 2 * both >= similarity * (sizes[i] + sizes[j]) if dice else both >= similarity * (sizes[i] + sizes[j] - both)
    label = _stars(i[linked], j[linked], n)
    return [(k, int(label[k])) for k in np.flatnonzero(label != np.arange(n)).tolist()]


def _linked(met: DataFrame, known: DataFrame, radius: int, similarity: float, dice: bool) -> DataFrame:
    """Edges (a, b) from members (sid, fp, bands, grp, band, key, m, c) of blocks and their sets (sid, grams)."""
    pairs = met.join(known, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.select("band", "key", F.least("c", "other").alias("x"), F.greatest("c", "other").alias("y"), "c", "bands", "fp", F.col("sid").alias("rep"), "grp", "grams")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def block() -> pa.RecordBatch:
            if len(held) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            chunk, bands, fps, group = (np.array([h[k] for h in held], np.int64) for k in (3, 4, 0, 5))
            out = _verified(fps.view(np.uint64), [np.frombuffer(h[2], np.uint32) for h in held], bands, at[0], chunk, group, radius, similarity, dice)
            return pa.RecordBatch.from_arrays([pa.array([held[p[k]][1] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("band", "key", "x", "y", "fp", "rep", "grams", "c", "bands", "grp")]
            for *where, fp, rep, g, c, own, group in zip(*cols, strict=True):
                if where != at:
                    if held:
                        yield block()
                    at, held = where, []
                held.append((fp, rep, g, c, own, group))
        if held:
            yield block()

    return pairs.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y").mapInArrow(solve, "a long, b long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE, radius: int | None = None, measure: str = "jaccard", plain: bool = False) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text): groups linked by the similarity of their sets of word shingles.

    measure: see MEASURES. plain: words without ASCII punctuation, A-Z in lower case. Texts of one shingle set are one member. Members meet in a block for each band of minima
    they share; there fingerprints are compared bit-sliced, and pairs within the radius are decided by their sets (32 bits of each hash: two
    sets of 1,000 share one by chance once in 4,000 pairs). The first bands settle most groups; in later phases only blocks that still hold several
    groups are looked at, and sets travel for these alone. A block over COPY_CHUNK members or COPY_SHINGLES shingles is compared chunk
    against chunk. Rows of one doc_id are each judged by their text; null and empty texts are copies of one another. component_id is the group's
    smallest doc_id; a row without a doc_id has none unless another with one has its set of shingles.
    """
    rows, groups = _groups(docs, similarity, shingle, radius, measure, plain)
    return rows.select("doc_id", "sid").join(groups.select("sid", "component_id"), "sid", "left").select("doc_id", "component_id")


def _groups(docs: DataFrame, similarity: float, shingle: int, radius: int | None, measure: str, plain: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc_id, tid, sid), tid a hash of the text and sid of its shingles, and (sid, comp, component_id) of the sets that have a doc_id."""
    dice, bands = MEASURES.index(measure) == 1, BANDS[measure]
    radius = COPY_RADIUS[measure] if radius is None else radius

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [grams(x, shingle, plain) for x in blobs(b, "text")]
            rows = [_sketch(h, bands) for h in hs]
            cols = [b.column("doc_id"), b.column("tid"), pa.array([_set_id(h) for h in hs], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(h) for h in hs], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tid", "sid", "fp", "n", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [grams(x, shingle, plain) for x in blobs(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in hs], pa.int64()), pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in hs], pa.binary())], ["sid", "grams"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(base.withColumn("tid", F.xxhash64("text")).mapInArrow(sketch, "doc_id long, tid long, sid long, fp long, n long, bands array<long>"))
    reps = rows.where("doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))

    def edges(which: Column, grouped: DataFrame) -> DataFrame:
        """Of the bands that `which` chooses, from grouped: reps with their group so far."""
        banded = grouped.select("sid", "doc", "fp", "n", "bands", "grp", F.posexplode("bands").alias("band", "key")).where(which)
        sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
        m = F.ceil(F.greatest(F.col("members") / COPY_CHUNK, F.col("shingles") / COPY_SHINGLES)).cast("int")
        met = cut(banded.join(sizes, ["band", "key"]).select("sid", "doc", "fp", "bands", "grp", "band", "key", m.alias("m"), F.pmod(F.xxhash64("sid"), m).cast("int").alias("c")))
        wanted = met.select(F.col("doc").alias("doc_id")).distinct()
        known = base.join(bounded(wanted, 16), "doc_id", "left_semi").mapInArrow(sets, "sid long, grams binary").groupBy("sid").agg(F.first("grams").alias("grams"))
        return _linked(met, known, radius, similarity, dice)

    found = None
    for lo, hi in pairwise([0, *(p for p in PHASES if p < bands), bands]):
        grouped = reps.withColumn("grp", F.col("sid")) if found is None else reps.join(found, F.col("sid") == found.node, "left").select(*reps.columns, F.coalesce("component", "sid").alias("grp"))
        new = edges((F.col("band") >= lo) & (F.col("band") < hi), grouped)
        found = cut(components(new if found is None else new.union(found.select("node", "component"))))
    grouped = reps.select("sid", "doc").join(found, F.col("sid") == found.node, "left").select("sid", "doc", F.coalesce("component", "sid").alias("comp"))
    least = grouped.groupBy("comp").agg(F.min("doc").alias("component_id"))
    return rows.select("doc_id", "tid", "sid"), grouped.select("sid", "comp").join(least, "comp").select("sid", "comp", "component_id")


def first_texts(docs: DataFrame, similarity: float = SIMILARITY, measure: str = "jaccard", plain: bool = False) -> DataFrame:
    """One row of each group of near copies, all columns, of any type: that of the smallest doc_id, of its texts in the group the one of the least hash. Rows without a doc_id stay.

    Rows of one doc_id whose texts aren't near copies each stay. Of rows with one doc_id and text the one of the least hash of all columns stays.
    Texts aren't shuffled for this but for such rows.
    """
    rows, groups = _groups(docs, similarity, COPY_SHINGLE, None, measure, plain)
    known = rows.where("doc_id IS NOT NULL")
    by_set = known.groupBy("sid").agg(F.min(F.struct("doc_id", "tid")).alias("first"))
    firsts = by_set.join(groups, "sid").groupBy("comp").agg(F.min("first").alias("first")).select("first.doc_id", "first.tid")
    times = known.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n"))
    kept = cut(firsts.join(times, ["doc_id", "tid"]).select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid"), (F.col("n") > 1).alias("__several")))
    own = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__tid"))
    if kept.where("__several").isEmpty():
        out = docs.join(kept, own, "left_semi")
    else:
        out = docs.join(kept.where("NOT __several"), own, "left_semi")
        again = docs.join(kept.where("__several"), own)
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = again.groupBy("__doc", "__tid").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__row"))
        out = out.unionByName(one.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns)))
    return out.unionByName(docs.where("doc_id IS NULL"))


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY, measure: str = "jaccard", plain: bool = False) -> DataFrame:
    """first_texts(), with one row of each doc_id: of several texts of it the least, whose columns can be ordered."""
    kept = first_texts(docs, similarity, measure, plain)
    whole = F.struct(*(F.col(f"`{c}`") for c in ["text", *(c for c in docs.columns if c not in ("text", "doc_id"))]))
    one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(whole).alias("__row")).select(*(F.col("doc_id") if c == "doc_id" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
    return one.unionByName(kept.where("doc_id IS NULL"))
