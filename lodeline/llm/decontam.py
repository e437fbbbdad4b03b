"""Benchmark decontamination in DataFrame functions only.

A document's windows as long as a benchmark item get a SimHash; multi-index Hamming blocks find the items of that size
whose fingerprint lies within the radius, and an exact weighted-shingle similarity decides. Only windows whose
shingles, as far as items of the size have them, weigh as much as the similarity asks of one of these come so far: others can't reach it, so nothing is lost.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, cut

SHINGLE = 5
SIMILARITY = 0.8
#: Windows of similarity 0.8 differ from the item in 10 bits on average, with a deviation of 3.
RADIUS = 22
#: Blocks of a fingerprint; within the radius one block at least differs in RADIUS // BLOCKS bits or fewer.
BLOCKS = 8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _grams(words: Column, size: int) -> Column:
    """Hashes of each `size` consecutive words; fewer words have none."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _hashed(text: Column) -> Column:
    """The words' hashes."""
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _shingles(hashes: str) -> Column:
    """Hashes of each SHINGLE consecutive words, from the words' hashes (a column's name)."""
    n = F.size(hashes)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def _sums(shingles: str, lane: int) -> Column:
    """How many of the shingles, repeats included, have each bit: numbers of `lane` bits side by side, 64 / lane in a long."""
    mask = sum(1 << (lane * j) for j in range(64 // lane))

    def sums(k: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask)))

    return F.array(*map(sums, range(lane)))


def _printed(df: DataFrame, shingles: str, lane: int, name: str) -> DataFrame:
    """df with the SimHash of its shingles: a bit is 1 if set in over half of them. The sums are a column first, so that they are added up once."""
    df = df.withColumn("__sums", _sums(shingles, lane))
    fp = F.lit(0).cast("long")
    for bit in range(64):
        ones = F.shiftrightunsigned(F.col("__sums")[bit % lane], lane * (bit // lane)).bitwiseAND(F.lit((1 << lane) - 1))
        fp = fp.bitwiseOR(F.when(ones * 2 > F.size(shingles), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))).otherwise(F.lit(0).cast("long")))
    return df.withColumn(name, fp).drop("__sums")


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 64 // BLOCKS * b).bitwiseAND(F.lit((1 << 64 // BLOCKS) - 1)).cast("int")


def _short(base: DataFrame, items: DataFrame) -> DataFrame | None:
    """The leaks of items (iid, item_id, w) shorter than a shingle: an item is one shingle, so that its windows have a similarity of 1 or 0. None without items."""
    own = items.select("iid", "item_id", F.size("w").alias("n_words"), F.xxhash64("w").alias("h"))
    out = None
    for n in sorted(r.n_words for r in own.select("n_words").distinct().collect()):
        grams = base.select("doc_id", F.xxhash64("doc_id", "text").alias("tid"), F.posexplode(_grams(_words(F.col("text")), n)).alias("p", "h"))
        met = grams.join(bounded(own.where(F.col("n_words") == n)), "h").groupBy("doc_id", "tid", "iid").agg(F.first("item_id").alias("item_id"), F.min("p").alias("start_word"))
        met = met.select("doc_id", "tid", "item_id", F.lit(1.0).alias("similarity"), "start_word", F.lit(n).alias("n_words"))
        out = met if out is None else out.unionByName(met)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, tid, item_id, similarity, start_word, n_words): the best window of each document and item that reaches `similarity`.

    An item is an item_id with the words of a text: other texts of the item_id are items of their own and give rows of their own, and so does each text without an item_id.

    Words are runs of letters and digits in lower case. A window has as many words as the item (a shorter
    document is one window). The similarity is the weighted Jaccard of five-word shingles with their counts; a shingle weighs
    ln(1 + items / items that have it), one of no item as one of a single item. Null texts and items without
    a word match nothing; an item of fewer than five words is one shingle, met by the same words in a document; a null doc_id is kept; rows with one doc_id and text give one row. tid tells texts of one doc_id apart.
    """
    width = 64 // BLOCKS
    most = radius // BLOCKS
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text").cast("string")).alias("w")).distinct()
    items = items.where(F.size("w") > 0).withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))
    items = cut(items.select(F.xxhash64("item_id", "w").alias("iid"), "item_id", "w", _shingles("wh").alias("ish")))
    short = items.where(F.size("ish") == 0)
    items = items.where(F.size("ish") > 0).drop("w")
    count, longest = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("ish")), F.lit(0))).first()
    lane = next(x for x in (8, 16, 32) if longest < 1 << x)  # a lane holds the greatest count
    n_items = F.lit(float(count))
    by_shingle = items.select("iid", F.explode("ish").alias("h")).groupBy("iid", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    weighed = cut(by_shingle.join(by_shingle.groupBy("h").agg(F.log1p(n_items / F.count(F.lit(1))).alias("weight")), "h"))
    about = weighed.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("h", "c", "weight"))).alias("parts"), (F.sum(F.col("c") * F.col("weight")) * (similarity - 1e-9)).alias("wanted"))
    marks = cut(_printed(items.join(about, "iid"), "ish", lane, "ifp").select("iid", "item_id", F.size("ish").alias("m"), "ifp", "parts", "wanted"))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("tid", F.xxhash64("doc_id", "text"))
    # The generator takes an expression, not a column: of a column Spark would infer a filter, and work out the words' hashes inside it for each shingle.
    grams = base.select("tid", _hashed(F.col("text")).alias("wh")).select("tid", F.greatest(F.size("wh") - SHINGLE + 1, F.lit(0)).alias("k"), F.posexplode(_shingles("wh")).alias("p", "h"))
    # Windows worth a fingerprint, by size alone: an item's shingles in a window weigh as much as the window can share with it at most, so none that reaches the
    # similarity of some item of its size is left out. A shingle that many items have counts once for each size.
    by_size = weighed.join(bounded(marks.select("iid", "m"), 16), "iid").select("m", "h", "weight").distinct()
    sizes = bounded(marks.groupBy("m").agg(F.min("wanted").alias("wanted")), 16)
    hits = grams.join(bounded(by_size, 24), "h").groupBy("tid", "m").agg(F.first("k").alias("k"), F.sum("weight").alias("got"), F.collect_list(F.struct("p", "weight")).alias("at"))
    hits = hits.join(sizes, "m").where("got >= wanted")
    last = F.greatest(F.col("k") - F.col("m"), F.lit(0))
    each = hits.select("tid", "m", "wanted", last.alias("last"), F.explode("at").alias("x"))
    each = each.select("tid", "m", "wanted", "x.weight", F.explode(F.sequence(F.least(F.greatest(F.col("x.p") - F.col("m") + 1, F.lit(0)), F.col("last")), F.least(F.col("x.p"), F.col("last")))).alias("s"))
    starts = each.groupBy("tid", "m", "s").agg(F.sum("weight").alias("got"), F.first("wanted").alias("wanted")).where("got >= wanted")
    found = cut(starts.groupBy("tid").agg(F.collect_set(F.struct("m", "s")).alias("starts")))
    size = found.agg(F.coalesce(F.sum(32 + 16 * F.size("starts")), F.lit(0))).first()[0]
    near = base.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "tid").groupBy("doc_id", "tid").agg(F.first("text").alias("text"), F.first("starts").alias("starts"))
    near = near.select("doc_id", "tid", "starts", _hashed(F.col("text")).alias("wh")).select("doc_id", "tid", _shingles("wh").alias("sh"), "starts")
    near = near.select("doc_id", "tid", "sh", F.explode("starts").alias("x")).select("doc_id", "tid", "sh", "x.m", "x.s")
    windows = near.select("doc_id", "tid", "m", "s", F.slice("sh", F.col("s") + 1, F.col("m")).alias("wsh"))
    printed = _printed(windows, "wsh", lane, "fp")

    # The index finds the items: every block of a window's fingerprint meets the same block of items of its size within `most` bits.
    flips = [0, *(sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(range(width), k))]
    probes = marks.select("m", "iid", "ifp", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("ifp"), b).alias("own")) for b in range(BLOCKS)))).alias("x"))
    probes = probes.select("m", "iid", "ifp", "x.block", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: f.bitwiseXOR(F.col("x.own")))).alias("key"))
    keyed = printed.select("*", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("key")) for b in range(BLOCKS)))).alias("x")).select("*", "x.block", "x.key").drop("x")
    met = keyed.join(bounded(probes, 40), ["m", "block", "key"])
    first = F.coalesce(*(F.when(F.bit_count(_block(F.col("fp"), b).bitwiseXOR(_block(F.col("ifp"), b))) <= most, F.lit(b)) for b in range(BLOCKS)))
    met = met.where((F.col("block") == first) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius))  # once, not once a block
    met = met.join(bounded(marks.select("iid", "parts"), 32 + 24 * longest), "iid")

    alone = F.log1p(n_items)
    shares = F.transform("parts", lambda x: F.struct((F.size("wsh") - F.size(F.array_remove("wsh", x.h))).alias("cw"), x.c.alias("c"), x.weight.alias("weight")))
    met = met.select("doc_id", "tid", "iid", "s", F.size("wsh").alias("n"), shares.alias("shares"))

    def total(f) -> Column:
        return F.aggregate("shares", F.lit(0.0), lambda a, x: a + f(x))

    both = total(lambda x: x.weight * F.least(x.cw, x.c))
    either = total(lambda x: x.weight * F.greatest(x.cw, x.c)) + alone * (F.col("n") - F.aggregate("shares", F.lit(0), lambda a, x: a + x.cw))
    found = met.select("doc_id", "tid", "iid", "s", "n", F.round(both / either, 12).alias("similarity")).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "tid", "iid").agg(F.max(F.struct("similarity", -F.col("s"), "n")).alias("b"))
    best = best.join(bounded(marks.select("iid", "item_id"), 16), "iid")
    best = best.select("doc_id", "tid", "item_id", "b.similarity", (-F.col("b.col2")).cast("int").alias("start_word"), (F.col("b.n") + SHINGLE - 1).alias("n_words"))
    brief = _short(base, short)
    return best if brief is None else best.unionByName(brief)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks without tid: doc_id, item_id, similarity, start_word, n_words."""
    return leaks(docs, benchmark).drop("tid")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, without a leak."""
    bad = leaks(docs, benchmark).select(F.col("tid").alias("__tid")).distinct()
    return docs.join(bad, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col("__tid"), "left_anti")
