"""Filter interaction audit by inclusion-exclusion.

Every document gets a flag for each filter that it fails. Joint-failure counts of all 32 sets of filters are sums of flag products; Moebius inversion of
these gives survivors of any set, failures of one filter alone and, as Harsanyi dividends, Shapley values. Any order of filters is then read off: no order is run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, NULL_ID

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MOST_UPPER = 50, 65, 5
SIGNS = "#$%&*|"
SETS = range(1 << len(FILTERS))
#: What is counted: all documents, those of quality 1, toxic ones.
KINDS = ("every", "good", "toxic")


def text_flags(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) as doc (a null id as the greatest), part (a null source as ''), t1, t2 (128 bits of hash of the text), and A to D: 1 where a text fails the filter."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", GAP), "")
    base = base.select("doc", "part", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.char_length("text").alias("n_chars"), (F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_upper"), F.col("text").rlike(f"[{SIGNS}]").alias("signs"), words.alias("words"))
    base = base.select("doc", "part", "t1", "t2", "n_chars", "n_upper", "signs", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("n_distinct"))
    fails = {"A": F.col("n") < MIN_WORDS, "B": 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n"), "C": 100 * F.col("n_upper").cast("long") > MOST_UPPER * F.col("n_chars"), "D": F.col("signs")}
    return base.select("doc", "part", "t1", "t2", *(f.cast("int").alias(x) for x, f in fails.items()))


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, every, good, toxic) of every row of docs, 0 or 1 each but for part.

    E is 1 where a smaller doc_id has the same text anywhere in docs. A document is good or toxic if any row of labels says so. Texts don't travel for this: their hashes
    do, and meet the least doc_id of a text together with the doc_id, so that a group of copies is never one task.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = text_flags(docs)
    least = own.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.lit(0).alias("E"))
    met = own.join(least, ["t1", "t2", "doc"], "left").join(known, "doc", "left")
    zero = F.lit(0)
    return met.select("part", "A", "B", "C", "D", F.coalesce("E", F.lit(1)).alias("E"), F.lit(1).alias("every"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))


def joint_failures(flagged: DataFrame) -> DataFrame:
    """Of each part, for each kind, an array over all sets of filters (bit i: filter i): how many fail all of the set."""

    def count(s: int, kind: str) -> Column:
        return F.sum(reduce(mul, (F.col(FILTERS[i]) for i in range(len(FILTERS)) if s >> i & 1), F.col(kind))).alias(f"{kind}{s}")

    sums = flagged.groupBy("part").agg(*(count(s, kind) for kind in KINDS for s in SETS))
    return sums.select("part", *(F.array(*(f"{kind}{s}" for s in SETS)).alias(kind) for kind in KINDS))


def inverted(joint: DataFrame) -> DataFrame:
    """(part, fails, shapley, and for each kind KIND_left): failures and Shapley values, times the number of orders, of each filter; survivors of each set of filters.

    Survivors of a set are the sum over its subsets of the joint failures with alternating signs, by the fast Moebius transform: a step for each filter. What a set
    removes is a game whose Harsanyi dividends are these terms negated; a filter's Shapley value is the sum of the dividends of its sets, each shared evenly.
    """
    n = len(FILTERS)
    signed = joint.select("part", *(F.transform(k, lambda v, s: F.when(F.bit_count(s) % 2 == 1, -v).otherwise(v)).alias(k) for k in KINDS))
    fails = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: -F.get("every", F.call_function("shiftleft", F.lit(1), f)))
    shared = F.array(*(F.lit(factorial(n) // s.bit_count() if s else 0) for s in SETS))
    dividends = F.zip_with("every", shared, lambda v, w: -v * w)

    def value(f: int) -> Column:
        return F.aggregate(F.filter("dividends", lambda _, s: s.bitwiseAND(F.lit(1 << f)) != 0), F.lit(0).cast("long"), lambda a, v: a + v)

    left = signed.withColumn("fails", fails).withColumn("dividends", dividends).select("part", *KINDS, "fails", F.array(*map(value, range(n))).alias("shapley"))

    def step(kind: str, bit: int) -> Column:
        return F.transform(kind, lambda v, s: v + F.when(s.bitwiseAND(F.lit(bit)) != 0, F.get(kind, s.bitwiseXOR(F.lit(bit)))).otherwise(F.lit(0).cast("long"))).alias(kind)

    for i in range(n):
        left = left.select("part", *(step(kind, 1 << i) for kind in KINDS), "fails", "shapley")
    return left.select("part", *(F.col(kind).alias(f"{kind}_left") for kind in KINDS), "fails", "shapley")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each source of docs (doc_id, text, source).

    Null texts are empty and fail A only (and E, if a smaller doc_id's is empty or null); a null source is the part ''; a null doc_id is greater than any other, and
    equal to other null ones; repeated rows each count, and none of one doc_id is a copy of another. Labels (doc_id, quality, toxic) may be null, repeated or
    missing. Other columns are not read. An empty table has no part and gives no rows.
    """
    steps = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, f, done, done | 1 << f))
            done |= 1 << f
    rows = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'f', {f}, 'before', {a}, 'after', {b})" for o, k, f, a, b in steps)
    each = inverted(joint_failures(flags(docs, labels))).select("*", F.explode(F.expr(f"array({rows})")).alias("s")).select("*", "s.*")
    gone: Callable[[str], Column] = lambda kind: F.col(f"{kind}_left")[F.col("before")] - F.col(f"{kind}_left")[F.col("after")]
    f, all_ = F.col("f"), len(SETS) - 1
    alone = F.col("every_left")[F.lit(all_).bitwiseXOR(F.call_function("shiftleft", F.lit(1), f))] - F.col("every_left")[all_]  # what only this filter takes away
    return each.select(
        "part", "filter_order", "step", F.col("every_left")[F.col("after")].alias("kept"), gone("every").alias("removed"), (F.col("fails")[f] - gone("every")).alias("redundant"),
        alone.alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("shapley")[f].alias("shapley"),
    )


#: Every order is run, filter after filter.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT d.part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_UPPER} * length(text) AS c, regexp_matches(text, '[{SIGNS}]') AS d, d.doc_id > min(d.doc_id) OVER (PARTITION BY text) AS e,
        coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
    FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
m AS (SELECT part, map {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS failing, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
    WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT o, step, substr(o, step, 1) AS x, string_split(substr(o, 1, step - 1), '') AS before FROM orders, range(1, 6) AS t(step)),
runs AS (SELECT part, o, step, x, n, good, toxic, failing[x] AS fails, coalesce(list_bool_or([failing[y] FOR y IN before IF y <> '']), false) AS gone,
        coalesce(list_bool_or([failing[y] FOR y IN ['A', 'B', 'C', 'D', 'E'] IF y <> x]), false) AS others FROM m, steps),
r AS (SELECT part, o AS filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND NOT others), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
    FROM runs GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
""".replace("\\\\", "\\")
