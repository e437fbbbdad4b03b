"""Ranking of files and selection under a budget."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CHARS_PER_TOKEN, depth, file_name

# Names that raise or lower a path's score.
WELL_KNOWN = ("readme.md", "package.json", "pyproject.toml", "cargo.toml", "go.mod")
SOURCES = ("src", "app", "lib", "core", "main")
TESTS = ("tests", "test", "spec", "specs", "__tests__")
UTILITIES = ("utils", "helpers", "misc", "vendor")


def heuristic(path: Column) -> Column:
    """A score without a task: 100 for well-known files, 40 at the top; 40 for a source folder anywhere in the path, -10 for tests, -20 for utilities."""
    parts = F.split(F.lower(path), "/")

    def points(n: int, when: Column) -> Column:
        return F.when(when, n).otherwise(0)

    def among(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(parts, F.array(*map(F.lit, names)))

    return points(100, F.lower(file_name(path)).isin(*WELL_KNOWN)) + points(40, depth(path) == 1) + points(40, among(SOURCES)) + points(-10, among(TESTS)) + points(-20, among(UTILITIES))


def order() -> list[Column]:
    """Score, then shallow before deep, then name, then path."""
    return [F.desc("score"), depth(F.col("path")), file_name(F.col("path")), F.col("path")]


def ranked(files: DataFrame) -> DataFrame:
    """files (path, score) with their rank from 1. The ranks come from a sort by ranges and the ranges' sizes, so no task sees all rows."""
    cols = [F.col(c) for c in files.columns]
    parts = files.orderBy(*order()).select(*cols, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    from ..plans.lineage import cut

    parts = cut(parts)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    return parts.join(F.broadcast(before), "__part").select(*cols, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def guidance(ranks: DataFrame) -> DataFrame:
    """Of ranks (path, rank): the first fifth is to be read first, the last two fifths to be ignored if there are more than three."""
    n = ranks.agg(F.count(F.lit(1)).alias("n"))
    first, last = F.greatest(F.lit(1), F.floor(F.col("n") * 0.2)), F.greatest(F.lit(1), F.floor(F.col("n") * 0.4))
    advice = F.when(F.col("rank") <= first, "read_first").when((F.col("n") > 3) & (F.col("rank") > F.col("n") - last), "ignore").otherwise("normal")
    return ranks.crossJoin(F.broadcast(n)).select("path", "rank", advice.alias("advice"))  # n is one row


#: Items that still fit, up to which one task takes the rest of a budget.
FEW = 1 << 16
_RANGE = 33  # the bits of a position within its range


def within_budget(items: DataFrame, cap: float, *by: Column, size: str = "size", spent: float = 0) -> DataFrame:
    """The items (all columns) kept greedily in the order of `by`: one that would exceed the cap is skipped, later smaller ones still fit.

    Integer sizes are added as integers, so that what fits exactly is kept. Items without a size, or with a negative one, are left out. The order is sorted once, by ranges. Each round then settles a stretch of
    it: of what is left, items up to a half are small. They are all taken until they exceed the half together, or until a larger item meets as much
    room as it needs; either way over half of what was left is spent by then. So there are at most as many rounds as what is left has bits, of two jobs each, however
    many ranges there are; once no more than FEW items are left that could fit, one task takes the rest. A round brings a row for each range to the driver.
    """
    from ..plans.lineage import cut

    whole = items.schema[size].dataType.typeName() in ("byte", "short", "integer", "long")
    cap, spent = (math.floor(cap), math.ceil(spent)) if whole else (cap, spent)
    name, n = "__pos", F.col(size)
    rows = cut(items.where((n <= cap - spent) & (n >= 0)).orderBy(*by).withColumn(name, F.monotonically_increasing_id()))
    left, after, kept, rest = cap - spent, -1, [], None
    while True:
        live = rows.where((F.col(name) > after) & (n <= left))
        half = left // 2 if whole else left / 2
        sums = live.groupBy(F.shiftright(name, _RANGE).alias("r")).agg(F.coalesce(F.sum(F.when(n <= half, n)), F.lit(0)).alias("small"), F.count(F.lit(1)).alias("n")).orderBy("r").collect()
        if sum(r.n for r in sums) <= FEW:
            rest = live
            break
        starts, total = {}, 0
        for r in sums:
            if total > half:
                break
            starts[r.r] = total
            total += r.small
        first = live.where(F.shiftright(name, _RANGE) <= max(starts)).select(name, size).mapInArrow(_spends_half(size, starts, left, half), f"pos long, total {'long' if whole else 'double'}").orderBy("pos").first()
        if first is None:
            kept.append((F.col(name) > after) & (n <= half))
            break
        kept.append((F.col(name) > after) & (F.col(name) <= first.pos) & ((n <= half) | (F.col(name) == first.pos)))
        left, after = left - first.total, first.pos
    out = rows.where(reduce(or_, kept)) if kept else rows.limit(0)
    return (out if rest is None else out.unionByName(rest.repartition(1).sortWithinPartitions(name).mapInArrow(_taken(size, left), rows.schema))).drop(name)


def _spends_half(size: str, starts: dict[int, float], left: float, half: float):
    """Of each range its first item by which over half of what is left is spent, with the sum spent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = 0, None
        for b in batches:
            for pos, s in zip(b.column("__pos").to_pylist(), b.column(size).to_pylist(), strict=True):
                if pos >> _RANGE != at:
                    at = pos >> _RANGE
                    total = starts[at]
                if s <= half:
                    total += s
                    found = total if total > half else None
                else:
                    found = total + s if total + s <= left else None
                if found is not None:
                    yield pa.RecordBatch.from_pydict({"pos": [pos], "total": [found]})
                    return

    return run


def _taken(size: str, left: float):
    """The rows taken one after the other while they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = left
        for b in batches:
            keep = []
            for s in b.column(size).to_pylist():
                keep.append(s <= room)
                room -= s if keep[-1] else 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def packed_by_domain(blocks: DataFrame, max_tokens: float, header: str = "# {}\n", footer: str = "", spent: int = 0) -> DataFrame:
    """Second pass over rendered blocks (domain, rank, chars): domains in the order of their best rank, each charged its header and footer; blocks that don't fit are skipped.

    Characters are counted, against what max_tokens are in characters; spent: characters that are taken already.
    """
    best = blocks.groupBy("domain").agg(F.min("rank").alias("best"))
    d = blocks.join(best, "domain")
    heads = best.agg(F.sum(F.length(F.format_string(header.replace("{}", "%s"), F.col("domain"))) + len(footer)).alias("h")).first().h or 0
    d = d.withColumn("tokens", F.col("chars") / CHARS_PER_TOKEN)
    return within_budget(d, max_tokens * CHARS_PER_TOKEN, F.col("best"), F.col("rank"), size="chars", spent=heads + spent).drop("best")


def token_total(files: DataFrame, chars: str = "n_chars") -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(chars).alias("chars"), F.round(F.sum(chars) / CHARS_PER_TOKEN, 3).alias("tokens"))


def size_guard(files: DataFrame, most: int = 100_000, chars: str = "n_chars") -> DataFrame:
    """The estimated tokens and whether they exceed the guard; one row."""
    return token_total(files, chars).select("tokens", (F.col("tokens") > most).alias("too_large"))


def largest(files: DataFrame, key: str, size: str, top: int = 5) -> DataFrame:
    flag = F.when(F.col(size) > 100 * 1024, "very large").when(F.col(size) > 50 * 1024, "large").otherwise("ok")
    return files.orderBy(F.desc(size), key).limit(top).select(key, size, flag.alias("flag"))
