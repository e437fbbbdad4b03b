"""Discovery over paths, dependencies and names by rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import extension, file_name, spaced

#: Suffix to language.
LANGUAGES = {".py": "Python", ".pyw": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".html": "HTML", ".css": "CSS"}
#: A small taxonomy of our own, made for data repositories: (target, rule, pattern, weight) over paths in lower case with blanks.
RULES = [
    ("Ingestion", "reader", r"\b(loaders?|readers?|importers?|crawlers?)\b", 0.6), ("Ingestion", "format", r"\b(parquet|avro|csv|jsonl)\b", 0.4),
    ("Transformation", "step", r"\b(transforms?|pipelines?|etl)\b", 0.7), ("Modelling", "training", r"\b(train|training|trainer|finetune)\b", 0.6),
    ("Serving", "endpoint", r"\b(endpoints?|routes?|handlers?)\b", 0.6), ("Observability", "signal", r"\b(metrics|tracing|telemetry|dashboards?)\b", 0.7),
]
#: Rules of our own: (dependency, side, framework).
FRAMEWORKS = [("react", "frontend", "React"), ("next", "frontend", "Next.js"), ("vue", "frontend", "Vue"), ("svelte", "frontend", "Svelte"), ("@angular/core", "frontend", "Angular"), ("fastapi", "backend", "FastAPI"), ("django", "backend", "Django"), ("flask", "backend", "Flask"), ("express", "backend", "Express"), ("@nestjs/core", "backend", "NestJS"), ("typer", "backend", "Typer")]
# Fixed values: (dependency, category, pattern, priority); of a category with priorities the first match counts.
CONVENTIONS = [
    ("zustand", "state", "Zustand", 1), ("redux", "state", "Redux", 2), ("@reduxjs/toolkit", "state", "Redux", 2), ("jotai", "state", "Jotai", 3),
    ("tailwindcss", "styling", "Tailwind", 1), ("styled-components", "styling", "Styled Components", 2),
    ("pytest", "testing", "pytest", None), ("jest", "testing", "Jest", None), ("sqlalchemy", "data", "SQLAlchemy", None), ("pydantic", "data", "Pydantic", None),
]
#: Rules of our own: folder to layer.
LAYERS = [("controllers", "presentation"), ("views", "presentation"), ("components", "presentation"), ("services", "application"), ("usecases", "application"), ("domain", "domain"), ("models", "domain"), ("entities", "domain"), ("repositories", "infrastructure"), ("adapters", "infrastructure"), ("infrastructure", "infrastructure")]
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "Pipfile")


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def languages(paths: DataFrame, top: int = 5) -> DataFrame:
    """Files by suffix, the most frequent first, with the language of each."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    n = paths.select(extension(F.col("path")).alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "ext").limit(top).select("ext", "n", F.coalesce(F.element_at(names, F.col("ext")), F.lit("Unknown")).alias("language"))


def ancestors(paths: DataFrame) -> DataFrame:
    """Every path and all folders above it, once."""
    p = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).alias("path")).distinct()


#: Patterns that are words, or a choice of words, between word bounds: what they can match is known by equality.
_WORDS = r"^\\b\(?([a-z0-9_|]+)\)?\\b$"


#: Words of rules up to which they are broadcast to the paths, once counted; and rows that a task is dealt of more matches.
FEW_WORDS, TASK_ROWS = 1 << 16, 1 << 19


def matches(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, rule, weight, path) of paths (path) that the pattern of a rule (target, rule, pattern, weight) matches, in one pass over the paths."""
    return _matches(paths, rules).distinct()


def _matches(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """matches(), a row for each of a path's words that a rule names.

    A rule whose pattern is a choice of words meets the words of the paths by equality, and its pattern is tried on these paths only, so that rules may be many; the
    others, which should be few, are tried on every path in one projection. Paths are matched in lower case, camel case cut into words.
    """
    table = rules.select("target", "rule", "pattern", F.col("weight").cast("double").alias("weight"), F.regexp_extract("pattern", _WORDS, 1).alias("words"))
    tokens = table.where("words <> ''").select("target", "rule", "pattern", "weight", F.explode(F.array_distinct(F.split("words", r"\|"))).alias("word")).where("word <> ''")
    text = paths.select("path", F.lower(spaced(F.col("path"))).alias("text"))
    own = text.select("path", F.explode(F.array_distinct(F.split("text", "[^a-z0-9_]+"))).alias("word"))
    few = tokens.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    # A path's text is made again after the join, so that a shuffle has the path alone.
    met = own.join(F.broadcast(tokens) if few else tokens, "word").where(F.rlike(F.lower(spaced(F.col("path"))), F.col("pattern"))).select("target", "rule", "weight", "path")
    rest = table.where("words = ''").collect()  # patterns that aren't words
    if not rest:
        return met
    tried = F.array(*(F.when(F.col("text").rlike(r.pattern), F.struct(F.lit(r.target).alias("target"), F.lit(r.rule).alias("rule"), F.lit(r.weight).alias("weight"))) for r in rest))
    return met.union(text.select("path", F.explode(F.array_compact(tried)).alias("x")).select("x.*", "path"))


def evaluated(paths: DataFrame, rules: list[tuple] | DataFrame | None = None, evidence: int = 5) -> DataFrame:
    """(target, confidence, evidence): each rule that any path matches counts its weight once; the sum stops at 1.

    rules: (target, rule, pattern, weight), as a list or a table. The matches are stored, so that patterns are tried once; evidence is the `evidence` smallest paths over all.
    """
    from pyspark.sql import Window

    from ..plans.lineage import cut

    rules = RULES if rules is None else rules
    table = rules if isinstance(rules, DataFrame) else rule_table(paths.sparkSession, [(t, r, p, float(w)) for t, r, p, w in rules], "target string, rule string, pattern string, weight double")
    hits = cut(_matches(paths, table))  # repeated ones change nothing below
    n = -(-hits.count() // TASK_ROWS)
    sums = hits.groupBy("target", "rule").agg(F.max("weight").alias("weight")).groupBy("target").agg(F.round(F.least(F.sum("weight"), F.lit(1.0)), 6).alias("confidence"))
    # The smallest paths by target first, so that a target's list never holds more than a few.
    pairs = hits.select("target", "path")
    first = (pairs.repartition(n, "target", "path") if n > 1 else pairs).distinct().withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("path"))).where(F.col("k") <= evidence)
    lists = first.groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("evidence"))
    return sums.where("confidence > 0").join(lists, "target").select("target", "confidence", "evidence")


def frameworks(dependencies: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(side, framework) of dependencies (name)."""
    table = rule_table(dependencies.sparkSession, rules or FRAMEWORKS, "name string, side string, framework string")
    return dependencies.select(F.lower("name").alias("name")).join(F.broadcast(table), "name").select("side", "framework").distinct()


def conventions(dependencies: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(category, pattern) of dependencies; of a category with priorities only the first."""
    table = rule_table(dependencies.sparkSession, rules or CONVENTIONS, "name string, category string, pattern string, priority int")
    hits = dependencies.select(F.lower("name").alias("name")).join(F.broadcast(table), "name").select("category", "pattern", "priority").distinct()
    best = hits.where("priority IS NOT NULL").groupBy("category").agg(F.min_by("pattern", "priority").alias("pattern"))
    return hits.where("priority IS NULL").select("category", "pattern").union(best)


def layers(paths: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(layer, folder) that the folders of paths hint at."""
    table = rule_table(paths.sparkSession, rules or LAYERS, "folder string, layer string")
    p = F.split(F.lower("path"), "/")
    folders = paths.select(F.explode(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).alias("folder")).distinct()
    return folders.join(F.broadcast(table), "folder").select("layer", "folder")


def manifests(paths: DataFrame) -> DataFrame:
    return paths.where(file_name(F.col("path")).isin(*MANIFESTS))


def architecture(domains: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rank, name, confidence) from domains (name, size) and candidates (target, confidence): over two domains of more than three nodes are
    Modular, `api` with `core` Clean before it, nothing at all Monolith."""
    d = domains.agg(F.count_if((F.col("size") > 3) & (F.col("name") != "root")).alias("big"), F.coalesce(F.bool_or(F.col("name") == "api"), F.lit(False)).alias("api"), F.coalesce(F.bool_or(F.col("name") == "core"), F.lit(False)).alias("core"))
    own = d.select(F.explode(F.array_compact(F.array(F.when(F.col("api") & F.col("core"), F.struct(F.lit(0).alias("rank"), F.lit("Clean Architecture").alias("name"), F.lit(0.85).alias("confidence"))), F.when(F.col("big") > 2, F.struct(F.lit(1).alias("rank"), F.lit("Modular").alias("name"), F.lit(0.9).alias("confidence"))), F.struct(F.lit(9).alias("rank"), F.lit("Monolith").alias("name"), F.lit(0.1).alias("confidence"))))).alias("x")).select("x.*")
    every = own.union(candidates.select(F.lit(2), "target", "confidence"))
    count = every.where("rank < 9").agg(F.count(F.lit(1)).alias("n"))
    return every.crossJoin(F.broadcast(count)).where("rank < 9 OR n = 0").drop("n")  # count is one row


def by_category(rows: DataFrame, category: str = "category", confidence: str = "confidence") -> DataFrame:
    return rows.orderBy(category, F.desc(confidence))


def _told(c: str) -> Column:
    """A value with its length before it, so that no two rows read alike; a null has none."""
    x = F.col(c).cast("string")
    return F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def fingerprint(files: DataFrame, groups: int = 1024, depth: int | None = None) -> DataFrame:
    """One SHA-256 over (path, size, mtime), whatever their order.

    A tree of hashes: each row's hash, leaves of the rows whose path's hash has the same first `depth` hex digits, and above them nodes of the sixteen below each,
    up to one root. Without a depth leaves get about 256 rows, so that no task gathers more than a few. groups <= 1: the plain hash over the rows in the order of
    path, for small trees only (all rows in one task).
    """
    if groups <= 1:
        row = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
        lines = F.array_sort(F.collect_list(F.struct("path", "size", "mtime", row.alias("row"))))
        return files.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x.row), ""), 256).alias("fingerprint"))
    if depth is None:
        n, depth = files.count(), 0
        while 16**depth * 256 < n:
            depth += 1
    row = F.sha2(F.concat(*map(_told, ("path", "size", "mtime"))), 256)
    level = files.select(F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, depth).alias("at"), row.alias("h"))
    for d in range(depth, -1, -1):
        level = level.groupBy(F.substring("at", 1, d).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return files.sparkSession.range(1).join(level.select("h"), how="left").select(F.coalesce("h", F.sha2(F.lit(""), 256)).alias("fingerprint"))  # one row each
