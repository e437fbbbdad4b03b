"""Assembly of the graph from parsed files, and resolution of references by ranked equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import extension, module_path, node_id, normal_path, without_extension
from .graph import Graph

#: Which file wins a name without suffix, first to last.
SUFFIXES = (".ts", ".tsx", ".py", ".js", ".jsx")


def _first(keyed: DataFrame, key: list[str], value: str, *by: str) -> DataFrame:
    return keyed.groupBy(*key).agg(F.min(F.struct(*by, value)).alias("b")).select(*key, F.col(f"b.{value}").alias(value), *(F.col(f"b.{c}").alias(c) for c in by))


def resolved_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, module, dst): imports (src, module) to files (path): the path itself, then without suffix, then as a folder's index, then as a package.
    What matches nothing is dropped. One join: the keys' tiers are ranked before it."""
    priority = F.coalesce(F.array_position(F.array(*map(F.lit, SUFFIXES)), extension(F.col("path"))), F.lit(0))
    priority = F.when(priority == 0, 99).otherwise(priority).cast("int")
    bare = without_extension(F.col("path"))
    tiers = F.array(
        F.struct(F.lit(0).alias("tier"), F.col("path").alias("key")), F.struct(F.lit(1).alias("tier"), bare.alias("key")),
        F.when(bare.endswith("/index"), F.struct(F.lit(2).alias("tier"), F.regexp_replace(bare, "/index$", "").alias("key"))),
        F.when(bare.endswith("/__init__"), F.struct(F.lit(3).alias("tier"), F.regexp_replace(bare, "/__init__$", "").alias("key"))),
    )
    keys = files.select("path", priority.alias("priority"), F.explode(F.array_compact(tiers)).alias("t")).select("path", "priority", "t.tier", "t.key")
    best = _first(keys, ["key"], "path", "tier", "priority")
    return imports.join(best, imports.module == best.key).select("src", "module", F.col("path").alias("dst"))


def aliased(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports (src, module) with relative modules normalised against src and others by the first alias (prefix, target, ordinal) they start with."""
    folder = F.regexp_replace("src", "/?[^/]*$", "")
    rel = F.col("module").startswith(".")
    i = imports.withColumn("__m", F.when(rel, normal_path(F.concat_ws("/", folder, "module"))).otherwise(F.col("module")))
    # Prefixes are enumerated and joined by equality; the first alias in their order wins.
    prefixes = i.where(~rel).select("src", "module").distinct().select("src", "module", F.explode(F.transform(F.sequence(F.lit(0), F.length("module")), lambda k: F.substring("module", 1, k))).alias("prefix"))
    hit = prefixes.join(aliases, "prefix").groupBy("src", "module").agg(F.min_by(F.struct("prefix", "target"), "ordinal").alias("a"))
    return i.join(hit, ["src", "module"], "left").select("src", F.when(F.col("a").isNotNull() & ~rel, F.concat("a.target", F.substr("module", F.length("a.prefix") + 1))).otherwise(F.col("__m")).alias("module"))


def resolved_symbols(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """(module, symbol, target, confidence, method) of refs (module, symbol) to entities (fqn).

    The module's own entity first (1.0), then the simple name (0.8, or 0.5 for the least of several), then a dotted suffix (0.6), else a new
    external node. Each step is an equi-join with a table of one row a key.
    """
    simple = F.element_at(F.split("fqn", r"\."), -1)
    by_name = entities.groupBy(simple.alias("symbol")).agg(F.min("fqn").alias("named"), F.count_distinct("fqn").alias("n"))
    p = F.split("fqn", r"\.")
    suffixes = entities.select("fqn", F.explode(F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))).alias("symbol"))
    by_suffix = suffixes.groupBy("symbol").agg(F.min("fqn").alias("dotted"))
    own = entities.select(F.col("fqn").alias("local")).distinct()
    r = refs.join(own, F.concat_ws(".", "module", "symbol") == F.col("local"), "left").join(by_name, "symbol", "left").join(by_suffix, "symbol", "left")

    def pick(local, named, dotted, other) -> Column:
        return F.when(F.col("local").isNotNull(), local).when(F.col("named").isNotNull(), named).when(F.col("dotted").isNotNull(), dotted).otherwise(other)

    return r.select(
        "module", "symbol", pick(F.col("local"), F.col("named"), F.col("dotted"), node_id("ext", F.col("symbol"))).alias("target"),
        pick(F.lit(1.0), F.when(F.col("n") == 1, 0.8).otherwise(0.5), F.lit(0.6), F.lit(1.0)).alias("confidence"),
        pick(F.lit("file_local_match"), F.when(F.col("n") == 1, "global_name").otherwise("ambiguous_name"), F.lit("suffix"), F.lit("unresolved")).alias("method"),
    )


def assembled(parsed: DataFrame, aliases: DataFrame | None = None) -> Graph:
    """The graph of parsed files (file_path, imports, entities[name, kind, purpose, parent_classes, called_entities, outputs], error); aliases: see aliased()."""
    files = parsed.select(F.col("file_path").alias("path")).distinct()
    nodes = files.select(node_id("file", F.col("path")).alias("id"), F.lit("FILE").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", module_path(F.col("path")).alias("fqn"), F.lit(None).cast("string").alias("purpose"))
    ents = parsed.select(F.col("file_path").alias("path"), F.posexplode("entities").alias("at", "e")).select("path", "at", "e.*").withColumn("module", module_path(F.col("path"))).withColumn("fqn", F.concat_ws(".", "module", "name"))
    # Of several entities of one name that of the least path counts, and of these the one that comes first.
    own = [c for c in ents.columns if c != "fqn"]
    ents = ents.groupBy("fqn").agg(F.min_by(F.struct(*own), F.struct("path", "at")).alias("e")).select("fqn", "e.*").drop("at").withColumn("id", node_id("entity", F.col("fqn")))
    nodes = nodes.unionByName(ents.select("id", F.col("kind").alias("type"), "name", "path", "fqn", "purpose"))
    contains = ents.select(node_id("file", F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("parsed").alias("method"))
    asked = parsed.select(F.col("file_path").alias("src"), F.explode("imports").alias("module"))
    if aliases is not None:
        typed = F.col("src").rlike(r"\.[jt]sx?$")
        asked = aliased(asked.where(typed), aliases).union(asked.where(~typed))
    imports = resolved_imports(files, asked)
    imported = imports.select(node_id("file", F.col("src")).alias("src"), node_id("file", F.col("dst")).alias("dst"), F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("path").alias("method"))
    kinds = F.array(F.struct(F.lit("CALLS").alias("type"), F.col("called_entities").alias("of")), F.struct(F.lit("EXTENDS").alias("type"), F.col("parent_classes").alias("of")), F.struct(F.lit("RETURNS").alias("type"), F.when(F.col("outputs").isNotNull() & (F.col("outputs") != ""), F.array("outputs")).otherwise(F.array().cast("array<string>")).alias("of")))
    refs = ents.select("id", "module", F.explode(kinds).alias("k")).select("id", "module", "k.type", F.explode("k.of").alias("symbol"))
    found = resolved_symbols(ents.select("fqn"), refs.select("module", "symbol").distinct())
    target = F.when(F.col("method") == "unresolved", F.col("target")).otherwise(node_id("entity", F.col("target")))
    links = refs.join(found, ["module", "symbol"]).select(F.col("id").alias("src"), target.alias("dst"), "type", "confidence", "method")
    ext = found.where("method = 'unresolved'").select(F.col("target").alias("id"), F.lit("UNRESOLVED_EXTERNAL").alias("type"), F.col("symbol").alias("name"), F.lit("").alias("path"), F.col("symbol").alias("fqn"), F.lit(None).cast("string").alias("purpose")).distinct()
    return Graph(nodes.unionByName(ext), contains.unionByName(imported).unionByName(links))


#: Fixed values of our own: folders that open a domain, that are infrastructure, and that are shared.
BOUNDARY, INFRA, SHARED = ("features", "modules", "domains", "apps", "packages"), ("infra", "infrastructure", "config", "db", "database"), ("shared", "common", "utils", "lib", "helpers")


def structural_labels(nodes: DataFrame) -> DataFrame:
    """(id, label) by the first marker on a node's path: after a boundary the next segment, `infrastructure`, or `shared`."""
    p = F.split(F.lower("path"), "/")
    parts = nodes.select("id", F.posexplode(p).alias("pos", "part"), p.alias("p"))
    nxt = F.regexp_replace(F.get("p", F.col("pos") + 1), r"\.[^.]*$", "")
    label = F.when(F.col("part").isin(*BOUNDARY), nxt).when(F.col("part").isin(*INFRA), "infrastructure").when(F.col("part").isin(*SHARED), "shared")
    return parts.select("id", "pos", label.alias("label")).where("label IS NOT NULL").groupBy("id").agg(F.min_by("label", "pos").alias("label"))


def domain_groups(domains: DataFrame) -> DataFrame:
    """(id, name, type, n, members) of (id, domain); members sorted. The id hashes name and members."""
    g = domains.groupBy(F.col("domain").alias("name")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kind = F.when(F.col("name") == "shared", "SHARED").when(F.col("name") == "infrastructure", "INFRASTRUCTURE").otherwise("DOMAIN")
    return g.select(node_id("domain", F.concat(F.col("name"), F.lit(":"), F.array_join("ids", ","))).alias("id"), "name", kind.alias("type"), F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("members"))
