"""One table of what is wrong with a graph and its files, found in one pass, with counts that are observed while the table is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.lineage import stored
from .graph import BUILTINS, ENTITY, EXTERNAL, LOGICAL, Graph, dealt

#: Severities, worst first.
SEVERITIES = ("ERROR", "WARNING", "INFO")
#: Codes of findings and how severe they are; that of a cycle is the cycle's own.
CODES = {"unparsed": "WARNING", "dead_edge": "WARNING", "repeated_name": "WARNING", "unread": "WARNING", "orphan": "INFO", "unresolved": "INFO"}
SCHEMA = "code string, severity string, subject string, path string, n long, message string"


@dataclass(frozen=True)
class Diagnostics:
    """findings: SCHEMA, a row each; counts: how many of each code and severity there are, of nodes, internal entities (`internal`), edges, and dead ones among them."""

    findings: DataFrame
    counts: dict[str, int]

    @property
    def failed(self) -> bool:
        return self.counts["ERROR"] > 0

    def of(self, *severities: str) -> DataFrame:
        """The findings of these severities, worst first."""
        rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)))
        return self.findings.where(F.col("severity").isin(*severities)).orderBy(rank, "code", "subject")


def _entry(space: str, key: Column, missing: Column | None = None) -> Column:
    """What an edge says about a key: an id that is live, or a dead edge, and which ends it misses as a number."""
    return F.struct(F.lit(space).alias("space"), key.alias("key"), F.lit(space == "id").alias("live"), (F.lit(None) if missing is None else missing).cast("int").alias("missing"))


#: What a dead edge misses, in the order of the words.
MISSING = ("dst", "src", "src,dst")


def entries(g: Graph) -> DataFrame:
    """(space, key, nodes, n, node, live, missing): everything that is said of an id, a name, a dead edge or a type of edges, as one row.

    Edges meet the ids of their ends, as they do wherever a graph is validated; a live logical edge speaks for both its ends. An id that several nodes have is one of the least type, name
    and path; null ids, names and ends are keys of their own: a null end is missing. Where the graph's size is known, every shuffle is dealt by it, so that no task holds more as the graph
    grows; else what is said is summed before it is shuffled. Only flags and counts are summed by key, in a hash table of the keys, so that a hub costs a task no memory; types are few and summed apart.
    """
    ids = dealt(g.nodes.select("id").where("id IS NOT NULL"), g.size, "id").distinct()
    s, d = ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), ids.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst"))
    edges = dealt(dealt(g.edges.select("src", "dst", "type"), g.size, "src").join(s, "src", "left"), g.size, "dst").join(d, "dst", "left")
    missing = F.when(F.col("has_src").isNull() & F.col("has_dst").isNull(), 2).when(F.col("has_src").isNull(), 1).when(F.col("has_dst").isNull(), 0)
    ends = F.array(_entry("id", F.col("src")), _entry("id", F.col("dst")))
    shown = F.concat(F.coalesce("src", F.lit("")), F.lit(" > "), F.coalesce("dst", F.lit("")), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")"))
    said = F.when(missing.isNotNull(), F.array(_entry("edge", shown, missing))).when(F.coalesce(F.col("type").isin(*LOGICAL), F.lit(False)), ends)
    size = g.size and 2 * g.size
    said = dealt(edges.select(F.explode(said).alias("x")).select("x.*"), size, "space", "key").groupBy("space", "key").agg(F.count(F.lit(1)).alias("said"), F.max("live").alias("live"), F.min("missing").alias("missing"))
    own = dealt(g.nodes.select(F.lit("id").alias("space"), F.col("id").alias("key"), F.struct("type", "name", "path").alias("node")), size, "space", "key")
    own = own.groupBy("space", "key").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node"))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    nodes = F.coalesce("nodes", zero)
    word = F.get(F.array(*map(F.lit, MISSING)), F.col("missing"))
    met = own.join(said, ["space", "key"], "full").select("space", "key", nodes.alias("nodes"), (nodes + F.coalesce("said", zero)).alias("n"), "node", F.coalesce("live", F.lit(False)).alias("live"), word.alias("missing"))

    def counted(df: DataFrame, space: str, key: str, nodes: Column) -> DataFrame:
        out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return out.select(F.lit(space).alias("space"), F.col(key).alias("key"), nodes.alias("nodes"), "n", none.cast(own.schema["node"].dataType).alias("node"), F.lit(False).alias("live"), none.cast("string").alias("missing"))

    names = counted(dealt(g.nodes.select("fqn"), g.size, "fqn"), "name", "fqn", F.col("n"))
    return met.unionByName(names).unionByName(counted(g.edges.select("type"), "type", "type", zero))


def _judged(rows: DataFrame) -> DataFrame:
    """entries() with the code of what is wrong, null where nothing is."""
    node = F.col("space") == "id"
    code = (
        F.when(F.col("space") == "edge", "dead_edge").when((F.col("space") == "name") & F.col("key").isNotNull() & (F.col("nodes") > 1), "repeated_name")
        .when(node & F.col("node.type").isin(*ENTITY) & ~F.col("live"), "orphan").when(node & (F.col("node.type") == EXTERNAL) & ~F.coalesce(F.col("node.name").isin(*BUILTINS), F.lit(False)), "unresolved")
    )
    return rows.withColumn("code", code)


def _shown(rows: DataFrame) -> DataFrame:
    name = F.coalesce("node.name", F.lit(""))
    message = (
        F.when(F.col("code") == "dead_edge", F.concat(F.lit("no node for "), "missing")).when(F.col("code") == "repeated_name", F.concat(F.col("nodes").cast("string"), F.lit(" nodes have this name")))
        .when(F.col("code") == "orphan", F.concat(F.lit("no logical edge: "), name)).otherwise(F.concat(F.lit("unknown symbol: "), name))
    )
    n = F.when(F.col("space") == "edge", F.col("n")).otherwise(F.col("nodes"))
    path = F.when(F.col("space") == "id", F.coalesce("node.path", F.lit(""))).otherwise("")
    return rows.select("code", _severity(F.col("code")).alias("severity"), F.coalesce("key", F.lit("")).alias("subject"), path.alias("path"), n.alias("n"), message.alias("message"))


def _severity(code: Column) -> Column:
    return F.coalesce(*(F.when(code == c, F.lit(s)) for c, s in CODES.items()))


def _of_files(rows: DataFrame, code: str) -> DataFrame:
    """Findings of rows (path, error) that have an error."""
    path = F.coalesce("path", F.lit(""))
    return rows.where("error IS NOT NULL").select(F.lit(code).alias("code"), F.lit(CODES[code]).alias("severity"), path.alias("subject"), path.alias("path"), F.lit(1).cast("long").alias("n"), F.col("error").alias("message"))


def _of_cycles(cycles: DataFrame) -> DataFrame:
    """Findings of cycles as iterate.cycles() gives them, one for each strong component."""
    message = F.concat(F.col("type"), F.lit(" in a circle: "), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " > "))
    return cycles.select(F.lit("cycle").alias("code"), "severity", F.col("component").alias("subject"), F.lit("").alias("path"), F.col("size").cast("long").alias("n"), message.alias("message"))


def collected(g: Graph, cycles: DataFrame | None = None, files: DataFrame | None = None, parsed: DataFrame | None = None) -> Diagnostics:
    """All findings of a graph that hasn't been validated, written to the shared folder, and their counts, which need no pass of their own.

    cycles: of iterate.cycles(); files (path, error): what the scan couldn't read; parsed (file_path, error): what the parsers couldn't. The counts are observed in the
    stage that writes the table, where a task counts once however often it is tried. Tables without rows give no findings and counts of 0.
    """
    one, code = F.lit(1).cast("long"), F.col("code")

    def number(when: Column, of: Column = one) -> Column:
        return F.coalesce(F.sum(F.when(when, of)), F.lit(0).cast("long"))

    graph, other = Observation(), Observation()
    kinds = [number(code == c).alias(c) for c in ("dead_edge", "repeated_name", "orphan", "unresolved")]
    node, edge = F.col("space") == "id", F.col("space") == "type"
    judged = _judged(entries(g)).observe(graph, *kinds, number(node, F.col("nodes")).alias("nodes"), number(node & F.col("node.type").isin(*ENTITY), F.col("nodes")).alias("internal"), number(edge, F.col("n")).alias("edges"), number(F.col("space") == "edge", F.col("n")).alias("dead"))
    found = _shown(judged.where("code IS NOT NULL"))
    more = g.nodes.sparkSession.createDataFrame([], SCHEMA)
    if files is not None:
        more = more.unionByName(_of_files(files.select("path", "error"), "unread"))
    if parsed is not None:
        more = more.unionByName(_of_files(parsed.select(F.col("file_path").alias("path"), "error"), "unparsed"))
    if cycles is not None:
        more = more.unionByName(_of_cycles(cycles))
    seen = [number((code == "cycle") & (F.col("severity") == s)).alias(f"cycle_{s}") for s in SEVERITIES]
    more = more.observe(other, number(code == "unread").alias("unread"), number(code == "unparsed").alias("unparsed"), *seen)
    findings = stored(found.unionByName(more))
    counts = {k: int(v or 0) for k, v in {**graph.get, **other.get}.items()}
    for s in SEVERITIES:
        counts[s] = counts[f"cycle_{s}"] + sum(counts[c] for c, own in CODES.items() if own == s)
    return Diagnostics(findings, counts)


def tally(d: Diagnostics) -> DataFrame:
    """(name, n) of the counts, a row each."""
    return d.findings.sparkSession.createDataFrame(sorted(d.counts.items()), "name string, n long")


def report(d: Diagnostics, verbose: bool = False) -> DataFrame:
    """The lines of a report, worst first: errors, and with verbose everything."""
    place = F.when(F.col("path").isin("", F.col("subject")), "").otherwise(F.concat(F.lit(" at "), "path"))
    return d.of(*SEVERITIES if verbose else SEVERITIES[:1]).select(F.concat("severity", F.lit(" "), "code", F.lit(" "), "subject", place, F.lit(": "), "message").alias("line"))
