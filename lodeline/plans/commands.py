"""What a user asks of a repository: plans over its file tree, from scan to report."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import diagnostics, discovery, graph, iterate, lexical, memory, ranking, render, resolve
from ..sources import config, manifests, packsink, parse, tree, vault
from .lineage import cut


def scan(spark: SparkSession, root: str, content: bool = True, defaults: bool = True, depth: int | None = None, max_bytes: int | None = None, ignore: list[str] | None = None) -> DataFrame:
    tree.register(spark)
    reader = spark.read.format("repo_tree").option("path", root).option("content", str(content).lower()).option("defaults", str(defaults).lower())
    if depth is not None:
        reader = reader.option("depth", depth)
    if ignore:
        reader = reader.option("ignore", "\n".join(ignore))
    return (reader.option("maxBytes", max_bytes) if max_bytes is not None else reader).load()


def texts(files: DataFrame) -> DataFrame:
    """files (path, content) as path, text: decoded as what they are; text is null for binaries."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([parse.decoded(x or b"") for x in b.column("content").to_pylist()], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def aliases(files: DataFrame) -> DataFrame:
    """(prefix, target, ordinal) of the tsconfig files at the root and one folder below, up to 500 KB each; targets lie below their file's folder."""
    own = files.where((F.element_at(F.split("path", "/"), -1) == "tsconfig.json") & (F.size(F.split("path", "/")) <= 2) & (F.col("length") <= 500 * 1024))
    rows = []
    for r in texts(own).where("text IS NOT NULL").orderBy("path").collect():  # a few small files
        folder = os.path.dirname(r.path)
        for prefix, target, _ in parse.tsconfig_aliases(r.text):
            path = os.path.normpath(os.path.join(folder, target)).replace(os.sep, "/")
            rows.append((prefix, path if path.endswith("/") or not target.endswith("/") else path + "/", len(rows)))
    return files.sparkSession.createDataFrame(rows, "prefix string, target string, ordinal int")


@dataclass
class Analysis:
    """Tables of a repository. Nothing is computed until one is read."""

    files: DataFrame
    graph: graph.Graph
    domains: DataFrame
    languages: DataFrame
    dependencies: DataFrame
    frameworks: DataFrame
    conventions: DataFrame
    capabilities: DataFrame
    architecture: DataFrame
    fingerprint: DataFrame


#: Scanners by name, in order: functions of (files, graph, domains, what the scanners before found) to a DataFrame. Register more here; a name that is there already is replaced.
SCANNERS: dict[str, Callable[[DataFrame, graph.Graph, DataFrame, dict[str, DataFrame]], DataFrame]] = {
    "languages": lambda files, g, domains, found: discovery.languages(files.select("path")),
    "dependencies": lambda files, g, domains, found: manifests.dependencies(texts(discovery.manifests(files)).where("text IS NOT NULL")),
    "frameworks": lambda files, g, domains, found: discovery.frameworks(found["dependencies"]),
    "conventions": lambda files, g, domains, found: discovery.conventions(found["dependencies"]),
    "layers": lambda files, g, domains, found: discovery.layers(files.select("path")),
    "capabilities": lambda files, g, domains, found: discovery.evaluated(discovery.ancestors(files.select("path"))),
    "architecture": lambda files, g, domains, found: discovery.architecture(domains.select("name", F.col("n").alias("size")), architecture_candidates(files.select("path"))),
}


def scanned(files: DataFrame, g: graph.Graph, domains: DataFrame) -> dict[str, DataFrame]:
    """What all scanners find, each given what those before it found."""
    found: dict[str, DataFrame] = {}
    for name, scanner in SCANNERS.items():
        found[name] = scanner(files, g, domains, found)
    return found


#: Styles of our own that folders hint at: (target, rule, pattern, weight).
STYLES = [
    ("Layered", "presentation", r"\b(controllers?|views?|components)\b", 0.3), ("Layered", "application", r"\b(services|usecases)\b", 0.3), ("Layered", "infrastructure", r"\b(repositories|adapters)\b", 0.3),
    ("Event driven", "messages", r"\b(events?|consumers?|subscribers?)\b", 0.6), ("Pipeline", "steps", r"\b(pipelines?|stages|dags?)\b", 0.6),
]


def architecture_candidates(paths: DataFrame) -> DataFrame:
    return discovery.evaluated(discovery.ancestors(paths), STYLES).select("target", "confidence")


def assembled(files: DataFrame) -> graph.Graph:
    """The valid graph of files, imports resolved through the project's aliases."""
    return graph.valid(resolve.assembled(parse.parsed(files), aliases(files)))


def analyze(spark: SparkSession, root: str, out: str | None = None, defaults: bool = True, ignore: list[str] | None = None) -> Analysis:
    """Scan, parse, assemble, validate, cluster, discover; with out the graph is written there first and read back for the rest."""
    own = config.load(root)
    files = scan(spark, root, defaults=defaults, depth=own.depth, max_bytes=own.max_bytes, ignore=ignore)
    g = assembled(files)
    if out:
        render.save(g, out)
        g = render.load(spark, out)
    labels = iterate.domains(g.nodes, g.of_type(("IMPORTS",)), resolve.structural_labels(g.nodes))
    domains = resolve.domain_groups(labels)
    found = scanned(files, g, domains)
    return Analysis(files, g, domains, found["languages"], found["dependencies"], found["frameworks"], found["conventions"], found["capabilities"], found["architecture"], discovery.fingerprint(files.select("path", F.col("length").alias("size"), "mtime")))


def facts(a: Analysis) -> dict[str, list[str]]:
    """The small tables of an analysis as lines, for a context document."""
    return {
        "Languages": [f"{r.language} ({r.ext}): {r.n}" for r in a.languages.collect()], "Dependencies": [f"{r.ecosystem}: {r.name}" for r in a.dependencies.orderBy("ecosystem", "name").collect()],
        "Frameworks": [f"{r.side}: {r.framework}" for r in a.frameworks.orderBy("side", "framework").collect()], "Conventions": [f"{r.category}: {r.pattern}" for r in a.conventions.orderBy("category", "pattern").collect()],
        "Capabilities": [f"{r.target}: {r.confidence}" for r in a.capabilities.orderBy(F.desc("confidence"), "target").collect()], "Architecture": [f"{r.name}: {r.confidence}" for r in a.architecture.orderBy("rank").collect()],
        "Domains": [f"{r.name}: {r.n} nodes" for r in a.domains.orderBy(F.desc("n"), "name").limit(15).collect()],
    }


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(category, name, confidence, label) of frameworks, conventions, layers and capabilities; ignore files hold here too."""
    files = scan(spark, root)
    deps = manifests.dependencies(texts(discovery.manifests(files)).where("text IS NOT NULL"))
    one = F.lit(1.0).alias("confidence")
    found = discovery.frameworks(deps).select(F.col("side").alias("category"), F.col("framework").alias("name"), one)
    found = found.union(discovery.conventions(deps).select("category", F.col("pattern").alias("name"), one)).union(discovery.layers(files.select("path")).select(F.lit("layer"), "layer", F.lit(0.7)).distinct())
    found = found.union(discovery.evaluated(files.select("path")).select(F.lit("capability"), "target", "confidence"))
    return discovery.by_category(found.withColumn("label", scalar.confidence_label(F.col("confidence"))))


def learn(found: DataFrame, vault: DataFrame) -> DataFrame:
    """Patterns of discover() that the vault lacks, best first."""
    return memory.unknown_patterns(found.select("category", "name", "confidence", F.concat_ws(": ", "category", "name").alias("description")), vault).orderBy(F.desc("confidence"), "category", "name")


def remember(vault: DataFrame, learnt: DataFrame, source: str = "auto") -> DataFrame:
    return memory.upserted(vault, learnt.select("name", "category", F.col("description").alias("rule"), "confidence", F.lit(source).alias("source"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")))


def learn_into_vault(spark: SparkSession, root: str) -> DataFrame:
    """Learns what discover() finds and the vault lacks, saves it, and returns it, best first."""
    with vault.held(root):
        rules = vault.load(spark, root)
        learnt = learn(discover(spark, root), rules).cache()
        vault.save(remember(rules, learnt), root)
    return learnt


def remembered(spark: SparkSession, root: str) -> DataFrame:
    """The vault's rules by category, the most confident first, with a label of the confidence."""
    return vault.load(spark, root).withColumn("label", scalar.confidence_label(F.col("confidence"))).orderBy("category", F.desc("confidence"), "id")


def inspect(spark: SparkSession, root: str, top: int = 5, defaults: bool = True) -> DataFrame:
    return ranking.largest(scan(spark, root, content=False, defaults=defaults), "path", "length", top)


def explain(g: graph.Graph, domains: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A domain's payload (one row) and the edges that cross its border."""
    members = domains.where(F.col("name") == name).select(F.explode(F.split("members", ",")).alias("id"))
    return render.domain_payload(g, members, name), graph.domain_cut(g, members)


def stats(g: graph.Graph, top: int = 3) -> DataFrame:
    """(provider, value_json) of all metric providers, hotspots cut to `top`; the health and the counts of a validation, each strong component of calls a warning, the cycles of calls and imports by severity, and what the run took."""
    began = time.monotonic()
    cycles = cut(iterate.cycles(g))
    n = diagnostics.collected(g, cycles).counts
    spark, validated = g.nodes.sparkSession, {"dead": n["dead"], "repeated": n["repeated_name"], "orphans": n["orphan"], "unresolved": n["unresolved"], "warnings": n["cycle_WARNING"]}
    one = spark.createDataFrame([(n["internal"], n["orphan"], n["unresolved"], n["cycle_WARNING"], 0)], "internal long, orphans long, unresolved long, warnings long, criticals long")
    validation = spark.createDataFrame([tuple(validated.values())], ", ".join(f"{k} long" for k in validated))
    own = {"hubs": lambda g: graph.hubs(g, top), "fat_modules": lambda g: graph.fat_modules(g, top), "health": lambda g: graph.scored(one), "validation": lambda g: validation, "cycles": lambda g: cycles}
    return graph.report(g, graph.PROVIDERS | own | {"run": lambda g: run_metrics(g, began, n["nodes"] + n["edges"])})


def diagnosed(spark: SparkSession, root: str, defaults: bool = True, ignore: list[str] | None = None) -> diagnostics.Diagnostics:
    """All that is wrong with a repository: files that can't be read or parsed, dead edges, repeated names, orphans, unknown symbols, cycles."""
    own = config.load(root)
    files = scan(spark, root, defaults=defaults, depth=own.depth, max_bytes=own.max_bytes, ignore=ignore)
    parsed = cut(parse.parsed(files))
    g = resolve.assembled(parsed, aliases(files))
    return diagnostics.collected(g, cut(iterate.cycles(graph.valid(g))), files, parsed)


def run_metrics(g: graph.Graph, began: float, rows: int) -> DataFrame:
    """One row: seconds since `began`, the rows that were counted meanwhile, and the peak of memory in MB, of the driver's Python and of Java's heap, there and on executors."""
    import resource

    own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    return g.nodes.sparkSession.createDataFrame([(round(time.monotonic() - began, 3), rows, round(own, 1), heap_mb(g.nodes.sparkSession))], "seconds double, rows long, peak_mb double, heap_mb double")


def heap_mb(spark: SparkSession) -> float:
    """The largest heap that Spark's metrics have of the driver or an executor, in MB; what the driver holds now if they have none yet."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    most = runtime.totalMemory() - runtime.freeMemory()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    for i in range(executors.size()):
        peak = executors.apply(i).peakMemoryMetrics()
        if peak.isDefined():
            most = max(most, peak.get().getMetricValue("JVMHeapMemory"))
    return round(most / 2**20, 1)


def with_more(rows: DataFrame, top: int, *order) -> DataFrame:
    """The first `top` rows, with how many more there are."""
    more = rows.agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("more"))
    return rows.orderBy(*order).limit(top).crossJoin(F.broadcast(more))  # more is one row


def summary(g: graph.Graph, top: int = 10) -> dict[str, DataFrame]:
    """The scale, and of domains, entry points and hubs the first with how many more there are."""
    domains = g.nodes.where("type = 'FILE'").groupBy(scalar.pack_domain(F.col("path")).alias("domain")).agg(F.count(F.lit(1)).alias("files"))
    files = graph.degrees(g).where("type = 'FILE' AND n_in > 0").select("id", "path", "n_in")
    return {"scale": graph.scale(g), "domains": with_more(domains, 15, F.desc("files"), "domain"), "entry_points": with_more(graph.entry_points(g), top, F.desc("n_out"), "id"), "hubs": with_more(files, top, F.desc("n_in"), "id")}


def impacted(g: graph.Graph, target: str, top: int = 50) -> DataFrame:
    """What a change of the target reaches, nearest first, each with the next node on a shortest way to it, whether the search was cut short, and how many more there are."""
    return with_more(cut(iterate.impact_paths(g, target, strict=True)), top, "depth", "path", "id")


def pack(spark: SparkSession, root: str, target: str = "", task: str | None = None, max_tokens: float | None = None, raw: bool = False, force: bool = False, profile: str | None = None, defaults: bool = True) -> tuple[DataFrame, DataFrame]:
    """(domain, best, text) of the most useful files below target, and the paths left out; see pack_blocks()."""
    blocks, left_out = pack_blocks(spark, root, target, task, max_tokens, raw, force, profile, defaults)
    return render.packed_text(blocks, _title(root)), left_out


def _title(root: str) -> str:
    return os.path.basename(os.path.abspath(root))


def save_pack(blocks: DataFrame, root: str, path: str) -> None:
    """The blocks of a pack as a folder of files, a domain or more each, written by the tasks that have them."""
    packsink.save(blocks, path, render.DOMAIN_HEADER.replace("{title}", _title(root)), render.DOMAIN_FOOTER)


def pack_blocks(spark: SparkSession, root: str, target: str = "", task: str | None = None, max_tokens: float | None = None, raw: bool = False, force: bool = False, profile: str | None = None, defaults: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, rank, domain, block, chars) of the most useful files below target, and the paths left out.

    Files are ranked by the task's relevance, or by what they are. Two passes keep the budget: by size, then by rendered blocks with their
    headers. Without a limit a pack over the guard of 100,000 tokens is refused unless forced. max_tokens None is no limit, 0 lets nothing in.
    """
    own = config.load(root)
    wanted = [p.strip("/") for p in (own.profiles.get(profile, []) if profile else [target]) if p.strip("/")]
    files = scan(spark, root, defaults=defaults, max_bytes=own.max_bytes).where("error IS NULL")
    below = F.lit(not wanted)
    for w in wanted:
        below = below | (F.col("path") == w) | F.col("path").startswith(f"{w}/")
    files = files.where(below)
    if max_tokens is None and not force and files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("s")).first().s / scalar.CHARS_PER_TOKEN > 100_000:
        raise ValueError("the pack would exceed 100,000 tokens; give a limit or force it")
    if task:
        g = assembled(files)
        words = g.nodes.select("id", F.concat_ws(" ", "name", "path", "purpose").alias("text"))
        seeds = lexical.top_seeds(lexical.lexical_scores(words, task))
        scores = lexical.path_scores(iterate.diffusion(g.edges, seeds).join(g.nodes.select("id", "path"), "id"))
        scored = lexical.file_scores(files.select("path"), scores)
    else:
        scored = files.select("path", ranking.heuristic(F.col("path")).cast("double").alias("score"))
    ranks = ranking.ranked(scored).join(files.select("path", F.col("length").alias("size")), "path")
    name = _title(root)
    if max_tokens is not None:
        ranks = ranking.within_budget(ranks, max_tokens * scalar.CHARS_PER_TOKEN, F.col("rank"), spent=len(render.pack_header(name)))
    entities = parse.parsed(files).select(F.col("file_path").alias("path"), "entities")
    body = F.concat(F.lit("## "), "path", F.lit("\n"), "text", F.lit("\n")) if raw else render.file_block(F.col("path"), F.col("text"), F.coalesce("entities", F.array()))
    # Binaries have no text and stay out.
    blocks = ranks.join(texts(files).where("text IS NOT NULL"), "path").join(entities, "path", "left").select("path", "rank", scalar.pack_domain(F.col("path")).alias("domain"), body.alias("block"))
    blocks = blocks.withColumn("chars", F.length("block"))
    if max_tokens is not None:
        blocks = ranking.packed_by_domain(blocks, max_tokens, render.DOMAIN_HEADER.replace("{title}", name), render.DOMAIN_FOOTER, len(render.pack_header(name)))
    left_out = files.select("path").join(blocks.select("path"), "path", "left_anti")
    return blocks, left_out


def write_pack(packed: DataFrame, root: str, name: str) -> str:
    """The pack as a file of its own below the settings folder, one domain after the other, readable by its owner only; its path. A name that is taken gets a suffix.

    The file appears as a whole or not at all. Domains are fetched one at a time.
    """
    folder = os.path.join(root, ".lodeline", "packs")
    os.makedirs(folder, exist_ok=True)
    safe = os.path.basename(name) or "pack"
    path = os.path.join(folder, f"{safe}.md")
    while os.path.exists(path):
        path = os.path.join(folder, f"{safe}-{uuid.uuid4().hex[:8]}.md")
    new = f"{path}.{uuid.uuid4().hex}.new"
    try:
        with os.fdopen(os.open(new, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8") as f:
            f.write(render.pack_header(safe))
            for r in packed.orderBy("best").toLocalIterator():
                f.write(r.text)
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.unlink(new)
    return path


def export(context: str, packed: DataFrame) -> DataFrame:
    """One row (text): the context and the whole pack, whose text can't close the pack's tag."""
    whole = packed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("best", "text"))), lambda x: x.text), "\n").alias("pack"))
    return whole.select(render.exported(F.lit(context), F.col("pack")).alias("text"))
