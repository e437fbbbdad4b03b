"""Queries over the test tables, one or more for each operator, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import diagnostics, discovery, graph, graphstore, hashtree, iterate, lexical, lexindex, memory, ranking, render, resolve, vaultlog
from ..sources import packsink, tree
from . import fixtures as fx
from . import lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

G1 = f"WITH RECURSIVE nodes AS ({fx.NODES}), edges AS ({fx.EDGES}) "
LOGICAL = "('" + "', '".join(graph.LOGICAL) + "')"
QUERY = "the tention and thor ertion heresa reonly"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _graph(name: str, oracle: str, f: Callable[[graph.Graph], DataFrame], injected: bool = False) -> None:
    """A query over G1."""
    query(name, oracle)(lambda spark, sf_dir: f(fx.graph(spark, sf_dir, injected)))


FAN = f"""le AS (SELECT DISTINCT src, dst FROM edges WHERE type IN {LOGICAL}),
fan AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM le UNION ALL SELECT src, 0, 1 FROM le) AS x GROUP BY id) """
_graph("hubs", G1 + f", {FAN} SELECT f.id, coalesce(n.name, f.id) AS name, fan_in, fan_out, 2 * fan_in + fan_out AS score FROM fan f LEFT JOIN nodes n ON n.id = f.id ORDER BY score DESC, f.id LIMIT 10", graph.hubs)
_graph("hub_scores", G1 + f", {FAN} SELECT id, fan_in, fan_out, 2 * fan_in + fan_out AS score FROM fan", graph.hub_scores)
_graph("most_depended", G1 + f", {FAN} SELECT id, fan_in FROM fan WHERE fan_in > 0 ORDER BY fan_in DESC, id LIMIT 10", graph.most_depended)
_graph(
    "topology",
    G1 + """SELECT count(*) FILTER (type = 'FILE') AS files, count(*) FILTER (type <> 'FILE') AS entities, count(*) FILTER (type = 'CLASS') AS class, count(*) FILTER (type = 'FUNCTION') AS "function", count(*) FILTER (type = 'INTERFACE') AS interface,
(SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE type = 'CONTAINS') AS edges_contains, (SELECT count(*) FROM edges WHERE type = 'IMPORTS') AS edges_imports,
(SELECT count(*) FROM edges WHERE type = 'CALLS') AS edges_calls, (SELECT count(*) FROM edges WHERE type = 'EXTENDS') AS edges_extends FROM nodes""",
    graph.topology,
)
_graph("edge_mix", G1 + "SELECT type, count(*) AS n FROM edges GROUP BY type", graph.edge_mix)
_graph("density", G1 + "SELECT v, e, round(e / (CAST(v AS DOUBLE) * (v - 1)), 9) AS density, CASE WHEN e / (CAST(v AS DOUBLE) * (v - 1)) < 0.05 THEN 'sparse' WHEN e / (CAST(v AS DOUBLE) * (v - 1)) < 0.2 THEN 'moderate' ELSE 'dense' END AS label FROM (SELECT count(*) FILTER (type <> 'FILE') AS v FROM nodes) AS a, (SELECT count(*) FILTER (type <> 'CONTAINS') AS e FROM edges) AS b", graph.density)
_graph("confidence_buckets", G1 + "SELECT count(*) AS n, round(100.0 * count(*) FILTER (confidence >= 0.9) / count(*), 6) AS high, round(100.0 * count(*) FILTER (confidence >= 0.4 AND confidence < 0.9) / count(*), 6) AS medium, round(100.0 * count(*) FILTER (confidence < 0.4) / count(*), 6) AS low, count(*) FILTER (method = 'unresolved') AS unresolved FROM edges", graph.confidence_buckets)
ORPHANS = f"SELECT id, type, name FROM nodes WHERE type IN ('CLASS', 'FUNCTION', 'INTERFACE') AND id NOT IN (SELECT src FROM edges WHERE type IN {LOGICAL} UNION SELECT dst FROM edges WHERE type IN {LOGICAL})"
_graph("orphans", G1 + ORPHANS, graph.orphans)
_graph("duplicates", G1 + "SELECT fqn, count(*) AS n, min(id) AS first_id FROM nodes GROUP BY fqn HAVING count(*) > 1", graph.duplicates)
_graph("dead_edges", f"WITH nodes AS ({fx.NODES}), edges AS ({fx.INJECTED}) SELECT src, dst, type, CASE WHEN s AND d THEN 'src,dst' WHEN s THEN 'src' ELSE 'dst' END AS missing FROM (SELECT *, src NOT IN (SELECT id FROM nodes) AS s, dst NOT IN (SELECT id FROM nodes) AS d FROM edges) AS x WHERE s OR d", graph.dead_edges, True)
_graph("valid_edges", f"WITH nodes AS ({fx.NODES}), edges AS ({fx.INJECTED}) SELECT src, dst, type, confidence, method FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)", lambda g: graph.valid(g).edges, True)
DEGREES = "deg AS (SELECT n.id, n.type, n.path, (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS n_in, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS n_out FROM nodes n) "
_graph("degrees", G1 + f", {DEGREES} SELECT * FROM deg", graph.degrees)
HINTED = " OR ".join(f"contains(lower(path), '{h}')" for h in graph.ENTRY_HINTS)
_graph("entry_points", G1 + f", {DEGREES} SELECT id, path, n_in, n_out FROM deg WHERE type = 'FILE' AND ((n_in = 0 AND n_out > 0) OR {HINTED}) AND n_in < 3", graph.entry_points)
_graph("file_hubs", G1 + f", {DEGREES} SELECT id, path, n_in FROM deg WHERE type = 'FILE' AND n_in > 0 ORDER BY n_in DESC, id LIMIT 10", graph.file_hubs)
_graph(
    "module_coupling",
    G1 + """, m AS (SELECT id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS module FROM nodes),
e AS (SELECT DISTINCT a.module AS a, b.module AS b FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE type IN ('CALLS', 'USES', 'EXTENDS', 'IMPLEMENTS') AND a.module <> b.module),
f AS (SELECT module, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT b AS module, 1 AS i, 0 AS o FROM e UNION ALL SELECT a, 0, 1 FROM e) AS x GROUP BY module)
SELECT module, fan_in, fan_out, round(CAST(fan_out AS DOUBLE) / (fan_in + fan_out), 2) AS instability FROM f""",
    graph.coupling,
)
_graph("component_density", G1 + "SELECT round(CAST(count(*) FILTER (type = 'FUNCTION') AS DOUBLE) / count(*) FILTER (type = 'FILE'), 6) AS functions_per_file, round(CAST(count(*) FILTER (type = 'CLASS') AS DOUBLE) / count(*) FILTER (type = 'FILE'), 6) AS classes_per_file FROM nodes", graph.component_density)
_graph("fat_modules", G1 + "SELECT src, coalesce(path, src) AS path, n, CASE WHEN n > 20 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT src, count(*) AS n FROM edges WHERE type = 'CONTAINS' GROUP BY src ORDER BY n DESC, src LIMIT 3) AS x LEFT JOIN nodes ON nodes.id = x.src", graph.fat_modules)
_graph(
    "health",
    G1 + f""", o AS ({ORPHANS}), c AS (SELECT count(*) FILTER (type IN ('CLASS', 'FUNCTION', 'INTERFACE')) AS internal, count(*) FILTER (type = 'UNRESOLVED_EXTERNAL') AS unresolved FROM nodes),
s AS (SELECT internal, (SELECT count(*) FROM o) AS orphans, unresolved, CAST(0 AS BIGINT) AS warnings FROM c),
t AS (SELECT *, round(greatest(100 - least(15.0, 100.0 * orphans / internal) - least(10.0, 50.0 * unresolved / internal), 0.0), 1) AS score FROM s)
SELECT internal, orphans, unresolved, warnings, CAST(score AS DOUBLE) AS score, CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 80 THEN 'WARNING' ELSE 'INFO' END AS severity FROM t""",
    lambda g: graph.health(g, iterate.cyclic_nodes(g.of_type(("CALLS",)))),
)
_graph("scale", G1 + "SELECT count(*) FILTER (type = 'FILE') AS files, count(*) FILTER (type = 'CLASS') AS classes, count(*) FILTER (type = 'FUNCTION') AS functions FROM nodes", graph.scale)
_graph("domain_cut", G1 + ", m AS (SELECT id FROM nodes WHERE path LIKE 'core/r1/%') SELECT src, dst, type, CASE WHEN a THEN 'out' ELSE 'in' END AS direction FROM (SELECT *, src IN (SELECT id FROM m) AS a, dst IN (SELECT id FROM m) AS b FROM edges) AS x WHERE a <> b", lambda g: graph.domain_cut(g, g.nodes.where("path LIKE 'core/r1/%'").select("id")))
_graph("node_ids", G1 + "SELECT id, concat('file_', substr(sha256(path), 1, 12)) AS node_id, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') AS module FROM nodes", lambda g: g.nodes.select("id", scalar.node_id("file", F.col("path")).alias("node_id"), scalar.module_path(F.col("path")).alias("module")))
_graph("suffix_flags", G1 + "SELECT coalesce(bool_or(ends_with(lower(name), 'command')), false) AS command, coalesce(bool_or(ends_with(lower(name), 'query')), false) AS query, coalesce(bool_or(ends_with(lower(name), 'handler')), false) AS handler, coalesce(bool_or(type IN ('CLASS', 'INTERFACE') AND (ends_with(lower(name), 'provider') OR contains(lower(name), 'injector') OR contains(lower(name), 'container'))), false) AS injection FROM nodes", graph.suffix_flags)

IMPACT = """hit AS (SELECT id FROM nodes WHERE lower(path) = 'core/r1/n1' OR ends_with(lower(path), '/core/r1/n1')),
walk AS (SELECT id, 0 AS depth FROM hit UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.depth < 5),
found AS (SELECT n.id, n.type, n.path, min(depth) AS depth FROM walk w JOIN nodes n ON n.id = w.id WHERE n.type <> 'UNRESOLVED_EXTERNAL' GROUP BY ALL HAVING min(depth) > 0),
risky AS (SELECT id, type, path, depth, CASE WHEN depth = 1 THEN 'HIGH' WHEN depth = 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM found) """
_graph("impact", G1 + f", {IMPACT} SELECT * FROM risky", lambda g: iterate.impact(g, "core/r1/n1"))
_graph("impact_summary", G1 + f", {IMPACT} SELECT count(DISTINCT path) FILTER (type = 'FILE') AS files, count(*) FILTER (type <> 'FILE') AS entities, CASE WHEN min(depth) = 1 THEN 'HIGH' WHEN min(depth) = 2 THEN 'MEDIUM' WHEN count(*) > 0 THEN 'LOW' ELSE 'NONE' END AS risk, string_agg(DISTINCT string_split(path, '/')[1], ',' ORDER BY string_split(path, '/')[1]) AS domains FROM risky", lambda g: iterate.impact_summary(iterate.impact(g, "core/r1/n1"), scalar.impact_domain(F.col("path"))))
_HOP = "h{k} AS (SELECT b.next AS id, max(f.score) * 0.5 AS score FROM {f} f JOIN both_ b ON b.id = f.id WHERE f.score * 0.5 >= 5 AND b.next NOT IN ({seen}) GROUP BY b.next)"
_SEEN = ["SELECT id FROM h0", "SELECT id FROM h0 UNION SELECT id FROM h1", "SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2"]
_graph(
    "relevance_diffusion",
    G1 + f", {FAN}, both_ AS (SELECT src AS id, dst AS next FROM edges UNION SELECT dst, src FROM edges), top AS (SELECT id, 2 * fan_in + fan_out AS score FROM fan ORDER BY score DESC, id LIMIT 50), h0 AS (SELECT id, 100.0 * CAST(score AS DOUBLE) / (SELECT max(score) FROM top) AS score FROM top), "
    + ", ".join(_HOP.format(k=k + 1, f=f"h{k}", seen=_SEEN[k]) for k in range(3)) + " SELECT id, round(score, 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) AS x",
    lambda g: iterate.diffusion(g.edges, graph.hub_scores(g).select("id", F.col("score").cast("double").alias("score")), size=g.size).select("id", F.round("score", 6).alias("score")),
)

RING = f"WITH RECURSIVE edges AS ({fx.RING}), seeds AS ({fx.SEEDS}), "


@query("domains", RING + "reach AS (SELECT id AS seed, label, id FROM seeds UNION SELECT r.seed, r.label, e.dst FROM reach r JOIN edges e ON e.src = r.id WHERE e.dst NOT IN (SELECT id FROM seeds)), l AS (SELECT id, count(DISTINCT label) AS k, min(label) AS label FROM reach GROUP BY id) SELECT concat('p', p_partkey) AS id, CASE WHEN k = 1 THEN label WHEN k > 1 THEN 'shared' ELSE 'global' END AS domain FROM part LEFT JOIN l ON l.id = concat('p', p_partkey)")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.views(spark, sf_dir, "part")
    return iterate.domains(spark.sql(fx.RING_NODES), spark.sql(fx.RING), spark.sql(fx.SEEDS))


@query("cyclic_nodes", RING + "reach AS (SELECT src AS o, dst AS id FROM edges UNION SELECT r.o, e.dst FROM reach r JOIN edges e ON e.src = r.id) SELECT DISTINCT o AS id FROM reach WHERE o = id")
def cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.cyclic_nodes(fx.sql(spark, sf_dir, fx.RING, "part"))


@query("include_closure", f"WITH RECURSIVE links AS ({fx.INCLUDES}), seen AS (SELECT 'f1' AS id UNION SELECT l.dst FROM seen s JOIN links l ON l.src = s.id) SELECT id FROM seen")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.closure(fx.sql(spark, sf_dir, fx.INCLUDES, "part"), spark.sql("SELECT 'f1' AS id"))


@query("domain_groups", "SELECT concat('domain_', substr(sha256(concat(name, ':', members)), 1, 12)) AS id, name, 'DOMAIN' AS type, n, members FROM (SELECT concat('r', n_regionkey) AS name, count(*) AS n, string_agg(concat('n', n_nationkey), ',' ORDER BY concat('n', n_nationkey)) AS members FROM nation GROUP BY n_regionkey) AS x")
def domain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.domain_groups(fx.sql(spark, sf_dir, "SELECT concat('n', n_nationkey) AS id, concat('r', n_regionkey) AS domain FROM nation", "nation"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


WORDS = "list_filter(regexp_extract_all(translate(lower(text), '_-', '  '), '[\\p{L}\\p{N}]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))"
TERMS = f"docs AS (SELECT doc_id AS id, list_distinct({WORDS}) AS t FROM documents)"
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"


@query("term_idf", f"WITH {TERMS}, w AS (SELECT unnest(t) AS term FROM docs) SELECT term, df, round({IDF}, 6) AS idf FROM (SELECT term, count(*) AS df, (SELECT count(*) FROM docs) AS n FROM w GROUP BY term) AS x")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_idf(_docs(spark, sf_dir))


SCORES = f"WITH {TERMS}, q AS (SELECT DISTINCT unnest(string_split('{QUERY}', ' ')) AS term), w AS (SELECT id, unnest(t) AS term FROM docs), d AS (SELECT term, count(*) AS df, (SELECT count(*) FROM docs) AS n FROM w JOIN q USING (term) GROUP BY term), s AS (SELECT id, sum({IDF}) AS score FROM w JOIN d USING (term) GROUP BY id), scores AS (SELECT docs.id, round(coalesce(score, 0), 6) AS score FROM docs LEFT JOIN s USING (id)) "


@query("lexical_scores", SCORES + "SELECT * FROM scores")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_scores(_docs(spark, sf_dir), QUERY)


@query("lexical_top50", SCORES + "SELECT * FROM scores WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def lexical_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_seeds(lexical_scores(spark, sf_dir))


@query(
    "bm25",
    f"""WITH docs AS (SELECT doc_id AS id, coalesce({WORDS}, []) AS w FROM documents), q AS (SELECT DISTINCT unnest(string_split('{QUERY}', ' ')) AS term),
t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM docs) AS x JOIN q USING (term) GROUP BY id, term), d AS (SELECT term, count(*) AS df, (SELECT count(*) FROM docs) AS n FROM t GROUP BY term),
a AS (SELECT avg(len(w)) AS avg FROM docs), s AS (SELECT id, sum({IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / greatest(avg, 1.0)))) AS score FROM t JOIN d USING (term) JOIN docs USING (id), a GROUP BY id)
SELECT docs.id, round(coalesce(score, 0), 6) AS score FROM docs LEFT JOIN s USING (id)""",
)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf_dir), QUERY).select("id", F.round("score", 6).alias("score"))


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("token_total", "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / 3.5::DOUBLE, 3) AS tokens FROM documents")
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.token_total(_table("documents")(spark, sf_dir))


@query("size_guard", "SELECT round(sum(n_chars) / 3.5::DOUBLE, 3) AS tokens, sum(n_chars) / 3.5::DOUBLE > 100000 AS too_large FROM documents")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.size_guard(_table("documents")(spark, sf_dir))


@query("largest", "SELECT doc_id, n_chars, CASE WHEN n_chars > 102400 THEN 'very large' WHEN n_chars > 51200 THEN 'large' ELSE 'ok' END AS flag FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.largest(_table("documents")(spark, sf_dir), "doc_id", "n_chars")


@query("budget", "WITH RECURSIVE r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents), f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS total, false AS kept UNION ALL SELECT r.k, r.doc_id, r.n_chars, CASE WHEN f.total + r.n_chars <= 350000 THEN f.total + r.n_chars ELSE f.total END, f.total + r.n_chars <= 350000 FROM f JOIN r ON r.k = f.k + 1) SELECT doc_id, n_chars FROM f WHERE kept")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table("documents")(spark, sf_dir).select("doc_id", "n_chars")
    return ranking.within_budget(docs, 100_000 * scalar.CHARS_PER_TOKEN, F.col("doc_id"), size="n_chars")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sql(spark, sf_dir, fx.PATHS, "pages")


PATHS = f"WITH paths AS ({fx.PATHS}) "
NAME = "string_split(path, '/')[-1]"
EXT = f"lower(regexp_extract({NAME}, '[^.](\\.[^.]+)$', 1))"


@query("ext_breakdown", PATHS + f"SELECT ext, n, CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in discovery.LANGUAGES.items()) + f" ELSE 'Unknown' END AS language FROM (SELECT {EXT} AS ext, count(*) AS n FROM paths WHERE {EXT} <> '' GROUP BY 1 ORDER BY n DESC, ext LIMIT 5) AS x")
def ext_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.languages(_paths(spark, sf_dir))


@query("ancestors", PATHS + "SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM paths) AS x")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.ancestors(_paths(spark, sf_dir))


RULES = [("Regions", "asia", r"\bcore/r[12]\b", 0.6), ("Regions", "europe", r"\br3\b", 0.5), ("Library", "brand", r"\bbrand#1\d\b", 0.7), ("Nothing", "none", "zzz", 1.0)]
_TEXT = "lower(translate(regexp_replace(path, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  '))"
_HITS = G1 + ", hits AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, '{r}' AS rule, {w} AS weight, path FROM nodes WHERE regexp_matches({_TEXT}, '{p}')" for t, r, p, w in RULES) + ") "


@query("rule_eval", _HITS + ", w AS (SELECT target, rule, max(weight) AS weight FROM hits GROUP BY ALL), e AS (SELECT target, path FROM (SELECT DISTINCT target, path FROM hits) AS x QUALIFY row_number() OVER (PARTITION BY target ORDER BY path) <= 5) SELECT target, round(CAST(least(sum(weight), 1.0) AS DOUBLE), 6) AS confidence, (SELECT string_agg(path, ',' ORDER BY path) FROM e WHERE e.target = w.target) AS evidence FROM w GROUP BY target")
def rule_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.evaluated(fx.graph(spark, sf_dir).nodes.select("path"), RULES)


@query("ranked_paths", PATHS + f"""SELECT path, score, row_number() OVER (ORDER BY score DESC, len(string_split(path, '/')), {NAME}, path) AS rank FROM (SELECT path,
CASE WHEN lower({NAME}) IN ({', '.join(f"'{x}'" for x in ranking.WELL_KNOWN)}) THEN 100 ELSE 0 END + CASE WHEN len(string_split(path, '/')) = 1 THEN 40 ELSE 0 END
+ CASE WHEN list_has_any(string_split(lower(path), '/'), {list(ranking.SOURCES)}) THEN 40 ELSE 0 END - CASE WHEN list_has_any(string_split(lower(path), '/'), {list(ranking.TESTS)}) THEN 10 ELSE 0 END - CASE WHEN list_has_any(string_split(lower(path), '/'), {list(ranking.UTILITIES)}) THEN 20 ELSE 0 END AS score FROM paths) AS x""")
def ranked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_paths(spark, sf_dir).select("path", ranking.heuristic(F.col("path")).alias("score")))


@query("guidance", PATHS + "SELECT path, rank, CASE WHEN rank <= greatest(1, floor(n * 0.2)) THEN 'read_first' WHEN n > 3 AND rank > n - greatest(1, floor(n * 0.4)) THEN 'ignore' ELSE 'normal' END AS advice FROM (SELECT path, row_number() OVER (ORDER BY len(string_split(path, '/')), string_split(path, '/')[-1], path) AS rank, count(*) OVER () AS n FROM paths) AS x")
def guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.guidance(ranking.ranked(_paths(spark, sf_dir).withColumn("score", F.lit(0))).select("path", "rank"))


@query("tree_breadth", PATHS + """, each AS (SELECT array_to_string(p[1:i - 1], '/') AS parent, p[i] AS name, i AS level, i < len(p) AS is_dir FROM (SELECT string_split(path, '/') AS p, unnest(range(1, least(len(string_split(path, '/')), 4) + 1)) AS i FROM paths) AS x),
g AS (SELECT parent, name, level, bool_or(is_dir) AS is_dir FROM each GROUP BY ALL)
SELECT parent, name, is_dir, CAST(level AS INT) AS level, CAST(k AS INT) AS k, more FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) AS k, greatest(count(*) OVER (PARTITION BY parent) - 50, 0) AS more FROM g) AS y WHERE k <= 50""")
def tree_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.tree_rows(_paths(spark, sf_dir))


@query("pack_domains", PATHS + "SELECT domain, count(*) AS n FROM (SELECT CASE WHEN len(p) < 2 THEN 'root' WHEN p[1] IN ('src', 'app', 'lib', 'cli', 'frontend', 'backend') AND len(p) > 2 THEN concat(p[1], '/', p[2]) ELSE p[1] END AS domain FROM (SELECT string_split(path, '/') AS p FROM paths) AS x) AS y GROUP BY domain")
def pack_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(scalar.pack_domain(F.col("path")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("import_resolution", "SELECT * FROM (VALUES ('m.py', 'src/x', 'src/x.ts'), ('m.py', 'src/u', 'src/u.py'), ('m.py', 'src/v', 'src/v/__init__.py'), ('m.py', 'src/x.py', 'src/x.py')) AS t(src, module, dst)")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_imports(spark.sql(fx.FILES), spark.sql(fx.IMPORTS))


@query("symbol_resolution", "SELECT module, symbol, target, CAST(confidence AS DOUBLE) AS confidence, method FROM (VALUES ('m.a', 'Foo', 'm.a.Foo', 1.0, 'file_local_match'), ('m.c', 'Foo', 'm.a.Foo', 0.5, 'ambiguous_name'), ('m.c', 'Bar', 'm.b.Bar', 0.8, 'global_name'), ('m.c', 'b.Bar', 'm.b.Bar', 0.6, 'suffix'), ('m.c', 'zzz', concat('ext_', substr(sha256('zzz'), 1, 12)), 1.0, 'unresolved')) AS t(module, symbol, target, confidence, method)")
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_symbols(spark.sql(fx.ENTITIES), spark.sql(fx.REFS))


@query("part_symbols", "WITH e AS (SELECT concat('lib.', replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_')) AS fqn, replace(p_name, ' ', '_') AS symbol FROM part), s AS (SELECT symbol, min(fqn) AS target, count(DISTINCT fqn) AS n FROM e GROUP BY symbol) SELECT 'main' AS module, symbol, target, CASE WHEN n = 1 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN n = 1 THEN 'global_name' ELSE 'ambiguous_name' END AS method FROM s")
def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"))
    return resolve.resolved_symbols(parts.select(F.concat_ws(".", F.lit("lib"), "brand", "symbol").alias("fqn")), parts.select(F.lit("main").alias("module"), "symbol").distinct())


@query("memory_upsert", "SELECT id, name, category, rule, CAST(confidence AS DOUBLE) AS confidence, source, created_at FROM (VALUES ('1', 'naming', 'style', 'use camel case', 0.7, 'auto', '2024-01-01'), ('2', 'tests', 'quality', 'write tests', 0.9, 'user', '2024-01-01'), ('3', 'globals', 'style', 'no globals', 0.9, 'auto', '2024-01-01'), (concat('rule_', substr(sha256('quality|docs|write docs'), 1, 12)), 'docs', 'quality', 'write docs', 0.7, 'auto', '2024-02-01')) AS t(id, name, category, rule, confidence, source, created_at)")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault, new = (spark.sql(x).withColumn("confidence", F.col("confidence").cast("double")) for x in (fx.VAULT.format(string="STRING"), fx.NEW_RULES))
    return memory.upserted(vault, new)


@query("pattern_antijoin", "SELECT 'docs' AS name, 'quality' AS category, 'write docs' AS description")
def pattern_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.unknown_patterns(spark.sql(fx.NEW_RULES).select("name", "category", F.col("rule").alias("description")), spark.sql(fx.VAULT.format(string="STRING"))).select("name", "category", "description")


@query("fingerprint", "SELECT sha256(string_agg(concat(doc_id, '|', n_chars, '|', source), '' ORDER BY CAST(doc_id AS VARCHAR), n_chars, source)) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table("documents")(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("source").alias("mtime"))
    return discovery.fingerprint(docs, groups=1)


def _told(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(length(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)) END"


_LEVEL = "l{d} AS (SELECT substr(leaf, 1, {d}) AS leaf, sha256(string_agg(h, '' ORDER BY h)) AS h FROM {of} GROUP BY 1)"


@query(
    "fingerprint_tree",
    f"WITH x AS (SELECT substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS leaf, sha256(concat({', '.join(map(_told, ('doc_id', 'n_chars', 'source')))})) AS h FROM documents), "
    + ", ".join(_LEVEL.format(d=d, of="x" if d == 3 else f"l{d + 1}") for d in (3, 2, 1, 0)) + " SELECT h AS fingerprint FROM l0",
)
def fingerprint_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table("documents")(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("source").alias("mtime"))
    return discovery.fingerprint(docs, depth=3)


@query("excerpts", "SELECT page_id, CASE WHEN length(html) > 1000 THEN concat(substr(html, 1, 1000), chr(10), '... (cut)') ELSE html END AS excerpt, length(html) - length(replace(html, chr(10), '')) + 1 AS lines FROM pages")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("pages")(spark, sf_dir).select("page_id", scalar.excerpt(F.col("html")).alias("excerpt"), scalar.line_count(F.col("html")).cast("long").alias("lines"))


@query("exported_pages", "SELECT page_id, concat('context', chr(10), '<html>', chr(10), regexp_replace(html, '</\\s*html\\s*>', '&lt;/html&gt;', 'gi'), chr(10), '</html>', chr(10)) AS text FROM pages")
def exported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("pages")(spark, sf_dir).select("page_id", render.exported(F.lit("context"), F.col("html"), "html").alias("text"))


@query("metrics_report")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All providers' rows as JSON; each provider but the health is a query of its own with SQL."""
    return graph.report(fx.graph(spark, sf_dir))


@query("safe_names", "SELECT p_partkey, substr(rtrim(regexp_replace(concat(p_name, ' / ', p_type, '?'), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 20) AS name FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("part")(spark, sf_dir).select("p_partkey", scalar.safe_name(F.concat("p_name", F.lit(" / "), "p_type", F.lit("?")), 20).alias("name"))


_BARE = "trim(regexp_replace(line, '(^|\\s)#.*$', ''))"


@query("requirement_names", f"SELECT id, CASE WHEN {_BARE} = '' OR starts_with({_BARE}, '-') OR regexp_matches({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*://') OR NOT regexp_matches({_BARE}, '^[A-Za-z0-9]') THEN NULL ELSE lower(regexp_extract({_BARE}, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)) END AS name FROM ({fx.REQUIREMENTS}) AS x")
def requirement_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sql(spark, sf_dir, fx.REQUIREMENTS, "part").select("id", scalar.requirement_name(F.col("line")).alias("name"))


@query("confidence_labels", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_quantity / 50 >= 0.9 THEN 'High' WHEN l_quantity / 50 >= 0.7 THEN 'Medium' ELSE 'Low' END AS label FROM lineitem) AS x GROUP BY label")
def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("lineitem")(spark, sf_dir).groupBy(scalar.confidence_label(F.col("l_quantity") / 50).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_TOPS = "('" + "', '".join(scalar.IMPACT_TOP) + "')"


@query("impact_domains", PATHS + f"SELECT domain, count(*) AS n FROM (SELECT CASE WHEN p[1] IN {_TOPS} AND len(p) > 1 THEN p[2] ELSE p[1] END AS domain FROM (SELECT string_split(path, '/') AS p FROM paths) AS x) AS y GROUP BY domain")
def impact_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(scalar.impact_domain(F.col("path")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("unresolved_externals", f"SELECT id, name FROM ({fx.EXTERNALS}) AS x WHERE type = 'UNRESOLVED_EXTERNAL' AND name NOT IN ('" + "', '".join(graph.BUILTINS) + "')")
def unresolved_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fx.sql(spark, sf_dir, fx.EXTERNALS, "part")
    return graph.unresolved(graph.Graph(nodes, spark.createDataFrame([], "src string, dst string, type string, confidence double, method string")))


_SHOWN = "SELECT path, CAST(length(path) AS DOUBLE) AS score FROM paths WHERE length(path) % 3 = 0"


@query("path_scores", PATHS + "SELECT regexp_replace(path, '/[^/]*$', '') AS path, CAST(max(length(path)) AS DOUBLE) AS score FROM paths GROUP BY 1")
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.path_scores(_paths(spark, sf_dir).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.length("path").cast("double").alias("score")))


@query(
    "file_relevance",
    PATHS + f""", s AS (SELECT CASE WHEN length(path) % 2 = 0 THEN concat('/repo/', path) ELSE regexp_replace(path, '^[^/]*/', '') END AS path, score FROM ({_SHOWN}) AS x), b AS (SELECT path, max(score) AS score FROM s GROUP BY path)
SELECT f.path, coalesce(max(CASE WHEN b.path = f.path THEN b.score END), max(b.score), 0) AS score FROM paths f LEFT JOIN b ON b.path = f.path OR ends_with(b.path, concat('/', f.path)) OR ends_with(f.path, concat('/', b.path)) GROUP BY f.path""",
)
def file_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    shown = paths.where(F.length("path") % 3 == 0).select(F.when(F.length("path") % 2 == 0, F.concat(F.lit("/repo/"), "path")).otherwise(F.regexp_replace("path", "^[^/]*/", "")).alias("path"), F.length("path").cast("double").alias("score"))
    return lexical.file_scores(paths, shown)


FRAMEWORK_RULES = [("brand#11", "frontend", "Eleven"), ("brand#12", "backend", "Twelve"), ("brand#13", "backend", "Twelve"), ("nothing", "backend", "None")]
CONVENTION_RULES = [("brand#21", "state", "B", 2), ("brand#22", "state", "A", 1), ("brand#23", "testing", "C", None), ("brand#24", "testing", "D", None)]
LAYER_RULES = [(f"brand#{i}", "odd" if i % 2 else "even") for i in range(11, 30)]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("part")(spark, sf_dir).select(F.col("p_brand").alias("name"))


@query("framework_rules", f"SELECT DISTINCT side, framework FROM part JOIN {_values(FRAMEWORK_RULES)} AS r(name, side, framework) ON lower(p_brand) = name")
def framework_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.frameworks(_brands(spark, sf_dir), FRAMEWORK_RULES)


@query("convention_rules", f"WITH h AS (SELECT DISTINCT category, pattern, priority FROM part JOIN {_values(CONVENTION_RULES)} AS r(name, category, pattern, priority) ON lower(p_brand) = name) SELECT category, pattern FROM h WHERE priority IS NULL OR priority = (SELECT min(priority) FROM h AS o WHERE o.category = h.category)")
def convention_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.conventions(_brands(spark, sf_dir), CONVENTION_RULES)


@query("layer_hints", G1 + f", f AS (SELECT DISTINCT unnest(string_split(lower(path), '/')[:-2]) AS folder FROM nodes) SELECT layer, folder FROM f JOIN {_values(LAYER_RULES)} AS r(folder, layer) USING (folder)")
def layer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.layers(fx.graph(spark, sf_dir).nodes.select("path"), LAYER_RULES)


@query("architecture", "WITH d AS (SELECT lower(r_name) AS name, count(*) AS size FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'api', 1 UNION ALL SELECT 'core', 9), c AS (SELECT p_brand AS target, 0.5::DOUBLE AS confidence FROM part GROUP BY p_brand) SELECT CAST(0 AS INT) AS rank, 'Clean Architecture' AS name, 0.85::DOUBLE AS confidence WHERE (SELECT count(*) FROM d WHERE name IN ('api', 'core')) = 2 UNION ALL SELECT 1, 'Modular', 0.9::DOUBLE WHERE (SELECT count(*) FROM d WHERE size > 3 AND name <> 'root') > 2 UNION ALL SELECT 2, target, confidence FROM c")
def architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.views(spark, sf_dir, "nation", "region", "part")
    sizes = spark.sql("SELECT lower(r_name) AS name, count(*) AS size FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'api', 1 UNION ALL SELECT 'core', 9")
    return discovery.architecture(sizes, spark.sql("SELECT p_brand AS target, CAST(0.5 AS DOUBLE) AS confidence FROM part GROUP BY p_brand"))


PACK_TOKENS = 40_000
_BLOCKS = "SELECT source AS domain, doc_id AS rank, n_chars AS chars FROM documents"


@query(
    "pack_budget",
    f"""WITH RECURSIVE b AS ({_BLOCKS}), best AS (SELECT domain, min(rank) AS best, length(domain) + 3 AS head FROM b GROUP BY domain), r AS (SELECT domain, rank, chars, row_number() OVER (ORDER BY best, rank) AS k FROM b JOIN best USING (domain)),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS domain, CAST(-1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS chars, (SELECT CAST(sum(head) AS BIGINT) FROM best) AS total, false AS kept
    UNION ALL SELECT r.k, r.domain, r.rank, r.chars, CASE WHEN f.total + r.chars <= {PACK_TOKENS * 7 // 2} THEN f.total + r.chars ELSE f.total END, f.total + r.chars <= {PACK_TOKENS * 7 // 2} FROM f JOIN r ON r.k = f.k + 1)
SELECT domain, rank, chars FROM f WHERE kept""",
)
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.views(spark, sf_dir, "documents")
    return ranking.packed_by_domain(spark.sql(_BLOCKS), PACK_TOKENS).select("domain", "rank", "chars")


_BARE_PATH = "regexp_replace(path, '\\.[^./]*$', '')"


@query(
    "page_imports",
    PATHS + f""", files AS (SELECT path, coalesce(nullif(list_position(['.ts', '.tsx', '.py', '.js', '.jsx'], {EXT}), 0), 99) AS prio, {_BARE_PATH} AS bare FROM (SELECT concat(path, CASE length(path) % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' WHEN 2 THEN '/__init__.py' ELSE '.py' END) AS path FROM paths UNION SELECT concat(path, '.py') FROM paths) AS p),
keys AS (SELECT path, prio, 0 AS tier, path AS key FROM files UNION ALL SELECT path, prio, 1, bare FROM files UNION ALL SELECT path, prio, 2, regexp_replace(bare, '/index$', '') FROM files WHERE ends_with(bare, '/index') UNION ALL SELECT path, prio, 3, regexp_replace(bare, '/__init__$', '') FROM files WHERE ends_with(bare, '/__init__')),
best AS (SELECT key, path FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, prio, path) = 1)
SELECT 'm.py' AS src, p.path AS module, best.path AS dst FROM paths p JOIN best ON best.key = p.path""",
)
def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    n = F.length("path") % 4
    files = paths.select(F.concat("path", F.when(n == 0, ".ts").when(n == 1, "/index.js").when(n == 2, "/__init__.py").otherwise(".py")).alias("path")).union(paths.select(F.concat("path", F.lit(".py")))).distinct()
    return resolve.resolved_imports(files, paths.select(F.lit("m.py").alias("src"), F.col("path").alias("module")))


@query(
    "part_references",
    f"""WITH e AS ({fx.PART_ENTITIES}), r AS ({fx.PART_REFS}), n AS (SELECT string_split(fqn, '.')[-1] AS symbol, min(fqn) AS named, count(*) AS k FROM e GROUP BY 1),
s AS (SELECT array_to_string(p[i:], '.') AS symbol, min(fqn) AS dotted FROM (SELECT fqn, string_split(fqn, '.') AS p, unnest(range(2, len(string_split(fqn, '.')))) AS i FROM e) AS x GROUP BY 1)
SELECT r.module, r.symbol, coalesce(l.fqn, named, dotted, concat('ext_', substr(sha256(r.symbol), 1, 12))) AS target, CASE WHEN l.fqn IS NOT NULL THEN 1.0 WHEN named IS NOT NULL THEN CASE WHEN k = 1 THEN 0.8 ELSE 0.5 END WHEN dotted IS NOT NULL THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence,
    CASE WHEN l.fqn IS NOT NULL THEN 'file_local_match' WHEN named IS NOT NULL THEN CASE WHEN k = 1 THEN 'global_name' ELSE 'ambiguous_name' END WHEN dotted IS NOT NULL THEN 'suffix' ELSE 'unresolved' END AS method
FROM r LEFT JOIN e l ON l.fqn = concat(r.module, '.', r.symbol) LEFT JOIN n USING (symbol) LEFT JOIN s ON s.symbol = r.symbol""",
)
def part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.views(spark, sf_dir, "part")
    return resolve.resolved_symbols(spark.sql(fx.PART_ENTITIES), spark.sql(fx.PART_REFS))


@query(
    "part_memory",
    f"""WITH v AS ({fx.PART_VAULT}), u AS ({fx.PART_RULES}), named AS (SELECT v.id, v.name, v.category, CASE WHEN u.rule <> v.rule THEN u.rule ELSE v.rule END AS rule, CASE WHEN u.rule <> v.rule THEN u.confidence ELSE v.confidence END AS confidence, CASE WHEN u.rule <> v.rule THEN u.source ELSE v.source END AS source, v.created_at FROM v LEFT JOIN u USING (category, name)),
rest AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.category = u.category AND v.name = u.name)),
merged AS (SELECT n.id, coalesce(n.name, r.name) AS name, n.category, n.rule, greatest(n.confidence, coalesce(r.confidence, n.confidence)) AS confidence, n.source, n.created_at FROM named n LEFT JOIN rest r ON r.category = n.category AND r.rule = n.rule),
added AS (SELECT concat('rule_', substr(sha256(concat(category, '|', name, '|', rule)), 1, 12)) AS id, name, category, rule, confidence, source, created_at FROM rest r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.category = r.category AND v.rule = r.rule))
SELECT * FROM merged UNION ALL SELECT * FROM added""",
)
def part_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.views(spark, sf_dir, "part")
    return memory.upserted(spark.sql(fx.PART_VAULT), spark.sql(fx.PART_RULES))


@query("part_unknown", f"WITH v AS ({fx.PART_VAULT}), u AS ({fx.PART_RULES}) SELECT name, category, rule AS description FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.category = u.category AND v.name = u.name) AND NOT EXISTS (SELECT 1 FROM v WHERE v.name IS NULL AND v.rule = u.rule)")
def part_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.views(spark, sf_dir, "part")
    return memory.unknown_patterns(spark.sql(fx.PART_RULES).select("name", "category", F.col("rule").alias("description")), spark.sql(fx.PART_VAULT)).select("name", "category", "description")


_PARSED = """SELECT concat('lib/', replace(p_brand, '#', ''), '.py') AS file_path, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 2 = 0 THEN 'CLASS' ELSE 'FUNCTION' END AS kind, p_type AS purpose, concat(p_type, p_size % 7) AS called, p_partkey FROM part"""


@query(
    "assembled_nodes",
    f"""WITH p AS ({_PARSED}), f AS (SELECT DISTINCT file_path AS path FROM p), e AS (SELECT path, fqn, name, kind FROM (SELECT file_path AS path, concat(replace(regexp_replace(file_path, '\\.[^./]*$', ''), '/', '.'), '.', name) AS fqn, name, kind, p_partkey FROM p) AS x QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY path, p_partkey) = 1)
SELECT concat('file_', substr(sha256(path), 1, 12)) AS id, 'FILE' AS type, string_split(path, '/')[-1] AS name, path, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') AS fqn FROM f
UNION ALL SELECT concat('entity_', substr(sha256(fqn), 1, 12)), kind, name, path, fqn FROM e UNION ALL SELECT DISTINCT concat('ext_', substr(sha256(called), 1, 12)), 'UNRESOLVED_EXTERNAL', called, '', called FROM p""",
)
def assembled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.sql(spark, sf_dir, _PARSED, "part")
    none = F.array().cast("array<string>")
    entity = F.struct("p_partkey", "name", "kind", "purpose", none.alias("parent_classes"), F.array("called").alias("called_entities"), F.lit(None).cast("string").alias("outputs"))
    parsed = rows.groupBy("file_path").agg(F.sort_array(F.collect_list(entity)).alias("entities")).withColumn("imports", none)
    return resolve.assembled(parsed).nodes.select("id", "type", "name", "path", "fqn")


@query("parse_python")
def parse_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of this package's own source."""
    import os

    from ..sources import parse, tree

    tree.register(spark)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = spark.read.format("repo_tree").option("path", root).load()
    return parse.parsed(files).select("file_path", "error", F.explode_outer("entities.name").alias("entity"))


RINGS = f"WITH RECURSIVE nodes AS ({fx.RING_FILES}), edges AS ({fx.RING_TYPED}), "


def _rings(spark: SparkSession, sf_dir: str) -> graph.Graph:
    fx.views(spark, sf_dir, "part")
    return graph.Graph(spark.sql(fx.RING_FILES), spark.sql(fx.RING_TYPED))


@query(
    "impact_evidence",
    RINGS + """walk AS (SELECT id, 0 AS depth FROM nodes WHERE ends_with(path, '/25') UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.depth < 5),
d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id), v AS (SELECT d.id, min(p.id) AS via FROM d JOIN edges e ON e.src = d.id JOIN d p ON p.id = e.dst AND p.depth = d.depth - 1 GROUP BY d.id)
SELECT d.id, n.type, n.path, d.depth, v.via, CASE WHEN d.depth = 1 THEN 'HIGH' WHEN d.depth = 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, false AS truncated FROM d JOIN nodes n USING (id) JOIN v USING (id) WHERE d.depth > 0""",
)
def impact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever reaches a node of a path that ends with /25, one of each block, with the next node on a shortest way there."""
    return iterate.impact_paths(_rings(spark, sf_dir), "25", most=None)


_CYCLES = """reach AS (SELECT type, src AS o, dst AS id FROM edges UNION SELECT r.type, r.o, e.dst FROM reach r JOIN edges e ON e.src = r.id AND e.type = r.type),
comp AS (SELECT a.type, a.o AS id, min(a.id) AS component FROM reach a JOIN reach b ON b.type = a.type AND b.o = a.id AND b.id = a.o GROUP BY ALL),
inner_ AS (SELECT DISTINCT e.type, e.src, e.dst, a.component FROM edges e JOIN comp a ON a.type = e.type AND a.id = e.src JOIN comp b ON b.type = e.type AND b.id = e.dst AND b.component = a.component),
bfs AS (SELECT DISTINCT type, component, component AS id, 0 AS depth FROM comp UNION SELECT b.type, b.component, i.dst, b.depth + 1 FROM bfs b JOIN inner_ i ON i.type = b.type AND i.component = b.component AND i.src = b.id WHERE i.dst <> b.component AND b.depth < 60),
d AS (SELECT type, component, id, min(depth) AS depth FROM bfs GROUP BY ALL),
v AS (SELECT d.type, d.component, d.id, d.depth, min(p.id) AS via FROM d JOIN inner_ i ON i.type = d.type AND i.component = d.component AND i.dst = d.id JOIN d p ON p.type = d.type AND p.component = d.component AND p.id = i.src AND p.depth = d.depth - 1 GROUP BY ALL),
closing AS (SELECT i.type, i.component, min({'depth': d.depth, 'id': d.id}) AS c FROM inner_ i JOIN d ON d.type = i.type AND d.component = i.component AND d.id = i.src WHERE i.dst = i.component GROUP BY ALL),
back AS (SELECT type, component, c.id AS id, c.depth AS depth FROM closing UNION SELECT b.type, b.component, v.via, b.depth - 1 FROM back b JOIN v ON v.type = b.type AND v.component = b.component AND v.id = b.id WHERE b.depth > 0),
found AS (SELECT b.type, CASE b.type WHEN 'CALLS' THEN 'WARNING' ELSE 'INFO' END AS severity, b.component, (SELECT count(*) FROM comp c WHERE c.type = b.type AND c.component = b.component) AS size, CAST(count(*) AS INTEGER) AS length, string_agg(b.id, '>' ORDER BY b.depth) AS cycle FROM back b GROUP BY b.type, b.component) """


@query("shortest_cycles", RINGS + _CYCLES + "SELECT * FROM found")
def shortest_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strong component of calls and of imports, its severity, and the shortest cycle through its least node."""
    return iterate.cycles(_rings(spark, sf_dir)).withColumn("cycle", F.array_join("cycle", ">"))


@query(
    "health_of_rings",
    RINGS + _CYCLES + """, c AS (SELECT (SELECT count(*) FROM nodes) AS internal, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE type = 'CALLS' UNION SELECT dst FROM edges WHERE type = 'CALLS')) AS orphans, CAST(0 AS BIGINT) AS unresolved, (SELECT count(*) FROM found WHERE severity = 'WARNING') AS warnings),
s AS (SELECT *, round(greatest(100 - 2.0::DOUBLE * warnings - least(15.0::DOUBLE, 100.0::DOUBLE * orphans / internal), 0.0::DOUBLE), 1) AS score FROM c)
SELECT internal, orphans, unresolved, warnings, score, CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 80 THEN 'WARNING' ELSE 'INFO' END AS severity FROM s""",
)
def health_of_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health of a graph with cycles: each strong component of calls is a warning."""
    g = _rings(spark, sf_dir)
    return graph.health(g, lineage.cut(iterate.cycles(g)).where("severity = 'WARNING'"))


def _index(spark: SparkSession, sf_dir: str) -> lexindex.Index:
    return lexindex.build(_docs(spark, sf_dir), f"{lineage.shared_folder(spark.sparkContext)}/index-{uuid.uuid4().hex}")


@query("indexed_top50", ORACLES["lexical_top50"])
def indexed_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lexical_top50, from an index."""
    return lexindex.top(_index(spark, sf_dir), spark, QUERY)


@query("indexed_bm25", ORACLES["bm25"] + " WHERE coalesce(score, 0) > 0 ORDER BY 2 DESC, 1 LIMIT 50")
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexindex.top(_index(spark, sf_dir), spark, QUERY, ranked_by="bm25")


_PAGE_FILES = "SELECT concat('d', page_id % 7, '/', page_id % 31, '/page', page_id, '.html') AS path, html FROM pages"


def _written_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, html) below root, by the tasks that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, html in zip(b.column("path").to_pylist(), b.column("html").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
                with open(os.path.join(root, path), "wb") as f:
                    f.write((html or "").encode())
            yield b.select(["path"]).slice(0, 0)

    files.mapInArrow(run, "path string").count()


@query("tree_scan", f"SELECT path, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length FROM ({_PAGE_FILES}) AS f WHERE starts_with(path, 'd3/') AND strlen(coalesce(html, '')) >= 500")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree, written from all pages, below a folder and of a least size."""
    root = lineage.shared_path(spark, "tree")
    _written_tree(fx.sql(spark, sf_dir, _PAGE_FILES, "pages"), root)
    tree.register(spark)
    files = spark.read.format("repo_tree").option("path", root).option("content", "false").option("defaults", "false").option("pushdown", "true").load()
    return files.where("path LIKE 'd3/%' AND length >= 500").select("path", "length")


@query("pack_folder", "SELECT domain, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM (SELECT coalesce(source, '') AS domain, coalesce(text, '') AS text FROM documents) AS d GROUP BY domain")
def pack_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a pack, a domain for each source, and what its index says."""
    path = lineage.shared_path(spark, "pack")
    blocks = _table("documents")(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("domain"), F.col("doc_id").alias("rank"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("block"))
    packsink.save(blocks, path, render.DOMAIN_HEADER.replace("{title}", "documents"), render.DOMAIN_FOOTER)
    return packsink.index(spark, path).groupBy("domain").agg(F.sum("blocks").alias("blocks"), F.sum("chars").alias("chars"))


#: A rule for each part, of words: its own path or that of the order of the same number; the nodes of G1 as paths.
_PART_PATTERNS = "SELECT concat('T', p_partkey % 40) AS target, concat('part', p_partkey) AS rule, concat('{b}(p', p_partkey, '|o', p_partkey, ')', '{b}') AS pattern, CAST((1 + p_partkey % 3) / 64.0 AS DOUBLE) AS weight FROM part"


@query(
    "many_rules",
    G1 + f""", rules AS ({_PART_PATTERNS.format(b=chr(92) + 'b')}), words AS (SELECT path, unnest(list_distinct(regexp_split_to_array({_TEXT}, '[^a-z0-9_]+'))) AS word FROM nodes),
hits AS (SELECT DISTINCT target, rule, weight, path FROM (SELECT target, rule, weight, unnest(string_split(substr(pattern, 4, length(pattern) - 6), '|')) AS word FROM rules) AS r JOIN words USING (word)),
w AS (SELECT target, rule, max(weight) AS weight FROM hits GROUP BY ALL), e AS (SELECT target, path FROM (SELECT DISTINCT target, path FROM hits) AS x QUALIFY row_number() OVER (PARTITION BY target ORDER BY path) <= 5)
SELECT target, round(CAST(least(sum(weight), 1.0) AS DOUBLE), 6) AS confidence, (SELECT string_agg(path, ',' ORDER BY path) FROM e WHERE e.target = w.target) AS evidence FROM w GROUP BY target""",
)
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part over the paths of G1."""
    return discovery.evaluated(fx.graph(spark, sf_dir).nodes.select("path"), spark.sql(_PART_PATTERNS.format(b=chr(92) * 2 + "b")))


_BEFORE = "SELECT CAST(doc_id AS {string}) AS path, n_chars AS size, source AS mtime FROM documents"
_AFTER = """SELECT CAST(doc_id AS {string}) AS path, CASE WHEN doc_id % 89 = 0 THEN n_chars + 1 ELSE n_chars END AS size, source AS mtime FROM documents WHERE doc_id % 97 <> 0
UNION ALL SELECT concat('new', doc_id), n_chars, source FROM documents WHERE doc_id % 101 = 0"""


@query(
    "changed_files",
    f"WITH a AS ({_BEFORE.format(string='VARCHAR')}), b AS ({_AFTER.format(string='VARCHAR')}) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size IS DISTINCT FROM b.size OR a.mtime IS DISTINCT FROM b.mtime",
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes between documents and documents with some added, removed and grown, from two stored trees of hashes."""
    fx.views(spark, sf_dir, "documents")
    folder = f"{lineage.shared_folder(spark.sparkContext)}/trees-{uuid.uuid4().hex}"
    hashtree.save(spark.sql(_BEFORE.format(string="STRING")), f"{folder}/before")
    hashtree.save(spark.sql(_AFTER.format(string="STRING")), f"{folder}/after", like=f"{folder}/before")
    return hashtree.changed(spark, f"{folder}/before", f"{folder}/after")


def _stored(name: str, oracle: str, f: Callable[[graphstore.Store], DataFrame]) -> None:
    """A query over G1 as stored tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = uuid.uuid4().hex
        return f(graphstore.save(fx.graph(spark, sf_dir), f"graph_{own}", f"{lineage.shared_folder(spark.sparkContext)}/graph-{own}"))

    query(name, oracle)(run)


_stored("stored_degrees", ORACLES["degrees"], graphstore.degrees)
_stored("stored_hub_scores", ORACLES["hub_scores"], graphstore.hub_scores)
_stored("stored_cross_types", G1 + f"SELECT a.type AS src_type, e.type, b.type AS dst_type, count(*) AS n FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE e.type IN {LOGICAL} GROUP BY ALL", graphstore.cross_types)


_FIRST_RULES = f"SELECT name, category, CASE WHEN substr(name, 2) LIKE '%3' THEN rule ELSE concat('first ', rule) END AS rule, CAST(0.75 AS DOUBLE) AS confidence, 'user' AS source, '2024-01-01' AS created_at FROM ({fx.PART_RULES}) AS r WHERE name NOT LIKE '%7'"


@query(
    "vault_log",
    f"""WITH v AS (SELECT concat('rule_', substr(sha256(concat(category, '|', name, '|', rule)), 1, 12)) AS id, * FROM ({_FIRST_RULES}) AS f), u AS ({fx.PART_RULES}),
named AS (SELECT v.id, v.name, v.category, coalesce(u.rule, v.rule) AS rule, CASE WHEN u.rule <> v.rule THEN u.confidence ELSE v.confidence END AS confidence, CASE WHEN u.rule <> v.rule THEN u.source ELSE v.source END AS source, v.created_at FROM v LEFT JOIN u USING (category, name))
SELECT * FROM named UNION ALL SELECT concat('rule_', substr(sha256(concat(category, '|', name, '|', rule)), 1, 12)), * FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.category = u.category AND v.name = u.name)""",
)
def vault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the parts, appended as two batches with a compaction between them, merged."""
    fx.views(spark, sf_dir, "part")
    path = f"{lineage.shared_folder(spark.sparkContext)}/vault-{uuid.uuid4().hex}"
    vaultlog.append(path, spark.sql(_FIRST_RULES))
    vaultlog.compact(spark, path)
    vaultlog.append(path, spark.sql(fx.PART_RULES))
    return vaultlog.current(spark, path)[0]


_FINDINGS = f"""WITH nodes AS ({fx.NODES} UNION ALL SELECT id, type, name, path, fqn FROM ({fx.EXTERNALS}) AS x), edges AS ({fx.INJECTED}),
dead AS (SELECT src, dst, type, concat_ws(',', CASE WHEN src NOT IN (SELECT id FROM nodes) THEN 'src' END, CASE WHEN dst NOT IN (SELECT id FROM nodes) THEN 'dst' END) AS missing FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)),
live AS (SELECT unnest([src, dst]) AS id FROM edges e WHERE type IN {LOGICAL} AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.src = e.src AND d.dst = e.dst)),
findings AS (SELECT 'dead_edge' AS code, 'WARNING' AS severity, concat(src, ' > ', dst, ' (', type, ')') AS subject, '' AS path, count(*) AS n, concat('no node for ', min(missing)) AS message FROM dead GROUP BY src, dst, type
UNION ALL SELECT 'repeated_name', 'WARNING', fqn, '', count(*), concat(count(*), ' nodes have this name') FROM nodes GROUP BY fqn HAVING count(*) > 1
UNION ALL SELECT 'orphan', 'INFO', id, path, 1, concat('no logical edge: ', name) FROM nodes WHERE type IN ('CLASS', 'FUNCTION', 'INTERFACE') AND id NOT IN (SELECT id FROM live)
UNION ALL SELECT 'unresolved', 'INFO', id, path, 1, concat('unknown symbol: ', name) FROM nodes WHERE type = 'UNRESOLVED_EXTERNAL' AND name NOT IN ('len', 'Promise'))"""


def _diagnosed(spark: SparkSession, sf_dir: str) -> diagnostics.Diagnostics:
    """G1 with dead edges and an external symbol for each part."""
    g = fx.graph(spark, sf_dir, True)
    return diagnostics.collected(graph.Graph(g.nodes.unionByName(spark.sql(fx.EXTERNALS)), g.edges, g.size))


@query("diagnostics", f"{_FINDINGS} SELECT * FROM findings")
def diagnostics_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).findings


@query(
    "diagnostic_counts",
    f"""{_FINDINGS}, c AS (SELECT code AS name, count(*) AS n FROM findings GROUP BY code UNION ALL SELECT severity, count(*) FROM findings GROUP BY severity UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'dead', count(*) FROM dead UNION ALL SELECT 'internal', count(*) FROM nodes WHERE type IN ('CLASS', 'FUNCTION', 'INTERFACE'))
SELECT name, CAST(coalesce(max(n), 0) AS BIGINT) AS n FROM (SELECT * FROM c UNION ALL SELECT unnest(['ERROR', 'INFO', 'WARNING', 'cycle_ERROR', 'cycle_INFO', 'cycle_WARNING', 'dead', 'dead_edge', 'edges', 'internal', 'nodes', 'orphan', 'repeated_name', 'unparsed', 'unread', 'unresolved']), 0) AS x GROUP BY name""",
)
def diagnostic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of diagnostics, observed while its table was written."""
    return diagnostics.tally(_diagnosed(spark, sf_dir))
