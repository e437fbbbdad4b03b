"""Diagnostics against plain Python, on odd graphs, and over a small repository."""

import random
from collections import Counter

import pytest

from lodeline.operators import diagnostics, graph, iterate
from lodeline.plans import commands

NODE, EDGE = "id string, type string, name string, path string, fqn string", "src string, dst string, type string, confidence double, method string"


def made(spark, nodes, edges):
    return graph.Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, 1.0, "path") for e in edges], EDGE))


def plain(nodes, edges):
    ids = {n[0] for n in nodes} - {None}
    out, live = Counter(), set()
    for s, d, t in edges:
        missing = ",".join(x for x, end in (("src", s), ("dst", d)) if end not in ids)
        if missing:
            out["dead_edge", f"{s or ''} > {d or ''} ({t})", missing] += 1
        elif t in graph.LOGICAL:
            live |= {s, d}
    found = {("dead_edge", "WARNING", s, "", n, f"no node for {m}") for (_, s, m), n in out.items()}
    for f, n in Counter(n[4] for n in nodes if n[4] is not None).items():
        if n > 1:
            found.add(("repeated_name", "WARNING", f, "", n, f"{n} nodes have this name"))
    for i, t, name, path, _ in nodes:
        if t in graph.ENTITY and i not in live:
            found.add(("orphan", "INFO", i or "", path or "", 1, f"no logical edge: {name or ''}"))
        if t == graph.EXTERNAL and name not in graph.BUILTINS:
            found.add(("unresolved", "INFO", i, path or "", 1, f"unknown symbol: {name or ''}"))
    return found, sum(out.values())


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    rng = random.Random(seed)
    kinds = ["FILE", "CLASS", "FUNCTION", "INTERFACE", graph.EXTERNAL]
    nodes = [(f"n{i}", rng.choice(kinds), rng.choice(["len", "Map", "own", f"x{i}", None]), rng.choice([f"p/{i}", "", None]), rng.choice([f"f{i}", "same", "twice", None])) for i in range(120)]
    edges = [(f"n{rng.randrange(124)}", f"n{rng.randrange(124)}", rng.choice(["CALLS", "CONTAINS", "IMPORTS", "RETURNS"])) for _ in range(90)]
    edges += [("n1", "gone", "CALLS")] * 3 + [(None, "n2", "CALLS"), ("n3", None, "USES"), ("n4", "n4", "CALLS")] + [("n5", "n6", "CALLS")] * 50
    g = made(spark, nodes, edges)
    d = diagnostics.collected(g)
    want, dead = plain(nodes, edges)
    assert {tuple(r) for r in d.findings.collect()} == want and d.findings.count() == len(want)
    codes = Counter(x[0] for x in want)
    assert {k: d.counts[k] for k in codes} == dict(codes)
    assert d.counts["dead"] == dead and d.counts["nodes"] == 120 and d.counts["edges"] == len(edges) and d.counts["internal"] == sum(n[1] in graph.ENTITY for n in nodes)
    assert d.counts["WARNING"] == sum(x[1] == "WARNING" for x in want) and d.counts["INFO"] == sum(x[1] == "INFO" for x in want) and not d.failed
    checked = graph.valid(g)
    assert d.counts["orphan"] == graph.orphans(checked).count() and d.counts["unresolved"] == graph.unresolved(g).where("name IS NOT NULL").count() + sum(n[1] == graph.EXTERNAL and n[2] is None for n in nodes)


def test_empty_tables(spark):
    d = diagnostics.collected(made(spark, [], []), None, spark.createDataFrame([], "path string, error string"), spark.createDataFrame([], "file_path string, error string"))
    assert d.findings.count() == 0 and set(d.counts.values()) == {0}
    assert diagnostics.report(d, True).count() == 0


def test_clashing_columns_and_a_null_id(spark):
    g = made(spark, [(None, "CLASS", "a", "p", "f"), ("b", "CLASS", "b", "p", "g"), ("b", "CLASS", "b", "p", "h")], [("b", "b", "CALLS"), (None, "b", "CALLS")])
    odd = graph.Graph(g.nodes.selectExpr("*", "1 AS key", "map('k', 1) AS node", "2 AS live"), g.edges.selectExpr("*", "1 AS space", "3 AS missing", "true AS has_src0"))
    rows = {(r.code, r.subject, r.n) for r in diagnostics.collected(odd).findings.collect()}
    assert rows == {("orphan", "", 1), ("dead_edge", " > b (CALLS)", 1)}


def test_files_and_cycles(spark):
    g = made(spark, [(x, "FUNCTION", x, f"{x}.py", x) for x in "abc"], [("a", "b", "CALLS"), ("b", "a", "CALLS"), ("b", "c", "IMPORTS"), ("c", "b", "IMPORTS")])
    files = spark.createDataFrame([("big.bin", "over 10 bytes"), ("a.py", None)], "path string, error string")
    parsed = spark.createDataFrame([("c.py", "SyntaxError: x"), ("b.py", None)], "file_path string, error string")
    d = diagnostics.collected(g, iterate.cycles(g, {"CALLS": "ERROR", "IMPORTS": "INFO"}), files, parsed)
    assert {(r.code, r.severity, r.subject, r.n) for r in d.findings.collect()} == {("cycle", "ERROR", "a", 2), ("cycle", "INFO", "b", 2), ("unread", "WARNING", "big.bin", 1), ("unparsed", "WARNING", "c.py", 1), ("orphan", "INFO", "c", 1)}
    assert d.failed and (d.counts["ERROR"], d.counts["WARNING"], d.counts["INFO"]) == (1, 2, 2)
    assert [r.line for r in diagnostics.report(d).collect()] == ["ERROR cycle a: CALLS in a circle: a > b > a"]
    assert [r.line.split(" ")[0] for r in diagnostics.report(d, True).collect()] == ["ERROR", "WARNING", "WARNING", "INFO", "INFO"]


def test_one_pass(spark):
    """The ids are shuffled for the ends and once for all findings; counts need no job after the table is written."""
    g = made(spark, [("a", "CLASS", "a", "p", "f")], [("a", "a", "CALLS")])
    d = diagnostics.collected(g)
    plan = d.findings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan parquet" in plan


def test_over_a_repository(spark, tmp_path):
    for name, text in {"a.py": "def f():\n    return g()\n\ndef g():\n    return f()\n\ndef alone():\n    pass\n", "bad.py": "def (:\n", "b.py": "import nothing\n"}.items():
        (tmp_path / name).write_text(text)
    d = commands.diagnosed(spark, str(tmp_path))
    found = {(r.code, r.severity) for r in d.findings.collect()}
    assert {("unparsed", "WARNING"), ("cycle", "WARNING"), ("orphan", "INFO")} <= found
    stats = {r.provider: r.value_json for r in commands.stats(commands.analyze(spark, str(tmp_path)).graph).collect()}
    assert '"warnings":1' in stats["health"] and '"warnings":1' in stats["validation"] and '"heap_mb"' in stats["run"]
