"""Operators on tiny inputs with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import scalar
from lodeline.operators import discovery, graph, iterate, lexical, memory, ranking, render, resolve


def _edges(spark, rows, kind="IMPORTS"):
    return spark.createDataFrame([(a, b, kind, 1.0, "parsed") for a, b in rows], "src string, dst string, type string, confidence double, method string")


def test_impact(spark):
    nodes = spark.createDataFrame([(f"f{i}", "FILE", f"f{i}", f"a/f{i}.py", f"f{i}") for i in range(1, 8)] + [("e1", "FUNCTION", "e1", "b/e1", "e1"), ("u1", "UNRESOLVED_EXTERNAL", "u1", "", "u1")], "id string, type string, name string, path string, fqn string")
    g = graph.Graph(nodes, _edges(spark, [(f"f{i + 1}", f"f{i}") for i in range(1, 7)] + [("e1", "f1"), ("u1", "f1")]))
    found = {r.id: (r.depth, r.risk) for r in iterate.impact(g, "./A\\f1.py").collect()}
    assert found == {"f2": (1, "HIGH"), "e1": (1, "HIGH"), "f3": (2, "MEDIUM"), "f4": (3, "LOW"), "f5": (4, "LOW"), "f6": (5, "LOW")}
    s = iterate.impact_summary(iterate.impact(g, "nothing"), scalar.impact_domain(F.col("path"))).first()
    assert (s.files, s.entities, s.risk) == (0, 0, "NONE")


def test_diffusion(spark):
    e = _edges(spark, [("s1", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("s2", "c")])
    seeds = spark.createDataFrame([("s1", 100.0), ("s2", 12.0)], "id string, score double")
    assert {r.id: r.score for r in iterate.diffusion(e, seeds).collect()} == {"s1": 100, "s2": 12, "a": 50, "b": 25, "c": 6}


def test_domains_and_cycles_against_simulation(spark):
    rng = random.Random(4)
    for _ in range(2):
        ids = [f"n{i}" for i in range(12)]
        e = {(rng.choice(ids), rng.choice(ids)) for _ in range(16)}
        seeds = {i: rng.choice("xy") for i in rng.sample(ids, 3)}
        reach = {i: set() for i in ids}
        for s, label in seeds.items():
            todo, seen = [s], set()
            while todo:
                for a, b in e:
                    if a == todo[0] and b not in seeds and b not in seen:
                        seen.add(b)
                        todo.append(b)
                todo.pop(0)
            for i in seen:
                reach[i].add(label)
        want = {i: seeds.get(i) or ("global" if not reach[i] else "shared" if len(reach[i]) > 1 else min(reach[i])) for i in ids}
        df = _edges(spark, sorted(e))
        nodes = spark.createDataFrame([(i,) for i in ids], "id string")
        got = iterate.domains(nodes, df, spark.createDataFrame(list(seeds.items()), "id string, label string"))
        assert {r.id: r.domain for r in got.collect()} == want
        cyclic = set()
        for i in ids:
            todo, seen = [b for a, b in e if a == i], set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [b for a, b in e if a == x]
            if i in seen:
                cyclic.add(i)
        assert {r.id for r in iterate.cyclic_nodes(df).collect()} == cyclic
    assert iterate.cyclic_nodes(_edges(spark, [("a", "b")]).where("false")).count() == 0


def test_budget_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([60, 50, 30, 10, 5])], "k int, size int")
    assert [r.size for r in ranking.within_budget(items, 100, F.col("k")).orderBy("k").collect()] == [60, 30, 10]
    assert ranking.within_budget(items, 0, F.col("k")).count() == 0
    blocks = spark.createDataFrame([("b", 1, 35), ("a", 2, 3500), ("b", 3, 35)], "domain string, rank int, chars int")
    assert {(r.domain, r["rank"]) for r in ranking.packed_by_domain(blocks, 50).collect()} == {("b", 1), ("b", 3)}


def test_guidance(spark):
    ranks = spark.createDataFrame([(f"f{i}", i) for i in range(1, 11)], "path string, rank long")
    got = {r["rank"]: r.advice for r in ranking.guidance(ranks).collect()}
    assert [k for k, v in got.items() if v == "read_first"] == [1, 2] and sorted(k for k, v in got.items() if v == "ignore") == [7, 8, 9, 10]


def test_scalars(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    assert row(scalar.normal_path(F.lit("a/./b/../c.py")))[0] == "a/c.py"
    assert row(scalar.module_path(F.lit("a/b.c/d.py")))[0] == "a.b.c.d"
    lines = spark.createDataFrame([("Flask>=2 # web",), ("-r other.txt",), ("# only",), ("",), ("https://x/y.whl",), ("pkg @ git+https://x",), ("a_b[extra]; python_version>'3'",)], "line string")
    assert [r[0] for r in lines.select(scalar.requirement_name(F.col("line"))).collect()] == ["flask", None, None, None, None, "pkg", "a_b"]
    assert row(scalar.terms(F.lit("Foo_bar foo-BAR x1y für")))[0] == ["foo", "bar"]
    assert row(scalar.closing_tag_safe(F.lit("a</ Pack >b"), "pack"))[0] == "a&lt;/pack&gt;b"
    assert row(scalar.pack_domain(F.lit("src/a/b.py")), scalar.pack_domain(F.lit("x.py")), scalar.impact_domain(F.lit("lib/z/q.py")))[:] == ("src/a", "root", "z")


def test_file_scores(spark):
    files = spark.createDataFrame([("a/b.py",), ("c.py",), ("z.py",)], "path string")
    scores = spark.createDataFrame([("a/b.py", 5.0), ("x/c.py", 3.0), ("q/a/b.py", 9.0)], "path string, score double")
    assert {r.path: r.score for r in lexical.file_scores(files, scores).collect()} == {"a/b.py": 5.0, "c.py": 3.0, "z.py": 0.0}


def test_discovery(spark):
    deps = spark.createDataFrame([("React",), ("redux",), ("mobx",), ("pytest",), ("fastapi",)], "name string")
    assert {tuple(r) for r in discovery.frameworks(deps).collect()} == {("frontend", "React"), ("backend", "FastAPI")}
    assert {tuple(r) for r in discovery.conventions(deps).collect()} == {("state", "Redux"), ("testing", "pytest")}
    paths = spark.createDataFrame([("src/AuthService/login.py",), ("src/authority.py",)], "path string")
    got = discovery.evaluated(paths, [("Authentication", "folder", r"\b(auth|login|session)\b", 0.6), ("Authentication", "token", r"\b(jwt|oauth|token)\b", 0.4)]).first()
    assert (got.target, got.confidence, got.evidence) == ("Authentication", 0.6, "src/AuthService/login.py")
    none = spark.createDataFrame([], "target string, confidence double")
    assert [r.name for r in discovery.architecture(spark.createDataFrame([("a", 1)], "name string, size int"), none).collect()] == ["Monolith"]
    big = spark.createDataFrame([("api", 5), ("core", 6), ("x", 7)], "name string, size int")
    assert [r.name for r in discovery.architecture(big, none).orderBy("rank").collect()] == ["Clean Architecture", "Modular"]
    assert {tuple(r) for r in discovery.layers(spark.createDataFrame([("a/Services/x.py",)], "path string")).collect()} == {("application", "services")}


def test_aliases(spark):
    i = spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "@/d"), ("a/b.ts", "react"), ("a/b.ts", "../e")], "src string, module string")
    al = spark.createDataFrame([("@/", "src/", 0), ("@", "other", 1)], "prefix string, target string, ordinal int")
    assert {r.module for r in resolve.aliased(i, al).collect()} == {"a/c", "src/d", "react", "e"}


def test_memory_upsert_is_idempotent(spark):
    empty = spark.createDataFrame([], "id string, name string, category string, rule string, confidence double, source string, created_at string")
    new = spark.createDataFrame([("n", "c", "r", 0.5, "s", "t"), (None, "c", "q", 0.4, "s", "t")], "name string, category string, rule string, confidence double, source string, created_at string")
    once = memory.upserted(empty, new)
    assert sorted(map(str, memory.upserted(once, new).collect())) == sorted(map(str, once.collect())) and once.count() == 2


def test_render(spark):
    assert render.context({"a": ["<x>"]}, "xml").count("&lt;x&gt;") == 1 and render.context({"a": ["b"]}, "nothing") == render.context({"a": ["b"]})
    paths = spark.createDataFrame([("b.py",), ("A/x.py",), ("A/y/z.py",)], "path string")
    assert render.tree_text(paths) == "A/\n  y/\n    z.py\n  x.py\nb.py"
    assert render.tree_text(paths, breadth=1).endswith("... 1 more")


def test_save_and_load(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "FILE", "a", "a", "a")], "id string, type string, name string, path string, fqn string")
    render.save(graph.Graph(nodes, _edges(spark, [("a", "a")])), str(tmp_path))
    g = render.load(spark, str(tmp_path))
    assert g.nodes.count() == g.edges.count() == 1
    assert '"id":"a"' in render.domain_payload(g, nodes.select("id"), "x").first().payload and '"src":"a"' in render.document(g, "r").first().json


def test_streaming(spark, tmp_path):
    from lodeline.streaming import activity

    spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b")], "src string, dst string").write.parquet(str(tmp_path / "e"))
    s = activity.running_fan_in(spark.readStream.schema("src string, dst string").parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("fan").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM fan").collect()] == [("b", 2)]


@pytest.mark.parametrize("f", [graph.dead_edges, graph.duplicates, graph.hubs, graph.topology, graph.density, graph.confidence_buckets, graph.orphans, graph.degrees, graph.coupling, graph.fat_modules, graph.suffix_flags])
def test_empty_graph(spark, f):
    nodes = spark.createDataFrame([], "id string, type string, name string, path string, fqn string")
    f(graph.Graph(nodes, _edges(spark, [("a", "b")]).where("false"))).collect()
