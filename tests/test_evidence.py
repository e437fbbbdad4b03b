"""Impact with evidence, strong components and their cycles, the lexical index, subtree scans and the pack sink."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodeline.operators import graph, iterate, lexical, lexindex
from lodeline.sources import packsink, tree


def _graph(spark, edges, kind="CALLS"):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(i, "FUNCTION", i, f"src/{i}", i) for i in ids], "id string, type string, name string, path string, fqn string")
    rows = [(e[0], e[1], e[2] if len(e) > 2 else kind, 1.0, "parsed") for e in edges]
    return graph.Graph(nodes, spark.createDataFrame(rows, "src string, dst string, type string, confidence double, method string"))


def test_impact_keeps_a_way_back_and_says_when_it_was_cut(spark):
    g = _graph(spark, [("b", "t"), ("c", "t"), ("d", "c"), ("d", "b"), ("e", "d"), ("t", "e"), ("f", "f")])
    found = {r.id: (r.depth, r.via, r.risk, r.truncated) for r in iterate.impact_paths(g, "src/t").collect()}
    assert found == {"b": (1, "t", "HIGH", False), "c": (1, "t", "HIGH", False), "d": (2, "b", "MEDIUM", False), "e": (3, "d", "LOW", False)}
    assert {(r.id, r.truncated) for r in iterate.impact_paths(g, "src/t", most=1).collect()} == {("b", True), ("c", True)}
    assert {r.truncated for r in iterate.impact_paths(g, "src/t", most=3).collect()} == {True}  # e would have come
    assert {r.truncated for r in iterate.impact_paths(g, "src/t", most=4).collect()} == {False}
    assert iterate.impact_paths(g, "nope").count() == 0


def _brute(edges):
    """{component: (size, length)} and {component: nodes}, by reachability and plain searches."""
    nodes = {x for e in edges for x in e}
    reach = {}
    for s in nodes:
        todo, seen = [s], set()
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    comps = {}
    for x in nodes:
        if x in reach[x]:
            comps.setdefault(min(y for y in reach[x] if x in reach[y]), set()).add(x)
    out = {}
    for c, own in comps.items():
        depth, level, k = {c: 0}, {c}, 0
        while True:
            k += 1
            level = {b for a, b in edges if a in level and b in own and (b == c or b not in depth)}
            if c in level:
                break
            depth.update(dict.fromkeys(level, k))
        out[c] = (len(own), k)
    return out, comps


def test_components_and_cycles(spark):
    rng = random.Random(8)
    edges = {(f"{g}n{rng.randrange(9)}", f"{g}n{rng.randrange(9)}") for g in "abcd" for _ in range(12)} | {("x", "x"), ("y", "z"), ("an0", "bn0"), *((f"l{i}", f"l{(i + 1) % 7}") for i in range(7)), ("l0", "l3")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    want, comps = _brute(edges)
    found = iterate.strong_components(df)
    assert {r.id: r.component for r in found.collect()} == {x: c for c, own in comps.items() for x in own}
    rows = iterate.shortest_cycles(df, found).collect()
    assert {r.component: (r["size"], r.length) for r in rows} == want
    for r in rows:
        assert r.cycle[0] == r.component and len(r.cycle) == len(set(r.cycle)) == r.length and {*zip(r.cycle, [*r.cycle[1:], r.cycle[0]], strict=True)} <= edges
    assert [r.cycle for r in rows if r.component == "l0"] == [["l0", "l3", "l4", "l5", "l6"]]
    assert iterate.shortest_cycles(df.where("src = 'y'")).count() == 0


def test_severity_and_health_of_cycles(spark):
    g = _graph(spark, [("a", "b", "CALLS"), ("b", "a", "CALLS"), ("c", "c", "CALLS"), ("a", "d", "IMPORTS"), ("d", "a", "IMPORTS"), ("d", "b", "CALLS"), ("a", "b", "IMPORTS"), ("e", "a", "USES"), ("a", "e", "USES")])
    found = iterate.cycles(g)
    assert sorted((r.type, r.severity, r.component, r["size"], r.cycle) for r in found.collect()) == [("CALLS", "WARNING", "a", 2, ["a", "b"]), ("CALLS", "WARNING", "c", 1, ["c"]), ("IMPORTS", "INFO", "a", 2, ["a", "d"])]
    h = graph.health(g, found.where("severity = 'WARNING'")).first()
    assert (h.warnings, h.score) == (2, 96.0)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20))]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.95 else "alpha" for _ in range(rng.randrange(0, 60)))) for i in range(600)] + [(600, None), (601, "alpha_beta Gamma-gamma " * 30)]
    return spark.createDataFrame(rows, "id long, text string").cache()


@pytest.mark.parametrize("block", [4096, 7])
def test_index_gives_what_the_text_gives(spark, texts, tmp_path, block):
    built = lexindex.build(texts, str(tmp_path), buckets=5, block=block)
    index = lexindex.load(spark, str(tmp_path))
    assert index == built and index.n == 602
    for query in ("alpha beta gamma", "omega", "wab wbc delta nothere", "the of", "nothere"):
        for k in (1, 10, 1000):
            plain = lexical.lexical_scores(texts, query).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
            want = [tuple(r) for r in plain.collect()] if query not in ("the of", "nothere") else []
            assert [tuple(r) for r in lexindex.top(index, spark, query, k).collect()] == want
            bm = lexical.bm25(texts, query).select("id", F.round("score", 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
            assert [tuple(r) for r in lexindex.top(index, spark, query, k, ranked_by="bm25").collect()] == [tuple(r) for r in bm.collect()]


def test_a_query_reads_its_own_terms_and_no_text(spark, texts, tmp_path):
    index = lexindex.build(texts, str(tmp_path), buckets=16, block=50)
    plan = lexindex.top(index, spark, "omega", 3)._jdf.queryExecution().toString()
    assert "counted" not in plan and "text" not in plan.replace("nextext", "") and "PartitionFilters" in plan and "bucket" in plan
    files = {r.f for r in index.postings(spark, ["omega"]).select(F.input_file_name().alias("f")).collect()}
    assert len({os.path.basename(os.path.dirname(f)) for f in files}) == 1


def _tree(root, folders, files):
    for i in range(folders):
        os.makedirs(f"{root}/a{i % 3}/b{i}")
        for j in range(files):
            with open(f"{root}/a{i % 3}/b{i}/f{j}.txt", "w") as f:
                f.write("x" * j)


def test_subtrees_are_dealt_out_without_their_files(spark, tmp_path):
    _tree(tmp_path / "s", 12, 5)
    _tree(tmp_path / "l", 12, 50)
    sizes = []
    for name in "sl":
        r = tree._Reader({"path": str(tmp_path / name), "content": "false"})
        parts = r.partitions()
        sizes.append(sum(len(p.folders) for p in parts))
        assert len([f for p in parts for f in r.read(p)]) == (60 if name == "s" else 600)
    assert sizes[0] == sizes[1] == 16  # the root, three folders, twelve below: as many for ten times the files
    few = tree._Reader({"path": str(tmp_path / "l"), "folders": "3", "tasks": "2", "content": "false"})
    assert len(few.partitions()) == 2 and sum(len(p.folders) for p in few.partitions()) <= 8
    assert sorted(f[0] for p in few.partitions() for f in few.read(p)) == sorted(f[0] for f in tree.walk(str(tmp_path / "l"), None, tree.Ignore.of([], False)))


def test_filters_reach_the_walk(spark, tmp_path):
    _tree(tmp_path / "t", 12, 9)
    tree.register(spark)

    def files(pushdown=True):
        return spark.read.format("repo_tree").option("path", str(tmp_path / "t")).option("content", "false").option("pushdown", str(pushdown)).load()

    for pushdown in (True, False):
        found = files(pushdown).where("path LIKE 'a1/b1%' AND length > 3 AND length <= 7 AND path LIKE '%.txt'")
        assert {(r.path, r.length) for r in found.collect()} == {(f"a1/b{i}/f{j}.txt", j) for i in (1, 10) for j in range(4, 8)}
        assert [(r.path, r.length) for r in files(pushdown).where("path = 'a2/b2/f3.txt'").collect()] == [("a2/b2/f3.txt", 3)]
        assert files(pushdown).where("path = 'a2/b2/f3.txt' AND path LIKE 'a1%'").count() == 0 and files(pushdown).count() == 108
    again = files(False)
    assert [again.where("length > 7").count(), again.count(), again.where("path LIKE 'a1%'").count(), again.count()] == [12, 108, 36, 108]
    r = tree._PushingReader({"path": str(tmp_path / "t"), "content": "false"})
    assert list(r.pushFilters([tree.StringStartsWith(("path",), "a1/"), tree.LessThan(("length",), 2), tree.EqualTo(("error",), "x")])) == [tree.EqualTo(("error",), "x")]
    assert {f for p in r.partitions() for f, *_ in p.folders} <= {"", "a1", *(f"a1/b{i}" for i in (1, 4, 7, 10))}


def test_pack_folder(spark, tmp_path):
    rows = [(d, r, f"{d}{r}\n") for r, d in enumerate(["b", "a/x", "b", "c é", "a/x", "b"])]
    blocks = spark.createDataFrame(rows, "domain string, rank int, block string").repartition(3)
    path = str(tmp_path / "pack")
    packsink.save(blocks, path, "# {}\n", "end\n")
    index = packsink.index(spark, path).orderBy("n").collect()
    assert [(r.domain, r.blocks, r.chars) for r in index] == [("b", 3, 9), ("a/x", 2, 10), ("c é", 1, 5)]
    assert [open(f"{path}/{r.file}").read() for r in index] == ["# b\nb0\nb2\nb5\nend\n", "# a/x\na/x1\na/x4\nend\n", "# c é\nc é3\nend\n"]
    assert {*os.listdir(path)} == {packsink.INDEX, *(r.file for r in index)} and os.stat(f"{path}/{index[0].file}").st_mode & 0o77 == 0
    with pytest.raises(Exception, match="FileExists|pack"):
        packsink.save(blocks, path)
    packsink.save(blocks.where("domain = 'b'"), path, mode="overwrite")
    assert [json.loads(x)["domain"] for x in open(f"{path}/{packsink.INDEX}")] == ["b"] and len(os.listdir(path)) == 2
    packsink.save(blocks.where("false"), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == [packsink.INDEX] and {*os.listdir(tmp_path)} == {"pack", "none"}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    blocks = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 4).alias("domain"), F.col("id").alias("rank"), F.when(F.col("id") == 37, F.raise_error(F.lit("no such block"))).otherwise(F.lit("x\n")).alias("block"))
    with pytest.raises(Exception, match="no such block"):
        packsink.save(blocks, str(tmp_path / "pack"))
    bad = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "domain string, rank int, block string")  # fails inside the writer, after another domain's file
    with pytest.raises(Exception, match="(?i)none|argument|python"):
        packsink.save(bad.coalesce(1), str(tmp_path / "pack"))
    assert os.listdir(tmp_path) == []


def test_and_n_more(spark):
    from lodeline.plans import commands

    g = _graph(spark, [(f"n{i:02}", "t") for i in range(12)])
    found = commands.impacted(g, "src/t", 5).collect()
    assert [(r.id, r.via, r.more) for r in found] == [(f"n{i:02}", "t", 7) for i in range(5)]
    assert {r.more for r in commands.impacted(g, "src/t").collect()} == {0}
    files = graph.Graph(g.nodes.withColumn("type", F.lit("FILE")), g.edges)
    parts = commands.summary(files, 3)
    assert [(r.id, r.more) for r in parts["entry_points"].collect()] == [("n00", 9), ("n01", 9), ("n02", 9)]
    assert [(r.id, r.n_in, r.more) for r in parts["hubs"].collect()] == [("t", 12, 0)] and [(r.domain, r.files, r.more) for r in parts["domains"].collect()] == [("src", 13, 0)]


def test_many_rules_in_one_pass(spark):
    from lodeline.operators import discovery

    paths = [("src/auth_login/a.py",), ("lib/paymentGateway/x.ts",), ("lib/authx/y.ts",), ("docs/été_auth.md",), ("r3/core",)]
    rules = [("T", f"w{i}", rf"\b(w{i}|v{i})\b", 0.001) for i in range(10_000)] + [("Auth", "word", r"\b(auth|login)\b", 0.5), ("Auth", "one", r"\bauth\b", 0.25), ("Pay", "word", r"\bgateway\b", 0.75), ("Odd", "free", r"auth.", 0.5), ("Odd", "free", r"r\d", 0.25)]
    df = spark.createDataFrame(paths, "path string")
    found = {r.target: (r.confidence, r.evidence) for r in discovery.evaluated(df, rules).collect()}
    assert found == {"Auth": (0.75, "docs/été_auth.md,src/auth_login/a.py"), "Pay": (0.75, "lib/paymentGateway/x.ts"), "Odd": (0.5, "docs/été_auth.md,lib/authx/y.ts,r3/core,src/auth_login/a.py")}
    scans = discovery.matches(df.repartition(2), discovery.rule_table(spark, rules[:10_002], "target string, rule string, pattern string, weight double"))._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("RepartitionByExpression") + scans.count("Repartition ") == 1


@pytest.mark.parametrize("depth,named", [(2, 1000), (1, 0), (0, 1000)])
def test_changes_between_stored_trees(spark, tmp_path, monkeypatch, depth, named):
    from lodeline.operators import discovery, hashtree

    monkeypatch.setattr(hashtree, "NAMED", named)
    old = [(f"d{i % 9}/f{i}", i, "m") for i in range(300)] + [("twice", 1, "a"), ("twice", 1, "a"), (None, 1, None), ("gone", None, None)]
    new = [(p, s + (p == "d3/f3"), m) for p, s, m in old[:300] if p != "d4/f4"] + [("twice", 1, "a"), (None, 2, None), ("", 0, ""), ("-", 0, "")]
    schema = "path string, size long, mtime string"
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    root = hashtree.save(spark.createDataFrame(old, schema), a, depth)
    assert root == discovery.fingerprint(spark.createDataFrame(old[::-1], schema), depth=depth).first().fingerprint
    hashtree.save(spark.createDataFrame(new, schema), b, like=a)
    want = {("d3/f3", "changed"), ("d4/f4", "removed"), ("twice", "changed"), (None, "changed"), ("gone", "removed"), ("", "added"), ("-", "added")}
    assert {(r.path, r.change) for r in hashtree.changed(spark, a, b).collect()} == want
    assert hashtree.differing_leaves(spark, a, b)[1] <= len(want) and hashtree.changed(spark, a, a).count() == 0
    hashtree.save(spark.createDataFrame([], schema), str(tmp_path / "none"), like=a)
    assert hashtree.changed(spark, str(tmp_path / "none"), a).count() == len({p for p, *_ in old})


def test_a_stored_graph_is_joined_without_a_shuffle(spark, tmp_path):
    from lodeline.operators import graphstore

    rng = random.Random(6)
    g = _graph(spark, sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice(["CALLS", "USES", "IMPORTS"])) for _ in range(200)}))
    s = graphstore.save(g, "graph_of_a_test", str(tmp_path), buckets=3)
    try:
        for stored, plain in ((graphstore.degrees(s), graph.degrees(g)), (graphstore.hub_scores(s), graph.hub_scores(g))):
            assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
            plan = stored._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Bucketed: true" in plan
        ends = g.edges.where("type <> 'IMPORTS'").groupBy("type").count().collect()
        assert sorted(map(tuple, graphstore.cross_types(s).collect())) == sorted(("FUNCTION", r.type, "FUNCTION", r["count"]) for r in ends)
        assert {os.path.basename(os.path.dirname(f)) for f in s.by_src(("CALLS",)).inputFiles()} >= {"type=CALLS"} and {r.d for r in s.by_src(("CALLS",)).select(F.regexp_extract(F.input_file_name(), "type=[A-Z]+", 0).alias("d")).distinct().collect()} == {"type=CALLS"}
        assert sorted(map(tuple, s.graph().edges.collect())) == sorted(map(tuple, g.edges.collect()))
    finally:
        s.drop()


def test_no_writer_of_the_vault_is_lost(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from lodeline.operators import vaultlog

    path = str(tmp_path / "vault")

    def rules(*names, text="use {}", confidence=0.5):
        return spark.createDataFrame([(n, "c", text.format(n), confidence, "auto", "now") for n in names], vaultlog.NEW)

    def names():
        return {r.name: r.rule for r in vaultlog.current(spark, path)[0].collect()}

    assert names() == {}
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: vaultlog.append(path, rules(f"a{i}", "both")), range(4)))
    assert {*names()} == {"a0", "a1", "a2", "a3", "both"}
    vaultlog.compact(spark, path)
    assert vaultlog.current(spark, path)[1] == []
    late = vaultlog.append(path, rules("late", "a1", text="avoid {}"))
    assert vaultlog.current(spark, path)[1] == [late] and names()["a1"] == "avoid a1" and names()["late"] == "avoid late"
    held, before = vaultlog._base(spark, path), names()
    with ThreadPoolExecutor(3) as pool:  # two compactions and a writer at once
        done = [pool.submit(vaultlog.compact, spark, path), pool.submit(vaultlog.compact, spark, path), pool.submit(vaultlog.append, path, rules("meanwhile"))]
        [f.result() for f in done]
    assert names() == before | {"meanwhile": "use meanwhile"} and held[1].count() == 4
    vaultlog.compact(spark, path)
    assert vaultlog.current(spark, path)[1] == [] and names() == before | {"meanwhile": "use meanwhile"}
