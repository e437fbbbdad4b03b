"""What must not grow with the tables: what the driver gets, what one task holds, what is shuffled."""

from lodeline.operators import diagnostics, discovery, graph, iterate


def test_loops_send_little_to_the_driver(spark):
    """What a loop joins is shuffled, or broadcast only as a frontier counted as small: nothing that grows with the graph passes through the driver each round."""
    from lodeline.plans.lineage import cut

    plans = []

    def seen(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    df = spark.createDataFrame([(f"f{i}", f"f{2 * i + k}") for i in range(1, 200) for k in (0, 1)] + [("f9", "f4")], "src string, dst string")
    own, frontier = iterate.cut, iterate.FRONTIER
    iterate.cut, iterate.FRONTIER = seen, 0
    try:
        assert iterate.closure(df, spark.sql("SELECT 'f1' AS id")).count() == 399
        assert {r.id for r in iterate.strong_components(df).collect()} == {"f4", "f9"}
        assert [(r.component, r.size, r.length, r.cycle) for r in iterate.shortest_cycles(df).collect()] == [("f4", 2, 2, ["f4", "f9"])]
    finally:
        iterate.cut, iterate.FRONTIER = own, frontier
    assert plans and not any("Broadcast" in p for p in plans)


def test_large_graphs_are_dealt_by_their_size(spark, monkeypatch):
    """Where a graph's size is known, a task gets about TASK_ROWS of its rows, however few partitions shuffles have; results stay the same."""
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    edges = spark.range(2000).selectExpr("concat('a', id % 300) AS src", "concat('b', id % 7) AS dst")
    found, want = graph.fans(edges, 2000), graph.fans(edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" in plan and ", 20)" in plan and ", 40)" in plan
    assert sorted(found.collect()) == sorted(want.collect())
    seeds = spark.sql("SELECT 'a1' AS id, 1.0D AS score")
    assert sorted(iterate.diffusion(edges, seeds, size=2000).collect()) == sorted(iterate.diffusion(edges, seeds).collect())


def test_few_rules_are_not_shuffled_to_and_matches_are_dealt(spark, monkeypatch):
    """A few rules' words are broadcast; matches are dealt by their number, and repeated paths or words change nothing."""
    monkeypatch.setattr(discovery, "TASK_ROWS", 50)
    paths = spark.range(400).selectExpr("concat('core/r', id % 9, '/n', id) AS path")
    paths = paths.union(paths)
    rules = [("A", "one", r"\b(r1|n7)\b", 0.5), ("A", "two", r"\bn9\b", 0.25), ("B", "three", r"core/r[23]\b", 0.75)]
    want = [("A", 0.75, "core/r0/n9,core/r1/n1,core/r1/n10,core/r1/n100,core/r1/n109"), ("B", 0.75, "core/r2/n101,core/r2/n11,core/r2/n110,core/r2/n119,core/r2/n128")]
    table = discovery.rule_table(spark, rules, "target string, rule string, pattern string, weight double")
    for few in (discovery.FEW_WORDS, 0):
        monkeypatch.setattr(discovery, "FEW_WORDS", few)
        found = discovery.evaluated(paths, rules)
        assert sorted(map(tuple, found.collect())) == want
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        plan = discovery.matches(paths, table)._jdf.queryExecution().executedPlan().toString()
        assert not few or "BroadcastHashJoin" in plan


def test_diagnostics_are_dealt_by_the_graphs_size(spark, monkeypatch):
    """Joins and groupings of diagnostics get about TASK_ROWS rows a task where the size is known; a hub, repeated ids and null ends change nothing."""
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    nodes = spark.range(700).selectExpr("concat('a', id % 600) AS id", "if(id % 3 = 0, 'FUNCTION', 'FILE') AS type", "concat('n', id) AS name", "concat('p/', id) AS path", "concat('f', id % 500) AS fqn")
    edges = spark.range(2000).selectExpr("concat('a', id % 650) AS src", "if(id % 2 = 0, 'a3', if(id % 11 = 0, NULL, concat('a', id % 640))) AS dst", "if(id % 5 = 0, 'CONTAINS', 'CALLS') AS type", "1.0D AS confidence", "'path' AS method")
    found, want = (diagnostics.entries(graph.Graph(nodes, edges, size)) for size in (2000, None))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"hashpartitioning({k}" in plan for k in ("src", "dst", "space", "fqn")) and ", 20), REPARTITION_BY_NUM" in plan and ", 40), REPARTITION_BY_NUM" in plan
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
