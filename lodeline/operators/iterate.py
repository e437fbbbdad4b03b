"""Iterative graph operators: a loop of joins over a frontier, each round cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graph import EXTERNAL, Graph, dealt


def target_match(path: Column, target: str) -> Column:
    """The path is the target or ends with it, whatever the case; `\\` counts as `/`, a leading `./` doesn't count."""
    t = target.replace("\\", "/").removeprefix("./").lower()
    p = F.lower(path)
    return (p == t) | p.endswith(f"/{t}")


class NoMatch(ValueError):
    """No node has the target's path."""


#: Rows up to which a frontier is broadcast to the links, once counted. What is broadcast passes through the driver, in every round.
FRONTIER = 1 << 16
#: Nodes from which on an impact says that it was cut short. A fixed value.
MOST_NODES = 2000


def _apart(df: DataFrame) -> DataFrame:
    """df, whose joins shuffle it however small it seems: in a loop, what Spark chose to broadcast would pass through the driver round after round."""
    return df.hint("merge")


def _next_hop(frontier: DataFrame, rows: int, links: DataFrame) -> DataFrame:
    """frontier (id, ...) joined to links (id, next), which stay where they are while the frontier is small."""
    return links.join(F.broadcast(frontier) if rows <= FRONTIER else _apart(frontier), "id")


def impact_paths(g: Graph, target: str, hops: int = 5, most: int | None = MOST_NODES, strict: bool = False) -> DataFrame:
    """Nodes that reach the target's over edges of any type: id, type, path, depth, via, risk, truncated.

    via: the least id among the nodes one hop nearer that the node points to, so that following it gives one shortest path to the target. No round begins once more
    than `most` nodes are known; truncated says of all rows that another would have. The links are stored once, partitioned by where they lead.
    """
    spark = g.edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = cut(g.nodes.where(target_match(F.col("path"), target)).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct())
    n = seen.count()
    if strict and not n:
        raise NoMatch(target)
    back = cut(g.edges.select(F.col("dst").alias("id"), F.col("src").alias("next")).distinct().repartition(parts, "id"))
    frontier, known, truncated = seen, n, False
    for d in range(1, hops + 1):
        if not n:
            break
        if most is not None and known > most:
            truncated = not _next_hop(frontier.select("id"), n, back).select(F.col("next").alias("id")).join(_apart(seen), "id", "left_anti").isEmpty()
            break
        new = _next_hop(frontier.select("id"), n, back).groupBy(F.col("next").alias("id")).agg(F.min("id").alias("via")).join(_apart(seen), "id", "left_anti")
        frontier = cut(new.select("id", F.lit(d).alias("depth"), "via"))
        n = frontier.count()
        known += n
        seen = seen.union(frontier)
    risk = F.when(F.col("depth") == 1, "HIGH").when(F.col("depth") == 2, "MEDIUM").otherwise("LOW")
    found = seen.where("depth > 0").join(g.nodes.where(F.col("type") != EXTERNAL).select("id", "type", "path"), "id")
    return found.select("id", "type", "path", "depth", "via", risk.alias("risk"), F.lit(truncated).alias("truncated"))


def impact(g: Graph, target: str, hops: int = 5, strict: bool = False) -> DataFrame:
    """Nodes that reach the target's over edges of any type: id, depth, risk (1 HIGH, 2 MEDIUM, further LOW). Start nodes and external symbols don't come back.
    strict: a target that no node has is an error."""
    return impact_paths(g, target, hops, None, strict).select("id", "type", "path", "depth", "risk")


def impact_summary(found: DataFrame, domain: Column) -> DataFrame:
    """One row of an impact: files, entities, worst risk, domains."""
    rank = F.when(F.col("risk") == "HIGH", 1).when(F.col("risk") == "MEDIUM", 2).otherwise(3)
    return found.agg(F.count_distinct(F.when(F.col("type") == "FILE", F.col("path"))).alias("files"), F.count_if(F.col("type") != "FILE").alias("entities"), F.coalesce(F.min_by("risk", rank), F.lit("NONE")).alias("risk"), F.array_join(F.array_sort(F.collect_set(domain)), ",").alias("domains"))


def diffusion(edges: DataFrame, seeds: DataFrame, top: int = 50, hops: int = 3, decay: float = 0.5, floor: float = 5.0, size: int | None = None) -> DataFrame:
    """Relevance from the `top` seeds (id, score), the best scaled to 100, over undirected edges: each hop keeps `decay` of the best neighbour that a node
    is first reached from; below `floor` nothing is passed on. size: rows of edges, if known; they are then dealt by it, and only a frontier moves in a hop."""
    best = seeds.where("score > 0").orderBy(F.desc("score"), "id").limit(top).collect()  # at most `top` rows
    most = max((r.score for r in best), default=1.0)
    start = edges.sparkSession.createDataFrame([(r.id, 100.0 * r.score / most) for r in best], "id string, score double")
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("id"), F.col("src").alias("next")))).alias("x")).select("x.*")
    both = cut(dealt(both, size and 2 * size, "id", "next").distinct())
    seen, frontier = start, start
    for _ in range(hops):
        sent = cut(frontier.where(F.col("score") * decay >= floor))
        passed = _next_hop(sent, sent.count(), both).groupBy(F.col("next").alias("id")).agg((F.max("score") * decay).alias("score"))
        frontier = cut(passed.join(_apart(seen), "id", "left_anti").select("id", "score"))
        seen = seen.union(frontier)
    return seen


def domains(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, shared: str = "shared", other: str = "global") -> DataFrame:
    """(id, domain): the label of seeds (id, label); for others the one label that reaches them over edges without crossing a seed, `shared` for several,
    `other` for none. A round passes on at most two labels of a node, which is as many as matter."""
    plain = edges.select("src", "dst").distinct().join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), F.col("dst").alias("next"))
    plain = cut(plain)
    frontier = seeds.select("id", F.col("label").alias("lo"), F.col("label").alias("hi"))
    known = None  # (id, lo, hi): least and greatest label so far
    while True:
        sent = _apart(frontier).join(plain, "id").groupBy(F.col("next").alias("id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        if known is None:
            merged = sent.withColumn("new", F.lit(True))
        else:
            old = known.select("id", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
            merged = _apart(old).join(sent, "id", "full").select("id", F.least("lo", "lo0").alias("lo"), F.greatest("hi", "hi0").alias("hi"), (F.least("lo", "lo0").eqNullSafe(F.col("lo0")) & F.greatest("hi", "hi0").eqNullSafe(F.col("hi0"))).alias("same")).select("id", "lo", "hi", (~F.col("same")).alias("new"))
        known = cut(merged)
        frontier = known.where("new").select("id", "lo", "hi")
        if frontier.isEmpty():
            break
        known = known.select("id", "lo", "hi")
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(shared))
    found = seeds.select("id", "label").union(known.select("id", label.alias("label")))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(other)).alias("domain"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, self-loops included."""
    return strong_components(edges).select("id")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes that reach themselves: the least id that they reach and that reaches them. A node with a loop alone is a component of its own.

    The acyclic fringe is trimmed first. Then the greatest id that reaches a node colours it, and what leads back to the colour's own node within the
    colour is its strong component; the rest goes on without it. No transitive closure is built.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found, n = None, e.count()
    while True:
        while n:  # trim, twice a round: what only leads out of or into cycles goes
            before = n
            for _ in range(2):
                inner = e.select(F.col("src").alias("id")).distinct().join(_apart(e.select(F.col("dst").alias("id")).distinct()), "id", "left_semi")
                e = e.join(_apart(inner.withColumnRenamed("id", "src")), "src", "left_semi").join(_apart(inner.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst")
            e = cut(e)
            n = e.count()
            if n == before:
                break
        if n == 0:
            break
        colour = cut(e.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            sent = e.join(_apart(colour.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("c"))
            nxt = cut(colour.join(_apart(sent), "id", "left").select("id", F.greatest("colour", "c").alias("colour"), (F.coalesce(F.col("c"), F.col("colour")) > F.col("colour")).alias("new")))
            done = nxt.where("new").isEmpty()
            colour = nxt.select("id", "colour")
            if done:
                break
        within = e.join(_apart(colour.withColumnsRenamed({"id": "src", "colour": "a"})), "src").join(_apart(colour.withColumnsRenamed({"id": "dst", "colour": "b"})), "dst").where("a = b").select("src", "dst")
        within = cut(within)
        seen = cut(colour.where("id = colour").select("id"))
        frontier = seen
        while not frontier.isEmpty():
            frontier = cut(within.join(_apart(frontier.withColumnRenamed("id", "dst")), "dst").select(F.col("src").alias("id")).distinct().join(_apart(seen), "id", "left_anti"))
            seen = seen.union(frontier)
        part = seen.join(_apart(colour), "id")
        strong = part.join(_apart(part.groupBy("colour").count().where("count > 1")), "colour", "left_semi").select("id", "colour")
        found = strong if found is None else found.union(strong)
        e = cut(e.join(_apart(seen.withColumnRenamed("id", "src")), "src", "left_anti").join(_apart(seen.withColumnRenamed("id", "dst")), "dst", "left_anti").select("src", "dst"))
        n = e.count()
    alone = loops.withColumn("colour", F.col("id"))
    if found is None:
        return alone.select("id", F.col("colour").alias("component"))
    # A loop inside a larger component is no component of its own.
    every = cut(found.union(alone.join(_apart(found), "id", "left_anti")))
    return every.join(_apart(every.groupBy("colour").agg(F.min("id").alias("component"))), "colour").select("id", "component")


def shortest_cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, size, length, cycle) of each strong component: its nodes, and the shortest cycle through its least node, as an array that begins with that node.

    All components are searched at once, breadth first, each node keeping the least id that it was first reached from; a component leaves when its least node is reached
    again. The cycles are then read backwards, a step of all of them a round. Of equally long ones the way back of least ids holds.
    """
    comps = cut(strong_components(edges) if components is None else components)
    e = edges.select("src", "dst").distinct().join(_apart(comps.select(F.col("id").alias("src"), "component")), "src").join(_apart(comps.select(F.col("id").alias("dst"), F.col("component").alias("other"))), "dst")
    e = cut(e.where("component = other").select(F.col("src").alias("id"), F.col("dst").alias("next"), "component"))
    none = F.lit(None).cast("string")
    seen = cut(comps.select(F.col("component").alias("id"), F.lit(0).alias("depth"), none.alias("via")).distinct())
    frontier, closed, d, n = seen, None, 0, seen.count()
    while n:
        d += 1
        sent = cut(_next_hop(frontier.select("id"), n, e).groupBy(F.col("next").alias("id"), "component").agg(F.min("id").alias("via")))
        back = sent.where("id = component").select("component", F.lit(d).alias("length"), F.col("via").alias("at"))
        closed = back if closed is None else closed.union(back)
        new = sent.join(_apart(closed.select("component")), "component", "left_anti").join(_apart(seen), "id", "left_anti")
        frontier = cut(new.select("id", F.lit(d).alias("depth"), "via"))
        n = frontier.count()
        seen = seen.union(frontier)
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    if closed is None:
        return sizes.select("component", "size", F.lit(0).alias("length"), F.array().cast("array<string>").alias("cycle"))
    seen = cut(seen)
    walks = cut(closed.select("component", "length", "at", F.array("at").alias("cycle")))
    open_, done = walks.where("at <> component"), walks.where("at = component")
    while not open_.isEmpty():
        step = _apart(open_).join(seen.select(F.col("id").alias("at"), "via"), "at").select("component", "length", F.col("via").alias("at"), F.concat(F.array("via"), "cycle").alias("cycle"))
        step = cut(step)
        done = done.union(step.where("at = component"))
        open_ = step.where("at <> component")
    return _apart(done).join(sizes, "component").select("component", "size", "length", "cycle")


#: The severity of a cycle by the type of its edges.
CYCLE_SEVERITY = {"CALLS": "WARNING", "IMPORTS": "INFO"}


def cycles(g: Graph, severity: dict[str, str] | None = None) -> DataFrame:
    """(type, severity, component, size, length, cycle): the cycles of each type of edges. All types are searched at once, a node being one of its own for each."""
    levels = severity or CYCLE_SEVERITY
    typed = g.of_type(tuple(levels)).select(*(F.concat("type", F.lit(":"), c).alias(c) for c in ("src", "dst")))
    found = shortest_cycles(typed).withColumn("type", F.substring_index("component", ":", 1))
    level = F.coalesce(*(F.when(F.col("type") == kind, F.lit(level)) for kind, level in levels.items()))

    def bare(c: Column) -> Column:
        return F.substr(c, F.length("type") + 2)

    return found.select("type", level.alias("severity"), bare(F.col("component")).alias("component"), "size", "length", F.transform("cycle", bare).alias("cycle"))


def closure(links: DataFrame, starts: DataFrame) -> DataFrame:
    """All ids reachable from starts (id) over links (src, dst), starts included; each is visited once."""
    links = links.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    seen = cut(starts.select("id").distinct())
    frontier, n = seen, seen.count()
    while n:
        frontier = cut(_next_hop(frontier, n, links).select(F.col("next").alias("id")).distinct().join(_apart(seen), "id", "left_anti"))
        n = frontier.count()
        seen = seen.union(frontier)
    return seen
