"""Text renderings: entities, trees, packs, domain payloads, exports."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import closing_tag_safe, extension, line_count
from .graph import Graph


def entity_markdown(e: Column) -> Column:
    """A compact Markdown block of an entity struct (name, kind, purpose, fields, methods, inputs, outputs)."""

    def params(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("any")))), ", ")

    head = F.concat(F.lit("### "), F.lower(e["kind"]), F.lit(" "), e["name"])
    purpose = F.when(F.coalesce(e.purpose, F.lit("")) != "", F.trim(F.regexp_replace(e.purpose, r"\s+", " ")))
    fields = F.when(F.size(e.fields) > 0, F.concat(F.lit("- fields: "), params(e.fields)))
    methods = F.when(F.size(e.methods) > 0, F.array_join(F.transform(e.methods, lambda m: F.concat(F.lit("- "), m["name"], F.lit("("), params(m["inputs"]), F.lit(") -> "), F.coalesce(m["returns"], F.lit("any")))), "\n"))
    sign = F.when(e.kind == "FUNCTION", F.concat(F.lit("- ("), params(e.inputs), F.lit(") -> "), F.coalesce(e.outputs, F.lit("any"))))
    return F.concat_ws("\n", head, purpose, fields, methods, sign)


def file_block(path: Column, content: Column, entities: Column | None = None) -> Column:
    """A file's block: its entities if it has some, else suffix and line count."""
    plain = F.concat(F.lit("- type: "), F.when(extension(path) == "", "none").otherwise(extension(path)), F.lit("\n- lines: "), line_count(content).cast("string"))
    body = plain if entities is None else F.when(F.size(entities) > 0, F.array_join(F.transform(entities, entity_markdown), "\n")).otherwise(plain)
    return F.concat(F.lit("## "), path, F.lit("\n"), body, F.lit("\n"))


def tree_rows(paths: DataFrame, depth: int = 4, breadth: int = 50) -> DataFrame:
    """Rows of a folder tree (parent, name, is_dir, level, k, more): folders first, names without regard to case; at most `breadth` a folder."""
    p = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(p, F.lit(1), i - 1), "/").alias("parent"), F.get(p, i - 1).alias("name"), (i < F.size(p)).alias("is_dir"), i.alias("level")))
    rows = paths.select(F.explode(each).alias("x")).select("x.*").groupBy("parent", "name", "level").agg(F.bool_or("is_dir").alias("is_dir"))
    w = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    n = F.count(F.lit(1)).over(Window.partitionBy("parent"))
    return rows.select("parent", "name", "is_dir", "level", F.row_number().over(w).alias("k"), F.greatest(n - breadth, F.lit(0)).alias("more")).where(F.col("k") <= breadth)


def tree_text(paths: DataFrame, depth: int = 4, breadth: int = 50, most: int = 2500) -> str:
    """The tree drawn, at most `most` rows."""
    rows = tree_rows(paths, depth, breadth).orderBy("level", "parent", "k").limit(most + 1).collect()
    below: dict[str, list] = {}
    for r in rows[:most]:
        below.setdefault(r.parent, []).append(r)
    out: list[str] = []

    def draw(parent: str, indent: str) -> None:
        for r in below.get(parent, []):
            out.append(f"{indent}{r.name}{'/' if r.is_dir else ''}")
            if r.is_dir:
                draw(f"{parent}/{r.name}" if parent else r.name, indent + "  ")
        if below.get(parent) and below[parent][0].more:
            out.append(f"{indent}... {below[parent][0].more} more")

    draw("", "")
    return "\n".join(out + ["... (cut)"] * (len(rows) > most))


#: What a pack begins with, and what stands around each domain; all are charged to a budget.
PACK_HEADER, DOMAIN_HEADER, DOMAIN_FOOTER = "Context of {}\n\n", "# {title}: {}\n", "\n"


def pack_header(name: str) -> str:
    return PACK_HEADER.replace("{}", name)


def packed_text(blocks: DataFrame, title: str) -> DataFrame:
    """(domain, best, text): one string a domain of blocks (domain, rank, block), in rank order; the caller writes them as files."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x.block), "")
    head = F.format_string(DOMAIN_HEADER.replace("{title}", title.replace("%", "%%")).replace("{}", "%s"), F.col("domain"))
    return blocks.groupBy("domain").agg(F.min("rank").alias("best"), body.alias("body")).select("domain", "best", F.concat(head, "body", F.lit(DOMAIN_FOOTER)).alias("text"))


def domain_payload(g: Graph, members: DataFrame, name: str) -> DataFrame:
    """One row (payload): a domain's nodes and edges as JSON, after a heading."""
    ids = members.select("id").distinct()
    nodes = g.nodes.join(ids, "id", "left_semi").agg(F.sort_array(F.collect_list(F.struct("id", "type", "name", "path"))).alias("nodes"))
    inner = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = inner.agg(F.sort_array(F.collect_list(F.struct("src", "dst", "type"))).alias("edges"))
    return nodes.crossJoin(edges).select(F.concat(F.lit(f"# Domain {name}\n"), F.to_json(F.struct("nodes", "edges"))).alias("payload"))  # one row each


def exported(context: Column, pack: Column, tag: str = "context_pack") -> Column:
    """The context, then the pack inside the tag, which nothing inside can close."""
    return F.concat(context, F.lit(f"\n<{tag}>\n"), closing_tag_safe(pack, tag), F.lit(f"\n</{tag}>\n"))


def markdown_context(facts: dict[str, list[str]]) -> str:
    return "\n".join(line for k, xs in facts.items() for line in (f"## {k}", *(f"- {x}" for x in xs), ""))


def xml_context(facts: dict[str, list[str]]) -> str:
    rows = (f"  <section name={k!r}>\n" + "".join(f"    <item>{escape(x)}</item>\n" for x in xs) + "  </section>\n" for k, xs in facts.items())
    return f"<context>\n{''.join(rows)}</context>"


#: Renderers by name; an unknown name gives the first.
RENDERERS: dict[str, Callable[[dict[str, list[str]]], str]] = {"markdown": markdown_context, "xml": xml_context}


def context(facts: dict[str, list[str]], name: str = "markdown") -> str:
    return RENDERERS.get(name, next(iter(RENDERERS.values())))(facts)


def document(g: Graph, name: str) -> DataFrame:
    """The whole graph as one JSON row; for small graphs. Large ones are written as two tables by `save`."""
    n = g.nodes.agg(F.sort_array(F.collect_list(F.struct("id", "type", "name", "path"))).alias("nodes"))
    e = g.edges.agg(F.sort_array(F.collect_list(F.struct("src", "dst", "type", "confidence", "method"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(name).alias("name"), F.struct("nodes", "edges").alias("graph"))).alias("json"))


def save(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
