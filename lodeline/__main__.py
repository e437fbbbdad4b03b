"""python -m lodeline COMMAND [ROOT] [--option value ...]: the commands of plans/commands.py on a local session."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import diagnostics, iterate, render
from .plans import commands
from .sources import config


def main() -> None:
    p = argparse.ArgumentParser(prog="lodeline")
    p.add_argument("command", choices=["init", "analyze", "discover", "pack", "export", "inspect", "explain", "stats", "impact", "summary", "learn", "memory", "diagnose"])
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--target", default="")
    p.add_argument("--task")
    p.add_argument("--profile")
    p.add_argument("--domain")
    p.add_argument("--model", default="markdown")
    p.add_argument("--max-tokens", type=float)
    p.add_argument("--top", type=int)
    p.add_argument("--ignore", action="append")
    p.add_argument("--out")
    p.add_argument("--parts", action="store_true", help="pack: a folder with a file or more for each domain, at --out")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-default-excludes", action="store_true")
    p.add_argument("--verbose", action="store_true", help="diagnose: warnings and remarks too")
    a = p.parse_args()
    if a.command == "init":
        print("done" if config.initialise(a.root) else "there already")
        return
    spark = SparkSession.builder.appName("lodeline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def rows(df) -> None:
        print("\n".join(df.toJSON().collect()))

    if a.command == "inspect":
        rows(commands.inspect(spark, a.root, a.top or 5, not a.no_default_excludes))
    elif a.command == "discover":
        rows(commands.discover(spark, a.root))
    elif a.command == "diagnose":
        found = commands.diagnosed(spark, a.root, not a.no_default_excludes, a.ignore)
        for r in diagnostics.report(found, a.verbose).toLocalIterator():
            print(r.line)
        rows(diagnostics.tally(found))
        if found.failed:
            raise SystemExit(1)
    elif a.command == "learn":
        rows(commands.learn_into_vault(spark, a.root))
    elif a.command == "memory":
        rows(commands.remembered(spark, a.root))
    elif a.command == "pack" and a.parts:
        if not a.out:
            p.error("--parts needs --out, a folder that isn't there yet")
        blocks, left_out = commands.pack_blocks(spark, a.root, a.target, a.task, a.max_tokens, a.raw, a.force, a.profile, not a.no_default_excludes)
        commands.save_pack(blocks, a.root, a.out)
        print(json.dumps({"left_out": [r.path for r in left_out.orderBy("path").collect()]}))
    elif a.command in ("pack", "export"):
        packed, left_out = commands.pack(spark, a.root, a.target, a.task, a.max_tokens, a.raw, a.force, a.profile, not a.no_default_excludes)
        if a.command == "export":
            context = render.context(commands.facts(commands.analyze(spark, a.root)), a.model)
            print(commands.export(context, packed).first().text)
        else:
            print(commands.write_pack(packed, a.root, a.out or a.profile or a.target or "project"))
            print(json.dumps({"left_out": [r.path for r in left_out.orderBy("path").collect()]}))
    else:
        found = commands.analyze(spark, a.root, defaults=not a.no_default_excludes, ignore=a.ignore)
        if a.command == "analyze":
            print(render.context(commands.facts(found), a.model))
        elif a.command == "stats":
            rows(commands.stats(found.graph, a.top or 3))
        elif a.command == "impact":
            try:
                rows(commands.impacted(found.graph, a.target, a.top or 50))
            except iterate.NoMatch:
                raise SystemExit(f"no file matches {a.target!r}") from None
        elif a.command == "explain":
            payload, border = commands.explain(found.graph, found.domains, a.domain or "global")
            print(payload.first().payload)
            rows(border)
        else:
            for name, df in commands.summary(found.graph).items():
                print(f"# {name}")
                rows(df)


if __name__ == "__main__":
    main()
