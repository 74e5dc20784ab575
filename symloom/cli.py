"""Commands on a repository and its graph: ``python -m symloom COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CodeGraph
from .operators import changes, communities, lookup, reach
from .plans import build
from .render import context as render
from .sources import discovery


def session() -> SparkSession:
    made = SparkSession.builder.appName("symloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="symloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args, graph: bool = True):
        sub = commands.add_parser(name)
        if graph:
            sub.add_argument("--graph", required=True)
        sub.add_argument("--out", default="-")
        for flags, options in args:
            sub.add_argument(*flags.split(), **options)

    chosen = (("--repo", {}), ("--base", {}), ("--risk-config", {}))
    many, number, real = {"nargs": "*", "default": []}, lambda d: {"type": int, "default": d}, lambda d: {"type": float, "default": d}
    command("parse", ("repo", {}), ("--files", many), ("--include", many), ("--exclude", many), ("--max-files", number(None)), ("--allow-partial", {"action": "store_true"}), graph=False)
    command("update", ("repo", {}))
    command("analyze", ("--files", many), *chosen, ("--max-depth", number(3)), ("--min-confidence", real(0.5)))
    command("context", ("--old", {}), ("--files", many), *chosen, ("--diff", {}), ("--format", {"choices": ("text", "xml", "json"), "default": "text"}), ("--max-depth", number(3)), ("--min-confidence", real(0.5)))
    command("diff", ("--old", {"required": True}), ("--files", many))
    command("communities", ("--depth", number(2)), ("--min-size", number(3)), ("--topological", {"action": "store_true"}))
    command("pr-overlap", ("--a", many), ("--b", many), ("--max-depth", number(3)))
    command("subsystem-context", ("--symbols", many))
    command("context-of", ("symbol", {}), ("--limit", number(10)))
    command("path", ("start", {}), ("end", {}), ("--kinds", {"nargs": "*", "default": ["CALLS"]}), ("--max-depth", number(10)))
    command("rank", ("--top", number(20)), ("--file", {}))
    command("status", ("repo", {}))
    command("flows", ("--max-depth", number(10)), ("--type", {"choices": ("test", "http")}))
    command("search", ("pattern", {"nargs": "?"}), ("--kind", {}), ("--file", {}), ("--callers-of", {}), ("--callees-of", {}), ("--limit", number(50)))
    command("outline", ("--files", many), ("--exported-only", {"action": "store_true"}))
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | str | None:
    def files(names) -> DataFrame:
        return spark.createDataFrame([(n,) for n in names], "file_path string")

    def symbols(names) -> DataFrame:
        return spark.createDataFrame([(n,) for n in names], "qualified_name string")

    def read(path: str) -> CodeGraph:
        return CodeGraph.load_json(spark, path) if path.endswith(".json") else CodeGraph.load(spark, path)

    if args.command == "parse":
        made = build.parse(spark, args.repo, args.files or None, args.include, args.exclude, args.max_files, args.allow_partial)
        made.save_json(args.out) if args.out.endswith(".json") else made.save(args.out)
        return None
    g = read(args.graph)
    if args.command == "update":
        made = build.update(g, discovery.discover(spark, args.repo), build.manifest_of(args.repo))
        made.save_json(args.out) if args.out.endswith(".json") else made.save(args.out)
        return None
    names = list(getattr(args, "files", None) or [])
    if getattr(args, "base", None):  # what git says has changed since then
        names += discovery.git_changed(args.repo or ".", args.base)
    changed = files(names) if names or getattr(args, "base", None) else g.nodes.select("file_path").distinct()
    if args.command in ("analyze", "context"):
        hunks = None
        if getattr(args, "diff", None):
            with open(args.diff, encoding="utf-8", errors="replace") as f:
                hunks = discovery.diff_hunks_of(spark, f.read())
        risk = None
        if args.risk_config:
            with open(args.risk_config, encoding="utf-8") as f:
                risk = changes.risk_config(json.load(f))
        parts = render.change_context(g, changed, read(args.old) if getattr(args, "old", None) else None, hunks, args.max_depth, args.min_confidence, risk=risk)
        style = getattr(args, "format", "json")
        if style != "json":
            return {"text": render.text, "xml": render.xml}[style](parts)
        return json.dumps({k: [r.asDict(True) for r in v.collect()] for k, v in parts.items() if k != "flows"}, default=str)
    if args.command == "diff":
        old = read(args.old)
        return json.dumps({k: [r.asDict(True) for r in f(old, g, changed).collect()] for k, f in (("nodes", changes.diff_nodes), ("contracts", changes.diff_contracts), ("edges", changes.diff_edges))} | {"risk_by_file": [r.asDict() for r in changes.file_risk(g, changed).collect()]})
    if args.command == "communities":
        return communities.topological_communities(g, args.min_size) if args.topological else communities.directory_communities(g, args.depth, args.min_size).orderBy("community")
    if args.command == "pr-overlap":
        return reach.overlap(g, *(lookup.in_files(g, files(x)).select("qualified_name") if all("::" not in s for s in x) else symbols(x) for x in (args.a, args.b)), args.max_depth).orderBy("relation", "qualified_name")
    if args.command == "subsystem-context":
        return reach.subsystem_context(g, communities.topological_communities(g), symbols(args.symbols)).orderBy("relation", "qualified_name")
    if args.command == "context-of":
        return lookup.context_of(g, args.symbol, args.limit).orderBy("relation", "place")
    if args.command == "path":
        return reach.shortest_path(g, args.start, args.end, args.kinds, args.max_depth)
    if args.command == "rank":
        return lookup.rank(g, args.top, args.file)
    if args.command == "status":
        return changes.file_status(g, discovery.discover(spark, args.repo).select("file_path", "file_hash")).orderBy("file_path")
    if args.command == "flows":
        members = reach.flow_members(g, reach.entry_points(g, args.type), args.max_depth)
        return reach.flows(g, members, with_path=True).orderBy(F.desc("criticality"), "entry")
    if args.command == "search":
        if args.callers_of or args.callees_of:
            return lookup.neighbours(g, args.callers_of or args.callees_of, "callers" if args.callers_of else "callees", args.limit)
        return lookup.search(g, args.pattern, args.kind, args.file, args.limit)
    return changes.outline(CodeGraph(lookup.in_files(g, changed), g.edges), args.exported_only).orderBy("file_path", "line_start")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    found = run(args, session())
    if found is None:
        return 0
    out = sys.stdout if args.out == "-" else open(args.out, "w", encoding="utf-8")
    try:
        if isinstance(found, str):
            out.write(found)
        else:
            for row in found.toJSON().toLocalIterator():
                out.write(row + "\n")
    finally:
        if out is not sys.stdout:
            out.close()
    return 0
