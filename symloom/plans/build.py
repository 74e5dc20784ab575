"""From source files to a graph, and from a graph and changed files to the next one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..operators import changes, derive, resolve
from ..sources import discovery, extract, imports, noise
from .scratch import cut

_NODE = ("kind", "ast_kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "params", "return_type", "modifiers", "is_test", "file_hash", "content_hash", "is_exported", "is_async", "decorators", "throws", "complexity", "ord")
MANIFESTS = ("package.json", "tsconfig.json", "go.mod", "Cargo.toml", "composer.json", "pubspec.yaml", "pyproject.toml", "Gemfile")


def manifest_of(root: str) -> dict:
    texts = {}
    for name in MANIFESTS:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                texts[name] = f.read()
    return imports.read_manifest(texts)


def graph_of_files(files: DataFrame, manifest: dict | None = None, baseline: CodeGraph | None = None, noise_names: DataFrame | None = None) -> CodeGraph:
    """The graph of ``files`` (file_path, language, content, file_hash); a ``baseline`` lends its symbols and files."""
    extracted = cut(extract.extract(files))
    staged = cut(extract.nodes_of(extracted))
    nodes = staged.select(*_NODE)
    known = extracted.select("file_path")
    if baseline is not None:
        known = known.union(baseline.nodes.select("file_path")).distinct()

    raw = extracted.select(F.col("file_path").alias("file"), "language", F.posexplode("imports").alias("ord", "i")).select("file", "language", "ord", "i.*")
    found = cut(imports.resolve_imports(raw, known, manifest))
    symbols = cut(resolve.symbol_table(nodes, baseline.nodes if baseline else None))
    barrels = resolve.re_export_map(found.filter("re_export").select("file", "target"))
    named = found.select("file", F.coalesce("target", "module").alias("target"), "ord", "names")
    import_map = cut(resolve.import_map(named, symbols, barrels))

    calls = extracted.select(F.col("file_path").alias("file"), "language", F.posexplode("calls").alias("k", "c")).select("file", "language", "k", "c.*")
    injected = extracted.select(F.col("file_path").alias("file"), F.explode("bindings").alias("b")).select("file", F.col("b.field").alias("field"), F.col("b.type").alias("di"))
    injected = injected.groupBy("file", "field").agg(F.min("di").alias("di"))
    field = F.regexp_extract("receiver", r"^(?:\$?this|self)(?:\.|->)(\w+)$", 1)
    sites = calls.withColumn("field", field).join(injected, ["file", "field"], "left")
    sites = sites.select(F.xxhash64("file", "k").alias("site_id"), "file", "language", F.col("name").alias("call_name"), F.when(F.col("di").isNull(), F.col("receiver_type")).alias("receiver_type"), F.col("di").alias("di_type"), F.col("in_class").alias("resolve_in_class"), "line", "col", "chained_line", "chained_col", "receiver_call", "receiver_import")
    heritage = staged.filter("kind IN ('Class', 'Interface')").select("name", F.explode(F.array_compact(F.concat(F.array("extends"), F.coalesce("implements", F.array().cast("array<string>"))))).alias("parent"))
    everything = nodes.unionByName(baseline.nodes.select(*_NODE), allowMissingColumns=True) if baseline is not None else nodes
    results = cut(resolve.returned_types(everything))
    values = extracted.select(F.col("file_path").alias("file"), F.explode("values").alias("v")).select("file", "v.*")
    typed = cut(resolve.deferred_receivers(cut(sites), symbols, import_map, values, results))

    def resolved_calls(rows: DataFrame) -> DataFrame:
        return resolve.resolve_calls(rows, symbols, import_map, heritage, noise_names)

    resolved = resolve.chained_calls(cut(resolved_calls(typed)), results, resolved_calls).filter("target IS NOT NULL")
    placed = changes.enclosing_function(nodes, resolved.withColumnRenamed("file", "file_path"))
    edges = placed.filter("source <> target").select(F.lit("CALLS").alias("kind"), F.col("source").alias("source_qualified"), F.col("target").alias("target_qualified"), "file_path", "line", "confidence", "tier", "alternatives")
    edges = cut(derive.known_calls(edges, everything))

    classes = staged.filter("kind = 'Class'").select("qualified_name", F.col("file_path").alias("file"), F.col("line_start").alias("line"), "extends", F.coalesce("implements", F.array().cast("array<string>")).alias("implements"))
    tested = derive.tested_by_calls(edges.drop("kind"), nodes)
    plain = [derive.imports(found), derive.heritage(classes, everything, import_map), tested, derive.tested_by_name(nodes, tested), derive.uses_type(nodes, import_map), derive.contains(nodes)]
    out = edges
    for rows in plain:
        out = out.unionByName(rows, allowMissingColumns=True)
    return CodeGraph(nodes, cut(out))


def parse(spark: SparkSession, root: str, files: list[str] | None = None, include=(), exclude=(), max_files: int | None = None, allow_partial: bool = False) -> CodeGraph:
    return graph_of_files(discovery.discover(spark, root, files, include, exclude, max_files, allow_partial), manifest_of(root), noise_names=noise.noise_table(spark))


def update(graph: CodeGraph, files: DataFrame, manifest: dict | None = None, noise_names: DataFrame | None = None) -> CodeGraph:
    """The graph after ``files``, the sources as they are now: only added and modified ones are read again.

    Names that make no edges are those of ``parse``, unless others are given, so that calls of read files are
    resolved as a full build resolves them.
    """
    stored = graph.nodes.groupBy("file_path").agg(F.max("file_hash").alias("file_hash"))
    status = cut(changes.classify_files(stored, files.select("file_path", "file_hash")))
    stale = status.filter("status <> 'unchanged'")
    if stale.isEmpty():
        return graph
    fresh = files.join(status.filter("status IN ('added', 'modified')"), "file_path", "left_semi")
    rest = CodeGraph(graph.nodes.join(stale, "file_path", "left_anti"), graph.edges.join(stale, "file_path", "left_anti"))
    names = noise.noise_table(files.sparkSession) if noise_names is None else noise_names
    return changes.merge(graph, graph_of_files(fresh, manifest, rest, names), stale.select("file_path"))
