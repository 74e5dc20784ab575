"""Lookups on the graph: search, neighbours, context of a symbol, ranking, coverage, hierarchy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph, file_of


def pattern_filter(pattern: str, *columns: str) -> Column:
    """``/re/flags``, a glob with ``*``, or a substring; globs and substrings ignore case."""
    regex = re.fullmatch(r"/(.*)/([a-z]*)", pattern)
    if regex:
        text = ("(?i)" if "i" in regex[2] else "") + regex[1]
        tests = [F.col(c).rlike(text) for c in columns]
    elif "*" in pattern:
        text = "(?i)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
        tests = [F.col(c).rlike(text) for c in columns]
    else:
        tests = [F.contains(F.lower(c), F.lit(pattern.lower())) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def search(graph: CodeGraph, pattern: str | None = None, kind: str | None = None, file: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols whose name or qualified name matches, by file and line."""
    found = graph.nodes
    if pattern:
        found = found.filter(pattern_filter(pattern, "name", "qualified_name"))
    if kind:
        found = found.filter(F.col("kind") == kind)
    if file:
        found = found.filter(pattern_filter(file, "file_path"))
    found = found.orderBy("file_path", "line_start", "qualified_name")
    return found.limit(limit) if limit is not None else found


def neighbours(graph: CodeGraph, symbol: str, direction: str = "callers", limit: int | None = None) -> DataFrame:
    """CALLS neighbours with a known node, one row for each edge."""
    here, there = ("target_qualified", "source_qualified") if direction == "callers" else ("source_qualified", "target_qualified")
    edges = graph.of_kind("CALLS").filter(F.col(here) == symbol).select(F.col(there).alias("qualified_name"), "line", "confidence")
    out = edges.join(graph.known().select("qualified_name", "name", "kind", "file_path"), "qualified_name").orderBy("qualified_name", "line")
    return out.limit(limit) if limit is not None else out


def degrees(graph: CodeGraph, *kinds: str) -> DataFrame:
    """(qualified_name, in_degree, out_degree) by one aggregation over both ends of every edge."""
    edges = graph.of_kind(*kinds) if kinds else graph.edges
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_qualified").alias("q"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_qualified").alias("q"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.q").alias("qualified_name")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def rank(graph: CodeGraph, top: int | None = 20, file: str | None = None) -> DataFrame:
    """Symbols by degree over CALLS, INHERITS and USES_TYPE; isolated ones are left out."""
    nodes = graph.known().select("qualified_name", "name", "kind", "file_path")
    if file:
        nodes = nodes.filter(pattern_filter(file, "file_path"))
    out = degrees(graph, "CALLS", "INHERITS", "USES_TYPE").join(nodes, "qualified_name").withColumn("score", F.col("in_degree") + F.col("out_degree"))
    out = out.orderBy(F.desc("score"), F.desc("in_degree"), "qualified_name")
    return out.limit(top) if top is not None else out


def context_of(graph: CodeGraph, symbol: str, limit: int = 10) -> DataFrame:
    """(relation, qualified_name, degree, place): callers and callees by degree, types used and tests by name, ``limit`` of each."""
    from pyspark.sql.window import Window

    calls = graph.of_kind("CALLS")
    near = calls.filter(F.col("target_qualified") == symbol).select(F.lit("caller").alias("relation"), F.col("source_qualified").alias("qualified_name"))
    near = near.union(calls.filter(F.col("source_qualified") == symbol).select(F.lit("callee"), "target_qualified")).distinct()
    degree = degrees(graph).select("qualified_name", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    near = near.join(degree, "qualified_name", "left").select("relation", "qualified_name", "degree")
    for kind, relation in (("USES_TYPE", "uses_type"), ("TESTED_BY", "tested_by")):
        near = near.union(graph.of_kind(kind).filter(F.col("source_qualified") == symbol).select(F.lit(relation), "target_qualified", F.lit(0).cast("long")).distinct())
    by = Window.partitionBy("relation").orderBy(F.desc("degree"), "qualified_name")
    return near.withColumn("place", F.row_number().over(by)).filter((F.col("place") <= limit) | F.col("relation").isin("uses_type", "tested_by"))


def tested_symbols(graph: CodeGraph) -> DataFrame:
    """(name, level): sources of TESTED_BY, as symbols where they hold ``::`` and as files otherwise."""
    return graph.of_kind("TESTED_BY").select(F.col("source_qualified").alias("name"), F.when(F.contains("source_qualified", F.lit("::")), "symbol").otherwise("file").alias("level")).distinct()


def in_files(graph: CodeGraph, files: DataFrame) -> DataFrame:
    """Nodes of the files in the column ``file_path`` of ``files``."""
    return graph.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi")


def test_gaps(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """Functions and methods of changed files that neither a symbol's nor a file's evidence calls tested."""
    tested = tested_symbols(graph)
    rows = in_files(graph, changed).filter(F.col("kind").isin("Function", "Method") & ~F.col("is_test"))
    rows = rows.join(tested.filter("level = 'symbol'").select(F.col("name").alias("qualified_name")), "qualified_name", "left_anti")
    return rows.join(tested.filter("level = 'file'").select(F.col("name").alias("file_path")), "file_path", "left_anti").select("qualified_name", "file_path", "line_start", "line_end")


def owner_of(qualified: str) -> Column:
    """``file::Class`` of ``file::Class.member``; empty without an owner."""
    return F.regexp_extract(qualified, r"^(.*::.*)\.[^.]*$", 1)


def hierarchy_share(graph: CodeGraph, nodes: DataFrame) -> Column | DataFrame:
    """Share of ``nodes`` that derive from something, or whose class does."""
    members = graph.of_kind("INHERITS", "IMPLEMENTS").select(F.col("source_qualified").alias("m")).distinct()
    rows = nodes.select("qualified_name", owner_of("qualified_name").alias("owner"))
    rows = rows.join(members.withColumn("self", F.lit(1)).withColumnRenamed("m", "qualified_name"), "qualified_name", "left")
    rows = rows.join(members.withColumn("own", F.lit(1)).withColumnRenamed("m", "owner"), "owner", "left")
    return rows.agg(F.coalesce(F.avg(F.when(F.col("self").isNotNull() | F.col("own").isNotNull(), 1.0).otherwise(0.0)), F.lit(0.0)).alias("share"))


def inheritance(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """Classes of changed files with what they extend, implement, and who extends them."""
    up = graph.of_kind("INHERITS", "IMPLEMENTS").groupBy(F.col("source_qualified").alias("qualified_name")).agg(
        F.max(F.when(F.col("kind") == "INHERITS", F.col("target_qualified"))).alias("extends"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "IMPLEMENTS", F.col("target_qualified")))).alias("implements"),
    )
    down = graph.of_kind("INHERITS").groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.sort_array(F.collect_set("source_qualified")).alias("children"))
    classes = in_files(graph, changed).filter("kind = 'Class'").select("qualified_name", "file_path")
    return classes.join(up, "qualified_name", "left").join(down, "qualified_name", "left")


def changed_imports(graph: CodeGraph, changed: DataFrame, old: CodeGraph | None = None) -> DataFrame:
    """IMPORTS of changed files with is_new (against ``old``) and unresolved (no node in the target)."""
    files = changed.select("file_path").distinct()
    mine = graph.of_kind("IMPORTS").join(files, "file_path", "left_semi").select("file_path", "target_qualified").distinct()
    known = graph.nodes.select(file_of("qualified_name").alias("target_qualified")).distinct().withColumn("known", F.lit(True))
    out = mine.join(known, "target_qualified", "left")
    if old is not None:
        before = old.of_kind("IMPORTS").select("file_path", "target_qualified").distinct().withColumn("old", F.lit(True))
        out = out.join(before, ["file_path", "target_qualified"], "left").withColumn("is_new", F.col("old").isNull()).drop("old")
    return out.withColumn("unresolved", F.col("known").isNull()).drop("known")
