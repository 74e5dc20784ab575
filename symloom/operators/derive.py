"""Edges that follow from symbols and resolved calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import directory, file_stem, identifiers, shared_prefix, test_stem
from .resolve import resolve_types

_EDGE = ("kind", "source_qualified", "target_qualified", "file_path", "line")


def contains(nodes: DataFrame) -> DataFrame:
    """File to function or class."""
    return nodes.filter(F.col("kind").isin("Function", "Method", "Constructor", "Class")).select(F.lit("CONTAINS").alias("kind"), F.col("file_path").alias("source_qualified"), F.col("qualified_name").alias("target_qualified"), "file_path", F.col("line_start").alias("line"))


def imports(resolved: DataFrame) -> DataFrame:
    """Resolved imports (file, target, line) as edges from file to file."""
    return resolved.filter("target IS NOT NULL").groupBy("file", "target").agg(F.min("line").alias("line")).select(F.lit("IMPORTS").alias("kind"), F.col("file").alias("source_qualified"), F.col("target").alias("target_qualified"), F.col("file").alias("file_path"), "line")


def known_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls whose target stands in a file that declares a symbol."""
    files = nodes.select(F.col("file_path").alias("_f")).distinct()
    return calls.withColumn("_f", F.split("target_qualified", "::")[0]).join(files, "_f", "left_semi").drop("_f")


def tested_by_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """What calls from files with tests reach, as TESTED_BY that file."""
    files = nodes.filter("kind = 'Test'").select("file_path").distinct()
    rows = calls.join(files, "file_path", "left_semi").filter(F.split("target_qualified", "::")[0] != F.col("file_path"))
    return rows.select(F.lit("TESTED_BY").alias("kind"), F.col("target_qualified").alias("source_qualified"), F.col("file_path").alias("target_qualified"), "file_path", F.lit(0).alias("line")).distinct()


def tested_by_name(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Files that a test file's name points to, for languages without evidence by calls; the nearest, none on a tie."""
    files = nodes.select("file_path", "language").distinct()
    tests = nodes.filter("kind = 'Test'").select("file_path", "language").distinct()
    proven = evidence.select("file_path").distinct().join(tests, "file_path").select("language").distinct()
    tests = tests.join(proven, "language", "left_anti").select(F.col("file_path").alias("test"), "language", test_stem("file_path").alias("stem")).filter("stem IS NOT NULL")
    plain = files.join(nodes.filter("kind = 'Test'").select("file_path").distinct(), "file_path", "left_anti").select("file_path", "language", file_stem("file_path").alias("stem"))
    near = tests.join(plain, ["language", "stem"]).withColumn("near", shared_prefix(directory("test"), directory("file_path")))
    best = Window.partitionBy("test").orderBy(F.desc("near"))
    top = near.withColumn("r", F.rank().over(best)).filter("r = 1").groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("source_qualified")).filter("n = 1")
    return top.select(F.lit("TESTED_BY").alias("kind"), "source_qualified", F.col("test").alias("target_qualified"), F.col("test").alias("file_path"), F.lit(0).alias("line"))


def uses_type(nodes: DataFrame, import_map: DataFrame) -> DataFrame:
    """Types that signatures name, resolved; no symbol uses itself."""
    code = nodes.filter(F.col("kind").isin("Function", "Method", "Constructor"))
    named = code.select("qualified_name", F.col("file_path").alias("file"), "line_start", F.explode(identifiers(F.concat_ws(" ", "params", "return_type"))).alias("name"))
    declared = nodes.filter(F.col("kind").isin("Class", "Interface", "Enum")).select("name").distinct()
    found = resolve_types(named.join(declared, "name", "left_semi"), nodes, import_map).filter("resolved IS NOT NULL AND resolved <> qualified_name")
    return found.groupBy(F.lit("USES_TYPE").alias("kind"), F.col("qualified_name").alias("source_qualified"), F.col("resolved").alias("target_qualified"), F.col("file").alias("file_path")).agg(F.min("line_start").alias("line")).select(*_EDGE)


def heritage(classes: DataFrame, nodes: DataFrame, import_map: DataFrame) -> DataFrame:
    """INHERITS and IMPLEMENTS of classes (qualified_name, file, line, extends, implements), where the name resolves."""
    up = classes.select("qualified_name", "file", "line", F.lit("INHERITS").alias("kind"), F.col("extends").alias("name")).filter("name IS NOT NULL")
    across = classes.select("qualified_name", "file", "line", F.lit("IMPLEMENTS").alias("kind"), F.explode("implements").alias("name"))
    found = resolve_types(up.union(across), nodes, import_map).filter("resolved IS NOT NULL")
    return found.select("kind", F.col("qualified_name").alias("source_qualified"), F.col("resolved").alias("target_qualified"), F.col("file").alias("file_path"), "line").distinct()
