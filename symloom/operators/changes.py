"""Structural and contract diffs, merging, incremental classification, hunks, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normalize_params, normalize_return
from ..graph import CodeGraph, round2
from .lookup import hierarchy_share, in_files, test_gaps, tested_symbols

CONTRACT = ("params", "return_type", "modifiers", "is_async", "decorators", "throws")


def diff_nodes(old: CodeGraph, new: CodeGraph, changed: DataFrame | None = None) -> DataFrame:
    """(qualified_name, status, changes): added, removed or modified symbols, and what a modification touches."""
    keep = ("qualified_name", "file_path", "line_start", "line_end", "content_hash", *CONTRACT)
    sides = [(in_files(g, changed) if changed is not None else g.nodes).select(*keep).dropDuplicates(["qualified_name"]) for g in (old, new)]
    o, n = sides[0].alias("o"), sides[1].alias("n")
    both = o.join(n, "qualified_name", "full_outer")
    hashed = F.col("o.content_hash").isNotNull() & F.col("n.content_hash").isNotNull()
    size = lambda s: F.col(f"{s}.line_end") - F.col(f"{s}.line_start")
    changes = F.array_compact(F.array(
        F.when(hashed & (F.col("o.content_hash") != F.col("n.content_hash")), "body").when(~hashed & (size("o") != size("n")), "line_range"),
        *(F.when(c, k) for k, c in _contract_changes().items()),
    ))
    status = F.when(F.col("o.file_path").isNull(), "added").when(F.col("n.file_path").isNull(), "removed").when(F.size(changes) > 0, "modified")
    out = both.select("qualified_name", status.alias("status"), F.when(status == "modified", changes).otherwise(F.array().cast("array<string>")).alias("changes"))
    return out.filter("status IS NOT NULL")


def _contract_changes() -> dict[str, Column]:
    def text(side: str, c: str) -> Column:
        return F.coalesce(F.col(f"{side}.{c}"), F.lit(""))

    def known(c: str) -> Column:
        return F.col(f"o.{c}").isNotNull() & F.col(f"n.{c}").isNotNull()

    out = {
        "params": normalize_params(text("o", "params")) != normalize_params(text("n", "params")),
        "return_type": normalize_return(text("o", "return_type")) != normalize_return(text("n", "return_type")),
        "modifiers": text("o", "modifiers") != text("n", "modifiers"),
        "is_async": known("is_async") & (F.col("o.is_async") != F.col("n.is_async")),
    }
    for c in ("decorators", "throws"):
        out[c] = known(c) & (F.array_sort(F.col(f"o.{c}")) != F.array_sort(F.col(f"n.{c}")))
    return out


def diff_contracts(old: CodeGraph, new: CodeGraph, changed: DataFrame | None = None) -> DataFrame:
    """(qualified_name, field, old_value, new_value), one row for each changed part of a contract."""
    keep = ("qualified_name", *CONTRACT)
    sides = [(in_files(g, changed) if changed is not None else g.nodes).select(*keep).dropDuplicates(["qualified_name"]) for g in (old, new)]
    both = sides[0].alias("o").join(sides[1].alias("n"), "qualified_name")
    blank = {"params": "()", "return_type": "void"}

    def shown(side: str, c: str) -> Column:
        value = F.col(f"{side}.{c}")
        value = F.concat_ws(", ", F.array_sort(value)) if c in ("decorators", "throws") else value.cast("string")
        return F.when(value.isNull() | (value == ""), F.lit(blank.get(c, "(none)"))).otherwise(value)

    rows = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(c).alias("field"), shown("o", c).alias("old_value"), shown("n", c).alias("new_value"))) for c, test in _contract_changes().items())))
    return both.select("qualified_name", F.inline(rows))


def diff_edges(old: CodeGraph, new: CodeGraph, changed: DataFrame | None = None) -> DataFrame:
    """(status, kind, source_qualified, target_qualified): edges that one side has and the other has not."""
    key = ["kind", "source_qualified", "target_qualified"]
    marks = []
    for g, name in ((old, "was"), (new, "is")):
        rows = g.edges if changed is None else g.edges.join(changed.select("file_path").distinct(), "file_path", "left_semi")
        marks.append(rows.select(*key, F.lit(name).alias("side")))
    # One aggregation over both sides does for two anti-joins.
    sides = marks[0].union(marks[1]).groupBy(*key).agg(F.max((F.col("side") == "was").cast("int")).alias("was"), F.max((F.col("side") == "is").cast("int")).alias("is"))
    return sides.filter("was <> is").select(F.when(F.col("is") == 1, "added").otherwise("removed").alias("status"), *key)


def file_risk(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """(file_path, dependents, risk): distinct symbols outside the changed files that depend on a file's symbols."""
    files = changed.select("file_path").distinct()
    inner = in_files(graph, changed).select(F.col("qualified_name").alias("target_qualified"), F.col("file_path").alias("file"))
    edges = graph.of_kind("CALLS", "INHERITS", "IMPLEMENTS", "USES_TYPE").select("source_qualified", "target_qualified", "file_path")
    outer = edges.join(files, "file_path", "left_anti").join(inner, "target_qualified").groupBy(F.col("file").alias("file_path")).agg(F.count_distinct("source_qualified").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return files.join(outer, "file_path", "left").select("file_path", n.alias("dependents"), F.when(n >= 10, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW").alias("risk"))


def hunk_symbols(graph: CodeGraph, hunks: DataFrame, line_base: int = 0) -> DataFrame:
    """Symbols whose lines overlap a hunk (file, new_start, new_count) of their file."""
    spans = hunks.filter("new_count > 0").select(F.col("file").alias("file_path"), (F.col("new_start") - line_base).alias("lo"), (F.col("new_start") + F.col("new_count") - 1 - line_base).alias("hi")).distinct()
    hit = graph.nodes.join(spans, (graph.nodes["file_path"] == spans["file_path"]) & (F.col("line_start") <= F.col("hi")) & (F.col("line_end") >= F.col("lo")), "left_semi")
    return hit.select("qualified_name", "kind", "file_path", "line_start", "line_end")


def enclosing_function(nodes: DataFrame, sites: DataFrame, bin_size: int = 64) -> DataFrame:
    """``sites`` (site_id, file_path, line) with ``source``: the innermost function around each; others are dropped.

    Functions are dealt into bins of lines they cover, so that the join is an
    equi-join on file and bin even where one file holds very many functions.
    """
    scopes = nodes.filter(F.col("kind").isin("Function", "Method", "Constructor", "Test")).select("file_path", "qualified_name", "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / bin_size), F.floor(F.col("line_end") / bin_size))).alias("bin"))
    binned = sites.withColumn("bin", F.floor(F.col("line") / bin_size))
    near = binned.join(scopes, ["file_path", "bin"]).filter("line_start <= line AND line <= line_end")
    inner = near.groupBy("site_id").agg(F.max(F.struct("line_start", F.col("qualified_name").alias("q"))).alias("m"))
    return sites.join(inner, "site_id").select(*sites.columns, F.col("m.q").alias("source"))


def merge(main: CodeGraph, local: CodeGraph, changed: DataFrame) -> CodeGraph:
    """``local`` in place of what ``main`` has of the changed files."""
    files = changed.select("file_path").distinct()
    return CodeGraph(*(m.join(files, "file_path", "left_anti").unionByName(n, allowMissingColumns=True) for m, n in ((main.nodes, local.nodes), (main.edges, local.edges))))


def classify_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, status) from tables of (file_path, file_hash): added, modified, deleted or unchanged."""
    both = stored.select("file_path", F.col("file_hash").alias("old")).join(current.select("file_path", F.col("file_hash").alias("new")), "file_path", "full_outer")
    return both.select("file_path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged").alias("status"))


def file_status(graph: CodeGraph, current: DataFrame) -> DataFrame:
    """(file_path, status) of the graph's files: fresh, stale, deleted, or unknown without a stored hash."""
    stored = graph.nodes.groupBy("file_path").agg(F.max("file_hash").alias("old"))
    both = stored.join(current.select("file_path", F.col("file_hash").alias("new")), "file_path", "left")
    return both.select("file_path", F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "unknown").when(F.col("old") == F.col("new"), "fresh").otherwise("stale").alias("status"))


WEIGHTS = {"blast_radius": 0.35, "test_gaps": 0.30, "complexity": 0.20, "inheritance": 0.15}
CAPS = {"blast_functions": 20, "cyclomatic": 10, "lines_of_code": 50}


def risk_config(raw: dict) -> tuple[dict, dict]:
    """Weights and caps of a configuration; unknown keys are refused and weights have to sum to one."""
    unknown = (set(raw) - {"weights", "caps"}) | (set(raw.get("weights", {})) - set(WEIGHTS)) | (set(raw.get("caps", {})) - set(CAPS))
    if unknown:
        raise ValueError(f"unknown risk settings: {sorted(unknown)}")
    weights, caps = WEIGHTS | raw.get("weights", {}), CAPS | raw.get("caps", {})
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("risk weights have to sum to 1")
    return weights, caps


def risk_score(graph: CodeGraph, changed: DataFrame, blast_functions: int, weights: dict | None = None, caps: dict | None = None) -> DataFrame:
    """One row: the four factors, the score and its level; the level is taken before rounding."""
    weights, caps = weights or WEIGHTS, caps or CAPS
    nodes = in_files(graph, changed)
    code = nodes.filter(F.col("kind").isin("Function", "Method") & ~F.col("is_test"))
    rows = nodes.filter(F.col("kind").isin("Function", "Method", "Constructor")).agg(F.avg("complexity").alias("cc"), F.avg(F.col("line_end") - F.col("line_start")).alias("loc"))
    counts = code.agg(F.count(F.lit(1)).alias("functions")).join(test_gaps(graph, changed).agg(F.count(F.lit(1)).alias("untested"))).join(rows).join(hierarchy_share(graph, nodes))
    br = F.least(F.log1p(F.lit(float(blast_functions))) / F.log1p(F.lit(float(caps["blast_functions"]))), F.lit(1.0))
    tg = F.when(F.col("functions") > 0, F.col("untested") / F.col("functions")).otherwise(0.0)
    cx = F.coalesce(F.least(F.col("cc") / caps["cyclomatic"], F.lit(1.0)), F.least(F.col("loc") / caps["lines_of_code"], F.lit(1.0)), F.lit(0.0))
    total = weights["blast_radius"] * br + weights["test_gaps"] * tg + weights["complexity"] * cx + weights["inheritance"] * F.col("share")
    return counts.select(round2(br).alias("blast_radius"), round2(tg).alias("test_gaps"), round2(cx).alias("complexity"), round2(F.col("share")).alias("inheritance"), round2(total).alias("score"), F.when(total >= 0.6, "HIGH").when(total >= 0.3, "MEDIUM").otherwise("LOW").alias("level"))


def enriched_functions(graph: CodeGraph, changed: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Changed functions and methods with callers, callees, coverage and their display risk."""
    code = in_files(graph, changed).filter(F.col("kind").isin("Function", "Method")).select("qualified_name", "name", "file_path", "line_start", "line_end", "params", "return_type")
    calls = graph.of_kind("CALLS")
    callers = calls.filter(F.coalesce("confidence", F.lit(1.0)) >= min_confidence).groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count_distinct("source_qualified").alias("callers"))
    callees = calls.groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count_distinct("target_qualified").alias("callees"))
    tested = tested_symbols(graph)
    by_symbol = tested.filter("level = 'symbol'").select(F.col("name").alias("qualified_name"), F.lit(True).alias("ts"))
    by_file = tested.filter("level = 'file'").select(F.col("name").alias("file_path"), F.lit(True).alias("tf"))
    out = code.join(callers, "qualified_name", "left").join(callees, "qualified_name", "left").join(by_symbol, "qualified_name", "left").join(by_file, "file_path", "left")
    return out.select("qualified_name", "file_path", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), (F.col("ts").isNotNull() | F.col("tf").isNotNull()).alias("tested"), "line_start", "line_end")


def function_risk(rows: DataFrame, contract_changed: Column, modified: Column) -> Column:
    """Order of display: contract .3, callers .25, untested .2, modified .15, length .1."""
    return 0.3 * contract_changed.cast("int") + 0.25 * F.least(F.col("callers") / 10, F.lit(1.0)) + 0.2 * (~F.col("tested")).cast("int") + 0.15 * modified.cast("int") + 0.1 * F.least((F.col("line_end") - F.col("line_start")) / 100, F.lit(1.0))


def applicable_contracts(diffs: DataFrame, nodes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``diffs`` without parts that a symbol's language does not have; unknown languages keep all."""
    lang = nodes.select("qualified_name", "language").dropDuplicates(["qualified_name"]).join(F.broadcast(capabilities), "language", "left")
    keep = F.when(F.col("field") == "is_async", F.coalesce("has_async", F.lit(True))).when(F.col("field") == "throws", F.coalesce("has_exceptions", F.lit(True))).when(F.col("field") == "decorators", F.coalesce("has_decorators", F.lit(True))).otherwise(True)
    return diffs.join(lang, "qualified_name", "left").filter(keep).select(*diffs.columns)


def outline(graph: CodeGraph, exported_only: bool = False) -> DataFrame:
    """Symbols with the class of their file that holds them (by name and lines), and their calls in and out.

    ``exported_only``: symbols whose export is not known go as well; members stay with a holder that stays.
    """
    holders = graph.nodes.filter(F.col("kind").isin("Class", "Interface", "Enum")).select("file_path", F.col("name").alias("parent_name"), F.col("qualified_name").alias("owner"), F.col("line_start").alias("a"), F.col("line_end").alias("b"), F.coalesce("is_exported", F.lit(False)).alias("shown"))
    fits = F.col("kind").isin("Method", "Constructor") & (F.col("a") <= F.col("line_start")) & (F.col("line_end") <= F.col("b"))
    held = graph.nodes.join(holders, ["file_path", "parent_name"], "left")
    held = held.groupBy("qualified_name", "kind", "name", "file_path", "line_start", "line_end").agg(F.min(F.when(fits, F.struct("a", "b", "owner", "shown"))).alias("held"), F.max(F.coalesce("is_exported", F.lit(False))).alias("exported"))
    if exported_only:
        held = held.filter(F.col("exported") & F.coalesce("held.shown", F.lit(True)))
    held = held.select("qualified_name", "kind", "name", "file_path", "line_start", "line_end", F.col("held.owner").alias("owner"))
    calls = graph.of_kind("CALLS")
    fan = [calls.groupBy(F.col(c).alias("qualified_name")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("target_qualified", "fan_in"), ("source_qualified", "fan_out"))]
    return held.join(fan[0], "qualified_name", "left").join(fan[1], "qualified_name", "left").fillna(0, ["fan_in", "fan_out"])


def siblings(graph: CodeGraph) -> DataFrame:
    """(qualified_name, sibling): methods of one name in classes with the same parent class."""
    parents = graph.of_kind("INHERITS").select(F.col("source_qualified").alias("owner"), F.col("target_qualified").alias("parent"))
    methods = graph.nodes.filter("kind = 'Method'").select("qualified_name", "name", F.regexp_extract("qualified_name", r"^(.*::.*)(?:\.|::)[^.:]*$", 1).alias("owner"))
    rows = methods.join(parents, "owner")
    other = rows.select(F.col("qualified_name").alias("sibling"), "name", "parent", F.col("owner").alias("other"))
    return rows.join(other, ["name", "parent"]).filter("owner <> other").select("qualified_name", "sibling").distinct()


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")
