"""Resolution of calls, types and imports: first match wins, written as joins and one ``coalesce``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import directory
from ..plans.scratch import cut


def symbol_table(nodes: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(file, name, qualified, ord) of functions, classes and interfaces; a baseline adds its files that are not in ``nodes``."""
    def rows(df: DataFrame, *kinds: str) -> DataFrame:
        return df.filter(F.col("kind").isin(*kinds)).select(F.col("file_path").alias("file"), "name", F.col("qualified_name").alias("qualified"), "ord")

    out = rows(nodes, "Function", "Method", "Constructor", "Class", "Interface")
    if baseline is not None:
        rest = baseline.join(nodes.select("file_path").distinct(), "file_path", "left_anti")
        out = out.unionByName(rows(rest, "Function", "Method", "Constructor", "Class", "Interface", "Enum"))
    return out


def exact(symbols: DataFrame) -> DataFrame:
    """(file, name, qualified) of names that a file defines once."""
    return symbols.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified").alias("qualified")).filter("n = 1").drop("n")


def name_stats(symbols: DataFrame) -> DataFrame:
    """(name, definitions, files)."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct("file").alias("files"))


def _prefixes(path: str) -> Column:
    """Leading parts of a file's directory with their number: from (0, '') to the whole."""
    parts = F.split(directory(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix")))


def closest(wanted: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct (file, keys) of ``wanted`` the nearest of ``candidates``, with how many there are.

    Nearest: in the same directory, else with most leading path parts in common, the first in order among equals.
    Candidates are reduced to the first one under each leading path, and each file asks for its own leading paths:
    rows grow with the depth of directories, never with files times definitions of a name.
    """
    first = F.min(F.struct("ord", "qualified", F.col("file").alias("def_file"))).alias("m")
    every = cut(candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("only")))
    asked = cut(wanted.select("file", *keys).distinct().join(every, keys))
    out = asked.filter("n = 1").select("file", *keys, F.col("only").alias("m"), "n")
    several = asked.filter("n > 1").select("file", *keys, "n")
    if not several.isEmpty():
        crowd = candidates.join(every.filter("n > 1").select(*keys), keys, "left_semi")
        here = crowd.groupBy(*keys, directory("file").alias("dir")).agg(first)
        under = crowd.withColumn("p", F.explode(_prefixes("file"))).groupBy(*keys, F.col("p.depth").alias("depth"), F.col("p.prefix").alias("prefix")).agg(first)
        beside = several.withColumn("dir", directory("file")).join(here, [*keys, "dir"]).select("file", *keys, "n", F.lit(1 << 20).alias("depth"), "m")
        along = several.withColumn("p", F.explode(_prefixes("file"))).select("file", *keys, "n", F.col("p.depth").alias("depth"), F.col("p.prefix").alias("prefix")).join(under, [*keys, "depth", "prefix"]).select("file", *keys, "n", "depth", "m")
        out = out.union(beside.union(along).groupBy("file", *keys).agg(F.max_by("m", "depth").alias("m"), F.max("n").alias("n")))
    return out.select("file", *keys, F.col("m.qualified").alias("target"), F.col("m.def_file").alias("target_file"), "n")


def everyone(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, every): all candidates of keys that have several, sorted; joined once outcomes are known, as it is wide."""
    return candidates.groupBy(*keys).agg(F.sort_array(F.collect_set("qualified")).alias("every")).filter(F.size("every") > 1)


def members(symbols: DataFrame) -> DataFrame:
    """Symbols named ``file::Type.name`` by (type, name)."""
    owner = F.regexp_extract("qualified", r"::(?:.*\.)?([^.:]+)\.[^.:]+$", 1)
    return symbols.withColumn("type", owner).filter("type <> ''")


def ancestors(hierarchy: DataFrame, levels: int = 8) -> DataFrame:
    """(type, ancestor, level) of (name, parent) rows, at most ``levels`` up."""
    up = cut(hierarchy.select(F.col("name").alias("type"), F.col("parent").alias("ancestor")).distinct())
    step = up.toDF("ancestor", "next")
    frontier = up.withColumn("level", F.lit(1))
    out = frontier
    for level in range(2, levels + 1):
        frontier = cut(frontier.join(step, "ancestor").select("type", F.col("next").alias("ancestor"), F.lit(level).alias("level")).distinct())
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out.filter("type <> ancestor").groupBy("type", "ancestor").agg(F.min("level").alias("level"))


def _found(target: str, confidence: Column | float, tier: str) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(F.col(target).isNotNull(), F.struct(F.col(target).alias("target"), conf.cast("double").alias("confidence"), F.lit(tier).alias("tier")))


def implementation_names(language: str, type_: str) -> Column:
    """Names under which an injected interface is usually implemented, in order."""
    t, lang = F.col(type_), F.col(language)
    none = F.array().cast("array<string>")
    prefixed = F.when(t.rlike("^I[A-Z]"), F.array(F.substring(t, 2, 1000))).otherwise(none)
    stem = F.when(t.endswith("er"), F.array(F.regexp_replace(t, "er$", ""), F.concat(F.lit("Default"), t))).otherwise(F.array(F.concat(F.lit("Default"), t)))
    return F.when(lang.isin("typescript", "tsx", "javascript", "csharp"), prefixed).when(lang.isin("java", "kotlin", "scala", "php"), F.array(F.concat(t, F.lit("Impl")), F.concat(F.lit("Default"), t))).when(lang == "go", stem).otherwise(none)


def injected(sites: DataFrame, symbols: DataFrame, owned: DataFrame) -> DataFrame:
    """(file, di_type, call_name, di_guess, di_impl): the method by name in the nearest file that has the type, else in a usual implementation."""
    wanted = sites.filter("di_type IS NOT NULL").select("file", "language", "di_type", "call_name").distinct()
    home = closest(wanted.select("file", F.col("di_type").alias("name")), symbols, ["name"]).select("file", F.col("name").alias("di_type"), "target_file")
    tries = wanted.select("file", "di_type", "call_name", F.posexplode(implementation_names("language", "di_type")).alias("k", "type"))
    impl = tries.join(owned.select("type", F.col("name").alias("call_name"), "qualified", "ord"), ["type", "call_name"]).groupBy("file", "di_type", "call_name").agg(F.min(F.struct("k", "ord", "qualified")).alias("m"))
    out = wanted.select("file", "di_type", "call_name").distinct().join(home, ["file", "di_type"], "left").join(impl, ["file", "di_type", "call_name"], "left")
    guess = F.when(F.col("target_file").isNotNull(), F.concat("target_file", F.lit("::"), "di_type", F.lit("."), "call_name"))
    return out.select("file", "di_type", "call_name", guess.alias("di_guess"), F.col("m.qualified").alias("di_impl"))


def resolve_calls(sites: DataFrame, symbols: DataFrame, import_map: DataFrame, hierarchy: DataFrame | None = None, noise: DataFrame | None = None) -> DataFrame:
    """``sites`` with target, confidence, tier, alternatives and outcome.

    ``sites``: site_id, file, language, call_name, receiver_type, di_type, resolve_in_class (the last three may be
    null). ``import_map``: (file, name, target_file). ``noise``: (language, name). The order is receiver, injected
    type, noise (drops), own class, imported, same file, unique, ambiguous. Names that too many files define are
    dropped before their candidates are looked at, so a frequent name never multiplies its call sites.
    """
    symbols = cut(symbols)
    owned, one, stats = members(symbols), exact(symbols), name_stats(symbols)
    total = symbols.agg(F.count_distinct("file")).first()[0]
    crowded = max(15, -(-total // 50))

    def typed(column: str, prefix: str) -> DataFrame:
        wanted = sites.filter(F.col(column).isNotNull()).select("file", F.col(column).alias("type"), F.col("call_name").alias("name"))
        near = closest(wanted, owned, ["type", "name"])
        return near.select("file", F.col("type").alias(column), F.col("name").alias("call_name"), F.col("target").alias(f"{prefix}_target"), F.col("n").alias(f"{prefix}_n"))

    def inherited(column: str, prefix: str) -> DataFrame:
        wanted = sites.filter(F.col(column).isNotNull()).select("file", F.col(column).alias("own"), F.col("call_name").alias("name")).distinct()
        up = ancestors(hierarchy).select(F.col("type").alias("own"), F.col("ancestor").alias("type"), "level")
        hit = wanted.join(up, "own").join(owned.select("type", "name", "qualified", "ord"), ["type", "name"])
        best = hit.groupBy("file", "own", "name").agg(F.min(F.struct("level", "ord", "qualified")).alias("m"))
        return best.select("file", F.col("own").alias(column), F.col("name").alias("call_name"), F.col("m.qualified").alias(f"{prefix}_up"))

    out = sites.join(typed("receiver_type", "rc"), ["file", "receiver_type", "call_name"], "left").join(typed("di_type", "di"), ["file", "di_type", "call_name"], "left").join(typed("resolve_in_class", "cl"), ["file", "resolve_in_class", "call_name"], "left")
    out = out.join(injected(sites, symbols, owned), ["file", "di_type", "call_name"], "left")
    if hierarchy is not None:
        out = out.join(inherited("di_type", "di"), ["file", "di_type", "call_name"], "left").join(inherited("receiver_type", "rc"), ["file", "receiver_type", "call_name"], "left").join(inherited("resolve_in_class", "cl"), ["file", "resolve_in_class", "call_name"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("rc_up", "cl_up", "di_up")})
    if noise is not None:
        out = out.join(F.broadcast(noise.select("language", F.col("name").alias("call_name")).distinct().withColumn("noisy", F.lit(True))), ["language", "call_name"], "left")
    else:
        out = out.withColumn("noisy", F.lit(None).cast("boolean"))
    imported = import_map.select("file", F.col("name").alias("call_name"), "target_file")
    there = one.select(F.col("file").alias("target_file"), F.col("name").alias("call_name"), F.col("qualified").alias("im_exact"))
    out = out.join(imported, ["file", "call_name"], "left").join(there, ["target_file", "call_name"], "left")
    out = out.join(one.select("file", F.col("name").alias("call_name"), F.col("qualified").alias("sf_target")), ["file", "call_name"], "left")
    few = stats.filter((F.col("definitions") == 1) | (F.col("files") < crowded)).select(F.col("name"))
    usable = symbols.join(few, "name", "left_semi")
    near = closest(sites.select("file", F.col("call_name").alias("name")), usable, ["name"]).select("file", F.col("name").alias("call_name"), F.col("target").alias("g_target"), F.col("target_file").alias("g_file"), F.col("n").alias("g_n"))
    out = out.join(near, ["file", "call_name"], "left").join(stats.select(F.col("name").alias("call_name"), "definitions"), "call_name", "left")
    guess = F.when(F.col("target_file").isNotNull(), F.concat_ws("::", "target_file", "call_name"))
    out = out.withColumn("im_guess", guess).withColumn("cl_in_file", F.when(F.col("cl_target").startswith(F.concat(F.col("file"), F.lit("::"))), F.col("cl_target")))
    quiet = F.coalesce("noisy", F.lit(False))
    cascade = [
        _found("cl_in_file", 0.9, "same"), _found("cl_target", 0.85, "import"), _found("cl_up", 0.85, "same"), _found("im_exact", 0.9, "import"), _found("im_guess", 0.7, "import"), _found("sf_target", 0.85, "same"),
        F.when(F.col("g_n") == 1, _found("g_target", F.when(F.col("g_file").startswith(F.concat(directory("file"), F.lit("/"))), 0.6).otherwise(0.5), "unique")),
        F.when(F.col("g_n") > 1, _found("g_target", 0.3, "ambiguous")),
    ]
    found = F.coalesce(_found("rc_target", F.when(F.col("rc_n") == 1, 0.95).otherwise(0.9), "receiver"), _found("rc_up", 0.85, "receiver"), _found("di_target", 0.95, "di"), _found("di_up", 0.9, "di"), _found("di_impl", 0.9, "di"), _found("di_guess", 0.95, "di"), F.when(~quiet, F.coalesce(*cascade)))
    out = out.withColumn("r", found)
    outcome = F.when(F.col("r").isNotNull(), F.col("r.tier")).when(quiet, "noise").when(F.col("definitions") > 1, "too_common").otherwise("external")
    out = out.select(*sites.columns, "r.target", "r.confidence", "r.tier", outcome.alias("outcome"), F.when(F.col("r.tier") == "ambiguous", F.col("call_name")).alias("g_of"), F.when((F.col("r.target") == F.col("rc_target")) & (F.col("rc_n") > 1), F.col("receiver_type")).alias("rc_of"))
    out = out.join(everyone(usable, ["name"]).select(F.col("name").alias("g_of"), F.col("every").alias("g_every")), "g_of", "left")
    out = out.join(everyone(owned, ["type", "name"]).select(F.col("type").alias("rc_of"), F.col("name").alias("call_name"), F.col("every").alias("rc_every")), ["rc_of", "call_name"], "left")
    others = F.array_except(F.coalesce("g_every", "rc_every"), F.array("target"))
    return out.select(*sites.columns, "target", "confidence", "tier", F.when(F.size(others) > 0, others).alias("alternatives"), "outcome")


def tier_distribution(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


#: Names of methods that usually give an instance of the type they are called on.
FACTORIES = ("getInstance", "instance", "Instance", "default", "Default", "getDefault", "shared", "Shared", "newInstance", "create", "of")


def returned_types(nodes: DataFrame) -> DataFrame:
    """(qualified, type): what functions return by their signatures, wrappers taken off; the last node of a name counts."""
    last = nodes.filter("return_type IS NOT NULL").groupBy(F.col("qualified_name").alias("qualified")).agg(F.max_by("return_type", "ord").alias("return_type"))
    return last.select("qualified", strip_generics("return_type").alias("type"))


def callee_types(wanted: DataFrame, symbols: DataFrame, import_map: DataFrame, results: DataFrame) -> DataFrame:
    """``wanted`` (file, callee) with ``type``: what the function of the same file, an imported one, or the only one of that name returns."""
    one = exact(symbols).select(F.col("file").alias("place"), F.col("name").alias("callee"), "qualified")
    only = symbols.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min("qualified").alias("only")).filter("n = 1").drop("n")
    out = wanted.select("file", "callee").distinct()
    out = out.join(one.select(F.col("place").alias("file"), "callee", F.col("qualified").alias("here")), ["file", "callee"], "left")
    out = out.join(import_map.select("file", F.col("name").alias("callee"), F.col("target_file").alias("place")), ["file", "callee"], "left")
    out = out.join(one.select("place", "callee", F.col("qualified").alias("there")), ["place", "callee"], "left").join(only, "callee", "left")
    guess = F.when(F.col("place").isNotNull(), F.coalesce("there", F.concat_ws("::", "place", "callee")))
    return out.select("file", "callee", F.coalesce("here", guess, "only").alias("qualified")).join(results, "qualified", "left").select("file", "callee", "type")


def deferred_receivers(sites: DataFrame, symbols: DataFrame, import_map: DataFrame, values: DataFrame, results: DataFrame) -> DataFrame:
    """``sites`` (with receiver_call, receiver_import) whose missing receiver types come from what a callee returns or an imported value holds.

    ``values``: (file, name, type, callee) of each file's own variables; a variable that holds a call's result is
    followed once, in the file that declares it.
    """
    held = sites.filter("receiver_type IS NULL AND receiver_import IS NOT NULL").select("file", F.col("receiver_import").alias("name")).distinct()
    held = held.join(import_map.select("file", "name", "target_file"), ["file", "name"]).join(values.select(F.col("file").alias("target_file"), "name", "type", "callee"), ["target_file", "name"])
    held = cut(held)
    asked = sites.filter("receiver_type IS NULL AND receiver_call IS NOT NULL").select("file", F.col("receiver_call").alias("callee"))
    made = cut(callee_types(asked.union(held.filter("type IS NULL AND callee IS NOT NULL").select(F.col("target_file").alias("file"), "callee")), symbols, import_map, results))
    of_value = held.join(made.select(F.col("file").alias("target_file"), "callee", F.col("type").alias("made")), ["target_file", "callee"], "left")
    of_value = of_value.select("file", F.col("name").alias("receiver_import"), F.coalesce("type", "made").alias("imported_type"))
    of_call = made.select("file", F.col("callee").alias("receiver_call"), F.col("type").alias("called_type"))
    out = sites.join(of_call, ["file", "receiver_call"], "left").join(of_value, ["file", "receiver_import"], "left")
    return out.select(*(F.coalesce("receiver_type", "called_type", "imported_type").alias(c) if c == "receiver_type" else c for c in sites.columns))


def chained_calls(resolved: DataFrame, results: DataFrame, again) -> DataFrame:
    """``resolved`` after calls made on another call's value were resolved once more with the type that call returns.

    ``resolved``: what ``resolve_calls`` gives for sites with line, col, chained_line, chained_col. A factory of the
    fixed names without a declared type gives its own receiver's type. ``again`` resolves sites; only outcomes of the
    receiver tier count, and calls that have one already keep it.
    """
    base = [c for c in resolved.columns if c not in ("target", "confidence", "tier", "alternatives", "outcome")]
    inner = resolved.filter("target IS NOT NULL").groupBy("file", F.col("line").alias("chained_line"), F.col("col").alias("chained_col")).agg(F.min_by(F.struct("target", "call_name", "receiver_type"), "site_id").alias("inner"))
    typed = inner.join(results.select(F.col("qualified").alias("returns_of"), "type"), F.col("inner.target") == F.col("returns_of"), "left")
    typed = typed.select("file", "chained_line", "chained_col", F.coalesce("type", F.when(F.col("inner.call_name").isin(*FACTORIES), F.col("inner.receiver_type"))).alias("chain_type")).filter("chain_type IS NOT NULL")
    outer = resolved.filter("chained_line IS NOT NULL AND coalesce(tier, '') <> 'receiver'").select(*base)
    outer = cut(outer.join(typed, ["file", "chained_line", "chained_col"]).withColumn("receiver_type", F.col("chain_type")).select(*base))
    if outer.isEmpty():
        return resolved
    better = cut(again(outer).filter("tier = 'receiver'"))
    return resolved.join(better.select("site_id"), "site_id", "left_anti").select(*resolved.columns).union(better.select(*resolved.columns))


def strip_generics(column: str, rounds: int = 4) -> Column:
    """``T[]`` to T and ``W<A, B>`` or ``W[A, B]`` to its first argument, nested ``rounds`` deep."""
    c = F.trim(F.col(column))
    for _ in range(rounds):
        c = F.regexp_replace(c, r"\[\]$", "")
        inside = F.regexp_extract(c, r"^[\w.]+[<\[]\s*(.*)[>\]]$", 1)
        first = F.trim(F.regexp_extract(inside, r"^((?:[^,<>\[\]]+|[<\[].*[>\]])+)", 1))
        c = F.when(first != "", first).otherwise(c)
    return c


def resolve_types(wanted: DataFrame, nodes: DataFrame, import_map: DataFrame) -> DataFrame:
    """``wanted`` (file, name) with ``resolved``: an imported type, one of the file (class before interface), or the only one of its name."""
    types = nodes.filter(F.col("kind").isin("Class", "Interface", "Enum")).select(F.col("file_path").alias("file"), "name", F.col("qualified_name").alias("q"), "kind", "ord")
    own = types.groupBy("file", "name").agg(F.min(F.struct((F.col("kind") != "Class").cast("int").alias("k"), "ord", "q")).alias("m")).select("file", "name", F.col("m.q").alias("own"))
    only = types.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("only")).filter("n = 1").drop("n")
    there = own.select(F.col("file").alias("target_file"), "name", F.col("own").alias("imported"))
    out = wanted.join(import_map.select("file", "name", "target_file"), ["file", "name"], "left").join(there, ["target_file", "name"], "left").join(own, ["file", "name"], "left").join(only, "name", "left")
    return out.select(*wanted.columns, F.when(F.col("target_file").isNotNull(), F.col("imported")).otherwise(F.coalesce("own", "only")).alias("resolved"))


def re_export_map(re_exports: DataFrame) -> DataFrame:
    """(file, target): where a barrel's names come from, through one barrel more."""
    direct = re_exports.select("file", "target").filter("target IS NOT NULL AND file <> target").distinct()
    through = direct.alias("a").join(direct.alias("b"), F.col("a.target") == F.col("b.file")).select(F.col("a.file").alias("file"), F.col("b.target").alias("target"))
    return direct.union(through).filter("file <> target").distinct()


def import_map(imports: DataFrame, symbols: DataFrame, barrels: DataFrame) -> DataFrame:
    """(file, name, target_file) of imports (file, target, names, ord): through barrels to the file that defines the name; the last import wins."""
    names = imports.select("file", "target", "ord", F.explode("names").alias("name"))
    one = exact(symbols).select(F.col("file").alias("place"), "name").withColumn("defines", F.lit(1))
    places = names.select("file", "ord", "name", "target", F.col("target").alias("place"), F.lit(0).alias("far"))
    places = places.union(names.join(barrels.select(F.col("file").alias("target"), F.col("target").alias("place")), "target").select("file", "ord", "name", "target", "place", F.lit(1)))
    hit = places.join(one, ["place", "name"], "left").groupBy("file", "ord", "name", "target").agg(F.min(F.when(F.col("defines") == 1, F.struct("far", "place"))).alias("m"))
    last = Window.partitionBy("file", "name").orderBy(F.desc("ord"))
    return hit.select("file", "ord", "name", F.coalesce("m.place", "target").alias("target_file")).withColumn("r", F.row_number().over(last)).filter("r = 1").select("file", "name", "target_file")


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``candidates`` (id, paths in order) with ``target``: the first path that is a file."""
    tried = candidates.select("id", F.posexplode("paths").alias("k", "file_path"))
    hit = tried.join(files.select("file_path").distinct(), "file_path").groupBy("id").agg(F.min(F.struct("k", "file_path")).alias("m"))
    return candidates.join(hit, "id", "left").select("id", F.col("m.file_path").alias("target"))
