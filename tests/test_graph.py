"""Operators on small hand-made graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import scalars as S
from symloom.graph import CodeGraph
from symloom.operators import changes, communities, lookup, reach, resolve
from symloom.schema import compare_versions

NODE = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, params string, return_type string, modifiers string, is_test boolean, file_hash string, content_hash string, is_exported boolean, is_async boolean, decorators array<string>, throws array<string>, complexity int, ord long"
EDGE = "kind string, source_qualified string, target_qualified string, file_path string, line int, confidence double, tier string, alternatives array<string>"


def graph(spark, nodes, edges):
    """Nodes as (qualified_name, more), edges as (kind, source, target, confidence)."""
    rows = []
    for k, n in enumerate(nodes):
        q, more = n if isinstance(n, tuple) else (n, {})
        base = dict(kind="Function", name=q.split("::")[-1].split(".")[-1], qualified_name=q, file_path=q.split("::")[0], line_start=0, line_end=9, language="typescript", parent_name=None, params="()", return_type=None, modifiers=None, is_test=False, file_hash="h", content_hash="c", is_exported=None, is_async=None, decorators=None, throws=None, complexity=1, ord=k)
        rows.append(tuple((base | more)[f.split(" ")[0]] for f in NODE.split(", ")))
    links = [(e[0], e[1], e[2], e[1].split("::")[0], 1, e[3] if len(e) > 3 else None, None, None) for e in edges]
    return CodeGraph(spark.createDataFrame(rows, NODE), spark.createDataFrame(links, EDGE))


def names(spark, *q):
    return spark.createDataFrame([(x,) for x in q], "qualified_name string")


def blast(spark, g, *seeds, **more):
    return {r.qualified_name: (r.depth, round(r.confidence, 4), r.category) for r in reach.blast_radius(g, names(spark, *seeds), **more).collect()}


def test_blast_radius_levels_decay_and_limits(spark):
    g = graph(spark, ["a::f", "b::g", "c::h", "d::i"], [("CALLS", "b::g", "a::f", 0.9), ("CALLS", "c::h", "b::g", 0.8), ("CALLS", "d::i", "c::h", 0.4), ("INHERITS", "d::i", "b::g")])
    assert blast(spark, g, "a::f") == {"b::g": (1, 0.9, "behavior_affected"), "c::h": (2, 0.72, "transitive"), "d::i": (2, 0.81, "transitive")}
    assert set(blast(spark, g, "a::f", max_depth=1)) == {"b::g"}
    assert blast(spark, g, "a::f", contract_breaking=names(spark, "a::f"))["b::g"][2] == "contract_breaking"
    assert blast(spark, g) == {} and blast(spark, g, "nowhere") == {}


def test_blast_radius_better_path_later_keeps_depth(spark):
    g = graph(spark, ["s::s", "x::x", "y::y", "z::z"], [("CALLS", "x::x", "s::s", 0.5), ("CALLS", "y::y", "s::s", 0.95), ("CALLS", "x::x", "y::y", 0.95), ("CALLS", "z::z", "x::x", 1.0), ("CALLS", "s::s", "z::z", 1.0)])
    got = blast(spark, g, "s::s")
    assert got["x::x"] == (1, 0.9025, "behavior_affected") and got["z::z"][:2] == (2, 0.5) and "s::s" not in got


def test_blast_radius_skips_hidden_functions_of_other_files(spark):
    g = graph(spark, [("a::f", {"is_exported": False}), "a::g", "b::h"], [("CALLS", "a::g", "a::f", 1.0), ("CALLS", "b::h", "a::f", 1.0)])
    assert set(blast(spark, g, "a::f")) == {"a::g"}


@pytest.mark.parametrize("seed", [1, 2])
def test_blast_radius_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    q = [f"f{k}::n{k}" for k in range(25)]
    edges = [("CALLS", a, b, rng.choice([0.3, 0.5, 0.7, 0.9])) for a in q for b in rng.sample(q, 2) if a != b]
    adj: dict = {}
    for _, a, b, c in edges:
        if c >= 0.5:
            adj.setdefault(b, {})[a] = max(c, adj.get(b, {}).get(a, 0))
    best, frontier = {}, {q[0]: 1.0}
    for depth in (1, 2, 3):
        reached: dict = {}
        for n, acc in frontier.items():
            for m, c in adj.get(n, {}).items():
                if m != q[0]:
                    reached[m] = max(reached.get(m, 0), acc * c)
        frontier = {m: a for m, a in reached.items() if m not in best}
        for m, a in reached.items():
            best[m] = (best[m][0], max(best[m][1], a)) if m in best else (depth, a)
    got = {k: v[:2] for k, v in blast(spark, graph(spark, q, edges), q[0]).items()}
    assert got == {k: (d, round(a, 4)) for k, (d, a) in best.items()}


def test_flows_paths_and_overlap(spark):
    g = graph(spark, [("t::t", {"kind": "Test", "is_test": True}), ("c::C.get", {"kind": "Method", "name": "get"}), "a::f", "b::g"], [("CALLS", "t::t", "a::f", 1.0), ("CALLS", "a::f", "b::g", 1.0), ("CALLS", "c::C.get", "b::g", 1.0)])
    found = {r.entry: r for r in reach.flows(g, reach.flow_members(g, reach.entry_points(g)), with_path=True).collect()}
    assert (found["t::t"].depth, found["t::t"].node_count, found["t::t"].file_count, found["t::t"].criticality, found["t::t"].path) == (2, 3, 3, 9, ["t::t", "a::f", "b::g"])
    assert found["c::C.get"].type == "http" and set(r.entry for r in reach.entry_points(g, "test").collect()) == {"t::t"}
    assert [r.qualified_name for r in reach.shortest_path(g, "t::t", "b::g").collect()] == ["t::t", "a::f", "b::g"]
    assert reach.shortest_path(g, "b::g", "t::t").count() == 0 and reach.shortest_path(g, "a::f", "a::f").count() == 1
    over = {(r.relation, r.qualified_name) for r in reach.overlap(g, names(spark, "b::g"), names(spark, "a::f")).collect()}
    assert ("a_impacts_b", "a::f") in over and reach.overlap_level(reach.overlap(g, names(spark, "a::f"), names(spark, "a::f"))).first().level == "HIGH"


def test_diff_contracts_and_status(spark):
    old = graph(spark, [("a::f", {"params": "(a,  b)", "content_hash": "1"}), ("a::g", {"is_async": None}), "a::gone", ("a::k", {"params": "( a, b )"})], [("CALLS", "a::f", "a::g")])
    new = graph(spark, [("a::f", {"params": "(a, c)", "content_hash": "2"}), ("a::g", {"is_async": True}), "a::new", ("a::k", {"params": "(a, b)"})], [("CALLS", "a::g", "a::f")])
    assert {r.qualified_name: (r.status, sorted(r.changes)) for r in changes.diff_nodes(old, new).collect()} == {"a::f": ("modified", ["body", "params"]), "a::gone": ("removed", []), "a::new": ("added", [])}
    assert [tuple(r) for r in changes.diff_contracts(old, new).collect()] == [("a::f", "params", "(a,  b)", "(a, c)")]
    assert {(r.status, r.source_qualified) for r in changes.diff_edges(old, new).collect()} == {("added", "a::g"), ("removed", "a::f")}


def test_modularity_louvain_and_parts(spark):
    a, b = [f"x::a{k}" for k in range(4)], [f"y::b{k}" for k in range(4)]
    edges = [("CALLS", p, q) for s in (a, b) for p in s for q in s if p < q] + [("CALLS", a[0], b[0])]
    g = graph(spark, a + b, edges)
    w = communities.weighted_graph(g)
    for found in (communities.louvain(w), communities.louvain_exact(w)):
        of = {r.qualified_name: r.community for r in found.collect()}
        assert len({of[x] for x in a}) == len({of[x] for x in b}) == 1 and of[a[0]] != of[b[0]]
    assert communities.modularity(w, communities.louvain_exact(w), true_q=True).first().q > 0.3
    assert communities.connected_parts(w).select("part").distinct().count() == 1
    assert {r.qualified_name for r in communities.bridges(w, communities.louvain_exact(w), 2).collect()} == {a[0], b[0]}


def test_enclosing_function_is_the_innermost(spark):
    g = graph(spark, [("a::outer", {"line_end": 300}), ("a::inner", {"line_start": 100, "line_end": 200})], [])
    sites = spark.createDataFrame([(1, "a", 150), (2, "a", 250), (3, "a", 999), (4, "b", 1)], "site_id long, file_path string, line int")
    assert {r.site_id: r.source for r in changes.enclosing_function(g.nodes, sites).collect()} == {1: "a::inner", 2: "a::outer"}


def test_tiers_in_order(spark):
    g = graph(spark, [("a/x.ts::f", {}), ("b/y.ts::f", {}), ("b/y.ts::only", {}), ("b/y.ts::T.m", {"kind": "Method", "parent_name": "T"}), ("a/z.ts::h", {})], [])
    rows = [(1, "a/x.ts", "f", None), (2, "c/w.ts", "only", None), (3, "c/w.ts", "m", "T"), (4, "a/q.ts", "f", None), (5, "c/i.ts", "f", None), (6, "c/w.ts", "nothing", None), (7, "a/x.ts", "log", None)]
    sites = spark.createDataFrame([(i, f, "typescript", n, t, None, None) for i, f, n, t in rows], "site_id long, file string, language string, call_name string, receiver_type string, di_type string, resolve_in_class string")
    imported = spark.createDataFrame([("c/i.ts", "f", "b/y.ts")], "file string, name string, target_file string")
    noise = spark.createDataFrame([("typescript", "log")], "language string, name string")
    got = {r.site_id: (r.target, r.confidence, r.outcome) for r in resolve.resolve_calls(sites, resolve.symbol_table(g.nodes), imported, noise=noise).collect()}
    assert got == {1: ("a/x.ts::f", 0.85, "same"), 2: ("b/y.ts::only", 0.5, "unique"), 3: ("b/y.ts::T.m", 0.95, "receiver"), 4: ("a/x.ts::f", 0.3, "ambiguous"), 5: ("b/y.ts::f", 0.9, "import"), 6: (None, None, "external"), 7: (None, None, "noise")}


def test_injected_types_go_to_declared_or_usual_implementations(spark):
    g = graph(spark, [("a/repo.ts::Repo", {"kind": "Class"}), ("a/foo.java::FooImpl.run", {"kind": "Method"}), ("a/base.ts::Base.save", {"kind": "Method"})], [])
    rows = [(1, "a/s.ts", "typescript", "load", "Repo"), (2, "a/s.java", "java", "run", "Foo"), (3, "a/s.ts", "typescript", "save", "Repo")]
    sites = spark.createDataFrame([(i, f, lang, n, None, t, None) for i, f, lang, n, t in rows], "site_id long, file string, language string, call_name string, receiver_type string, di_type string, resolve_in_class string")
    none = spark.createDataFrame([], "file string, name string, target_file string")
    up = spark.createDataFrame([("Repo", "Base")], "name string, parent string")
    got = {r.site_id: (r.target, r.confidence, r.tier) for r in resolve.resolve_calls(sites, resolve.symbol_table(g.nodes), none, up).collect()}
    assert got == {1: ("a/repo.ts::Repo.load", 0.95, "di"), 2: ("a/foo.java::FooImpl.run", 0.9, "di"), 3: ("a/base.ts::Base.save", 0.9, "di")}


def test_scalars(spark):
    rows = spark.createDataFrame([("( a ,\n b, )", "a/user.test.ts", "Promise<Map<A, B>>")], "p string, f string, r string")
    got = rows.select(S.normalize_params("p").alias("p"), S.test_stem("f").alias("s"), resolve.strip_generics("r").alias("r"), S.camel_to_snake(F.lit("HTTPServerName")).alias("c")).first()
    assert tuple(got) == ("(a , b)", "user", "A", "http_server_name")
    assert S.tokenize_top_level("(a: Map<x, y>, b = [1, 2])") == ["a: Map<x, y>", "b = [1, 2]"]
    assert [compare_versions(v) for v in ("2.0", "3.0", "1.9", None)] == ["ok", "newer", "older", "missing"]


def test_search_and_coverage(spark):
    g = graph(spark, [("a::getUser", {}), ("a::User.load", {"kind": "Method"}), ("b::other", {})], [("TESTED_BY", "a::getUser", "t.ts"), ("INHERITS", "a::User", "b::Base")])
    assert {r.name for r in lookup.search(g, "*user*").collect()} == {"getUser", "load"} and {r.name for r in lookup.search(g, "/^get/").collect()} == {"getUser"}
    changed = spark.createDataFrame([("a",)], "file_path string")
    assert [r.qualified_name for r in lookup.test_gaps(g, changed).collect()] == ["a::User.load"]
    assert lookup.hierarchy_share(g, lookup.in_files(g, changed)).first().share == 0.5


def test_json_round_trip(spark, tmp_path):
    g = graph(spark, ["a::f", "b::g"], [("CALLS", "a::f", "b::g", 0.9)])
    g.save_json(str(tmp_path / "g.json"))
    back = CodeGraph.load_json(spark, str(tmp_path / "g.json"))
    assert back.nodes.count() == 2 and back.edges.first().confidence == 0.9
    (tmp_path / "n.json").write_text('{"metadata":{"schema_version":"9.0"},"nodes":[],"edges":[]}')
    with pytest.raises(ValueError):
        CodeGraph.load_json(spark, str(tmp_path / "n.json"))


def test_generics_are_taken_off(spark):
    cases = {"Promise<User>": "User", "User[]": "User", "Map<K, V>": "K", "Promise<Map<Array<A>, B>>": "A", "Optional[User]": "User", "a.b.Box<X>": "X", "plain": "plain", "Promise<void>": "void", "Box<Pair<A, B>, C>": "A"}
    rows = spark.createDataFrame(list(cases.items()), "r string, want string")
    assert all(x.got == x.want for x in rows.select("want", resolve.strip_generics("r").alias("got")).collect())


def test_fixed_values_of_names_and_signatures(spark):
    rows = spark.createDataFrame([("(__x: a, _1y)", "user-test.ts"), ("( _a: T,\n  _b )", "UserTests.java"), ("(a, [ _c ],)", "user_spec.rb"), ("(a: _Private)", "TestUser.java")], "p string, f string")
    got = [tuple(r) for r in rows.select(S.normalize_params("p"), S.test_stem("f")).collect()]
    assert got == [("(__x: a, _1y)", "user"), ("(a: T,b)", None), ("(a, [c])", "user"), ("(a: _Private)", None)]


def test_outline_keeps_what_is_known_to_be_exported(spark):
    def node(kind, name, lines, exported, parent=None):
        q = f"f.ts::{parent}.{name}" if parent else f"f.ts::{name}"
        return (kind, name, q, "f.ts", lines[0], lines[1], parent, exported)

    nodes = spark.createDataFrame(
        [node("Class", "Shown", (0, 9), True), node("Method", "a", (1, 2), True, "Shown"), node("Method", "b", (3, 4), None, "Shown"), node("Class", "Hidden", (10, 19), None), node("Method", "c", (11, 12), True, "Hidden"), node("Enum", "E", (20, 29), True), node("Method", "d", (21, 22), True, "E"), node("Function", "f", (30, 31), False), node("Function", "g", (32, 33), None), node("Function", "h", (34, 35), True, "Shown")],
        "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, parent_name string, is_exported boolean",
    )
    graph = CodeGraph(nodes, spark.createDataFrame([], "kind string, source_qualified string, target_qualified string"))
    found = {r.name: r.owner for r in changes.outline(graph, exported_only=True).collect()}
    assert found == {"Shown": None, "a": "f.ts::Shown", "E": None, "d": "f.ts::E", "h": None}
    assert {r.name for r in changes.outline(graph).collect()} == set("abcdfgh") | {"Shown", "Hidden", "E"}
