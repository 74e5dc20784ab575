"""Walks over whole parts against plain walks, with parts in one task and with all parts taken as large."""

import random

import numpy as np
import pytest

from symloom.operators import communities, parts, reach, walks

from .test_graph import graph, names


def _graph(spark, groups=3, size=14, seed=1):
    r = random.Random(seed)
    nodes, edges = [], []
    for p in range(groups):
        own = [f"f{r.randrange(5)}::g{p}n{k}" for k in range(size)]
        nodes += [(q, {"kind": "Test", "is_test": True} if k < 3 else {"kind": "Method", "name": "get"} if k == 5 else {}) for k, q in enumerate(own)]
        edges += [("CALLS", r.choice(own), r.choice(own), 1.0) for _ in range(size * 3 // 2)] + [("CALLS", own[4], f"x::unknown{p}", 1.0)]
    nodes.append(("z::alone", {"kind": "Test", "is_test": True}))
    return graph(spark, nodes, edges + edges[:3]), {q for q, _ in nodes}, [(a, b) for _, a, b, _ in edges]


def _plain(known, edges, entry, max_depth):
    seen, front, depth = {entry}, {entry}, 0
    for d in range(1, max_depth + 1):
        front = {b for a, b in edges if a in front} - seen
        if not front:
            break
        seen, depth = seen | front, d
    return depth, seen, len({n.split("::")[0] for n in seen & known})


@pytest.fixture(params=[False, True], ids=["one task", "large"])
def large(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(parts, "LARGE", 0)
        monkeypatch.setattr(reach, "BLOCKS", 1)
        monkeypatch.setattr(communities, "MOST", 0)
    else:
        monkeypatch.setattr(reach, "_levels", lambda *a: pytest.fail("parts that fit a task walk by joins"))
    return request.param


def test_forest_over_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(parts, "CHUNK", 7)
    r = np.random.default_rng(7)
    x, y = r.integers(-90, 90, (2, 120))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 5]), pa.array(y[k : k + 5])], ["a", "b"]) for k in range(0, 120, 5)]
    got = {a: b for out in parts._span(iter(batches)) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    label = {int(v): int(v) for v in [*x, *y]}
    for _ in label:
        for a, b in zip(x.tolist(), y.tolist()):
            label[a] = label[b] = min(label[a], label[b])
    linked = {int(v) for a, b in zip(x, y) if a != b for v in (a, b)}
    assert {k: v for k, v in label.items() if k in linked} == {k: v for k, v in got.items() if k in linked}


def test_affected_flows_walk_back_once(spark, monkeypatch):
    monkeypatch.setattr(reach, "_levels", lambda *a: pytest.fail("a walk of all entries"))
    g, known, edges = _graph(spark, seed=3)
    for max_depth in (2, 10):
        for hit in (sorted(known)[7], edges[0][1]):
            got = {r.entry for r in reach.affected_flows(g, reach.flow_members(g, reach.entry_points(g), max_depth), names(spark, hit)).collect()}
            is_test = {r[0] for r in g.nodes.filter("is_test").select("qualified_name").collect()}
            assert got == ({e.entry for e in reach.entry_points(g).collect() if hit in _plain(known, edges, e.entry, max_depth)[1]} if hit not in is_test else set())


@pytest.mark.parametrize("max_depth", [2, 10])
def test_scores_of_parts(spark, large, max_depth):
    g, known, edges = _graph(spark, seed=4)
    members = reach.flow_members(g, reach.entry_points(g), max_depth)
    found = {(e.entry, e.type): _plain(known, edges, e.entry, max_depth) for e in reach.entry_points(g).collect()}
    limit = max(1, *(len(s) * f for _, s, f in found.values()))
    blast = names(spark, *sorted(known)).selectExpr("qualified_name", "0.9D AS confidence")
    for r in reach.score_blast(blast, members, reach.flows(g, members)).collect():
        most = {t: max((len(s) * f for (_, kind), (_, s, f) in found.items() if kind == t and r.qualified_name in s), default=None) for t in ("http", "test")}
        weight = most["http"] / limit if most["http"] is not None else 0.3 * (most["test"] / limit) if most["test"] is not None else 0.1
        assert r.impact_score == int(0.9 * weight * 100 + 0.5) / 100


@pytest.mark.parametrize("max_depth", [2, 10])
def test_flows_of_parts(spark, large, max_depth):
    g, known, edges = _graph(spark)
    entries = reach.entry_points(g).collect()
    got = {(r.entry, r.type): (r.depth, r.node_count, r.file_count) for r in reach.flows(g, reach.flow_members(g, reach.entry_points(g), max_depth)).collect()}
    plain = {(e.entry, e.type): _plain(known, edges, e.entry, max_depth) for e in entries}
    assert len(got) == len(entries) and got == {k: (d, len(s), f) for k, (d, s, f) in plain.items()}


def test_communities_of_numbered_nodes(spark, large, monkeypatch):
    g, _, _ = _graph(spark, groups=4, size=20, seed=6)
    weights = communities.weighted_graph(g)
    whole = communities.connected_parts(weights, communities.louvain(weights)).collect()
    sizes = [r.part for r in whole]
    if not large:
        monkeypatch.setattr(communities, "louvain", lambda *a: pytest.fail("numbered nodes move by joins"))
    got = {(r.qualified_name, r.community) for r in communities.topological_communities(g, 2).collect()}
    assert got and got == {(r.qualified_name, r.part) for r in whole if sizes.count(r.part) >= 2}


def test_flow_summary_of_parts(spark, large):
    g, known, edges = _graph(spark, seed=2)
    plain = [_plain(known, edges, e.entry, 10) for e in reach.entry_points(g).collect()]
    got = reach.flow_summary(reach.flows(g, reach.flow_members(g, reach.entry_points(g)))).first()
    assert (got.total_flows, got.max_criticality, got.avg_depth) == (len(plain), max(len(s) * f for _, s, f in plain), int(sum(d for d, _, _ in plain) / len(plain) * 10 + 0.5) / 10)


def test_modularity_from_edges(spark):
    g, _, _ = _graph(spark, seed=5)
    for cut in (1, 2):
        members = communities.directory_of("file_path", cut)
        members = g.known().select("qualified_name", members.alias("community"))
        assert communities.adjacent_modularity(g, members).first().q == pytest.approx(communities.modularity(communities.weighted_graph(g), members).first().q, abs=1e-12)
    assert communities.adjacent_modularity(graph(spark, ["a::a"], []), names(spark, "a::a").selectExpr("qualified_name", "'c' AS community")).first().q == 0


@pytest.mark.parametrize("max_depth", [2, 10])
def test_large_parts_go_to_groups_of_entries(spark, monkeypatch, max_depth):
    monkeypatch.setattr(parts, "LARGE", 10)
    monkeypatch.setattr(walks, "BLOCK_EDGES", 7)
    monkeypatch.setattr(reach, "_levels", lambda *a: pytest.fail("numbered nodes walk by joins"))
    g, known, edges = _graph(spark, groups=2, size=40, seed=8)
    members = reach.flow_members(g, reach.entry_points(g), max_depth)
    flows = reach.flows(g, members)
    assert members.large
    plain = {(e.entry, e.type): _plain(known, edges, e.entry, max_depth) for e in reach.entry_points(g).collect()}
    assert {(r.entry, r.type): (r.depth, r.node_count, r.file_count) for r in flows.collect()} == {k: (d, len(s), f) for k, (d, s, f) in plain.items()}


@pytest.mark.parametrize("max_depth", [2, 10])
def test_scores_of_large_parts_come_in_rounds_over_blocks(spark, monkeypatch, max_depth):
    monkeypatch.setattr(parts, "LARGE", 10)
    monkeypatch.setattr(walks, "BLOCK_EDGES", 7)
    g, known, edges = _graph(spark, groups=2, size=20, seed=9)
    members = reach.flow_members(g, reach.entry_points(g), max_depth)
    monkeypatch.setattr(reach, "_levels", lambda *a: pytest.fail("numbered nodes walk by joins"))
    plain = {(e.entry, e.type): _plain(known, edges, e.entry, max_depth) for e in reach.entry_points(g).collect()}
    asked = names(spark, *sorted(known)).select(parts.hashed("qualified_name", members.seed).alias("h"), "qualified_name")
    weights = spark.createDataFrame([(*k, len(s) * f) for k, (_, s, f) in plain.items()], "entry string, type string, criticality long").select(parts.hashed("entry", members.seed).alias("h"), "type", "criticality")
    got = {r.qualified_name: (r.http, r.test) for r in reach._most_critical(members, weights, asked.select("h")).join(asked, "h", "right").collect()}
    assert members.large
    assert got == {q: tuple(max((len(s) * f for (_, t), (_, s, f) in plain.items() if t == kind and q in s), default=None) for kind in ("http", "test")) for q in known}
