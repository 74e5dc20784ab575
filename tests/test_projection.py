"""Registered graph queries on small tables, against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from symloom.plans import queries
from symloom.plans.projection import project

CUSTOMERS = [1, 2, 3, 4, 5, 6, 7, 10]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Customer k buys parts k and k + 1, so parts call each other in a chain; customer 10 is a test and buys part 1."""
    folder = tmp_path_factory.mktemp("tables")
    lines = [(k, p, 1, p - k, float(3 + k)) for k in range(1, 8) for p in (k, k + 1)] + [(7, 8, 2, 2, 9.0), (10, 1, 1, 0, 1.0)]
    made = {
        "region": ([(0, "A")], "r_regionkey long, r_name string"),
        "nation": ([(0, 0, "N")], "n_nationkey long, n_regionkey long, n_name string"),
        "customer": ([(k, 0) for k in CUSTOMERS], "c_custkey long, c_nationkey long"),
        "supplier": ([(1, 0), (2, 0)], "s_suppkey long, s_nationkey long"),
        "part": ([(p, "T", "Brand#11") for p in range(1, 9)], "p_partkey long, p_type string, p_brand string"),
        "orders": ([(k, k) for k in CUSTOMERS], "o_orderkey long, o_custkey long"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), lines


def test_every_line_item_becomes_edges(spark, tables):
    folder, lines = tables
    pairs = {(r.source_qualified.split("::")[1], r.target_qualified.split("::")[1]) for r in project(spark, folder).of_kind("CALLS").collect()}
    bought = {(f"C{c}", f"T.P{p}") for c, p, _, _, _ in lines}
    supplied = {(f"T.P{p}", f"S{s}") for _, p, s, _, _ in lines}
    assert pairs == bought | supplied | {(f"T.P{k}", f"T.P{k + 1}") for k in range(1, 8)}


def walked(edges, start, depth):
    """Fewest steps to each node within ``depth``."""
    found, frontier = {start: 0}, {start}
    for d in range(1, depth + 1):
        frontier = {t for s, t in edges if s in frontier} - found.keys()
        found |= dict.fromkeys(frontier, d)
    return found


def test_flow_queries_walk_to_depth_ten(spark, tables):
    folder, _ = tables
    g = project(spark, folder)
    edges = {(r.source_qualified, r.target_qualified) for r in g.of_kind("CALLS").collect()}
    (entry,) = (r.qualified_name for r in g.nodes.filter("kind = 'Test'").collect())
    nodes = walked(edges, entry, 10)
    files = {n.split("::")[0] for n in nodes}
    assert max(nodes.values()) == 9
    run = {n: queries.QUERIES[n](spark, folder).collect() for n in ("flows", "flow_summary", "affected_flows", "blast_flow_scores")}
    assert [tuple(r) for r in run["flows"]] == [(entry, "test", 9, len(nodes), len(files), len(nodes) * len(files))]
    assert tuple(run["flow_summary"][0]) == (1, 1, 0, 9.0, len(nodes) * len(files))
    assert [r.entry for r in run["affected_flows"]] == [entry]
    blast = {r.qualified_name: r.confidence for r in queries.QUERIES["blast_radius"](spark, folder).collect()}
    scores = {r.qualified_name: r.impact_score for r in run["blast_flow_scores"]}
    assert scores.keys() == blast.keys() and any(nodes.get(n, 0) > 2 for n in blast)
    assert all(abs(scores[n] - c * (0.3 if n in nodes else 0.1)) <= 0.0051 for n, c in blast.items())


def test_shortest_path_length_beyond_four_steps(spark, tables):
    folder, _ = tables
    g = project(spark, folder)
    edges = {(r.source_qualified, r.target_qualified) for r in g.of_kind("CALLS").collect()}
    start = min(r.qualified_name for r in g.nodes.filter("kind = 'Function'").collect())
    end = max(r.qualified_name for r in g.nodes.filter("kind = 'Class'").collect())
    assert walked(edges, start, 10)[end] == 8
    assert [r.length for r in queries.QUERIES["shortest_path_length"](spark, folder).collect()] == [8]
    assert [r.length for r in queries.QUERIES["shortest_path_length_depth4"](spark, folder).collect()] == [-1]


def test_flow_summary_takes_calls_from_keys(spark):
    """The pairs that flow_summary walks are those of the calls by name."""
    from symloom.operators.parts import hashed

    g = project(spark, "/root/testdata/sf0.001")
    pairs = {tuple(r) for r in g.call_pairs(lambda name: hashed(name, 42)).collect()}
    by_name = g.of_kind("CALLS").select(hashed("source_qualified", 42), hashed("target_qualified", 42))
    assert pairs - {(None, None)} and {(a, b) for a, b in pairs if a is not None and b is not None} == {tuple(r) for r in by_name.collect()}


def _by_name(g):
    """Calls between hashes of names, with their confidence."""
    from symloom.operators.parts import hashed

    return {tuple(r) for r in g.of_kind("CALLS").select(hashed("source_qualified", 42), hashed("target_qualified", 42), "confidence").collect()}


def _by_number(calls):
    from symloom.operators.numbered import edges_of

    return {(int(calls.ids[x]), int(calls.ids[y]), float(calls.confidence[k])) for a, b, code in edges_of(calls.values.toArrow().to_batches()) for x, y, k in zip(a, b, code)}


def _hash(name):
    from symloom.operators.parts import hashed

    return hashed(name, 42)


def test_flow_summary_walks_calls_of_a_few_bytes(spark, monkeypatch):
    from symloom.plans.projection import Projection

    g = project(spark, "/root/testdata/sf0.001")
    calls = g.numbered_calls(_hash)
    assert _by_number(calls) == _by_name(g)
    assert sum(len(z.as_py()) for z in calls.values.toArrow()["z"]) < 6 * g.of_kind("CALLS").count()
    monkeypatch.setattr(Projection, "_read", lambda *a: pytest.fail("edges by name"))
    assert queries.QUERIES["flow_summary"](spark, "/root/testdata/sf0.001").first().total_flows > 0


def _odd_tables(spark, folder, customers):
    made = {
        "region": ([(0, "A")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0, "N"), (1, 0, "M")], "n_nationkey int, n_regionkey int, n_name string"),
        "customer": (customers, "c_custkey long, c_nationkey int"),
        "supplier": ([(-4, 0), (9, 1)], "s_suppkey long, s_nationkey int"),
        "part": ([(p, "T", "Brand#11") for p in (-30, 1, 2, 3, 500)], "p_partkey long, p_type string, p_brand string"),
        "orders": ([(1, -5), (2, 7), (3, 99), (4, None)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, p, s, n, 50.0) for o in (1, 2, 3, 4, 5, None) for n, (p, s) in enumerate([(-30, -4), (1, 9), (1, None), (77, 9), (None, 9), (2, 8), (3, -4), (500, 9), (-30, 9)])], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return project(spark, str(folder))


def test_numbered_calls_of_odd_keys(spark, tmp_path):
    g = _odd_tables(spark, tmp_path, [(-5, 0), (7, 1), (8, 5)])
    calls = g.numbered_calls(_hash)
    assert _by_number(calls) == _by_name(g) and len(calls.ids) == 9


def test_a_key_of_two_names_has_no_number(spark, tmp_path):
    g = _odd_tables(spark, tmp_path, [(-5, 0), (-5, 1), (7, 1)])
    assert g.numbered_calls(_hash) is None
    assert {tuple(r) for r in g.call_pairs(_hash).filter("a IS NOT NULL AND b IS NOT NULL").collect()} == {e[:2] for e in _by_name(g)}


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_blast_flow_scores_reads_no_calls_by_name(spark, monkeypatch, least):
    from symloom.operators import reach
    from symloom.plans.projection import Projection

    folder = "/root/testdata/sf0.001"
    g = project(spark, folder)
    some = g.nodes.filter("pmod(hash(qualified_name), 97) = 3 AND kind <> 'Interface'").select("qualified_name")
    for seeds in (queries.seeds(g), some):
        seeds = seeds.distinct()
        by_name = reach._blast_of_names(reach.impact_edges(g, least), seeds, 3).select("node", "acc", "kind", "origin", "depth")
        got = reach._blast_of_numbers(g, seeds, 3, least)
        assert by_name.schema.simpleString() == got.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_name.collect()))
    assert reach._blast_of_numbers(g, g.nodes.select(F.col("file_path").alias("qualified_name")).limit(1), 3, least) is None
    read = Projection._read
    monkeypatch.setattr(Projection, "_read", lambda self, kinds: pytest.fail("calls by name") if "CALLS" in set(kinds) else read(self, kinds))
    assert queries.QUERIES["blast_flow_scores"](spark, folder).count() > 0


def test_blast_flow_scores_depth2_of_large_parts(spark, monkeypatch):
    """One task a part, or parts dealt out to groups of entries: the same scores and flows."""
    from symloom.operators import parts, walks

    folder = "/root/testdata/sf0.001"
    names = ("blast_flow_scores_depth2", "flows", "affected_flows")
    once = [sorted(map(tuple, queries.QUERIES[n](spark, folder).collect())) for n in names]
    monkeypatch.setattr(parts, "LARGE", 10)
    monkeypatch.setattr(walks, "BLOCK_EDGES", 997)
    assert once == [sorted(map(tuple, queries.QUERIES[n](spark, folder).collect())) for n in names]


def test_flow_summary_finds_next_parts_without_a_join_or_window(spark, tmp_path, monkeypatch):
    """Packed exchanges give the rows of FOLLOWS: repeated orders, nulls in each column, ends of the range of keys."""
    from symloom.plans.projection import FOLLOWS, Projection

    g = _odd_tables(spark, tmp_path / "a", [(-5, 0)])
    far = 2**63 - 1
    r = random.Random(5)
    lines = [(r.choice([1, 2, 3, -far, far, None]), r.choice([1, 2, None]), r.choice([4, -far, far, 0, None]), r.choice([0, 6, None])) for _ in range(300)]
    spark.createDataFrame([(o, r.choice([7, 0, -far, None])) for o in (1, 1, 2, 3, 3, -far, far, None, 9)], "o_orderkey long, o_custkey long").createOrReplaceTempView(g._views["orders"])
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").selectExpr("*", "50.0D AS l_quantity").createOrReplaceTempView(g._views["lineitem"])
    by_sql = sorted(map(str, g._sql(FOLLOWS).collect()))
    monkeypatch.setattr(Projection, "_sql", lambda *a: pytest.fail("line items by a join and a window"))
    assert len(by_sql) > 300 and sorted(map(str, g._follows().collect())) == by_sql
