"""Communities by directory and by topology, coupling, hubs, bridges, modularity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import CodeGraph, round2
from ..plans.scratch import cut
from .parts import by_part, dealt, hashed, parts_of, seed_of, small


def directory_of(path: str, depth: int) -> F.Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def directory_communities(graph: CodeGraph, depth: int = 2, min_size: int = 3) -> DataFrame:
    """(community, node_count, cohesion, language): nodes by the first ``depth`` parts of their path."""
    nodes = graph.known().select("qualified_name", "language", directory_of("file_path", depth).alias("community"))
    sizes = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("node_count")).filter(F.col("node_count") >= min_size)
    first = Window.partitionBy("community").orderBy(F.desc("n"), "language")
    language = nodes.groupBy("community", "language").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(first)).filter("r = 1").select("community", "language")
    pairs = _community_pairs(graph, nodes, *_INNER)
    inner = pairs.filter("a = b").groupBy(F.col("a").alias("community")).agg(F.sum("n").alias("inner"))
    n = F.col("node_count")
    cohesion = F.when(n > 1, round2(F.coalesce("inner", F.lit(0)) / (n * (n - 1)))).otherwise(0.0)
    return sizes.join(language, "community").join(inner, "community", "left").select("community", "node_count", cohesion.alias("cohesion"), "language")


_WEIGHED = ("CALLS", "INHERITS", "USES_TYPE")
_INNER = ("CALLS", "INHERITS", "IMPLEMENTS", "USES_TYPE", "TESTED_BY", "CONTAINS", "IMPORTS")


def _community_pairs(graph: CodeGraph, nodes: DataFrame, *kinds: str) -> DataFrame:
    """(a, b, n): edges from community to community, summed before anything else is joined."""
    side = nodes.select("qualified_name", "community")
    edges = graph.of_kind(*kinds).select("source_qualified", "target_qualified")
    edges = edges.join(side.toDF("source_qualified", "a"), "source_qualified").join(side.toDF("target_qualified", "b"), "target_qualified")
    return edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def directory_coupling(graph: CodeGraph, depth: int = 2, min_size: int = 3) -> DataFrame:
    """(a, b, calls, ratio, level): CALLS between two communities over all edges that start in either."""
    nodes = graph.known().select("qualified_name", directory_of("file_path", depth).alias("community"))
    kept = nodes.groupBy("community").count().filter(F.col("count") >= min_size).select("community")
    nodes = nodes.join(kept, "community", "left_semi")
    pairs = _community_pairs(graph, nodes, "CALLS").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("calls"))
    starts = graph.edges.join(nodes.toDF("community", "source_qualified") if nodes.columns[0] == "community" else nodes.toDF("source_qualified", "community"), "source_qualified").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(starts.toDF("a", "na"), "a").join(starts.toDF("b", "nb"), "b")
    ratio = F.col("calls") / (F.col("na") + F.col("nb"))
    return out.select("a", "b", "calls", round2(ratio).alias("ratio"), F.when(ratio > 0.3, "HIGH").when(ratio > 0.1, "MEDIUM").otherwise("LOW").alias("level"))


def weighted_graph(graph: CodeGraph) -> DataFrame:
    """(a, b, w) both ways: edges of CALLS, INHERITS and USES_TYPE between two known nodes."""
    nodes = graph.known().select("qualified_name")
    edges = graph.of_kind(*_WEIGHED).filter("source_qualified <> target_qualified").select(F.col("source_qualified").alias("a"), F.col("target_qualified").alias("b"))
    edges = edges.join(nodes.withColumnRenamed("qualified_name", "a"), "a", "left_semi").join(nodes.withColumnRenamed("qualified_name", "b"), "b", "left_semi")
    edges = edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    return edges.union(edges.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def strengths(weights: DataFrame) -> DataFrame:
    return weights.groupBy(F.col("a").alias("qualified_name")).agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("degree"))


def modularity(weights: DataFrame, members: DataFrame, true_q: bool = False) -> DataFrame:
    """Q of a partition (qualified_name, community); by default over adjacent pairs alone, else the usual Q."""
    k = strengths(weights)
    two_m = k.agg(F.sum("k")).first()[0] or 1
    side = members.join(k, "qualified_name")
    pairs = weights.join(side.select(F.col("qualified_name").alias("a"), F.col("community").alias("ca"), F.col("k").alias("ka")), "a").join(side.select(F.col("qualified_name").alias("b"), F.col("community").alias("cb"), F.col("k").alias("kb")), "b").filter("ca = cb")
    if not true_q:
        return pairs.agg((F.coalesce(F.sum(F.col("w") - F.col("ka") * F.col("kb") / F.lit(float(two_m))), F.lit(0.0)) / two_m).alias("q"))
    inner = pairs.groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inner"))
    totals = side.groupBy("community").agg(F.sum("k").alias("total")).join(inner, "community", "left")
    return totals.agg(F.sum(F.coalesce("inner", F.lit(0)) / two_m - (F.col("total") / two_m) * (F.col("total") / two_m)).alias("q"))


def adjacent_modularity(graph: CodeGraph, members: DataFrame) -> DataFrame:
    """``modularity`` of ``weighted_graph`` over adjacent pairs, from edges as pairs of hashes: strengths are counts
    of ends, and only pairs inside a community are ever summed."""
    seed = seed_of(graph.nodes)
    numbers = cut(members.select("community").distinct().withColumn("c", F.monotonically_increasing_id()))
    known = graph.known().select("qualified_name").join(members.select("qualified_name", "community"), "qualified_name", "left").join(numbers, "community", "left")
    side = cut(known.select(hashed("qualified_name", seed).alias("h"), "c"))
    edges = graph.of_kind(*_WEIGHED).filter("source_qualified <> target_qualified").select(hashed("source_qualified", seed).alias("a"), hashed("target_qualified", seed).alias("b"))
    ends = cut(edges.join(side.toDF("a", "ca"), "a").join(side.toDF("b", "cb"), "b").select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("same")))
    k = cut(ends.select(F.col("a").alias("h")).union(ends.select("b")).groupBy("h").agg(F.count(F.lit(1)).alias("k")))
    two_m = k.agg(F.sum("k")).first()[0] or 1
    pairs = ends.filter("same").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pairs = pairs.join(k.toDF("a", "ka"), "a").join(k.toDF("b", "kb"), "b")
    # Each pair stands for both directions.
    return pairs.agg((F.lit(2) * F.coalesce(F.sum(F.col("w") - F.col("ka") * F.col("kb") / F.lit(float(two_m))), F.lit(0.0)) / two_m).alias("q"))


def hubs(weights: DataFrame, top: int = 10) -> DataFrame:
    return strengths(weights).orderBy(F.desc("degree"), "qualified_name").limit(top)


def bridges(weights: DataFrame, members: DataFrame, top: int = 10) -> DataFrame:
    """Nodes by the number of other communities among their neighbours."""
    side = members.select("qualified_name", "community")
    far = weights.join(side.toDF("a", "ca"), "a").join(side.toDF("b", "cb"), "b").filter("ca <> cb")
    return far.groupBy(F.col("a").alias("qualified_name")).agg(F.count_distinct("cb").alias("communities")).orderBy(F.desc("communities"), "qualified_name").limit(top)


def connected_parts(weights: DataFrame, members: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(qualified_name, part): smallest node reachable, inside a community if ``members`` are given."""
    links = weights.select("a", "b")
    if members is not None:
        side = members.select("qualified_name", "community")
        links = links.join(side.toDF("a", "ca"), "a").join(side.toDF("b", "cb"), "b").filter("ca = cb").select("a", "b")
        every = side.select("qualified_name")
    else:
        every = links.select(F.col("a").alias("qualified_name")).distinct()
    links = cut(links.distinct())
    labels = cut(every.select("qualified_name", F.col("qualified_name").alias("part")))
    for _ in range(max_rounds):
        near = links.join(labels.toDF("b", "p"), "b").groupBy(F.col("a").alias("qualified_name")).agg(F.min("p").alias("p"))
        lower = cut(labels.join(near, "qualified_name", "left").select("qualified_name", F.col("part").alias("old"), F.least("part", F.coalesce("p", "part")).alias("part")))
        jump = lower.select(F.col("qualified_name").alias("part"), F.col("part").alias("next"))
        new = cut(lower.join(jump, "part").select("qualified_name", "old", F.least("part", "next").alias("part")))
        labels = new.select("qualified_name", "part")
        if new.filter("old <> part").isEmpty():
            break
    return labels


def louvain(weights: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(qualified_name, community) by rounds of modularity gain.

    All nodes of one half, by a hash that changes each round, choose the
    neighbouring community of the largest gain at once; the other half stands
    still, so that two nodes cannot swap for ever. Rounds end when none moves.
    """
    k = cut(strengths(weights))
    two_m = float(k.agg(F.sum("k")).first()[0] or 1)
    members = cut(k.select("qualified_name", F.col("qualified_name").alias("community"), "k"))
    still = 0
    for r in range(max_rounds):
        totals = members.groupBy("community").agg(F.sum("k").alias("total"))
        near = weights.join(members.select(F.col("qualified_name").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w_in"))
        options = near.join(totals, "community").join(members.select(F.col("qualified_name").alias("a"), F.col("community").alias("own"), "k"), "a")
        inside = F.col("community") == F.col("own")
        gain = F.col("w_in") - (F.col("total") - F.when(inside, F.col("k")).otherwise(0)) * F.col("k") / F.lit(two_m)
        options = options.select("a", "own", "k", F.struct((-gain).alias("g"), (~inside).cast("int").alias("moves"), "community").alias("o"), F.when(inside, gain).alias("stay"))
        chosen = options.groupBy("a").agg(F.min("o").alias("o"), F.max("stay").alias("stay"))
        # Alone in its community a node has no neighbour inside: staying gains nothing.
        moves = chosen.filter((-F.col("o.g") > F.coalesce("stay", F.lit(0.0)) + F.lit(1e-12)) & (F.pmod(F.xxhash64("a", F.lit(r)), F.lit(2)) == 0)).select(F.col("a").alias("qualified_name"), F.col("o.community").alias("new"))
        moves = cut(moves)
        if moves.isEmpty():
            still += 1
            if still > 2:
                break
            continue
        still = 0
        members = cut(members.join(moves, "qualified_name", "left").select("qualified_name", F.coalesce("new", "community").alias("community"), "k"))
    return members.select("qualified_name", "community")


def louvain_exact(weights: DataFrame, max_passes: int = 50, max_edges: int = 2_000_000) -> DataFrame:
    """One level of greedy local moving in node order, on the driver, for graphs of at most ``max_edges`` edges."""
    rows = weights.orderBy("a", "b").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} edges: use louvain()")
    near: dict[str, dict[str, int]] = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = w
    k = {a: sum(n.values()) for a, n in near.items()}
    two_m = sum(k.values()) or 1
    own, total = {a: a for a in near}, dict(k)
    for _ in range(max_passes):
        moved = False
        for a in near:
            total[own[a]] -= k[a]
            inside: dict[str, int] = {own[a]: 0}
            for b, w in near[a].items():
                inside[own[b]] = inside.get(own[b], 0) + w
            best, most = own[a], inside[own[a]] - total[own[a]] * k[a] / two_m
            for c, w in inside.items():
                gain = w - total[c] * k[a] / two_m
                if gain > most:
                    best, most = c, gain
            moved |= best != own[a]
            own[a] = best
            total[best] += k[a]
        if not moved:
            break
    return weights.sparkSession.createDataFrame(sorted(own.items()), "qualified_name string, community string")


#: Nodes whose communities the driver holds and sends to all tasks, 4 bytes each; edges of a packed block, about.
MOST, BLOCK_EDGES = 4_000_000, 500_000
ROUNDS = 50


def wishes(a: np.ndarray, b: np.ndarray, w: np.ndarray, own: np.ndarray, total: np.ndarray, k: np.ndarray, two_m: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b, w) that gain by moving, and the community that each goes to, as ``louvain`` chooses it."""
    key = a.astype(np.int64) * len(own) + own[b]
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    node, to = key[first] // len(own), key[first] % len(own)
    inside = own[node] == to
    gain = np.add.reduceat(w[by].astype(np.int64), first) - (total[to] - np.where(inside, k[node], 0)) * k[node] / float(two_m)
    run = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    of = np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(node)]))
    most, stay = np.maximum.reduceat(gain, run), np.zeros(len(run))
    stay[of[inside]] = gain[inside]
    at = np.flatnonzero(gain == most[of])
    at = at[np.r_[True, of[at][1:] != of[at][:-1]]]  # of equal gains the first community by name
    at = at[most > stay + 1e-12]
    return node[at], to[at]


def _numbered(graph: CodeGraph, seed: int) -> DataFrame:
    """(qualified_name, h, id, marks): nodes numbered from 0 by name; bit r of ``marks`` says who may move in round r."""
    names = cut(graph.nodes.select("qualified_name").filter("qualified_name IS NOT NULL").distinct().orderBy("qualified_name").withColumn("m", F.monotonically_increasing_id()))
    starts, n = [], 0
    for part, count in sorted(tuple(r) for r in names.groupBy(F.shiftright("m", 33).alias("p")).count().collect()):
        starts += [F.lit(part), F.lit(n)]
        n += count
    start = F.create_map(*starts)[F.shiftright("m", 33)] if starts else F.lit(0)
    marks = reduce(Column.bitwiseOR, [F.when(F.pmod(F.xxhash64("qualified_name", F.lit(r)), F.lit(2)) == 0, F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r in range(ROUNDS)])
    return cut(names.select("qualified_name", hashed("qualified_name", seed).alias("h"), (F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("long").alias("id"), marks.alias("marks")))


def _blocks(graph: CodeGraph, nodes: DataFrame, seed: int, n: int) -> DataFrame:
    """(a, b, w): weights both ways as packed numbers, all of a node in one row."""
    ids = cut(nodes.select("h", "id"))
    edges = graph.of_kind(*_WEIGHED).filter("source_qualified <> target_qualified").select(hashed("source_qualified", seed).alias("x"), hashed("target_qualified", seed).alias("y"))
    pairs = cut(edges.join(small(ids).toDF("x", "a"), "x").join(small(ids).toDF("y", "b"), "y").select("a", "b"))
    groups = max(1, 2 * pairs.count() // BLOCK_EDGES)
    rows = pairs.union(pairs.select("b", "a")).select(F.pmod(F.xxhash64("a"), F.lit(groups)).cast("long").alias("part"), F.lit(0).alias("kind"), F.col("a").alias("h"), F.col("b").alias("y"), F.lit(None).cast("string").alias("name"))

    def weigh(held: dict) -> pa.RecordBatch:
        key, w = np.unique(held[0][0] * n + held[0][1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (key // n, key % n, w)], ["a", "b", "w"])

    return cut(by_part(dealt(rows), weigh, "a binary, b binary, w binary"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in range(3))


def topological_communities(graph: CodeGraph, min_size: int = 3) -> DataFrame:
    """(community, qualified_name): local moving, then every community split into its connected parts.

    The rounds are those of ``louvain``. Edges stay packed where they are written; a round sends the numbers of
    all communities to the tasks and takes the moves back. Above MOST nodes, ``louvain`` itself.
    """
    spark = graph.nodes.sparkSession
    seed = seed_of(graph.nodes)
    nodes = _numbered(graph, seed)
    n = nodes.count()
    if n > MOST:
        weights = cut(weighted_graph(graph))
        parts = connected_parts(weights, louvain(weights, ROUNDS)).withColumnRenamed("part", "community")
        return _of_size(parts, min_size)
    blocks = _blocks(graph, nodes, seed, n)

    def strength(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, w in _unpacked(batches):
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(np.add.reduceat(w.astype(np.int64), first))], ["id", "k"])

    found, marked = blocks.mapInArrow(strength, "id int, k long").toArrow(), nodes.select("id", "marks").toArrow()
    k, marks, own = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n, dtype=np.int32)
    k[found["id"].to_numpy()] = found["k"].to_numpy()
    marks[marked["id"].to_numpy()] = marked["marks"].to_numpy()
    two_m, still, strengths_ = int(k.sum()) or 1, 0, spark.sparkContext.broadcast(k)
    for r in range(ROUNDS):
        total = np.zeros(n, np.int64)
        np.add.at(total, own, k)
        state = spark.sparkContext.broadcast((own, total, (marks >> r) & 1 == 1))

        def move(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own, total, may = state.value
            for a, b, w in _unpacked(batches):
                mine = may[a]
                if mine.any():
                    node, to = wishes(a[mine], b[mine], w[mine], own, total, strengths_.value, two_m)
                    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(to.astype(np.int32))], ["id", "to"])

        moves = blocks.mapInArrow(move, "id int, to int").toArrow()
        state.destroy()
        own = own.copy()
        own[moves["id"].to_numpy()] = moves["to"].to_numpy()
        still = 0 if len(moves) else still + 1
        if still > 2:
            break
    last = spark.sparkContext.broadcast(own)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last.value
        for a, b, _ in _unpacked(batches):
            # Each node with itself too, so that those alone in their community are there.
            x, y = a[own[a] == own[b]], b[own[a] == own[b]]
            alone = np.unique(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, alone].astype(np.int64)), pa.array(np.r_[y, alone].astype(np.int64))], ["a", "b"])

    links = blocks.mapInArrow(inside, "a long, b long")
    alone = links.filter("a = b").select(F.col("a").alias("h"))
    parts = alone.join(parts_of(links), "h", "left").select(F.col("h").alias("id"), F.coalesce("part", "h").alias("part"))
    names = nodes.select("id", "qualified_name")
    parts = parts.join(names, "id").join(names.toDF("part", "community"), "part").select("community", "qualified_name")
    return _of_size(cut(parts), min_size)


def _of_size(parts: DataFrame, least: int) -> DataFrame:
    kept = parts.groupBy("community").count().filter(F.col("count") >= least).select("community")
    return parts.join(kept, "community", "left_semi").select("community", "qualified_name")
