"""Bounded reachability: blast radius, execution flows, shortest paths, overlap of change sets.

Each level is one equi-join of a frontier with an edge table that was reduced
to the columns a step needs; levels are cut, so plans stay short and a lost
executor repeats one level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import CodeGraph, file_of, round2
from ..plans.scratch import cut, keep, passing, settle
from ..schema import DEFAULT_CONFIDENCE, DEFAULT_DEPTH
from . import communities, parts as whole, walks
from .numbered import Calls, best_steps, distinct, number_rows
from .parts import EDGE, by_part, hashed, large_parts, links_by_part, packed, parts_of, rows_of, seed_of, small


def impact_edges(graph: CodeGraph, least: float) -> DataFrame:
    """(from, to, kind, conf): what a change at ``from`` reaches in one step."""
    hidden = graph.known().filter(F.col("is_exported") == F.lit(False)).select(F.col("qualified_name").alias("target_qualified")).withColumn("hidden", F.lit(True))
    calls = graph.of_kind("CALLS").filter(F.coalesce("confidence", F.lit(1.0)) >= least).join(hidden, "target_qualified", "left")
    calls = calls.filter(F.col("hidden").isNull() | (file_of("source_qualified") == file_of("target_qualified")))
    parts = [calls.select(F.col("target_qualified").alias("from"), F.col("source_qualified").alias("to"), F.lit("CALLS").alias("kind"), F.coalesce("confidence", F.lit(1.0)).alias("conf"))]
    for kind, conf in (("USES_TYPE", 0.8), ("INHERITS", 0.9), ("IMPORTS", 1.0)):
        if conf >= least or kind == "IMPORTS":
            parts.append(graph.of_kind(kind).select(F.col("target_qualified").alias("from"), F.col("source_qualified").alias("to"), F.lit(kind).alias("kind"), F.lit(conf).alias("conf")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("from", "to", "kind").agg(F.max("conf").alias("conf"))


def blast_radius(graph: CodeGraph, seeds: DataFrame, max_depth: int = DEFAULT_DEPTH, min_confidence: float = DEFAULT_CONFIDENCE, contract_breaking: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """(qualified_name, depth, confidence, kind, origin, category) of what the ``seeds`` (column qualified_name) reach.

    Depth is the fewest steps; confidence the best product along a path found
    level by level. A better path that comes later raises the confidence of a
    node and leaves its depth, and its neighbours are not visited again. Ties
    go to the first kind and origin by name. ``steps``: impact edges of an earlier walk, to use them again.
    """
    seeds = cut(seeds.select("qualified_name").distinct())
    best = _blast_of_numbers(graph, seeds, max_depth, min_confidence) if steps is None else None
    if best is None:
        best = _blast_of_names(cut(impact_edges(graph, min_confidence)) if steps is None else steps, seeds, max_depth)
    breaking = (contract_breaking.select(F.col("qualified_name").alias("origin")).distinct() if contract_breaking is not None else seeds.limit(0).select(F.col("qualified_name").alias("origin"))).withColumn("cb", F.lit(True))
    out = best.join(breaking, "origin", "left")
    category = F.when((F.col("depth") == 1) & (F.col("kind") == "CALLS") & F.col("cb"), "contract_breaking").when(F.col("depth") == 1, "behavior_affected").otherwise("transitive")
    return out.select(F.col("node").alias("qualified_name"), "depth", F.col("acc").alias("confidence"), "kind", "origin", category.alias("category"))


def _blast_of_names(steps: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, acc, kind, origin, depth): a join of the frontier with ``steps`` at each level."""
    seed_nodes = seeds.withColumnRenamed("qualified_name", "to")
    frontier = seeds.select(F.col("qualified_name").alias("from"), F.lit(1.0).alias("acc"), F.col("qualified_name").alias("origin"))
    best = None
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, "from").join(seed_nodes, "to", "left_anti")
        reached = reached.select("to", F.struct((-F.col("acc") * F.col("conf")).alias("neg"), "kind", "origin").alias("b")).groupBy("to").agg(F.min("b").alias("b"))
        reached = reached.select(F.col("to").alias("node"), (-F.col("b.neg")).alias("acc"), F.col("b.kind").alias("kind"), F.col("b.origin").alias("origin"))
        if best is None:
            best = cut(reached.withColumn("depth", F.lit(depth)))
            frontier = best.select(F.col("node").alias("from"), "acc", "origin")
            continue
        both = best.alias("b").join(reached.alias("r"), "node", "full_outer")
        fresh = F.col("b.depth").isNull()
        better = fresh | (F.col("r.acc") > F.col("b.acc"))
        best = cut(both.select("node", *(F.when(better, F.col(f"r.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("acc", "kind", "origin")), F.coalesce("b.depth", F.lit(depth)).alias("depth")))
        frontier = best.filter(F.col("depth") == depth).select(F.col("node").alias("from"), "acc", "origin")
        if frontier.isEmpty():
            break
    return best


#: Kinds of impact edges by name, as their places.
KINDS = ("CALLS", "IMPORTS", "INHERITS", "USES_TYPE")


def _blast_of_numbers(graph: CodeGraph, seeds: DataFrame, max_depth: int, least: float) -> DataFrame | None:
    """``_blast_of_names`` over numbered calls, one look at them a level; None where a seed or an end of an edge has no number.

    IMPORTS link files, which no seed then is and no other kind leads to."""
    seed: list[int] = []

    def name_hash(name: str) -> Column:
        seed.extend([] if seed else [seed_of(graph.nodes)])
        return hashed(name, seed[0])

    calls = graph.numbered_calls(name_hash)
    if calls is None:
        return None
    spark, ids = graph.nodes.sparkSession, calls.ids
    origins = [r[0] for r in seeds.filter("qualified_name IS NOT NULL").orderBy("qualified_name").collect()]
    start = number_rows(seeds.filter("qualified_name IS NOT NULL").select(name_hash("qualified_name").alias("node"), "qualified_name"), calls.shared, 1)
    more = graph.of_kind("USES_TYPE").select(F.col("target_qualified").alias("f"), F.col("source_qualified").alias("t"), F.lit(KINDS.index("USES_TYPE")).cast("long").alias("kind"), F.lit(0.8).alias("conf"))
    more = more.union(graph.of_kind("INHERITS").select("target_qualified", "source_qualified", F.lit(KINDS.index("INHERITS")).cast("long"), F.lit(0.9)))
    ends = number_rows(more.filter(F.col("conf") >= least).select(name_hash("f").alias("f"), name_hash("t").alias("t"), "kind", "conf"), calls.shared, 2)
    known = graph.known().select(name_hash("qualified_name").alias("h"), file_of("qualified_name").alias("file"), F.coalesce(F.col("is_exported") == F.lit(False), F.lit(False)).alias("hidden")).filter("h IS NOT NULL")
    if start is None or ends is None:
        return None
    known = cut(known)
    files = cut(known.select("file").distinct().withColumn("n", F.monotonically_increasing_id()))
    found = known.join(files, "file").select("h", "n", "hidden").toArrow()
    at, there = walks.numbers_of(ids, found["h"].to_numpy())
    file, hidden = np.full(len(ids), -1, np.int32), np.zeros(len(ids), bool)
    file[at[there]] = np.unique(found["n"].to_numpy(), return_inverse=True)[1][there]
    hidden[at[there]] = found["hidden"].to_numpy()[there]
    del found, at, there
    sight = spark.sparkContext.broadcast((file, hidden))

    def accept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        file, hidden = sight.value
        return ~hidden[b] | (file[a] == file[b])

    is_seed, acc, tie, depth = np.zeros(len(ids), bool), np.full(len(ids), -1.0), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int8)
    origin, front = np.zeros(len(ids), np.int32), np.full(len(ids), -1.0)
    place = {name: k for k, name in enumerate(origins)}
    for r in start.collect():
        is_seed[r.node], front[r.node], origin[r.node] = True, 1.0, place[r.qualified_name]
    for level in range(1, max_depth + 1):
        to, value, ties = best_steps(calls, ends, accept, front, origin, is_seed, len(origins), least)
        better, fresh = value > acc[to], depth[to] == 0
        acc[to[better]], tie[to[better]] = value[better], ties[better]
        depth[to[fresh]] = level
        front, origin = np.where(depth == level, acc, -1.0), (tie % max(1, len(origins))).astype(np.int32)
        if not fresh.any():
            break
    sight.destroy()
    shared, held = calls.shared, spark.sparkContext.broadcast((acc, tie.astype(np.int32), depth))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, tie, depth = held.value
        for batch in batches:
            at, there = walks.numbers_of(shared.value, batch.column(0).to_numpy())
            k = np.flatnonzero(there & (depth[at] > 0))
            at = at[k]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(k)), pa.array(acc[at]), pa.array([KINDS[t] for t in (tie[at] // len(origins)).tolist()], pa.string()), pa.array([origins[t] for t in (tie[at] % len(origins)).tolist()], pa.string()), pa.array(depth[at].astype(np.int32))], ["node", "acc", "kind", "origin", "depth"])

    names = graph.nodes.filter("qualified_name IS NOT NULL").select(name_hash("qualified_name").alias("h"), "qualified_name").distinct()
    out = cut(names.mapInArrow(look, "node string, acc double, kind string, origin string, depth int"))
    held.destroy()
    settle(spark)
    return out


def blast_summary(graph: CodeGraph, seeds: DataFrame, blast: DataFrame) -> DataFrame:
    """(total_functions, total_files): seeds count, known or not; files are those of known nodes."""
    every = seeds.select("qualified_name").union(blast.select("qualified_name")).distinct()
    files = every.join(graph.known().select("qualified_name", "file_path"), "qualified_name", "left")
    return files.agg(F.count(F.lit(1)).alias("total_functions"), F.count_distinct("file_path").alias("total_files"))


HTTP_NAMES = ("get", "post", "put", "delete", "patch", "handle", "handler")


def entry_points(graph: CodeGraph, type_: str | None = None) -> DataFrame:
    """(entry, type): tests, and functions or methods named or owned like request handlers."""
    tests = graph.nodes.filter("kind = 'Test'").select(F.col("qualified_name").alias("entry"), F.lit("test").alias("type"))
    handler = F.lower("name").isin(*HTTP_NAMES) | F.coalesce(F.lower("parent_name").endswith("controller"), F.lit(False))
    http = graph.nodes.filter(F.col("kind").isin("Function", "Method") & handler).select(F.col("qualified_name").alias("entry"), F.lit("http").alias("type"))
    return (tests if type_ == "test" else http if type_ == "http" else tests.union(http)).distinct()


#: Entries that walk together as the bits of one row, and the 64-bit words they take.
BLOCK, WORDS = 1024, 16
#: Blocks of a large part that walk at once; the tables of their walk go before the next.
BLOCKS = 8
_W = [f"w{k}" for k in range(WORDS)]


#: Kinds of rows that parts of the call graph are packed with.
ENTRY, FILE, HTTP, TEST, ASKED = range(EDGE + 1, EDGE + 6)


@dataclass(frozen=True)
class FlowMembers:
    """What ``entries`` (entry, type) reach over CALLS in ``max_depth`` steps; each question walks as it needs."""

    graph: CodeGraph
    entries: DataFrame
    max_depth: int

    @cached_property
    def seed(self) -> int:
        return seed_of(self.graph.nodes)

    @cached_property
    def calls(self) -> DataFrame:
        """(a, b): hashes of caller and callee; a call of itself leads nowhere."""
        return self.graph.call_pairs(lambda name: hashed(name, self.seed)).filter("a <> b")

    @cached_property
    def numbered(self) -> Calls | None:
        return self.graph.numbered_calls(lambda name: hashed(name, self.seed))

    @cached_property
    def label(self) -> np.ndarray:
        """For each numbered node the least number of its part."""
        return self.numbered.parts()

    @cached_property
    def parts(self) -> DataFrame:
        if self.numbered is None:
            return parts_of(self.calls)
        spark = self.graph.nodes.sparkSession
        shared, held = self.numbered.shared, spark.sparkContext.broadcast(self.label)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[at]), pa.array(shared.value[held.value[at]])], ["h", "part"])

        out = cut(spark.range(len(self.label)).mapInArrow(look, "h long, part long"))
        held.destroy()
        return out

    @cached_property
    def numbers(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Hashes of all nodes in order, and their parts, if they are few enough for the driver."""
        if self.numbered is not None:
            return self.numbered.ids, self.numbered.ids[self.label]
        if self.parts.count() > communities.MOST:
            return None
        found = self.parts.toArrow()
        h, part = found["h"].to_numpy(), found["part"].to_numpy()
        by = np.argsort(h)
        return h[by], part[by]

    @cached_property
    def sizes(self) -> tuple[dict[int, int], bool]:
        """Edges of each part of more than LARGE, where nodes are numbered, and whether there are others."""
        if self.numbered is not None:
            n = self.numbered.count_by(self.label)
            return {int(self.numbered.ids[k]): int(n[k]) for k in np.flatnonzero(n > whole.LARGE)}, bool(((n > 0) & (n <= whole.LARGE)).any())
        held = self.graph.nodes.sparkSession.sparkContext.broadcast(self.numbers)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, part = held.value
            names, label = np.unique(part, return_inverse=True)
            n = np.zeros(len(names), np.int64)
            for batch in batches:
                n += np.bincount(label[np.searchsorted(ids, batch.column(0).to_numpy())], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[n > 0]), pa.array(n[n > 0])], ["part", "n"])

        found = cut(self.calls.select("a").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")))
        held.destroy()
        return {r[0]: r[1] for r in found.filter(F.col("n") > whole.LARGE).collect()}, not found.filter(F.col("n") <= whole.LARGE).isEmpty()

    @cached_property
    def edges(self) -> DataFrame:
        """Packed edges; where nodes are numbered, those of large parts are in ``blocks`` instead."""
        if self.numbered is not None:
            return links_by_part(self.numbered, self.label, self.in_large)
        if self.numbers is None:
            return cut(packed(rows_of(self.calls, EDGE, F.col("a"), F.col("b")), self.parts))
        held, apart = self.graph.nodes.sparkSession.sparkContext.broadcast(self.numbers), np.array(sorted(self.sizes[0]), np.int64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, part = held.value
            for batch in batches:
                a, b = (batch.column(k).to_numpy() for k in (0, 1))
                of = part[np.searchsorted(ids, a)]
                if len(apart):
                    here = ~np.isin(of, apart)
                    a, b, of = a[here], b[here], of[here]
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.full(len(of), EDGE, np.int32)), pa.array(a), pa.array(b), pa.nulls(len(of), pa.string())], ["part", "kind", "h", "y", "name"])

        calls = self.calls if self.sizes[1] else self.calls.limit(0)
        return cut(calls.mapInArrow(whole.packing(place), whole.PACKED))

    @cached_property
    def large(self) -> list[int]:
        return large_parts(self.edges) if self.numbers is None else sorted(self.sizes[0])

    @property
    def in_large(self) -> np.ndarray:
        """Which numbered nodes are in large parts."""
        return np.isin(self.numbers[1], self.large)

    @cached_property
    def ids(self) -> np.ndarray:
        """Hashes of the nodes of large parts, in order; places are their numbers in ``blocks``."""
        return self.numbers[0][self.in_large]

    @cached_property
    def blocks(self) -> DataFrame:
        if self.numbered is not None:
            place = np.where(self.in_large, np.cumsum(self.in_large) - 1, -1).astype(np.int32)
            return walks.blocks_of(self.numbered.values, self.ids, sum(self.sizes[0].values()), place)
        return walks.blocks_of(self.calls, self.ids, sum(self.sizes[0].values()))

    def with_edges(self, rows: DataFrame, f: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
        """What ``f`` makes of the packed edges and ``rows`` of each part but the large ones."""
        found = self.edges.union(packed(rows, self.parts))
        found = found.filter(~F.col("part").isin(self.large)) if self.large else found
        return by_part(found, f, schema, None if self.numbered is None else self.numbered.shared)

    def of_large(self) -> DataFrame:
        """(h) of the nodes of large parts."""
        return self.parts.filter(F.col("part").isin(self.large)).select("h")

    @cached_property
    def _walk(self) -> tuple[DataFrame, DataFrame]:
        calls = cut(self.graph.of_kind("CALLS").select(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("next")).distinct())
        numbered = _number(self.entries)
        return numbered, _levels(calls, numbered, self.max_depth)

    def rows(self) -> DataFrame:
        """(entry, type, node, depth), one row a member."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, bit = np.nonzero(_bits(batch))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("block").take(at), batch.column("depth").take(at), pa.array(bit.astype(np.int32))], ["node", "block", "depth", "bit"])

        numbered, levels = self._walk
        found = levels.mapInArrow(unpack, "node string, block long, depth int, bit int")
        return found.join(numbered, ["block", "bit"]).select("entry", "type", "node", "depth")


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, BLOCK) of zeros and ones from the words of a batch."""
    words = np.stack([batch.column(w).to_numpy(zero_copy_only=False).astype("<i8") for w in _W], 1)
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def _by_entry(levels: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, type, n, depth): set bits of each entry and the greatest depth that has one, summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, bits, depth = batch.column("block").to_numpy(), _bits(batch), batch.column("depth").to_numpy()
            for block in np.unique(blocks).tolist():
                here = blocks == block
                n = bits[here].sum(axis=0, dtype=np.int64)
                deep = (bits[here] * depth[here][:, None].astype(np.int32)).max(axis=0)
                held = sums.setdefault(block, np.zeros((2, BLOCK), np.int64))
                held[0] += n
                held[1] = np.maximum(held[1], deep)
        for block, (n, deep) in sums.items():
            bit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), block)), pa.array(bit.astype(np.int32)), pa.array(n[bit]), pa.array(deep[bit].astype(np.int32))], ["block", "bit", "n", "depth"])

    summed = levels.mapInArrow(count, "block long, bit int, n long, depth int").groupBy("block", "bit").agg(F.sum("n").alias("n"), F.max("depth").alias("depth"))
    return summed.join(entries, ["block", "bit"]).select("entry", "type", "n", "depth")


def _any(*keys: str):
    return lambda df: df.groupBy(*keys).agg(*(F.bit_or(w).alias(w) for w in _W))


def flow_members(graph: CodeGraph, entries: DataFrame, max_depth: int = 10) -> FlowMembers:
    """What each entry reaches over CALLS."""
    return FlowMembers(graph, cut(entries.select("entry", "type").distinct()), max_depth)


def _number(entries: DataFrame) -> DataFrame:
    """``entries`` with a block and a bit in it."""
    groups = max(1, entries.count() // (BLOCK // 2))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("entry", "type")) - 1
    numbered = entries.withColumn("part", F.pmod(F.xxhash64("entry", "type"), F.lit(groups))).withColumn("rank", rank)
    # A part that is larger than a block by chance goes on in a block of its own.
    return cut(numbered.select("entry", "type", (F.col("part") + groups * F.floor(F.col("rank") / BLOCK)).cast("long").alias("block"), (F.col("rank") % BLOCK).cast("int").alias("bit")))


def _levels(calls: DataFrame, numbered: DataFrame, max_depth: int) -> DataFrame:
    """(node, block, depth, w0 ...), a set bit for each entry of the block that meets the node first at that depth.

    All entries walk at once, BLOCK of them in the bits of a row, so that a step
    is one join of edges with nodes and blocks, whatever the number of entries that meet a node."""
    start = numbered.select(F.col("entry").alias("node"), "block", *(F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(_W)))
    frontier = cut(_any("node", "block")(start))
    seen, levels = frontier, frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = _any("node", "block")(frontier.join(calls, "node").select(F.col("next").alias("node"), "block", *_W))
        known = seen.select("node", "block", *(F.col(w).alias(f"s{w}") for w in _W))
        fresh = reached.join(known, ["node", "block"], "left").select("node", "block", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"s{w}", F.lit(0).cast("long")))).alias(w) for w in _W))
        frontier = cut(fresh.filter(" OR ".join(f"{w} <> 0" for w in _W)))
        if frontier.isEmpty():
            break
        seen = cut(_any("node", "block")(seen.union(frontier)))
        levels = levels.union(frontier.withColumn("depth", F.lit(depth)))
    return levels.select("node", "block", "depth", *_W)


def _bit_sums(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit set."""
    out = np.zeros(words.shape[1] * 64, np.int64)
    for k in range(0, len(words), 4096):
        out += np.unpackbits(np.ascontiguousarray(words[k : k + 4096]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def _or_into(out: np.ndarray, rows: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
    """Sets in ``out[to]`` the bits of ``rows[at]``; ``to`` is sorted."""
    step = max(1, (1 << 22) // rows.shape[1])
    for k in range(0, len(to), step):
        t = to[k : k + step]
        first = _starts(t)
        out[t[first]] |= np.bitwise_or.reduceat(rows[at[k : k + step]], first, axis=0)


def _indexed(x: np.ndarray, y: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, at, to): all names, and the edges as places in them by target, without those whose source nothing can reach."""
    ids = distinct(np.concatenate([x, y, more]))
    at, to = np.searchsorted(ids, x), np.searchsorted(ids, y)
    met = np.zeros(len(ids), bool)
    met[np.searchsorted(ids, more)] = True
    while True:
        new = met.copy()
        new[to[met[at]]] = True
        if np.array_equal(new, met):
            break
        met = new
    at, to = at[met[at]], to[met[at]]
    by = np.argsort(to, kind="stable")
    return ids, at[by], to[by]


def count_flows(x: np.ndarray, y: np.ndarray, entries: np.ndarray, named: np.ndarray, files: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, nodes and files of what each of ``entries`` reaches over the edges (x, y); ``files``: one for each of ``named``."""
    ids, at, to = _indexed(x, y, entries)
    place = np.searchsorted(ids, named)
    place[place == len(ids)] = 0
    there = ids[place] == named
    place, files = place[there], files[there]
    by = np.argsort(files, kind="stable")
    place, file = place[by], np.cumsum(np.r_[0, files[by][1:] != files[by][:-1]])[: len(by)]
    out = [np.zeros(len(entries), np.int64) for _ in range(3)]
    # Bits of at most 32 MB walk at once.
    step = max(1, min(-(-len(entries) // 64), (1 << 22) // max(1, len(ids)))) * 64
    for lo in range(0, len(entries), step):
        here = entries[lo : lo + step]
        k, words = np.arange(len(here)), -(-len(here) // 64)
        seen = np.zeros((len(ids), words), np.uint64)
        np.bitwise_or.at(seen, (np.searchsorted(ids, here), k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        fresh = seen.copy()
        for depth in range(1, max_depth + 1):
            live = fresh.any(axis=1)[at]
            reached = np.zeros_like(seen)
            _or_into(reached, fresh, at[live], to[live])
            fresh = reached & ~seen
            seen |= fresh
            deeper = np.flatnonzero(_bit_sums(np.bitwise_or.reduce(fresh, axis=0)[None]))
            if not len(deeper):
                break
            out[0][lo + deeper] = depth
        out[1][lo : lo + step] = _bit_sums(seen)[: len(here)]
        if len(file):
            held = np.zeros((int(file[-1]) + 1, words), np.uint64)
            _or_into(held, seen, place, file)
            out[2][lo : lo + step] = _bit_sums(held)[: len(here)]
    return out[0], out[1], out[2]


def _file_rows(members: FlowMembers) -> tuple[DataFrame, DataFrame]:
    """(h, file) of known nodes, with a number for each file."""
    known = cut(members.graph.known().select(hashed("qualified_name", members.seed).alias("h"), "file_path").filter("file_path IS NOT NULL AND h IS NOT NULL"))
    numbers = cut(known.select("file_path").distinct().withColumn("file", F.monotonically_increasing_id()))
    return known.join(numbers, "file_path").select("h", "file")


def _counts(members: FlowMembers) -> DataFrame:
    """(h, depth, node_count, file_count) of each entry."""
    entries = members.entries.select(hashed("entry", members.seed).alias("h")).distinct()
    files = cut(_file_rows(members))
    max_depth = members.max_depth

    def count(held: dict) -> pa.RecordBatch | None:
        none = np.empty(0, np.int64)
        if ENTRY not in held:
            return None
        x, y = held.get(EDGE, (none, none))[:2]
        named, file = held.get(FILE, (none, none))[:2]
        found = count_flows(x, y, held[ENTRY][0], named, file, max_depth)
        return pa.RecordBatch.from_arrays([pa.array(held[ENTRY][0]), pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(found[2])], ["h", "depth", "node_count", "file_count"])

    sides = rows_of(entries, ENTRY, F.col("h")).union(rows_of(files, FILE, F.col("h"), F.col("file")))
    out = members.with_edges(sides, count, "h long, depth int, node_count long, file_count long")
    if members.large and members.numbers is not None:
        ids = members.ids
        at, there = walks.numbers_of(ids, entries.toArrow()["h"].to_numpy())
        named = files.join(members.of_large(), "h", "left_semi").toArrow()
        file = np.full(len(ids), -1, np.int64)
        file[np.searchsorted(ids, named["h"].to_numpy())] = np.unique(named["file"].to_numpy(), return_inverse=True)[1]
        return out.union(walks.count_reach(members.blocks, ids, at[there], file, max_depth))
    if members.large:
        of = members.of_large()
        far = entries.join(of, "h", "left_semi").select(F.col("h").cast("string").alias("entry"), F.lit("").alias("type"))
        calls = cut(members.calls.join(of.withColumnRenamed("h", "a"), "a", "left_semi").select(F.col("a").cast("string").alias("node"), F.col("b").cast("string").alias("next")).distinct())
        numbered = _number(cut(far))
        blocks = sorted(r[0] for r in numbered.select("block").distinct().collect())
        for k in range(0, len(blocks), BLOCKS):
            some = numbered.filter(F.col("block").isin(blocks[k : k + BLOCKS]))
            with passing(members.graph.nodes.sparkSession):
                levels = _levels(calls, some, max_depth)
                nodes = _by_entry(levels, some).select("entry", "depth", F.col("n").alias("node_count"))
                by_file = _any("file", "block")(levels.join(files.select(F.col("h").cast("string").alias("node"), "file"), "node")).withColumn("depth", F.lit(0))
                found = nodes.join(_by_entry(by_file, some).select("entry", F.col("n").alias("file_count")), "entry", "left").fillna(0, ["file_count"])
                found = keep(found.select(F.col("entry").cast("long").alias("h"), "depth", "node_count", "file_count"))
            out = out.union(found)
    return out


def flows(graph: CodeGraph, members: FlowMembers, with_path: bool = False) -> DataFrame:
    """One row for each entry: depth, nodes, files of known nodes, criticality, and if asked for the path by depth and name."""
    entries = members.entries.withColumn("h", hashed("entry", members.seed))
    out = entries.join(_counts(members), "h", "left").select("entry", "type", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("node_count", F.lit(1).cast("long")).alias("node_count"), F.coalesce("file_count", F.lit(0).cast("long")).alias("file_count"))
    if with_path:
        paths = members.rows().groupBy("entry", "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda s: s["node"]).alias("path"))
        out = out.join(paths, ["entry", "type"])
    return out.withColumn("criticality", F.col("node_count") * F.col("file_count"))


def flow_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total_flows"), F.count_if(F.col("type") == "test").alias("test_flows"), F.count_if(F.col("type") == "http").alias("http_flows"), (F.floor(F.avg("depth") * 10 + F.lit(0.5)) / F.lit(10.0)).alias("avg_depth"), F.max("criticality").alias("max_criticality"))


def affected_flows(graph: CodeGraph, members: FlowMembers, changed: DataFrame) -> DataFrame:
    """Entries whose flow holds a changed symbol that is no test: one walk back from these symbols."""
    hit = changed.join(graph.nodes.filter("NOT is_test").select("qualified_name"), "qualified_name", "left_semi").select(hashed("qualified_name", members.seed).alias("h")).filter("h IS NOT NULL")
    if members.numbered is not None:
        return _affected(members, hit)
    seen = frontier = cut(hit.distinct())
    for _ in range(members.max_depth):
        before = members.calls.join(small(frontier.withColumnRenamed("h", "b")), "b", "left_semi").select(F.col("a").alias("h")).distinct()
        frontier = cut(before.join(seen, "h", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return members.entries.withColumn("h", hashed("entry", members.seed)).join(seen, "h", "left_semi").select("entry", "type")


def _affected(members: FlowMembers, hit: DataFrame) -> DataFrame:
    """``affected_flows`` over numbered calls; a hit that has no number is a flow of its own at most."""
    ids, found = members.numbered.ids, hit.toArrow()["h"].to_numpy()
    at, there = walks.numbers_of(ids, found)
    seen = np.zeros(len(ids), bool)
    seen[at[there]] = True
    frontier = seen
    for _ in range(members.max_depth):
        frontier = members.numbered.callers(frontier) & ~seen
        if not frontier.any():
            break
        seen = seen | frontier
    met = np.unique(np.concatenate([ids[seen], found]))
    held = members.graph.nodes.sparkSession.sparkContext.broadcast(met)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, there = walks.numbers_of(held.value, batch.column("h").fill_null(0).to_numpy())
            yield batch.select(["entry", "type"]).filter(pa.array(there & batch.column("h").is_valid().to_numpy(zero_copy_only=False)))

    return members.entries.withColumn("h", hashed("entry", members.seed)).mapInArrow(look, "entry string, type string")


def spread_most(x: np.ndarray, y: np.ndarray, value: list[tuple[np.ndarray, np.ndarray]], max_depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, for each of ``value``, given as nodes and numbers, the greatest number that comes to each of ids in ``max_depth`` steps, else -1)."""
    ids, at, to = _indexed(x, y, np.concatenate([h for h, _ in value]))
    first = _starts(to)
    out = []
    for h, number in value:
        most = np.full(len(ids), -1, np.int64)
        np.maximum.at(most, np.searchsorted(ids, h), number)
        for _ in range(max_depth if len(to) else 0):
            new = most.copy()
            new[to[first]] = np.maximum(most[to[first]], np.maximum.reduceat(most[at], first))
            if np.array_equal(new, most):
                break
            most = new
        out.append(most)
    return ids, out


def _most_critical(members: FlowMembers, weights: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, http, test): the greatest criticality of the flows through ``asked`` (h) by type; weights: (h, type, criticality)."""
    kinds, max_depth = {"http": HTTP, "test": TEST}, members.max_depth

    def spread(held: dict) -> pa.RecordBatch | None:
        none = np.empty(0, np.int64)
        if ASKED not in held or not (HTTP in held or TEST in held):
            return None
        x, y = held.get(EDGE, (none, none))[:2]
        ids, most = spread_most(x, y, [held.get(k, (none, none))[:2] for k in (HTTP, TEST)], max_depth)
        h = held[ASKED][0]
        h = h[np.isin(h, ids)]
        values = [m[np.searchsorted(ids, h)] for m in most]
        return pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(v, mask=v < 0) for v in values)], ["h", "http", "test"])

    sides = rows_of(asked, ASKED, F.col("h"))
    for k, kind in kinds.items():
        sides = sides.union(rows_of(weights.filter(F.col("type") == k), kind, F.col("h"), F.col("criticality")))
    out = members.with_edges(sides, spread, "h long, http long, test long")
    if members.large and members.numbers is not None:
        return out.union(_spread_large(members, weights, asked))
    if members.large:
        of = members.of_large()
        calls = cut(members.calls.join(of.withColumnRenamed("h", "a"), "a", "left_semi"))
        most = cut(weights.join(of, "h", "left_semi").groupBy("h").agg(*(F.max(F.when(F.col("type") == k, F.col("criticality"))).alias(k) for k in kinds)))
        for _ in range(max_depth):
            came = calls.join(most.withColumnRenamed("h", "a"), "a").groupBy(F.col("b").alias("h")).agg(*(F.max(k).alias(k) for k in kinds))
            most = cut(most.union(came.select(*most.columns)).groupBy("h").agg(*(F.max(k).alias(k) for k in kinds)))
        out = out.union(most.join(asked, "h", "left_semi").select("h", "http", "test"))
    return out


def _spread_large(members: FlowMembers, weights: DataFrame, asked: DataFrame) -> DataFrame:
    """``_most_critical`` of large parts: rounds over packed edges, criticalities as their ranks."""
    ids, found = members.ids, weights.toArrow()
    at, there = walks.numbers_of(ids, found["h"].to_numpy())
    values, rank = np.unique(found["criticality"].to_numpy(), return_inverse=True)
    state = np.full((2, len(ids)), -1, np.int32)
    for row, kind in zip(state, ("http", "test")):
        mine = there & (found["type"].to_numpy(zero_copy_only=False) == kind)
        np.maximum.at(row, at[mine], rank[mine].astype(np.int32))
    held = members.graph.nodes.sparkSession.sparkContext.broadcast((ids, walks.spread_rounds(members.blocks, state, members.max_depth), values))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, state, values = held.value
        for batch in batches:
            h = batch.column(0).to_numpy()
            at, there = walks.numbers_of(ids, h)
            ranks = state[:, at[there]]
            yield pa.RecordBatch.from_arrays([pa.array(h[there]), *(pa.array(values[r], mask=r < 0) for r in ranks)], ["h", "http", "test"])

    return asked.filter("h IS NOT NULL").mapInArrow(look, "h long, http long, test long")


def score_blast(blast: DataFrame, members: FlowMembers, found: DataFrame) -> DataFrame:
    """``blast`` with impact_score: confidence weighed by the most critical flow through a node, http before test."""
    weights = cut(found.select(hashed("entry", members.seed).alias("h"), "type", "criticality"))
    blast = cut(blast)
    limit = weights.agg(F.greatest(F.max("criticality"), F.lit(1)).alias("most")).first()[0] or 1
    asked = blast.select(hashed("qualified_name", members.seed).alias("h")).distinct()
    through = _most_critical(members, weights, asked)
    weight = F.when(F.col("http").isNotNull(), F.least(F.col("http") / F.lit(limit), F.lit(1.0))).when(F.col("test").isNotNull(), F.lit(0.3) * F.least(F.col("test") / F.lit(limit), F.lit(1.0))).otherwise(0.1)
    return blast.withColumn("h", hashed("qualified_name", members.seed)).join(through, "h", "left").withColumn("impact_score", round2(F.col("confidence") * weight)).drop("h", "http", "test")


def shortest_path(graph: CodeGraph, start: str, end: str, kinds: Iterable[str] = ("CALLS",), max_depth: int = 10) -> DataFrame:
    """(step, qualified_name, via): a shortest path, of equal ones through the first predecessor by name; empty without one."""
    spark = graph.nodes.sparkSession
    known = {r[0] for r in graph.known().filter(F.col("qualified_name").isin(start, end)).select("qualified_name").collect()}
    schema = "step int, qualified_name string, via string"
    if not {start, end} <= known:
        return spark.createDataFrame([], schema)
    if start == end:
        return spark.createDataFrame([(0, start, None)], schema)
    nodes = graph.known().select(F.col("qualified_name").alias("target_qualified"))
    steps = cut(graph.of_kind(*kinds).join(nodes, "target_qualified", "left_semi").groupBy(F.col("source_qualified").alias("node"), F.col("target_qualified").alias("next")).agg(F.min("kind").alias("via")))
    seen = cut(spark.createDataFrame([(start, 0, None, None)], "node string, depth int, before string, via string"))
    frontier, found = seen, None
    for depth in range(1, max_depth + 1):
        reached = frontier.select("node").join(steps, "node").groupBy("next").agg(F.min(F.struct("node", "via")).alias("p"))
        reached = reached.select(F.col("next").alias("node"), F.lit(depth).alias("depth"), F.col("p.node").alias("before"), F.col("p.via").alias("via"))
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").select("node", "depth", "before", "via"))
        seen = seen.union(frontier)
        if not frontier.filter(F.col("node") == end).isEmpty():
            found = depth
            break
        if frontier.isEmpty():
            break
    if found is None:
        return spark.createDataFrame([], schema)
    rows, at = [], end
    for depth in range(found, 0, -1):
        step = seen.filter((F.col("node") == at) & (F.col("depth") == depth)).first()
        rows.append((depth, at, step["via"]))
        at = step["before"]
    return spark.createDataFrame([(0, start, None), *reversed(rows)], schema)


def overlap(graph: CodeGraph, a: DataFrame, b: DataFrame, max_depth: int = DEFAULT_DEPTH, min_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """(relation, qualified_name): shared_changed, a_impacts_b, b_impacts_a and shared_blast of two sets of changed symbols."""
    a, b = a.select("qualified_name").distinct(), b.select("qualified_name").distinct()
    steps = cut(impact_edges(graph, min_confidence))
    in_blast = [blast_radius(graph, s, max_depth, min_confidence, steps=steps).select("qualified_name") for s in (a, b)]
    marks = [d.withColumn(m, F.lit(True)) for d, m in ((a, "ca"), (b, "cb"), (in_blast[0], "ba"), (in_blast[1], "bb"))]
    every = marks[0]
    for m in marks[1:]:
        every = every.join(m, "qualified_name", "full_outer")
    yes = {m: F.coalesce(F.col(m), F.lit(False)) for m in ("ca", "cb", "ba", "bb")}
    relation = F.when(yes["ca"] & yes["cb"], "shared_changed").when(yes["ba"] & yes["cb"], "a_impacts_b").when(yes["bb"] & yes["ca"], "b_impacts_a").when(yes["ba"] & yes["bb"], "shared_blast")
    return every.select(relation.alias("relation"), "qualified_name").filter("relation IS NOT NULL")


def overlap_level(found: DataFrame) -> DataFrame:
    """HIGH with a shared changed symbol, MEDIUM where one change reaches the other's, LOW otherwise; with counts."""
    n = {k: F.count_if(F.col("relation") == k) for k in ("shared_changed", "a_impacts_b", "b_impacts_a", "shared_blast")}
    level = F.when(n["shared_changed"] > 0, "HIGH").when(n["a_impacts_b"] + n["b_impacts_a"] > 0, "MEDIUM").otherwise("LOW")
    return found.agg(level.alias("level"), *(c.alias(k) for k, c in n.items()))


def subsystem_context(graph: CodeGraph, members: DataFrame, touched: DataFrame) -> DataFrame:
    """(relation, qualified_name): callers and callees outside the communities that ``touched`` symbols belong to.

    ``members``: (qualified_name, community); ``touched``: (qualified_name).
    """
    inside = members.join(members.join(touched, "qualified_name", "left_semi").select("community").distinct(), "community", "left_semi").select("qualified_name")
    calls = graph.of_kind("CALLS").select("source_qualified", "target_qualified").distinct()
    target = calls.join(inside.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_semi")
    outer = target.join(inside.withColumnRenamed("qualified_name", "source_qualified"), "source_qualified", "left_anti").select(F.lit("caller").alias("relation"), F.col("source_qualified").alias("qualified_name"))
    source = calls.join(inside.withColumnRenamed("qualified_name", "source_qualified"), "source_qualified", "left_semi")
    inner = source.join(inside.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_anti").select(F.lit("callee"), "target_qualified")
    return outer.union(inner).distinct()
