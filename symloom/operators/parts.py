"""Connected parts of a graph, each whole in one task.

Names travel as 64-bit hashes. A task reduces its edges to a spanning forest,
so finding the parts moves a few links for each node; then the edges of a part
are packed and met in one place, and a walk of many levels is a loop over arrays.
Parts of more than LARGE edges are left to the caller, who walks them by joins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, small, trim  # noqa: F401
from .numbered import Calls, Edges, edges_of, squeezed, unsqueezed

#: Kinds of rows that parts of the call graph are packed with; a link is a packed value of edges between numbers.
LINK, EDGE = -1, 0
#: Edges of a part that one task takes at most; edges and rows that a task holds before it folds or packs them.
LARGE, CHUNK, PACK = 8_000_000, 500_000, 500_000
ROWS = "h long, y long, kind int, name string"
PACKED = "part long, kind int, n long, x binary, y binary, z binary"


def seed_of(nodes: DataFrame) -> int:
    """A seed under which no two names of ``nodes`` share a hash."""
    names = nodes.select("qualified_name").distinct()
    return next(s for s in range(42, 142) if names.groupBy(hashed("qualified_name", s).alias("h")).count().filter("count > 1").isEmpty())


def hashed(name: str | Column, seed: int) -> Column:
    """Null stays null, so that it meets nothing."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.isNotNull(), F.xxhash64(F.lit(seed), c))


def rows_of(df: DataFrame, kind: int, h: Column, y: Column | None = None, name: Column | None = None) -> DataFrame:
    """(h, y, kind, name), as ``packed`` takes them."""
    text = F.lit(None).cast("string") if name is None else name
    return df.select(h.alias("h"), (F.lit(0) if y is None else y).cast("long").alias("y"), F.lit(kind).alias("kind"), text.alias("name")).filter("h IS NOT NULL AND y IS NOT NULL")


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (x, y) with the least node that it is connected with."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = np.arange(len(ids))
    a, b = at[: len(x)], at[len(x) :]
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return ids, ids[label]
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def _looked_up(ids: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``value`` of each x that is among the sorted ``ids``, else x itself."""
    if not len(ids):
        return x
    k = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where(ids[k] == x, value[k], x)


def _span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, more, n = (np.empty(0, np.int64),) * 2, [], 0

    def fold():
        ids, root = held
        x, y = (_looked_up(ids, root, np.concatenate([m[k] for m in more] or [ids[:0]])) for k in (0, 1))
        apart = x != y
        if not apart.any():
            return held
        new, to = forest(x[apart], y[apart])
        root = _looked_up(new, to, root)
        fresh = ~np.isin(new, ids, assume_unique=True)
        ids, root = np.concatenate([ids, new[fresh]]), np.concatenate([root, to[fresh]])
        by = np.argsort(ids)
        return ids[by], root[by]

    for batch in batches:
        more.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            held, more, n = fold(), [], 0
    held = fold()
    for k in range(0, len(held[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in held], ["a", "b"])


def parts_of(links: DataFrame) -> DataFrame:
    """(h, part) of the nodes of ``links`` (a, b): hashes of names, and one name's hash for all that are connected."""
    from . import communities
    from .communities import connected_parts

    tasks = 2 * links.sparkSession.sparkContext.defaultParallelism
    found = cut(links.coalesce(tasks).mapInArrow(_span, "a long, b long"))
    # Forests of at most MOST nodes are folded into each other, a few at a time; larger ones meet in rounds.
    while found.count() <= communities.MOST * tasks:
        if tasks == 1:
            return found.toDF("h", "part")
        tasks = -(-tasks // 4)
        found = cut(found.coalesce(tasks).mapInArrow(_span, "a long, b long"))
    found = cut(found.distinct())
    return cut(connected_parts(found.union(found.select("b", "a"))).toDF("h", "part"))


def packed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` packed by the part of h; what is in no part is one of its own."""
    return dealt(rows.join(parts, "h", "left").select(F.coalesce("part", "h").alias("part"), "kind", "h", "y", "name"))


def dealt(rows: DataFrame) -> DataFrame:
    """(part, kind, n, x, y, z): rows of (part, kind, h, y, name) by part and kind, arrays of h and y as bytes, and names if there are any."""
    return rows.mapInArrow(packing(), PACKED)


def packing(before: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``dealt`` does in a task, with what ``before`` makes of the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            part, kind, h, y = (np.concatenate([m.column(k).to_numpy() for m in more]) for k in range(4))
            names = [x for m in more for x in m.column(4).to_pylist()] if any(m.column(4).null_count < m.num_rows for m in more) else None
            by = np.lexsort((h, kind, part))
            part, kind, h, y = part[by], kind[by], h[by], y[by]
            first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            ends = [*first[1:].tolist(), len(part)]
            for lo in range(0, len(first), 256):
                span = list(zip(first[lo : lo + 256].tolist(), ends[lo : lo + 256]))
                at = first[lo : lo + 256]
                z = [pickle.dumps([names[k] for k in by[i:j].tolist()]) if names else b"" for i, j in span]
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(kind[at]), pa.array([j - i for i, j in span], pa.int64()), pa.array([h[i:j].tobytes() for i, j in span], pa.binary()), pa.array([y[i:j].tobytes() for i, j in span], pa.binary()), pa.array(z, pa.binary())], ["part", "kind", "n", "x", "y", "z"])

        for batch in before(batches):
            if batch.num_rows:
                more.append(batch)
            if sum(m.num_rows for m in more) >= PACK:
                yield from out()
                more = []
        if more:
            yield from out()

    return pack


def large_parts(edges: DataFrame) -> list[int]:
    """Parts of packed edges that are too large for a task; they are at most all edges over LARGE."""
    return [r[0] for r in edges.groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") > LARGE).select("part").collect()]


def links_by_part(calls: Calls, part: np.ndarray, apart: np.ndarray) -> DataFrame:
    """Calls packed by the part of the caller, as rows of kind LINK, without those of the nodes that are ``apart``."""
    shared, held = calls.shared, calls.values.sparkSession.sparkContext.broadcast((part, apart))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (part, apart) = shared.value, held.value
        more: list[Edges] = []

        def out() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([m[k] for m in more]) for k in (0, 1))
            of = part[a]
            by = np.argsort(of, kind="stable")
            a, b, of = a[by], b[by], of[by]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            ends = [*first[1:].tolist(), len(of)]
            for lo in range(0, len(first), 256):
                span = list(zip(first[lo : lo + 256].tolist(), ends[lo : lo + 256]))
                none = pa.array([b""] * len(span), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[first[lo : lo + 256]]]), pa.array(np.full(len(span), LINK, np.int32)), pa.array([j - i for i, j in span], pa.int64()), pa.array([squeezed(a[i:j], b[i:j]) for i, j in span], pa.binary()), none, none], ["part", "kind", "n", "x", "y", "z"])

        for a, b, _ in edges_of(batches):
            here = ~apart[a]
            if here.any():
                more.append((a[here], b[here]))
            if sum(len(m[0]) for m in more) >= 2 * PACK:
                yield from out()
                more = []
        if more:
            yield from out()
        more = []
        trim()

    return calls.values.mapInArrow(pack, PACKED)


Held = dict[int, tuple[np.ndarray, np.ndarray, list]]


def by_part(rows: DataFrame, f: Callable[[Held], pa.RecordBatch | None], schema: str, ids: Broadcast | None = None) -> DataFrame:
    """What ``f`` makes of the rows of each part: kind -> (h, y, names); rows of kind LINK, numbers of ``ids``, come as those of EDGE."""

    def whole(pieces: dict[int, list]) -> pa.RecordBatch | None:
        if found := [tuple(unsqueezed(p[0], np.int32, np.int32)) for p in pieces.pop(LINK, [])]:
            pieces[EDGE] = pieces.get(EDGE, []) + [tuple(ids.value[np.concatenate([e[k] for e in found])].tobytes() for k in (0, 1)) + (b"",)]
        return f({k: (*(np.frombuffer(b"".join(p[c] for p in v), np.int64) for c in (0, 1)), [x for p in v if p[2] for x in pickle.loads(p[2])]) for k, v in pieces.items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, {}
        for batch in batches:
            for part, kind, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "x", "y", "z"))):
                if part != now and pieces:
                    if (made := whole(pieces)) is not None:
                        yield made
                    pieces, made = {}, None
                    trim()
                now = part
                pieces.setdefault(kind, []).append((x, y, z))
        if pieces and (made := whole(pieces)) is not None:
            yield made
        pieces = made = None
        trim()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(each, schema)
