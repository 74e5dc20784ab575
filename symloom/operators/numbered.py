"""Calls between numbered nodes, packed and compressed: many walks read them, and a call takes two or three bytes of disk.

A node's number is the place of its hash among all. The arrays of one number for each node are held by the driver
and sent to the tasks, so only graphs of at most ``communities.MOST`` nodes have their calls numbered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ..plans.scratch import cut, trim

#: Edges of a packed value, about.
CHUNK = 200_000
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting, which takes an eighth of its time on numbers of eight bytes."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def squeezed(*arrays: np.ndarray) -> bytes:
    # Bytes of equal place stand together, which compresses better.
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(z: bytes, *types: type) -> Iterator[np.ndarray]:
    n, at = int.from_bytes(z[:8], "little"), 0
    raw = pa.decompress(memoryview(z)[8:], n * sum(np.dtype(t).itemsize for t in types), "zstd")
    for t in types:
        width = np.dtype(t).itemsize
        yield np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(t).ravel()
        at += n * width


def edges_of(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[Edges]:
    """Callers, callees and confidences as codes of each packed value."""
    for batch in batches:
        for z in batch.column(column):
            yield tuple(unsqueezed(z.as_py(), np.int32, np.int32, np.uint8))


def packed(edges: Iterator[Edges]) -> Iterator[pa.RecordBatch]:
    more, n = [], 0
    for e in edges:
        more.append(e)
        n += len(e[0])
        if n >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array([_value(more)], pa.binary())], ["z"])
            more, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([_value(more)], pa.binary())], ["z"])


def _value(more: list[Edges]) -> bytes:
    return squeezed(*(np.concatenate([m[k] for m in more]).astype(t) for k, t in enumerate((np.int32, np.int32, np.uint8))))


@dataclass(frozen=True)
class Calls:
    """``values`` (z): packed calls, which may come again, none of a node by itself; ``ids``: hashes of all nodes in order; ``confidence`` of each code."""

    values: DataFrame
    ids: np.ndarray
    confidence: np.ndarray

    @property
    def tasks(self) -> int:
        return self.values.sparkSession.sparkContext.defaultParallelism

    @cached_property
    def shared(self) -> Broadcast:
        """``ids`` in the tasks, sent once for all walks."""
        return self.values.sparkSession.sparkContext.broadcast(self.ids)

    def pairs(self) -> DataFrame:
        """(a, b): hashes of caller and callee."""
        held = self.shared

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b, _ in edges_of(batches):
                yield pa.RecordBatch.from_arrays([pa.array(held.value[a]), pa.array(held.value[b])], ["a", "b"])

        return self.values.mapInArrow(unpack, "a long, b long")

    def parts(self) -> np.ndarray:
        """For each node the least number of those that it is connected with."""
        from .parts import forest

        n = len(self.ids)

        def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return label
            new, to = forest(x[apart], y[apart])
            moved = np.arange(n, dtype=np.int32)
            moved[new] = to
            return moved[label]

        def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label = np.arange(n, dtype=np.int32)
            for a, b, _ in edges_of(batches):
                label = join(label, a, b)
            yield pa.RecordBatch.from_arrays([pa.array([squeezed(label)], pa.binary())], ["z"])
            trim()

        label, every = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        for z in self.values.coalesce(self.tasks).mapInArrow(span, "z binary").toArrow()["z"]:
            (found,) = unsqueezed(z.as_py(), np.int32)
            label = join(label, every, found)
        return label

    def count_by(self, label: np.ndarray) -> np.ndarray:
        """How many calls have a caller of each label (a number)."""
        n, held = len(self.ids), self.values.sparkSession.sparkContext.broadcast(label)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n, np.int64)
            for a, _, _ in edges_of(batches):
                out += np.bincount(held.value[a], minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array([squeezed(out)], pa.binary())], ["z"])
            trim()

        out = np.zeros(n, np.int64)
        for z in self.values.coalesce(self.tasks).mapInArrow(count, "z binary").toArrow()["z"]:
            out += next(unsqueezed(z.as_py(), np.int64))
        held.destroy()
        return out

    def callers(self, of: np.ndarray) -> np.ndarray:
        """Which nodes call one of ``of`` (a truth value for each node)."""
        n, held = len(self.ids), self.values.sparkSession.sparkContext.broadcast(of)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n, bool)
            for a, b, _ in edges_of(batches):
                out[a[held.value[b]]] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], ["z"])

        found = self.values.coalesce(self.tasks).mapInArrow(step, "z binary").toArrow()["z"].to_pylist()
        held.destroy()
        return np.unpackbits(np.bitwise_or.reduce([np.frombuffer(z, np.uint8) for z in found] or [np.zeros(-(-n // 8), np.uint8)]), count=n).astype(bool)


def better_of(to: np.ndarray, value: np.ndarray, tie: np.ndarray) -> Edges:
    """For each of ``to`` the greatest value, and of equal ones the least tie."""
    by = np.lexsort((tie, -value, to))
    first = by[np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]])] if len(by) else by
    return to[first], value[first], tie[first]


def best_steps(calls: Calls, more: DataFrame, accept: Callable[[np.ndarray, np.ndarray], np.ndarray], acc: np.ndarray, origin: np.ndarray, seeds: np.ndarray, origins: int, least: float) -> Edges:
    """One step against the calls and along ``more`` (from, to, kind, conf: numbers, a kind's place): reached nodes, the best product of
    ``acc`` (below 0: no node to step from) and confidence, and of equal ones the first kind and origin as kind * origins + origin."""
    spark, n = calls.values.sparkSession, len(calls.ids)
    held = spark.sparkContext.broadcast((acc, origin, seeds))
    conf, tasks = calls.confidence, calls.tasks
    size = -(-n // (2 * tasks))

    def step(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        acc, origin, seeds = held.value
        best, ties = np.full(n, -1.0), np.zeros(n, np.int64)
        for at, to, kind, c in rows:
            k = np.flatnonzero((acc[at] >= 0) & ~seeds[to])
            at, to = at[k], to[k]
            to, value, tie = better_of(to, acc[at] * c[k], kind[k] * origins + origin[at])
            up = (value > best[to]) | ((value == best[to]) & (tie < ties[to]))
            best[to[up]], ties[to[up]] = value[up], tie[up]
        yield from buckets(np.flatnonzero(best >= 0), best, ties)
        del best, ties
        trim()

    def buckets(found: np.ndarray, best: np.ndarray, ties: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(found // size).tolist():
            some = found[found // size == k]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeezed(some.astype(np.int32), best[some], ties[some])], pa.binary())], ["bucket", "z"])

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for a, b, code in edges_of(batches):
                k = np.flatnonzero((held.value[0][b] >= 0) & (conf[code] >= least))
                a, b, code = a[k], b[k], code[k]
                k = np.flatnonzero(accept(a, b))
                yield b[k], a[k], np.zeros(len(k), np.int64), conf[code[k]]

        return step(rows())

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return step(tuple(b.column(k).to_numpy() for k in range(4)) for b in batches)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(unsqueezed(z.as_py(), np.int32, np.float64, np.int64)) for batch in batches for z in batch.column(1)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([squeezed(*better_of(*(np.concatenate([f[k] for f in found]) for k in range(3))))], pa.binary())], ["z"])
        del found
        trim()

    rows = calls.values.coalesce(tasks).mapInArrow(against, "bucket int, z binary").union(more.coalesce(tasks).mapInArrow(along, "bucket int, z binary"))
    found = [tuple(unsqueezed(z.as_py(), np.int32, np.float64, np.int64)) for z in rows.repartition(2 * tasks, "bucket").mapInArrow(merge, "z binary").toArrow()["z"]]
    held.destroy()
    return tuple(np.concatenate([f[k] for f in found] or [np.empty(0, t)]) for k, t in enumerate((np.int32, np.float64, np.int64)))


def number_rows(df: DataFrame, ids: Broadcast, columns: int) -> DataFrame | None:
    """``df`` with hashes in its first ``columns`` columns as numbers, written; None if one of them is not among ``ids``."""
    from .walks import numbers_of

    rest = df.schema.fields[columns:]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbers_of(ids.value, batch.column(k).fill_null(0).to_numpy()) for k in range(columns)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.where(there, at, -1).astype(np.int32)) for at, there in found), *batch.columns[columns:]], batch.schema.names)

    schema = ", ".join([f"`{c}` int" for c in df.columns[:columns]] + [f"`{f.name}` {f.dataType.simpleString()}" for f in rest])
    out = cut(df.mapInArrow(number, schema))
    return out if out.filter(" OR ".join(f"`{c}` < 0" for c in df.columns[:columns])).isEmpty() else None
