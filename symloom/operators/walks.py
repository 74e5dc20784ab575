"""Walks over a part that is too large for one task's edges: entries are dealt out, edges go to every group of entries.

Nodes are numbers. A walk keeps one row of bits for each inner node (one that is called and calls), a bit for each
entry of a batch. Nodes that call nothing are looked at when a walk ends; nodes that nothing calls matter as entries only.
Edges stand in order of their targets, those beyond HELD bytes in a temporary file without a name. Walks of few steps,
which meet few nodes, go from callers instead, as pairs of entry and node.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import cut, settle, trim
from .numbered import distinct, edges_of, squeezed, unsqueezed

#: Bytes of the bits of a batch, one of three tables of that size that a task holds; targets that are met at once; edges of a packed block, about.
STATE, SPAN, BLOCK_EDGES = 56 << 20, 1 << 13, 500_000
#: Bytes of the edges of inner nodes, and of last ones, that a task holds in memory.
HELD = 192 << 20
#: Nodes that an entry meets, about, up to which a walk goes by pairs; pairs that a task meets at once.
FEW, PAIRS = 4096, 4_000_000


def bit_sums(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit set."""
    out = np.zeros(words.shape[1] * 64, np.int64)
    full = (words == ~np.uint64(0)).all(axis=1)
    out += np.count_nonzero(full)
    words = words[~full]
    for k in range(0, len(words), 16384):
        out += np.unpackbits(np.ascontiguousarray(words[k : k + 16384]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return out


class Into:
    """Edges by target, SPAN targets at a time: those of most sources first, the first source of each, then the second of each, ..."""

    def __init__(self, targets: int):
        self.targets, self.file, self.spans, self.size, self.held = targets, tempfile.TemporaryFile(), [], 0, 0

    def add(self, to: np.ndarray, counts: np.ndarray, src: np.ndarray) -> None:
        """Targets with the numbers of their sources, which stand one target after another in ``src``."""
        ends = np.cumsum(counts)
        for lo in range(0, len(to), SPAN):
            n = counts[lo : lo + SPAN]
            by = np.argsort(-n, kind="stable")
            n, start = n[by], (ends[lo : lo + SPAN] - n)[by]
            width = np.searchsorted(-n, -np.arange(n[0]), side="left") if len(n) else n  # targets of more than j sources
            step = np.repeat(np.arange(len(width)), width)
            at = np.r_[0, np.cumsum(width)]
            row = np.arange(at[-1]) - at[step]
            found, base = np.ascontiguousarray(src[start[row] + step], np.int32), None
            if self.held + found.nbytes <= HELD:
                self.held += found.nbytes
            else:
                self.file.write(found.tobytes())
                found, base = None, self.size
                self.size += int(at[-1])
            self.spans.append((to[lo : lo + SPAN][by], found, base, at))

    def close(self) -> None:
        self.file.flush()
        far = np.memmap(self.file, np.int32, "r") if self.size else np.empty(0, np.int32)
        self.spans = [(to, far[base : base + int(at[-1])] if src is None else src, at) for to, src, base, at in self.spans]

    def pull(self, rows: np.ndarray, out: np.ndarray, full: np.ndarray) -> None:
        """Sets in ``out`` the bits of ``rows`` of each target's sources; targets with all bits of ``full`` need no more."""
        live = rows.any(axis=1)
        few = np.count_nonzero(live) < 0.03 * len(live)
        room = np.empty((min(SPAN, self.targets), rows.shape[1]), np.uint64)
        for to, every, at in self.spans:
            if few:
                k = np.flatnonzero(live[every])
                if len(k):
                    target = to[k - at[np.searchsorted(at, k, side="right") - 1]]
                    by = np.argsort(target, kind="stable")
                    target = target[by]
                    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
                    out[target[first]] |= np.bitwise_or.reduceat(rows[every[k[by]]], first, axis=0)
                continue
            acc, left = out[to], None
            for j in range(len(at) - 1):
                src = every[at[j] : at[j + 1]]
                if j % 4 == 0:
                    open_ = np.flatnonzero((acc[: len(src)] != full).any(axis=1))
                    if not len(open_):
                        break
                    left = open_ if len(open_) < 0.7 * len(src) else None
                if left is not None:
                    left = left[: np.searchsorted(left, len(src))]
                    acc[left] |= rows[src[left]]
                else:
                    acc[: len(src)] |= np.take(rows, src, axis=0, out=room[: len(src)], mode="clip")
            out[to] = acc


def _new_bits(after: np.ndarray, before: np.ndarray | None, n: int) -> np.ndarray:
    """Which of n bits any row of ``after`` has that it lacks in ``before``."""
    held = np.zeros(after.shape[1], np.uint64)
    for k in range(0, len(after), 1 << 16):
        some = after[k : k + (1 << 16)]
        held |= np.bitwise_or.reduce(some if before is None else some & ~before[k : k + (1 << 16)], axis=0)
    return np.unpackbits(held.view(np.uint8), bitorder="little")[:n].astype(bool)


def _set(rows: np.ndarray, at: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(rows, (at, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))


def reach_counts(inner: Into, last: Into, own: np.ndarray, links: tuple[np.ndarray, np.ndarray], file: np.ndarray, own_file: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, nodes and files of what each entry of a batch reaches.

    Nodes are numbered, the inner ones first, then those that call nothing; ``own``: numbers of the entries, -1 for one that
    nothing calls, whose callees are ``links`` (place in the batch, number). ``file``: of each node, -1 for none, as in ``own_file``.
    A last node counts at the step after its callers, so that only the step after a walk's end has to be looked at.
    """
    n, ni, nl = len(own), inner.targets, last.targets
    words = -(-n // 64)
    full = np.full(words, ~np.uint64(0))
    if n % 64:
        full[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    depth, going = np.zeros(n, np.int64), np.ones(n, bool)
    before, now, ends = None, np.zeros((ni, words), np.uint64), np.zeros((nl, words), np.uint64)
    at = np.flatnonzero((own >= 0) & (own < ni))
    _set(now, own[at], at)
    direct = np.zeros((nl, words), np.uint64)
    bit, to = links
    _set(direct, to[to >= ni] - ni, bit[to >= ni])

    def met(rows: np.ndarray | None) -> np.ndarray:
        out = direct.copy() if rows is not None else np.zeros_like(direct)
        if rows is not None:
            last.pull(rows, out, full)
        return out

    for step in range(1, max_depth + 1):
        new = now.copy()
        inner.pull(now, new, full)
        if step == 1:
            _set(new, to[to < ni], bit[to < ni])
        fresh = _new_bits(new, now, n)
        depth[fresh] = step
        over = going & ~fresh
        if over.any() and nl:
            ends = met(now)
            depth[over & _new_bits(ends, met(before), n)] = step
        going &= fresh
        if not going.any():
            break
        before, now = now, new
    else:
        ends = met(before)
    nodes = (bit_sums(now) + bit_sums(ends))[:n]
    apart = np.flatnonzero((own < 0) | (own >= ni))
    nodes[apart] += 1
    held = np.zeros((int(max(file.max(initial=-1), own_file.max(initial=-1))) + 1, words), np.uint64)
    for rows, of in ((now, file[:ni]), (ends, file[ni:])):
        by = np.argsort(of, kind="stable")
        by = by[np.searchsorted(of[by], 0) :]
        for k in range(0, len(by), 1 << 16):
            some = by[k : k + (1 << 16)]
            first = np.flatnonzero(np.r_[True, of[some][1:] != of[some][:-1]])
            held[of[some][first]] |= np.bitwise_or.reduceat(rows[some], first, axis=0)
    apart = apart[own_file[apart] >= 0]
    _set(held, own_file[apart], apart)
    return depth, nodes, bit_sums(held)[:n]


class From:
    """Callees by caller, of the numbers below ``callers``."""

    def __init__(self, callers: int):
        self.callers, self.pieces = callers, []

    def add(self, base: int, to: bytes, counts: bytes, src: bytes) -> None:
        """As compressed; targets are numbers from ``base``."""
        self.pieces.append((base, to, counts, src))

    def close(self) -> None:
        width = np.zeros(self.callers + 1, np.int64)
        for *_, z in self.pieces:
            src = np.cumsum(next(unsqueezed(z, np.int32)), dtype=np.int32)
            width[1:] += np.bincount(src, minlength=self.callers)
        self.at = np.cumsum(width)
        self.to, free = np.empty(self.at[-1], np.int32), self.at[:-1].copy()
        while self.pieces:
            base, *piece = self.pieces.pop()
            to, counts, src = (next(unsqueezed(z, np.int32)) for z in piece)
            src = np.cumsum(src, dtype=np.int32)
            by = np.argsort(src, kind="stable")
            to, src = np.repeat(to + np.int32(base), counts)[by], src[by]
            first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])[: len(src)]
            run = np.diff(np.r_[first, len(src)])
            self.to[np.repeat(free[src[first]] - first, run) + np.arange(len(src))] = to
            free[src[first]] += run

    def after(self, pairs: np.ndarray, n: int) -> np.ndarray:
        """Pairs (bit * n + node) one step on, which may come again."""
        bit, node = np.divmod(pairs, n)
        calls = node < self.callers
        bit, node = bit[calls], node[calls]
        run = self.at[node + 1] - self.at[node]
        at = np.repeat(self.at[node] - np.cumsum(run) + run, run) + np.arange(run.sum())
        return np.repeat(bit * n, run) + self.to[at]

    def many(self, pairs: np.ndarray, n: int) -> bool:
        node = pairs % n
        node = node[node < self.callers]
        return int((self.at[node + 1] - self.at[node]).sum()) > PAIRS


def reach_few(calls: From, own: np.ndarray, links: tuple[np.ndarray, np.ndarray], file: np.ndarray, own_file: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``reach_counts`` by pairs of entry and node; a batch that meets too many at once goes in halves."""
    count, n = len(own), max(1, len(file))
    at = np.flatnonzero(own >= 0)
    seen = front = at * n + own[at]
    first = np.sort(links[0] * n + links[1])
    depth = np.zeros(count, np.int64)
    for step in range(1, max_depth + 1):
        if count > 1 and (calls.many(front, n) or len(seen) > PAIRS):
            half, (bit, to) = count // 2, links
            low = bit < half
            two = [reach_few(calls, own[s], (b, t), file, own_file[s], max_depth) for s, b, t in ((slice(0, half), bit[low], to[low]), (slice(half, None), bit[~low] - half, to[~low]))]
            return tuple(np.concatenate(x) for x in zip(*two))
        new = calls.after(front, n)
        new = distinct(np.concatenate([new, first]) if step == 1 else new)
        front = new[~numbers_of(seen, new)[1]]
        if not len(front):
            break
        depth[front // n] = step
        seen = np.sort(np.concatenate([seen, front]))
    bit, node = np.divmod(seen, n)
    apart = own < 0
    nodes = np.bincount(bit, minlength=count) + apart
    files = int(max(file.max(initial=-1), own_file.max(initial=-1))) + 1
    of = file[node].astype(np.int64)
    apart = np.flatnonzero(apart & (own_file >= 0))
    held = distinct(np.concatenate([(bit * files + of)[of >= 0], apart * files + own_file[apart]]))
    return depth, nodes, np.bincount(held // max(1, files), minlength=count)


def numbers_of(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted ``ids``, and which of x are there."""
    if not len(ids):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    k = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return k, ids[k] == x


def blocks_of(calls: DataFrame, ids: np.ndarray, edges: int, place: np.ndarray | None = None) -> DataFrame:
    """(block, to, n, src): distinct edges (a, b) between ``ids`` as numbers, all of a target in one row.

    With ``place``, calls are packed values, and it has for each of their nodes its place in ``ids`` or -1."""
    spark, n, groups = calls.sparkSession, len(ids), max(1, edges // BLOCK_EDGES)
    held = spark.sparkContext.broadcast(ids if place is None else place)

    numbered = place is not None

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if numbered:
            for a, b, _ in edges_of(batches):
                x, y = held.value[a], held.value[b]
                both = (x >= 0) & (y >= 0)
                yield x[both].astype(np.int64), y[both].astype(np.int64)
            return
        for batch in batches:
            (x, here), (y, there) = (numbers_of(held.value, batch.column(k).to_numpy()) for k in (0, 1))
            yield x[here & there], y[here & there]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            x, y = (np.concatenate([m[k] for m in more]) for k in (0, 1))
            block = y * groups // n
            by = np.argsort(block, kind="stable")
            x, y, block = x[by].astype(np.int32), y[by].astype(np.int32), block[by]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            spans = list(zip(first.tolist(), [*first[1:].tolist(), len(x)]))
            return pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), *(pa.array([c[i:j].tobytes() for i, j in spans], pa.binary()) for c in (x, y))], ["block", "x", "y"])

        for x, y in between(batches):
            if len(x):
                more.append((x, y))
            if sum(len(m[0]) for m in more) >= BLOCK_EDGES:
                yield out()
                more = []
        if more:
            yield out()
        more = []
        trim()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []

        def out() -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(p[k] for p in pieces), np.int32) for k in (0, 1))
            key = distinct(y.astype(np.int64) * n + x)
            to, counts = np.unique(key // n, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in (to, counts, key % n))], ["block", "to", "n", "src"])

        for batch in batches:
            for block, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if block != now and pieces:
                    yield out()
                    pieces = []
                now = block
                pieces.append((x, y))
        if pieces:
            yield out()
        pieces = []
        trim()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = calls.mapInArrow(pack, "block int, x binary, y binary").repartition(tasks, "block").sortWithinPartitions("block")
    out = cut(packed.mapInArrow(sort, "block int, to binary, n binary, src binary"))
    held.destroy()
    settle(spark)
    return out


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    for k in range(batch.num_rows):
        yield tuple(np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in names)


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, as sources of a target stand in order and so take less when compressed; ``cumsum`` undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


def _ends(blocks: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of n nodes call, which are called, and how many edges there are."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, called, edges = np.zeros(n, bool), np.zeros(n, bool), 0
        for batch in batches:
            for to, src in _arrays(batch, "to", "src"):
                called[to] = True
                call[src] = True
                edges += len(src)
        yield pa.RecordBatch.from_arrays([*(pa.array([np.packbits(b).tobytes()], pa.binary()) for b in (call, called)), pa.array([edges], pa.int64())], ["call", "called", "edges"])

    found = blocks.select("to", "src").mapInArrow(mark, "call binary, called binary, edges long").toArrow()
    return *(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in found[k].to_pylist()]), count=n).astype(bool) for k in ("call", "called")), sum(found["edges"].to_pylist())


def _apart(spark: SparkSession, n: int) -> list[int]:
    """n keys that a hash of the key deals to n tasks."""
    found = spark.range(200 * n).selectExpr("id", f"pmod(hash(id), {n}) AS task").groupBy("task").agg(F.min("id")).collect()
    return [r[1] for r in found]


def count_reach(blocks: DataFrame, ids: np.ndarray, entries: np.ndarray, file: np.ndarray, max_depth: int) -> DataFrame:
    """(h, depth, node_count, file_count) of ``entries`` (numbers) over ``blocks``; ``file``: of each node, -1 for none."""
    spark, n = blocks.sparkSession, len(ids)
    call, called, edges = _ends(blocks, n)
    few = (edges / max(1, np.count_nonzero(call))) ** max_depth <= FEW
    inner, last = np.flatnonzero(call & called), np.flatnonzero(called & ~call)
    number = np.full(n, -1, np.int32)
    number[inner], number[last] = np.arange(len(inner)), len(inner) + np.arange(len(last))
    # Entries that nothing calls walk together, as do the others; batches are dealt to the groups in turn.
    words = 4 if few else max(1, min(STATE // (8 * max(1, len(inner))), 64))
    # Pairs walk fast and need all edges in memory: a group for every two tasks that run at once, as an executor has room for one.
    keys = _apart(spark, max(1, min(spark.sparkContext.defaultParallelism // (2 if few else 1), -(-len(entries) // 64))))
    words = max(1, min(words, -(-len(entries) // (64 * len(keys)))))
    entries = entries[np.argsort(number[entries] >= 0, kind="stable")]
    batch_of = np.arange(len(entries)) // (64 * words)
    group = np.full(n, -1, np.int32)
    group[entries] = batch_of % len(keys)
    held = spark.sparkContext.broadcast((number, call, called, group, np.asarray(keys)))
    walk_with = spark.sparkContext.broadcast((entries.astype(np.int32), number[entries], file[entries].astype(np.int32), ids[entries], file[np.r_[inner, last]].astype(np.int32), len(inner), len(last)))
    place = {k: g for g, k in enumerate(keys)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, call, called, group, keys = held.value
        ni = np.count_nonzero(call & called)
        for batch in batches:
            rows = []
            for to, count, src in _arrays(batch, "to", "n", "src"):
                each = np.repeat(to, count)
                walked = called[src]
                for kind, base in ((0, 0), (1, ni)):
                    mine = walked & (call[each] == (kind == 0))
                    if mine.any():
                        t, c = np.unique(number[each[mine]], return_counts=True)
                        rows.append((None, kind, t - base, c, steps(number[src[mine]])))
                for g in np.unique(group[src[~walked]]).tolist():
                    if g >= 0:
                        mine = ~walked & (group[src] == g)
                        rows.append((int(keys[g]), 2, src[mine], number[each[mine]], src[:0]))
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array([r[1]], pa.int32()), *(pa.array([squeezed(np.asarray(c, np.int32))], pa.binary()) for c in r[2:])], ["key", "kind", "x", "y", "z"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, own, own_file, names, file, ni, nl = walk_with.value
        found: dict[int, tuple[Into | From, Into | None, list]] = {}
        for batch in batches:
            for key, kind, *values in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "x", "y", "z"))):
                if key not in found:
                    found[key] = (From(ni), None, []) if few else (Into(ni), Into(nl), [])
                if few and kind < 2:
                    found[key][0].add(ni * kind, *values)
                    continue
                x, y, z = (next(unsqueezed(v, np.int32)) for v in values)
                if kind < 2:
                    found[key][kind].add(x, y.astype(np.int64), np.cumsum(z, dtype=np.int32))
                else:
                    found[key][2].append((x.copy(), y.copy()))
        order = np.argsort(entries)
        size = 64 * words
        trim()
        for key, (into, ends, more) in found.items():
            into.close()
            trim()
            if not few:
                ends.close()
            links = [np.concatenate([m[k] for m in more]) if more else np.empty(0, np.int32) for k in (0, 1)]
            at = order[np.searchsorted(entries[order], links[0])]
            for lo in range(place[key] * size, len(entries), size * len(place)):
                here = slice(lo, lo + size)
                mine = (at >= lo) & (at < lo + size)
                side = own[here].astype(np.int64), (at[mine] - lo, links[1][mine].astype(np.int64)), file, own_file[here], max_depth
                got = reach_few(into, *side) if few else reach_counts(into, ends, *side)
                yield pa.RecordBatch.from_arrays([pa.array(names[here]), pa.array(got[0].astype(np.int32)), pa.array(got[1]), pa.array(got[2])], ["h", "depth", "node_count", "file_count"])

    every = F.array(*(F.lit(k).cast("long") for k in keys))
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    spark.conf.set(records, 4)  # rows of a megabyte or two
    try:
        # A group's key goes to its task even if no edge does.
        none = squeezed(np.empty(0, np.int32))
        start = spark.createDataFrame([(int(k), 2, none, none, none) for k in keys], "key long, kind int, x binary, y binary, z binary")
        rows = blocks.mapInArrow(split, "key long, kind int, x binary, y binary, z binary").withColumn("key", F.explode(F.when(F.col("key").isNull(), every).otherwise(F.array("key"))))
        return cut(rows.union(start).repartition(len(keys), "key").mapInArrow(walk, "h long, depth int, node_count long, file_count long"))
    finally:
        spark.conf.set(records, before)
        held.destroy()


def spread_rounds(blocks: DataFrame, state: np.ndarray, max_depth: int) -> np.ndarray:
    """``state``, rows of a number for each node, after the greatest of each node's callers came to it ``max_depth`` times."""
    context = blocks.sparkSession.sparkContext
    columns = [f"m{k}" for k in range(len(state))]
    for _ in range(max_depth):
        held = context.broadcast(state)

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for to, count, src in _arrays(batch, "to", "n", "src"):
                    first = np.r_[0, np.cumsum(count)[:-1]]
                    most = [np.maximum.reduceat(row[src], first) for row in held.value]
                    up = np.any([m > row[to] for m, row in zip(most, held.value)], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(c[up]) for c in (to, *most)], ["id", *columns])

        found = blocks.mapInArrow(step, "id int, " + ", ".join(f"{c} int" for c in columns)).toArrow()
        held.destroy()
        if not len(found):
            break
        state, at = state.copy(), found["id"].to_numpy()
        for row, c in zip(state, columns):
            row[at] = np.maximum(row[at], found[c].to_numpy())
    return state
