"""Line items with the part that their customer bought next, by two exchanges of packed rows.

A join and a window over single rows write each row twice with its overhead; here a task writes one compressed
value for each bucket, so a line item takes a few bytes of disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.scratch import trim

#: Rows that a task holds before it deals them out; rows that come out at once.
DEALT, OUT = 500_000, 60_000
#: Bits of what is null in a row.
NO_LINE, NO_PART, NO_SUPPLIER, NO_CUSTOMER = 1, 2, 4, 8
ROWS = "bucket int, side int, z binary"


def tight(*arrays: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, the first ones, which are in order, as steps."""
    first = arrays[0]
    head, raw = [len(first), int(first[0]) if len(first) else 0], []
    for x in (np.diff(first, prepend=first[:1]), *arrays[1:]):
        least, most = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        narrow = next((t for t in (np.uint8, np.uint16, np.uint32) if most - least <= np.iinfo(t).max), None)
        x = (x - least).astype(narrow) if narrow else x.astype(np.int64)
        head += [least if narrow else 0, x.itemsize]
        raw.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return np.array(head, np.int64).tobytes() + pa.compress(b"".join(raw), "zstd", asbytes=True)


def loose(z: bytes, k: int) -> list[np.ndarray]:
    """The k arrays that ``tight`` took."""
    n, first, *head = np.frombuffer(z, np.int64, 2 + 2 * k).tolist()
    raw = np.frombuffer(pa.decompress(memoryview(z)[16 * (k + 1) :], n * sum(head[1::2]), "zstd"), np.uint8)
    out, at = [], 0
    for least, width in zip(head[::2], head[1::2]):
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel().astype(np.int64) + least)
        at += n * width
    return [np.cumsum(out[0]) + first, *out[1:]]


def deal(side: int, key: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """One row for each of n buckets that keys fall into."""
    bucket = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)
    by = np.lexsort((key, bucket))
    bucket, key, columns = bucket[by], key[by], [c[by] for c in columns]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(key) else []
    for i, j in zip(first, [*first[1:], len(key)]):
        yield pa.RecordBatch.from_arrays([pa.array([bucket[i]], pa.int32()), pa.array([side], pa.int32()), pa.array([tight(key[i:j], *(c[i:j] for c in columns))], pa.binary())], ["bucket", "side", "z"])


def _filled(column: pa.Array, bit: int) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), np.where(column.is_null().to_numpy(zero_copy_only=False), bit, 0)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    found: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for bucket, side, z in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found.setdefault(bucket, {}).setdefault(side, []).append(z)
    while found:
        yield found.popitem()[1]
    trim()


def _whole(pieces: list[bytes], k: int) -> list[np.ndarray]:
    every = [loose(z, k) for z in pieces]
    return [np.concatenate([e[c] for e in every] or [np.empty(0, np.int64)]) for c in range(k)]


def follows(lines: DataFrame, orders: DataFrame, tasks: int) -> DataFrame:
    """(c, p, s, n) of whole numbers: customer, part and supplier of each line item, and the customer's next part.

    ``lines``: (order, line, part, supplier), ``orders``: (order, customer), as long. All rows of a customer meet in one task.
    """
    n = 4 * tasks  # buckets; a task opens one at a time

    def lines_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order, line, part, supplier in _some(batches):
            (x, a), (y, b), (z, c) = (_filled(v, bit) for v, bit in ((line, NO_LINE), (part, NO_PART), (supplier, NO_SUPPLIER)))
            yield from deal(0, order.to_numpy(), [x, y, z, a | b | c], n)

    def orders_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order, customer in _some(batches):
            yield from deal(1, order.to_numpy(), list(_filled(customer, NO_CUSTOMER)), n)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _by_bucket(batches):
            if len(pieces) < 2:
                continue
            order, line, part, supplier, none = _whole(pieces[0], 5)
            key, customer, no = _whole(pieces[1], 3)
            by = np.argsort(key, kind="stable")
            key, customer, no = key[by], customer[by], no[by]
            low = np.searchsorted(key, order, "left")
            times = np.searchsorted(key, order, "right") - low
            at = np.repeat(np.arange(len(order)), times)
            of = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield from deal(0, customer[of], [order[at], line[at], part[at], supplier[at], none[at] | no[of]], n)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _by_bucket(batches):
            c, order, line, p, s, none = _whole(pieces[0], 6)
            keys = [s, p, line, order, c]
            if none.any():  # nulls come first, and are a customer of their own
                keys = [s, -(none & NO_SUPPLIER), p, -(none & NO_PART), line, -(none & NO_LINE), order, c, -(none & NO_CUSTOMER)]
            by = np.lexsort(keys)
            c, p, s, none = c[by], p[by], s[by], none[by]
            last = np.r_[(c[1:] != c[:-1]) | ((none[1:] ^ none[:-1]) & NO_CUSTOMER > 0), True][: len(c)]
            after, unknown = np.roll(p, -1), last | (np.roll(none, -1) & NO_PART > 0)
            for k in range(0, len(c), OUT):
                here = slice(k, k + OUT)
                yield pa.RecordBatch.from_arrays([pa.array(v[here], mask=m[here]) for v, m in ((c, none & NO_CUSTOMER > 0), (p, none & NO_PART > 0), (s, none & NO_SUPPLIER > 0), (after, unknown))], ["c", "p", "s", "n"])

    met = lines.filter(f"`{lines.columns[0]}` IS NOT NULL").mapInArrow(lines_out, ROWS).union(orders.filter(f"`{orders.columns[0]}` IS NOT NULL").mapInArrow(orders_out, ROWS))
    return met.repartition(tasks, "bucket").mapInArrow(join, ROWS).repartition(tasks, "bucket").mapInArrow(follow, "c long, p long, s long, n long")


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of DEALT rows or a few more."""
    more, n = [], 0
    for batch in batches:
        more.append(batch)
        n += batch.num_rows
        if n >= DEALT:
            yield [c.combine_chunks() for c in pa.Table.from_batches(more).columns]
            more, n = [], 0
    if n:
        yield [c.combine_chunks() for c in pa.Table.from_batches(more).columns]
    trim()
