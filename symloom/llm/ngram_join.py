"""N-gram Jaccard join by signature trees.

1. Candidate groups. A document is the set of its word shingles. Two sets of
   similarity t or more differ in at most (1 - t) / (1 + t) of the sum of their
   sizes. Sizes fall into classes such that partners stand in the same or the
   next class; within a class shingles are dealt by hash into more segments
   than may differ, so partners agree on whole segments. Documents that share a
   segment are candidates; groups are the components of these candidate links.
   Keys of segments travel as packed binary rows, combined map-side: of the
   documents of one task that share a key only the smallest goes on, linked to
   the others as a candidate. So no task ever holds all documents of a key.
2. Thinning. In a group larger than a chunk (common lines join documents that
   have little else in common) every document has to share at least t of its
   shingles with others of such groups. Shingles are counted over these groups,
   again combined map-side; documents with more shingles of their own than a
   partner may lack link with nothing and go, the others are grouped anew,
   until hardly any goes.
3. Trees. Groups are cut into chunks of bounded size. In each chunk the sets
   stand in a tree whose nodes hold the OR and the AND of their members' bitmaps
   and the range of their sizes. A traversal of node pairs prunes a pair where
   the largest possible overlap of any two members is below what the threshold
   asks for, or where all members are known to be connected; pairs that two
   leaf pages leave are decided by the sets themselves.
4. Where a group has several chunks, its components' representatives meet in
   trees first. What then is not in the largest component of its group meets the
   whole group: trees against trees, in blocks of one part of either side and
   one size class, so that a block is bounded whatever the group's size. Only a
   forest over component labels leaves a block, never pairs of documents.

Links are exact; what is pruned is pairs that cannot link and, in
``components``, pairs already in one component. ``linked_pairs`` prunes the
former alone and returns every link between different sets.

Null and empty texts have no shingles and link with nothing. Texts with equal
sets link. Rows that repeat an id, and rows with a null id, are documents of
their own; a component is named by its smallest id, null if it has none. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import broadcast_if_small, documents, ids_of, mix, n_buckets, packed_rows, prefix_hash, short_batches, stash, texts_of, window_hash

#: Least number of segments that have to agree beyond the one that the bound gives.
EXTRA = 2
#: Documents of a chunk, sets of a leaf page, nodes below a node.
CHUNK, PAGE, FANOUT = 512, 32, 8
#: Bits of a bitmap: the first power of two from LEAST_BITS on that is twice the largest set, at most MOST_BITS.
LEAST_BITS, MOST_BITS = 1024, 1 << 16
#: Shingles of one side of a block; it bounds a task's memory and says nothing about which pairs meet.
PART = 1 << 19
#: Keys that a task holds before it combines and sends them, text of a bucket of segment keys, and of one of shingles.
HELD_KEYS, BUCKET_BYTES, SHINGLE_BYTES = 1_000_000, 16 << 20, 6 << 20

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, ASCII letters in lower case."""
    data = np.frombuffer(b" ".join([*(t.lower() for t in texts), b""]), np.uint8)
    space = _SPACE[data]
    prefix = prefix_hash(data)
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = window_hash(prefix, starts, ends)
    limits = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    out = []
    for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        n = hi - lo
        if n == 0:
            out.append(words[:0])
        elif n < width:
            out.append(mix((words[lo:hi] * _K[:n]).sum(dtype=np.uint64)[None] + np.uint64(n)))
        else:
            h = words[lo : hi - width + 1] * _K[0]
            for k in range(1, width):
                h = h + words[lo + k : hi - width + 1 + k] * _K[k]
            out.append(np.unique(mix(h)))
    return out


class SizeClasses:
    """Classes of set sizes for a threshold of num / den, and their numbers of segments."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts, self._spare = num, den, [1], {}

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def of_all(self, n: np.ndarray) -> np.ndarray:
        self.of(int(n.max(initial=1)))
        return np.searchsorted(self.starts, n, "right") - 1

    def may_differ(self, c: int) -> int:
        self.of(self.starts[c] if c < len(self.starts) else self.starts[-1])
        while len(self.starts) <= c + 1:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        top = self.starts[c + 1] - 1
        return 2 * top * (self.den - self.num) // (self.den + self.num)

    def spare(self, c: int) -> int:
        """Segments that have to agree beyond the first: more than a set of the class has empty ones, but for rare sets.

        Partners agree on 1 + spare segments. Either one of these holds shingles, or both sets have 1 + spare empty
        segments in common; sets with so many give out every combination of 1 + spare of them as well. The number
        decides how many keys there are, never which links are found.
        """
        if c not in self._spare:
            first, n = self.may_differ(c) + 1, self.starts[max(0, c - 1)]
            spare = EXTRA
            for _ in range(12):
                segments = first + spare
                empty = segments * math.exp(-n / segments)
                spare = max(spare, min(math.ceil(empty + 4 * math.sqrt(empty)), max(EXTRA, int(n / 1.5) - first)))
            self._spare[c] = spare
        return self._spare[c]

    def links(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))


_cuts: dict[int, np.ndarray] = {}


def segment_keys(s: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Keys of the segments of a sorted set in its own size class and the next."""
    out = []
    own = classes.of(len(s))
    sums = np.r_[np.uint64(0), np.cumsum(mix(s + _K[3]))]
    for c in (own, own + 1):
        spare = classes.spare(c)
        n = classes.may_differ(c) + 1 + spare
        cuts = _cuts.get(n)
        if cuts is None:
            cuts = _cuts[n] = np.array([(k << 64) // n for k in range(n)], np.uint64)
        at = np.r_[np.searchsorted(s, cuts), len(s)]
        at[0] = 0
        keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(n, dtype=np.uint64) * _K[4] + np.uint64(c * int(_K[5]) & 0xFFFFFFFFFFFFFFFF)))
        full = at[1:] > at[:-1]
        out.append(keys[full])
        none = np.flatnonzero(~full)
        if len(none) > spare:
            marks = mix(none.astype(np.uint64) * _K[1] + _K[2])
            sums_of = [sum(x) & 0xFFFFFFFFFFFFFFFF for x in combinations(marks.tolist(), spare + 1)]
            out.append(mix(np.array(sums_of, np.uint64) ^ np.uint64(c * int(_K[5]) & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


KEYED = np.dtype([("key", "<u8"), ("doc", "<i8")])
MEMBER = np.dtype([("doc", "<i8"), ("n", "<i8"), ("h1", "<u8"), ("h2", "<u8")])


def pack_keyed(keyed: np.ndarray) -> bytes:
    """Records of one bucket by document: number of documents, ids, keys each, and six bytes of every key.

    Six bytes and the bucket, which follows from the others, tell about 2 ** 48 keys a bucket apart; keys that
    fall together make a candidate more, never a link.
    """
    keyed = keyed[np.argsort(keyed["doc"], kind="stable")]
    new = np.flatnonzero(np.r_[True, np.diff(keyed["doc"]) != 0])
    counts = np.diff(np.r_[new, len(keyed)])
    keys = np.ascontiguousarray(keyed["key"]).view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([np.array([len(new)], "<u4").tobytes(), keyed["doc"][new].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), keys.tobytes()])


def unpack_keyed(blob: bytes) -> np.ndarray:
    (n,) = np.frombuffer(blob, "<u4", 1).tolist()
    docs, counts = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n)
    raw = np.frombuffer(blob, np.uint8, offset=4 + 12 * n).reshape(-1, 6)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :6] = raw
    out = np.empty(len(raw), KEYED)
    out["key"], out["doc"] = keys.view("<u8").ravel(), np.repeat(docs, counts)
    return out


def _combine(keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one record per key with its smallest id, candidate links of that id to the others)."""
    keyed = keyed[np.lexsort((keyed["doc"], keyed["key"]))]
    first = np.r_[True, keyed["key"][1:] != keyed["key"][:-1]]
    lead = keyed["doc"][np.maximum.accumulate(np.where(first, np.arange(len(keyed)), 0))]
    other = lead != keyed["doc"]
    return keyed[first], np.unique(np.stack([lead[other], keyed["doc"][other]], 1), axis=0)


def candidates(docs: DataFrame, classes: SizeClasses, width: int, n: int) -> DataFrame:
    """Rows (a, b, n): candidate links with n null, and members (a: id, n: set size, class, h1, h2) with b null; ``docs``: (doc_id, text)."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members = [], []
        size = 0

        def flush():
            if not held:
                return
            keyed, links = _combine(np.concatenate(held))
            held.clear()
            buckets = {}
            for b, r in packed_rows(((keyed["key"] >> np.uint64(32)) % np.uint64(n)).astype(np.int64), keyed):
                buckets.setdefault(b, [b"", b""])[0] = pack_keyed(r)
            if len(links):
                for b, r in packed_rows((mix(links[:, 1].astype(np.uint64)) % np.uint64(n)).astype(np.int64), links):
                    buckets.setdefault(b, [b"", b""])[1] = r.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(buckets), pa.int64()), pa.array([v[0] for v in buckets.values()], pa.binary()), pa.array([v[1] for v in buckets.values()], pa.binary()), pa.array([b""] * len(buckets), pa.binary())], ["bucket", "keys", "links", "members"])

        for batch in batches:
            members = []
            for i, s in zip(ids_of(batch).tolist(), _sets(batch, width), strict=True):
                if len(s):
                    keys = segment_keys(s, classes)
                    keyed = np.empty(len(keys), KEYED)
                    keyed["key"], keyed["doc"] = keys, i
                    held.append(keyed)
                    size += len(keys)
                members.append((i, len(s), int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))))
            m = np.array(members, MEMBER)
            packed = list(packed_rows((mix(m["doc"].astype(np.uint64)) % np.uint64(n)).astype(np.int64), m)) if len(m) else []
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int64()), pa.array([b""] * len(packed), pa.binary()), pa.array([b""] * len(packed), pa.binary()), pa.array([r.tobytes() for _, r in packed], pa.binary())], ["bucket", "keys", "links", "members"])
            if size > HELD_KEYS:
                yield from flush()
                size = 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        keyed = [unpack_keyed(x) for x in table.column("keys").to_pylist() if x]
        keyed = np.concatenate(keyed) if keyed else np.empty(0, KEYED)
        links = np.frombuffer(b"".join(table.column("links").to_pylist()), "<i8").reshape(-1, 2)
        m = np.frombuffer(b"".join(table.column("members").to_pylist()), MEMBER)
        if len(keyed):
            links = np.concatenate([links, _combine(keyed)[1]])
        links = np.unique(links, axis=0) if len(links) else links
        k = len(links)
        blank = [None]
        return pa.table({
            "a": pa.array(np.r_[links[:, 0], m["doc"]], pa.int64()),
            "b": pa.concat_arrays([pa.array(links[:, 1], pa.int64()), pa.array(blank * len(m), pa.int64())]),
            "n": pa.concat_arrays([pa.array(blank * k, pa.int64()), pa.array(m["n"], pa.int64())]),
            "class": pa.concat_arrays([pa.array(blank * k, pa.int32()), pa.array(classes.of_all(m["n"]), pa.int32())]),
            "h1": pa.concat_arrays([pa.array(blank * k, pa.int64()), pa.array(m["h1"].view(np.int64), pa.int64())]),
            "h2": pa.concat_arrays([pa.array(blank * k, pa.int64()), pa.array(m["h2"].view(np.int64), pa.int64())]),
        })

    packed = docs.mapInArrow(keys_of, "bucket long, keys binary, links binary, members binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long, n long, class int, h1 long, h2 long")


def _sets(batch: pa.RecordBatch, width: int, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    part, size = [], 0
    for t in texts_of(batch):
        part.append(t)
        size += len(t)
        if size > limit:
            yield from shingle_sets(part, width)
            part, size = [], 0
    if part:
        yield from shingle_sets(part, width)


class _Node:
    __slots__ = ("all", "any", "kids", "least", "members", "most")

    def __init__(self, members, any_, all_, least, most, kids):
        self.members, self.any, self.all, self.least, self.most, self.kids = members, any_, all_, least, most, kids


def _ones(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


class SignatureTree:
    """Sets in a tree of bitmaps and size ranges; joins itself or another tree.

    It keeps components in ``parent``, or, with ``every``, collects all links in ``links``. ``ids`` and ``asked``
    are for joins of two sides: a pair of two asked sets, which meets from both sides, counts once.
    """

    def __init__(self, sets: list[np.ndarray], classes: SizeClasses, parent: list[int], every: bool = False, ids: np.ndarray | None = None, asked: np.ndarray | None = None):
        self.sets, self.classes, self.parent, self.every, self.ids, self.asked = sets, classes, parent, every, ids, asked
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = LEAST_BITS
        while bits < min(MOST_BITS, 2 * int(self.sizes.max(initial=0))):
            bits *= 2
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        flags = np.zeros(bits, bool)
        for k, s in enumerate(sets):
            bit = (s & np.uint64(bits - 1)).astype(np.int64)
            flags[bit] = True
            self.maps[k] = np.packbits(flags).view(np.uint64)
            flags[bit] = False
        self.compared, self.links = 0, []

    def find(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def _roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.find(k) for k in members.tolist()])

    def build(self, members: list[int]) -> _Node:
        """Sorted by size class and smallest shingles, so that similar sets share leaf pages."""
        order = np.array(sorted(members, key=lambda k: (self.classes.of(max(1, int(self.sizes[k]))), self.sets[k][:2].tolist(), k)))
        pages = [order[i : i + PAGE] for i in range(0, len(order), PAGE)]
        level = [_Node(m, np.bitwise_or.reduce(self.maps[m]), np.bitwise_and.reduce(self.maps[m]), int(self.sizes[m].min()), int(self.sizes[m].max()), ()) for m in pages]
        while len(level) > 1:
            level = [self._above(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        return level[0]

    @staticmethod
    def _above(kids: list[_Node]) -> _Node:
        any_, all_ = kids[0].any, kids[0].all
        for x in kids[1:]:
            any_, all_ = any_ | x.any, all_ & x.all
        return _Node(np.concatenate([x.members for x in kids]), any_, all_, min(x.least for x in kids), max(x.most for x in kids), kids)

    def _possible(self, x: _Node, y: _Node) -> bool:
        """Whether any member of x and any of y could link, by sizes and bitmaps."""
        num, den = self.classes.num, self.classes.den
        if den * min(x.most, y.most) < num * max(x.least, y.least):
            return False
        # A bit that all of x have and none of y has is a shingle that the overlap lacks, whatever the pair.
        most = min(x.most - _ones(x.all & ~y.any), y.most - _ones(y.all & ~x.any))
        return most >= self.classes.least_overlap(x.least, y.least)

    def _one_component(self, x: _Node, y: _Node) -> bool:
        root = self.find(int(x.members[0]))
        return all(self.find(k) == root for z in ((x,) if x is y else (x, y)) for k in z.members.tolist())

    def join(self, x: _Node, y: _Node) -> None:
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if x is not y and not self._possible(x, y) or not self.every and self._one_component(x, y):
                continue
            if not x.kids and not y.kids:
                self._meet(x, y)
            elif x is y:
                stack += [(p, q) for i, p in enumerate(x.kids) for q in x.kids[i:]]
            elif x.kids and (not y.kids or len(x.members) >= len(y.members)):
                stack += [(p, y) for p in x.kids]
            else:
                stack += [(x, q) for q in y.kids]

    def _meet(self, x: _Node, y: _Node) -> None:
        """Pairs of two leaf pages: sizes, components and bitmaps of all of them at once, then the sets of what is left."""
        num, den, a, b = self.classes.num, self.classes.den, x.members, y.members
        na, nb = self.sizes[a][:, None], self.sizes[b][None, :]
        left = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
        if x is y:
            left &= np.triu(np.ones(left.shape, bool), 1)
        elif self.asked is not None:
            ia, ib = self.ids[a][:, None], self.ids[b][None, :]
            left &= (ia != ib) & ~(self.asked[b][None, :] & (ia > ib))
        if not self.every:
            left &= self._roots(a)[:, None] != self._roots(b)[None, :]
        i, j = np.nonzero(left)
        i, j = a[i], b[j]
        for lo in range(0, len(i), 256):
            p, q = i[lo : lo + 256], j[lo : lo + 256]
            mp, mq, np_, nq = self.maps[p], self.maps[q], self.sizes[p], self.sizes[q]
            most = np.minimum(np_ - np.bitwise_count(mp & ~mq).sum(axis=1, dtype=np.int64), nq - np.bitwise_count(mq & ~mp).sum(axis=1, dtype=np.int64))
            for k in np.flatnonzero(most >= -(-num * (np_ + nq) // (num + den))).tolist():
                self._decide(int(p[k]), int(q[k]))

    def _decide(self, a: int, b: int) -> None:
        if not self.every and self.find(a) == self.find(b):
            return
        self.compared += 1
        both = _common(self.sets[a], self.sets[b])
        if both and self.classes.links(both, int(self.sizes[a]), int(self.sizes[b])):
            if self.every:
                self.links.append((a, b, both))
            else:
                self.parent[self.find(max(a, b))] = self.find(min(a, b))


def _tree_of(pdf: pd.DataFrame, classes: SizeClasses, width: int, every: bool) -> tuple[pd.DataFrame, SignatureTree]:
    """The joined tree of a block with columns doc_id, label, side, asked, text: side 0 meets side 1, or itself if alone."""
    pdf = pdf.sort_values(["doc_id", "side"], kind="stable").reset_index(drop=True)
    sides = pdf["side"].to_numpy()
    sets: list[np.ndarray] = []
    for k in range(0, len(pdf), 64):
        sets += shingle_sets([b"" if t is None else t.encode() for t in pdf["text"].iloc[k : k + 64]], width)
    lead: dict = {}
    parent = [lead.setdefault(label, k) for k, label in enumerate(pdf["label"].tolist())]
    tree = SignatureTree(sets, classes, parent, every, pdf["doc_id"].to_numpy(), pdf["asked"].to_numpy(bool) if sides.any() else None)
    parts = [[k for k in np.flatnonzero(sides == side).tolist() if len(sets[k])] for side in (0, 1)]
    if all(parts):
        tree.join(tree.build(parts[0]), tree.build(parts[1]))
    elif parts[0] and not sides.any():
        root = tree.build(parts[0])
        tree.join(root, root)
    return pdf, tree


def _tree_links(pdf: pd.DataFrame, classes: SizeClasses, width: int) -> pd.DataFrame:
    """A forest (a, b) over the labels of a block that links found there connect."""
    pdf, tree = _tree_of(pdf, classes, width, False)
    labels = pdf["label"].tolist()
    tied = {(labels[tree.find(k)], labels[k]) for k in range(len(labels))}
    return pd.DataFrame([t for t in tied if t[0] != t[1]], columns=["a", "b"], dtype="int64")


def _tree_pairs(pdf: pd.DataFrame, classes: SizeClasses, width: int) -> pd.DataFrame:
    """All links of a block: (a, b, n_common), smaller id first."""
    pdf, tree = _tree_of(pdf, classes, width, True)
    ids = pdf["doc_id"].tolist()
    return pd.DataFrame([(*sorted((ids[a], ids[b])), both) for a, b, both in tree.links], columns=["a", "b", "n_common"], dtype="int64")


# ---- thinning of large groups


def _own_shingles(texts: DataFrame, width: int, n: int) -> DataFrame:
    """(doc_id, own): how many shingles of a document no other of ``texts`` (doc_id, text) has; none if all are shared."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            if not held:
                return
            keyed = np.concatenate(held)
            held.clear()
            keyed = keyed[np.argsort(keyed["key"], kind="stable")]
            new = np.flatnonzero(np.r_[True, keyed["key"][1:] != keyed["key"][:-1]])
            times = np.diff(np.r_[new, len(keyed)])
            once, several = keyed[new[times == 1]], keyed["key"][new[times > 1]]
            buckets: dict[int, list[bytes]] = {}
            for b, r in packed_rows(((once["key"] >> np.uint64(32)) % np.uint64(n)).astype(np.int64), once):
                buckets.setdefault(b, [b"", b""])[0] = pack_keyed(r)
            for b, r in packed_rows(((several >> np.uint64(32)) % np.uint64(n)).astype(np.int64), several & _SIX):
                buckets.setdefault(b, [b"", b""])[1] = r.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(buckets), pa.int64()), pa.array([v[0] for v in buckets.values()], pa.binary()), pa.array([v[1] for v in buckets.values()], pa.binary())], ["bucket", "once", "several"])

        for batch in batches:
            for i, s in zip(ids_of(batch).tolist(), _sets(batch, width), strict=True):
                keyed = np.empty(len(s), KEYED)
                keyed["key"], keyed["doc"] = s, i
                held.append(keyed)
                size += len(s)
                if size > HELD_KEYS:
                    yield from flush()
                    size = 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        keyed = [unpack_keyed(x) for x in table.column("once").to_pylist() if x]
        keyed = np.concatenate(keyed) if keyed else np.empty(0, KEYED)
        keyed = keyed[np.argsort(keyed["key"], kind="stable")]
        edge = np.r_[True, keyed["key"][1:] != keyed["key"][:-1], True]
        keyed = keyed[edge[:-1] & edge[1:]] if len(keyed) else keyed
        several = np.unique(np.frombuffer(b"".join(table.column("several").to_pylist()), "<u8"))
        if len(several):
            at = np.minimum(np.searchsorted(several, keyed["key"]), len(several) - 1)
            keyed = keyed[several[at] != keyed["key"]]
        docs, counts = np.unique(keyed["doc"], return_counts=True)
        out = np.empty(len(docs), OWN)
        out["doc"], out["own"] = docs, counts
        packed = list(packed_rows((mix(docs.astype(np.uint64)) % np.uint64(n)).astype(np.int64), out))
        return pa.table({"to": pa.array([b for b, _ in packed], pa.int64()), "counts": pa.array([r.tobytes() for _, r in packed], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(table.column("counts").to_pylist()), OWN)
        docs, at = np.unique(found["doc"], return_inverse=True)
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "own": pa.array(np.bincount(at, weights=found["own"], minlength=len(docs)).astype(np.int64), pa.int64())})

    counted = texts.mapInArrow(cut, "bucket long, once binary, several binary").groupBy("bucket").applyInArrow(meet, "to long, counts binary")
    return counted.groupBy("to").applyInArrow(add, "doc_id long, own long")


_SIX = np.uint64((1 << 48) - 1)
OWN = np.dtype([("doc", "<i8"), ("own", "<u4")])


def _small(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, written; broadcast where its checked size allows it."""
    return broadcast_if_small(stash(df), 48)


def _regrouped(links: DataFrame) -> DataFrame:
    """(doc_id, group) of all documents with a candidate link."""
    return connected_components(links.filter("a <> b")).select(F.col("node").alias("doc_id"), F.col("component").alias("group"))


def _thinned(rows: DataFrame, groups: DataFrame, sizes: DataFrame, classes: SizeClasses, width: int, chunk: int) -> DataFrame:
    """``groups`` (doc_id, group) without documents of large groups that have too many shingles of their own, these groups formed anew."""
    num, den = classes.num, classes.den
    while True:
        large = groups.groupBy("group").count().filter(F.col("count") > chunk).select("group")
        large = _small(large)
        inside = _small(groups.join(large, "group", "left_semi").select("doc_id"))
        before = inside.count()
        if not before:
            return groups
        texts = rows.join(inside, "doc_id", "left_semi")
        n = n_buckets(texts, "text", SHINGLE_BYTES)
        own = _small(_own_shingles(texts, width, n))
        counted = inside.join(sizes, "doc_id").join(own, "doc_id", "left")
        # A partner may lack n - ceil(t * n) shingles at most.
        staying = _small(counted.filter(F.coalesce("own", F.lit(0)) <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * num / F.lit(den))).select("doc_id"))
        after = staying.count()
        if after > 0.9 * before:
            return groups
        anew = candidates(rows.join(staying, "doc_id", "left_semi"), classes, width, n).filter("b IS NOT NULL").select("a", "b")
        groups = stash(groups.join(large, "group", "left_anti").select("doc_id", "group").union(_regrouped(anew)))


# ---- blocks


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (doc_id, group, label) after more links (a, b) between labels."""
    links = links.filter("a <> b")
    if links.isEmpty():
        return labels
    new = connected_components(links).select(F.col("node").alias("label"), "component")
    return _small(labels.join(_small(new), "label", "left").select("doc_id", "group", F.coalesce("component", "label").alias("label")))


def _grid(labels: DataFrame, members: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, label, block, side, asked) for what has to meet in the groups of ``labels`` (doc_id, group, label).

    Asked are the documents outside the largest component of their group, or all of them (``every``). They meet the
    documents of the same and the two neighbouring size classes of their group. Either side is dealt into parts.
    """
    sized = labels.join(members, "doc_id").select("doc_id", "group", "label", "n_shingles", "class")
    if every:
        sized = sized.withColumn("asked", F.lit(True))
    else:
        most = sized.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        sized = sized.join(_small(most), "group").withColumn("asked", F.col("label") != F.col("main")).drop("main")
    sized = stash(sized)
    asking = sized.filter("asked").withColumn("at", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    parts = sized.groupBy("group", F.col("class").alias("at")).agg(F.ceil(F.sum("n_shingles") / PART).alias("parts"))
    parts = parts.join(asking.groupBy("group", "at").agg(F.ceil(F.sum("n_shingles") / PART).alias("askers")), ["group", "at"])
    parts = _small(parts)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ask = asking.join(parts, ["group", "at"]).withColumn("asker", F.pmod(F.xxhash64("doc_id", F.lit(1)), "askers")).withColumn("part", each("parts")).withColumn("side", F.lit(0))
    other = sized.withColumn("at", F.col("class")).join(parts, ["group", "at"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).withColumn("asker", each("askers")).withColumn("side", F.lit(1))
    block = F.xxhash64("group", "at", "part", "asker").alias("block")
    return _small(ask.select("doc_id", "label", block, "side", "asked").union(other.select("doc_id", "label", block, "side", "asked")))


BLOCK = "a long, b long"


class _Join:
    """The steps that components and pairs share, over rows (doc_id, text) with unique ids."""

    def __init__(self, rows: DataFrame, num: int, den: int, width: int, chunk: int):
        self.rows, self.classes, self.width, self.chunk = rows, SizeClasses(num, den), width, chunk
        found = stash(candidates(rows, self.classes, width, n_buckets(rows, "text", BUCKET_BYTES)))
        self.members = found.filter("n IS NOT NULL").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "class", "h1", "h2")
        # Equal sets: one representative each goes on, the smallest id.
        same = self.members.filter("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
        self.copies = _small(self.members.join(_small(same), ["n_shingles", "h1", "h2"]).select("doc_id", "rep"))
        links = found.filter("b IS NOT NULL").select("a", "b")
        for side in ("a", "b"):
            links = links.join(self.copies.select(F.col("doc_id").alias(side), "rep"), side, "left").withColumn(side, F.coalesce("rep", side)).drop("rep")
        self.groups = _thinned(rows, _regrouped(links), self.members.select("doc_id", "n_shingles"), self.classes, width, chunk)

    def in_blocks(self, placed: DataFrame, decide, shape: str = BLOCK) -> DataFrame:
        """What ``decide`` finds in the blocks of ``placed`` (doc_id, label, block, side, asked), whose texts are joined on."""
        classes, width = self.classes, self.width
        texts = self.rows.join(placed, "doc_id")
        return stash(texts.groupBy("block").applyInPandas(lambda pdf: decide(pdf, classes, width), shape))

    def dealt(self, part: DataFrame, salt: int) -> DataFrame:
        """``part`` with chunks and block: groups larger than a chunk are dealt out by a hash of the id, groups of a page or less share blocks."""
        sizes = stash(part.groupBy("group").agg(F.count(F.lit(1)).alias("size")))
        few = sizes.filter(F.col("size") <= PAGE).agg(F.sum("size")).first()[0] or 0
        sizes = broadcast_if_small(sizes, 48)
        part = part.join(sizes, "group").withColumn("chunks", F.ceil(F.col("size") / self.chunk))
        shared = F.xxhash64(F.pmod(F.xxhash64("group", F.lit(salt)), F.lit(max(1, few // self.chunk))), F.lit("shared"))
        own = F.xxhash64("group", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("chunks")), F.lit(salt))
        return part.withColumn("block", F.when((F.col("size") <= PAGE) & (F.col("chunks") == 1), shared).otherwise(own)).drop("size")

    def labels(self) -> DataFrame:
        """(doc_id, label) of representatives with a candidate link; label: one representative of the component."""
        one_side = (F.lit(0).alias("side"), F.lit(True).alias("asked"))
        labels = _small(self.groups.select("doc_id", "group", F.col("doc_id").alias("label")))
        placed = _small(self.dealt(labels, 0).select("doc_id", "group", "label", "chunks", "block"))
        labels = _merge(labels, self.in_blocks(placed.select("doc_id", "label", "block", *one_side), _tree_links))
        split = _small(placed.filter("chunks > 1").select("group").distinct())
        if split.isEmpty():
            return labels

        def still_open() -> DataFrame:
            """Split groups that hold more than one component."""
            return _small(labels.join(split, "group", "left_semi").groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("group"))

        left = still_open()
        if not left.isEmpty():
            reps = labels.join(left, "group", "left_semi").groupBy("group", "label").agg(F.min("doc_id").alias("doc_id"))
            labels = _merge(labels, self.in_blocks(_small(self.dealt(reps, 1).select("doc_id", "label", "block", *one_side)), _tree_links))
            left = still_open()
        if not left.isEmpty():
            labels = _merge(labels, self.in_blocks(_grid(labels.join(left, "group", "left_semi"), self.members), _tree_links))
        return labels

    def of_all(self) -> DataFrame:
        """(doc_id, n_shingles, label) of every row."""
        labels = self.labels()
        of_copy = self.copies.join(labels.select(F.col("doc_id").alias("rep"), "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("label"))
        linked = _small(of_copy.union(labels.join(self.copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "label")))
        return self.members.select("doc_id", "n_shingles").join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label"))

    def pairs(self) -> DataFrame:
        """(a, b, n_common) for every link between representatives of different sets."""
        labels = stash(self.groups.select("doc_id", "group", F.col("doc_id").alias("label")))
        return self.in_blocks(_grid(labels, self.members, every=True), _tree_pairs, "a long, b long, n_common long").distinct()


#: Column that numbers rows; named such that it hides none of the caller's.
NODE = "symloom_node"


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with a column NODE: the id where ids are unique and not null, else a number of the row, written once."""
    node = docs[id_col].cast("long")
    odd = docs.select(node.alias(NODE)).groupBy(NODE).count().filter(f"count > 1 OR {NODE} IS NULL")
    if odd.isEmpty():
        return docs.withColumn(NODE, node), True
    return stash(docs.withColumn(NODE, F.monotonically_increasing_id())), False


def _join_of(docs: DataFrame, num: int, den: int, width: int, chunk: int, text_col: str) -> _Join:
    short_batches(docs.sparkSession)
    return _Join(docs.select(F.col(NODE).alias("doc_id"), F.col(text_col).cast("string").alias("text")), num, den, width, chunk)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def components(docs: DataFrame, num: int = 9, den: int = 10, width: int = 3, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: sets of similarity num / den or more link."""
    rows, unique = _numbered(_narrow(docs, id_col, text_col), "doc_id")
    found = _join_of(rows, num, den, width, chunk, "text").of_all()
    if unique:
        named = found
    else:
        named = found.withColumnRenamed("doc_id", NODE).join(rows.select(NODE, "doc_id"), NODE)
    named = stash(named)
    # A component's id is its smallest document.
    smallest = _small(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return named.join(smallest, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_pairs(docs: DataFrame, num: int = 9, den: int = 10, width: int = 3, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_common): every link between different sets, each set named by one document that has it, a before b.

    With ``components`` this is the whole join. It grows with the number of links, so with the square of a group of
    near copies; nothing is pruned but pairs that cannot link. Ids have to be unique and not null.
    """
    rows = _narrow(docs, id_col, text_col).withColumn(NODE, F.col("doc_id"))
    return _join_of(rows, num, den, width, chunk, "text").pairs()


def one_of_each(docs: DataFrame, num: int = 9, den: int = 10, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, the first of rows that share it."""
    rows, unique = _numbered(docs, id_col)
    found = stash(_join_of(rows, num, den, width, CHUNK, text_col).of_all())
    several = _small(found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label"))
    linked = found.join(several, "label", "left_semi").select(F.col("doc_id").alias(NODE), "label")
    if unique:
        stays = linked.groupBy("label").agg(F.min(NODE).alias("stays"))
    else:
        ids = rows.select(NODE, F.col(id_col).cast("long").alias("id"))
        stays = linked.join(ids, NODE).groupBy("label").agg(F.min(F.struct(F.isnull("id"), "id", NODE))[NODE].alias("stays"))
    dropped = _small(linked.join(_small(stays), "label").filter(F.col(NODE) != F.col("stays")).select(NODE))
    return rows.join(dropped, NODE, "left_anti").select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))
