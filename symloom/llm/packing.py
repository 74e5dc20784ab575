"""Packing documents into token sequences: best fit, then a swap-based local search.

Pieces are dealt by a hash into shards of about ``SHARD`` pieces, each packed
by one task: best fit in order of falling length, then exchanges between
underfull bins (moves, one-for-one, two-for-one) as long as the sum of squared
fills rises, which empties the emptiest bins. What stays in underfull bins of
all shards is dealt and packed again, in fewer shards each time, until it fits
one. A shard is bounded whatever the table's size, and nothing but lengths is
shuffled.

Null and empty texts are one piece holding the end id alone. Repeated rows and
ids, and null ids, are packed each; ties go by id and piece. Texts longer than a sequence, and
only they, are cut. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, short_batches, stash
from .tokens import _L, _N, WORD_BPE, Cache, pack, public_path, tokenizer

CAPACITY, END_ID = 4096, 1
#: Pieces of a shard, and the share of a sequence below which a bin is dealt again.
SHARD, FULL = 16_384, 0.98
#: Words whose ids a worker keeps at hand; it costs time only.
CACHE_WORDS = 200_000

#: The vocabulary's pattern of words, with the letters and numbers up to U+024F spelled out; others go to the library.
_LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_UNSURE = re.compile("[^\\x20-\\u024f]|<\\|")


@functools.cache
def word_encoder(path: str):
    """White-space separated string to packed ids: Latin strings by a rank encoder over the same merges, others by the library."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    library = tokenizer(path)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}

    def raw(token: str) -> bytes:
        stem = token.removesuffix("</w>")
        return bytes(of[c] for c in stem) + b"\xff" * (stem != token)

    # A word's last byte merges with the end mark before all else; other merges follow in their order.
    ranks, ids = {}, []

    def rank(token: str) -> None:
        ranks[raw(token)] = len(ids)
        ids.append(model["vocab"][token])

    letters = [c for c in of]
    for c in letters:
        rank(c + "</w>")
    for c in letters:
        rank(c)
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if raw(a + b) not in ranks:
            rank(a + b)
    fast = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    id_of = [i.to_bytes(4, "little") for i in ids]

    def encode(chunk: str) -> bytes:
        if _UNSURE.search(chunk):
            return pack(library.encode(chunk, add_special_tokens=False).ids)
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        return b"".join([id_of[r] for word in _LATIN_WORD.findall(text.lower()) for r in fast(word.encode() + b"\xff")])

    return Cache(encode, CACHE_WORDS)


_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def word_ids(text: str, encoder: Cache) -> bytes:
    """Ids of the whole text: white space is never part of a token, so its strings are encoded apart."""
    parts = text.split() if not re.search("[\x1c-\x1f]", text) else [p for p in _SPACE.split(text) if p]
    return b"".join(map(encoder.__getitem__, parts))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32)."""
    short_batches(docs.sparkSession)

    def cut(batches):
        encoder = word_encoder(path or public_path(WORD_BPE))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = word_ids(text or "", encoder) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(cut, PIECES)


class Bins:
    """Bins of items by number; lengths of items are given once."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        by_room: dict[int, list[int]] = {}
        rooms: list[int] = []
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                bins = by_room[room]
                b = bins.pop()
                if not bins:
                    del by_room[room]
                    del rooms[at]
                self.items[b].append(i)
                self.fill[b] += n
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([i])
                self.fill.append(n)
            left = room - n
            if left:
                if left not in by_room:
                    by_room[left] = []
                    bisect.insort(rooms, left)
                by_room[left].append(b)

    def exchange(self) -> None:
        """Empties bins, emptiest first, into all others that have room, until no exchange raises the sum of squared fills or no packing has fewer bins.

        An item moves, or goes for a smaller item, for two that are together smaller, or with another item of its bin
        for one larger item. Of all bins at least as full the one is taken that it leaves least room in.
        """
        least = -(-sum(self.lengths) // self.capacity)
        used, changed = sum(1 for f in self.fill if f), True
        while changed and used > least:
            changed = False
            partners = _Partners(self)
            for a in partners.order:
                for i in sorted(self.items[a], key=lambda i: (-self.lengths[i], i)):
                    if i in self.items[a] and self._improve(a, i, partners):
                        changed = True
                if not self.items[a]:
                    used -= 1
                    if used <= least:
                        return  # as few bins as any packing has

    def _improve(self, a: int, i: int, partners: "_Partners") -> bool:
        mine = [j for j in self.items[a] if j != i]
        n = np.array([self.lengths[i], *(self.lengths[i] + self.lengths[j] for j in mine)])
        found = partners.best(a, self.fill[a], n)
        if found is None:
            return False
        which, b, take = found
        give = [i] if which == 0 else [i, mine[which - 1]]
        done = self._swap(a, give, b, take)
        if done:
            partners.update(a)
            partners.update(b)
        return done

    def _swap(self, a: int, give: list[int], b: int, take: list[int]) -> bool:
        gain = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in take)
        if gain <= 0 or self.fill[b] + gain > self.capacity or self.fill[b] + gain <= self.fill[a]:
            return False
        for i in give:
            self.items[a].remove(i)
            self.items[b].append(i)
        for i in take:
            self.items[b].remove(i)
            self.items[a].append(i)
        self.fill[a] -= gain
        self.fill[b] += gain
        return True


class _Partners:
    """What bins that have room can give for an item: nothing, one of their items, or two of them, as flat arrays."""

    def __init__(self, bins: Bins):
        self.bins = bins
        self.order = sorted((b for b in range(len(bins.items)) if 0 < bins.fill[b] < bins.capacity), key=lambda b: (bins.fill[b], b))
        self.offers = {b: self._of(b) for b in self.order}
        self._flatten()

    def _of(self, b: int) -> list[tuple[int, ...]]:
        """Offers of a bin by different sums: (sum, items)."""
        items, lengths = self.bins.items[b], self.bins.lengths
        by_sum: dict[int, tuple[int, ...]] = {0: ()}
        for k, i in enumerate(items):
            by_sum.setdefault(lengths[i], (i,))
            for j in items[k + 1 :]:
                by_sum.setdefault(lengths[i] + lengths[j], (i, j))
        return list(by_sum.items())

    def _flatten(self) -> None:
        live = [b for b in self.order if self.bins.fill[b]]
        self.bin = np.repeat(np.array(live, np.int64), [len(self.offers[b]) for b in live])
        self.sum = np.array([s for b in live for s, _ in self.offers[b]], np.int64)
        self.items = [x for b in live for _, x in self.offers[b]]
        self.one = np.fromiter(map(len, self.items), np.int64, len(self.items)) == 1
        self.fill = np.array(self.bins.fill, np.int64)
        self.stale: set[int] = set()

    def update(self, b: int) -> None:
        """Offers of a changed bin are looked at again when many have changed; until then the bin makes none."""
        if b in self.offers:
            self.offers[b] = self._of(b)
            self.stale.add(b)
            self.fill[b] = self.bins.capacity + 1
            if len(self.stale) > 64:
                self._flatten()

    def best(self, a: int, fill: int, n: np.ndarray):
        """(which of the sums ``n`` to give, bin, its items to take) that fills a bin most, or none."""
        for again in (False, True):
            if again:
                if not self.stale:
                    return None
                self._flatten()
            # A bin gains n - sum; it has to have the room and to be as full as ``a`` at least, so that squares rise.
            own = self.fill[self.bin]
            room = self.bins.capacity - own
            fits = (self.bin != a) & (own >= fill) & (own <= self.bins.capacity)
            for which, total in enumerate(n.tolist()):
                gain = total - self.sum
                # Two items go for one only: other offers of two for two or for none are moves of their own.
                able = fits & (gain > 0) & (gain <= room) & (self.one if which else True)
                if able.any():
                    k = int(np.argmin(np.where(able, room - gain, self.bins.capacity + 1)))
                    return which, int(self.bin[k]), list(self.items[k])
        return None


def pack_shard(lengths: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(bin, offset, fill of the bin) of each item."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.exchange()
    out: list = [None] * len(lengths)
    for b, (items, fill) in enumerate(zip(bins.items, bins.fill, strict=True)):
        at = 0
        for i in items:
            out[i] = b, at, fill
            at += lengths[i]
    return out


def _solver(schema: pa.Schema, round_: int, capacity: int):
    """Packs one shard of a round; ties go by id (nulls last), piece and content."""

    def solve(table: pa.Table) -> pa.Table:
        keys = [(n, "ascending") for n in ("doc_id", "piece", "ids_crc32") if n in schema.names]
        table = table.sort_by(keys)
        placed = pack_shard(table.column("length").to_pylist(), capacity)
        base = (round_ << 56) + (table.column("shard")[0].as_py() << 20)
        columns = [table.column(n) for n in schema.names]
        return pa.table([*columns, *(pa.array(x, pa.int64()) for x in ([base + b for b, _, _ in placed], [o for _, o, _ in placed], [f for _, _, f in placed]))], names=[*schema.names, "sequence_id", "offset", "fill"])

    return solve


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, full: float = FULL) -> DataFrame:
    """``parts`` (with doc_id, piece, length) with sequence_id and offset.

    What is in underfull bins is dealt and packed again, until it is one shard or a round has not saved a bin.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in parts.schema]
    arrow = to_arrow_schema(parts.schema)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long, fill long"
    left, done, round_, bins = stash(parts), None, 0, None
    while True:
        n = left.count()
        shards = max(1, -(-n // shard_size))
        dealt = left.select(*names, F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), F.lit(shards)).alias("shard"))
        packed = dealt.groupBy("shard").applyInArrow(_solver(arrow, round_, capacity), schema)
        if shards == 1:
            packed = packed.drop("fill")
            return packed if done is None else done.unionByName(packed)
        packed = stash(packed)
        whole = packed.filter(F.col("fill") >= int(capacity * full)).drop("fill")
        open_ = packed.filter(F.col("fill") < int(capacity * full))
        now = open_.filter("offset = 0").count()
        done = whole if done is None else done.unionByName(whole)
        if bins is not None and now + whole.filter("offset = 0").count() >= bins:
            return done.unionByName(open_.drop("fill"))
        left, bins, round_ = open_.select(*names), now, round_ + 1


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text."""
    return pack_pieces(pieces(docs, capacity, id_col, text_col, path), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
