"""Byte-level BPE by content-defined chunk reuse, its decoding, and edit-aware token counts.

A text is cut where a rolling hash of its last bytes hits a mask, so passages
that documents share fall into the same chunks wherever they stand, and a chunk is
encoded once. Around a cut the pre-tokens of the chunks differ from those of
the whole text, so each join is repaired: the text from the last place of the
left chunk to the first place of the right one where any split has to have a
boundary (a space between a character that is no white space and a letter) is
encoded again. A chunk without such a place belongs to the seam as a whole, so
the seam grows until both sides agree. The split goes left to right and keeps
no state between pre-tokens, so agreement on a boundary makes the rest exact.

Chunks are counted over the whole table by their hashes first, one record a task
and chunk, however many of its texts have it. Those that most tasks share, at
most ``SHARED_CHUNKS``, are encoded once, each from one text that has it, and
sent to all workers. Every other chunk is encoded once by each worker that meets
it, as long as its cache holds it. The bound limits memory and changes no id;
``n_chunks_encoded`` tells how many chunks of a text had to be encoded.

Ids come from a byte-pair encoder over the same vocabulary that is faster on
short strings; strings with characters beyond Latin letters go to the
tokenizers library itself, whose tables of character classes decide.

Null and empty texts have no tokens. Very long texts are chunked like others.
Rows are independent of each other: ties and repeated rows give equal results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, n_buckets, packed_rows, short_batches, stash

BYTE_BPE, BYTE_RANKS, WORD_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
#: Pre-token pattern of the byte-level vocabulary (a fixed value of its public format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters and numbers up to U+024F, for which the faster module ``re`` gives the same split.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: Beyond these characters the library's own tables decide; the controls 1C-1F are white space for Python only.
_NOT_LATIN = re.compile("[^\\x00-\\x1b\\x20-\\u024f]")
#: Mean length of a chunk in characters, as a power of two, and characters that the rolling hash looks back on.
CHUNK_BITS, LOOK_BACK = 8, 16
#: Entries of each cache of a worker; a full cache starts anew and keeps the former one at hand, which costs time only.
CACHE_ENTRIES = 250_000


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache(dict):
    """A mapping filled by ``make``; holds the last ``entries`` to twice as many of its keys."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        self.make, self.entries, self.former, self.missed = make, entries, {}, 0

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.former = dict(self)
            self.clear()
        got = self.former.get(key)
        if got is None:
            self.missed += 1
            got = self.make(key)
        self[key] = got
        return got


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@functools.cache
def byte_encoder(json_path: str, ranks_path: str):
    """(text to ids without special tokens, the library's tokenizer)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
    library = tokenizer(json_path)
    library.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        if _NOT_LATIN.search(text):
            return library.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode, library


_ROLL = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 1 << 12, dtype=np.uint64)


def cuts(text: str, bits: int = CHUNK_BITS, back: int = LOOK_BACK) -> list[int]:
    """Character positions at which a chunk ends, by the ``back`` characters before them alone."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(raw) <= back:
        return [len(raw)] if len(raw) else []
    sums = np.cumsum(_ROLL[raw & 0xFFF] * power(len(raw)))
    rolled = (sums[back:] - sums[:-back]) * power(len(raw), inverse=True)[: len(raw) - back]
    hit = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + back + 1
    out = hit[hit < len(raw)].tolist()
    out.append(len(raw))
    return out


def power(n: int, inverse: bool = False) -> np.ndarray:
    from .shared import _INVERSE, BASE, _power_table

    return _power_table(_INVERSE if inverse else BASE, n)[:n]


#: A place where every split has a boundary: after a character that is no white space, before a space and a Latin letter.
_AGREED = re.compile("(?<=[^\\s\\x1c-\\x1f]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")


class Chunk:
    """Ids between a chunk's first and last agreed place; None where it has none."""

    __slots__ = ("first", "ids", "last")

    @classmethod
    def known(cls, first: int, last: int, ids: bytes) -> "Chunk":
        """A chunk that was encoded elsewhere; ``first`` below zero: without an agreed place."""
        out = cls.__new__(cls)
        out.first, out.last, out.ids = (first, last, ids) if first >= 0 else (None, None, None)
        return out

    def __init__(self, text: str, encode):
        m = _AGREED.search(text)
        if m is None:
            self.first = self.last = self.ids = None
            return
        self.first = m.start()
        at = len(text)
        while True:
            at = text.rfind(" ", self.first, at)
            if at == self.first or _AGREED.match(text, at):
                break
        self.last = at
        self.ids = pack(encode(text[self.first : at])) if at > self.first else b""


class ChunkEncoder:
    """Encodes texts with the chunk reuse described above; one for each worker."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None, entries: int = CACHE_ENTRIES // 4):
        encode, library = byte_encoder(json_path or public_path(BYTE_BPE), ranks_path or public_path(BYTE_RANKS))
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.stops = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.encoded, self.met, self.shared = 0, 0, {}

        def made(text: str) -> Chunk:
            given = self.shared.get(chunk_hash(text)) if self.shared else None
            if given is not None:
                return Chunk.known(*given)
            self.encoded += 1
            return Chunk(text, encode)

        self.chunks = Cache(made, entries)
        self.seams = Cache(lambda text: pack(encode(text)), entries)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if self.stops is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(pack([self.special[p]]) if p in self.special else self._plain(p) for p in self.stops.split(text) if p)

    def _plain(self, text: str) -> bytes:
        out, start, agreed = [], 0, 0
        for end in cuts(text):
            self.met += 1
            chunk = self.chunks[text[start:end]]
            if chunk.first is not None:
                seam = text[agreed : start + chunk.first]
                if seam:
                    out.append(self.seams[seam])
                out.append(chunk.ids)
                agreed = start + chunk.last
            start = end
        if agreed < len(text):
            out.append(self.seams[text[agreed:]])
        return b"".join(out)


@functools.cache
def chunk_encoder(json_path: str | None = None, ranks_path: str | None = None) -> ChunkEncoder:
    return ChunkEncoder(json_path, ranks_path)


@functools.cache
def byte_decoder(path: str | None = None) -> "Decoder":
    return Decoder(path)


class Decoder:
    """Ids to text as the library's decode(ids, skip_special_tokens=False) for byte-level vocabularies."""

    def __init__(self, path: str | None = None):
        made = tokenizer(path or public_path(BYTE_BPE))
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in keep]
        of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(other)}
        added = {i: t.content for i, t in made.get_added_tokens_decoder().items()}
        self.bytes = [b""] * (max([*made.get_vocab(True).values(), -1]) + 1)
        for token, i in made.get_vocab(True).items():
            self.bytes[i] = added[i].encode() if i in added else bytes(of[c] for c in token)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _strings(batch: pa.RecordBatch) -> list[str]:
    return ["" if x is None else x for x in batch.column("text").to_pylist()]


# ---- exchange of chunks

#: Chunks that are encoded once for all workers (about 300 bytes each), different chunks that a task holds before it sends
#: their hashes, and bytes of text for which there is one bucket.
SHARED_CHUNKS, HELD_CHUNKS, CHUNK_BUCKET_BYTES = 40_000, 200_000, 64 << 20
NAMED = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("th", "<u8")])


def chunk_hash(chunk: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "surrogatepass"))


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, th, text): ``doc`` and ``th`` name a text also where ids are null or repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _chunks_of(text: str):
    start = 0
    for end in cuts(text):
        yield text[start:end]
        start = end


def _most_shared(rows: DataFrame, most: int) -> DataFrame:
    """(doc, th, hash) of the chunks that most tasks have, two at least; (doc, th) names one text that has the chunk."""

    def name(batches):
        held: dict[int, tuple[int, int]] = {}

        def flush():
            if held:
                out = np.array([(h, d, t) for h, (d, t) in held.items()], NAMED)
                held.clear()
                packed = list(packed_rows(((out["hash"] >> np.uint64(20)) % np.uint64(n)).astype(np.int64), out))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int64()), pa.array([r.tobytes() for _, r in packed], pa.binary())], ["bucket", "named"])

        for batch in batches:
            for doc, th, text in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), _strings(batch), strict=True):
                for chunk in _chunks_of(text):
                    held.setdefault(chunk_hash(chunk), (doc, th & 0xFFFFFFFFFFFFFFFF))
            if len(held) > HELD_CHUNKS:
                yield from flush()
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        records = np.frombuffer(b"".join(table.column("named").to_pylist()), NAMED)
        records = records[np.lexsort((records["th"], records["doc"], records["hash"]))]
        new = np.flatnonzero(np.r_[True, records["hash"][1:] != records["hash"][:-1]]) if len(records) else np.zeros(0, np.int64)
        times = np.diff(np.r_[new, len(records)])
        lead, times = records[new[times > 1]], times[times > 1]
        if len(lead) > most:  # no more of one bucket can be among the most shared ones of all
            best = np.argsort(-times, kind="stable")[:most]
            lead, times = lead[best], times[best]
        return pa.table({"doc": pa.array(lead["doc"], pa.int64()), "th": pa.array(lead["th"].astype(np.int64), pa.int64()), "hash": pa.array(lead["hash"].astype(np.int64), pa.int64()), "tasks": pa.array(times.astype(np.int64), pa.int64())})

    n = n_buckets(rows, "text", CHUNK_BUCKET_BYTES)
    found = rows.select("doc", "th", "text").mapInArrow(name, "bucket long, named binary").groupBy("bucket").applyInArrow(meet, "doc long, th long, hash long, tasks long")
    return stash(found.orderBy(F.desc("tasks"), "hash").limit(most).select("doc", "th", "hash"))


def _shared_table(rows: DataFrame, json_path: str | None, ranks_path: str | None, most: int = SHARED_CHUNKS):
    """A broadcast of {hash: (first, last, ids)} for the most shared chunks, at most ``most`` of them, each encoded once."""
    wanted = _most_shared(rows, most).groupBy("doc", "th").agg(F.collect_list("hash").alias("hashes"))
    texts = rows.select("doc", "th", "text").join(F.broadcast(wanted), ["doc", "th"])

    def encode(batches):
        encoder = chunk_encoder(json_path, ranks_path)
        for batch in batches:
            out: dict[int, tuple[int, int, bytes]] = {}
            for text, hashes in zip(_strings(batch), batch.column("hashes").to_pylist(), strict=True):
                asked = set(hashes)
                for chunk in _chunks_of(text):
                    h = _signed(chunk_hash(chunk))
                    if h in asked and h not in out:
                        c = encoder.chunks[chunk]
                        out[h] = (-1, -1, b"") if c.first is None else (c.first, c.last, c.ids)
            found = list(out.items())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([x[0] for _, x in found], pa.int32()), pa.array([x[1] for _, x in found], pa.int32()), pa.array([x[2] for _, x in found], pa.binary())], ["hash", "first", "last", "ids"])

    got = texts.mapInArrow(encode, "hash long, first int, last int, ids binary").collect()
    return rows.sparkSession.sparkContext.broadcast({r["hash"] & 0xFFFFFFFFFFFFFFFF: (r["first"], r["last"], bytes(r["ids"])) for r in got})


def _encoded(rows: DataFrame, json_path: str | None, ranks_path: str | None, schema: str, row_of) -> DataFrame:
    """``row_of`` (ids, decoded text, chunks, chunks encoded here) of every row of ``rows``."""
    shared = _shared_table(rows, json_path, ranks_path)
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds[1:]]

    def run(batches):
        encoder, decoder = chunk_encoder(json_path, ranks_path), byte_decoder(json_path)
        encoder.shared = shared.value
        for batch in batches:
            out = []
            for text in _strings(batch):
                before, met = encoder.encoded, encoder.met
                ids = encoder.encode(text)
                out.append(row_of(ids, decoder.decode(ids), encoder.met - met, encoder.encoded - before))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], list(names))

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, ids binary, decoded string): ids little-endian unsigned 32-bit."""
    short_batches(docs.sparkSession)
    return _encoded(_rows(docs, id_col, text_col), json_path, ranks_path, "doc_id long, ids binary, decoded string", lambda ids, text, *_: (ids, text))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts; ``n_chunks``, and ``n_chunks_encoded`` of them that their worker had to encode."""
    short_batches(spark)

    def digest(ids: bytes, text: str, met: int, encoded: int) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), met, encoded

    return _encoded(_rows(documents(spark, sf_dir), "doc_id", "text"), None, None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long, n_chunks_encoded long", digest)


# ---- edit-aware counting


def pretokens(text: str) -> list[str]:
    return (PATTERN if _NOT_LATIN.search(text) else LATIN_PATTERN).findall(text)


class Leaves:
    """(lengths, token counts) by leaf: slices of the whole arrays until an edit gives a leaf its own."""

    def __init__(self, lengths: np.ndarray, numbers: np.ndarray, each: int, n: int):
        self.lengths, self.numbers, self.each, self.n, self.own = lengths, numbers, each, n, {}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int):
        if k in self.own:
            return self.own[k]
        part = slice(k * self.each, (k + 1) * self.each)
        return self.lengths[part], self.numbers[part]

    def __setitem__(self, k: int, value) -> None:
        self.own[k] = value


@functools.cache
def pretoken_counts(json_path: str, ranks_path: str) -> Cache:
    encode, _ = byte_encoder(json_path, ranks_path)
    return Cache(lambda piece: len(encode(piece)))


class CountTree:
    """Token counts of a text's pre-tokens in a segment tree; an edit re-encodes its own surroundings only.

    Leaves are runs of consecutive pre-tokens, about ``LEAF`` each. An edit cuts
    the leaves it touches, with one pre-token of context before and as many
    after as it takes for the new split to fall on an old boundary, splits and
    encodes that region anew, and updates the sums on the leaves' paths.
    """

    LEAF = 16

    def __init__(self, text: str, counts: Cache):
        """``counts``: number of tokens by pre-token."""
        self.counts, self.text, self.encoded = counts, text, 0
        self._grow(pretokens(text))

    def _grow(self, split: list[str]) -> None:
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.counts.__getitem__, split), np.int64, len(split))
        at = np.arange(0, max(1, len(split)), self.LEAF)
        self.n_pretokens = len(split)
        self.leaves = Leaves(lengths, numbers, self.LEAF, len(at))
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        if len(split):
            self.chars[self.size : self.size + len(at)] = np.add.reduceat(lengths, at)
            self.tokens[self.size : self.size + len(at)] = np.add.reduceat(numbers, at)
        level = self.size
        while level > 1:
            for tree in (self.chars, self.tokens):
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf in which character ``at`` stands and where that leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, lengths: np.ndarray, numbers: np.ndarray) -> None:
        self.leaves[leaf] = lengths, numbers
        node = self.size + leaf
        by = int(lengths.sum()) - int(self.chars[node]), int(numbers.sum()) - int(self.tokens[node])
        while node:
            self.chars[node] += by[0]
            self.tokens[node] += by[1]
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) by ``new``."""
        self.apply([(start, end, new)])

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Disjoint edits in the text as it is, in ascending order; applied from the last, so that places stay right."""
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        parts.append(self.text[at:])
        old, self.text = self.text, "".join(parts)
        shift = sum(len(n) - (e - s) for s, e, n in edits)
        for start, end, new in reversed(edits):
            # Text right of this edit is already new; text left of it is still old.
            shift -= len(new) - (end - start)
            self._one(old, start, end, new, shift)

    def _one(self, old: str, start: int, end: int, new: str, shift: int) -> None:
        """``shift``: by how much the edits left of this one will move it in the final text."""
        leaf, base = self._find(max(0, start))
        # Two pre-tokens of context before the edit: a run may grow backwards by one space, white space by one character.
        first, bounds = leaf, None
        while True:
            bounds = base + np.r_[0, np.cumsum(self.leaves[first][0])]
            inside = int(np.searchsorted(bounds, start, "right")) - 1
            if inside - 2 >= 0 or first == 0:
                break
            first -= 1
            base -= int(self.leaves[first][0].sum())
            if base + int(self.leaves[first][0].sum()) <= start and len(self.leaves[first][0]) >= 3:
                bounds = base + np.r_[0, np.cumsum(self.leaves[first][0])]
                inside = len(bounds) - 1
                break
        keep = max(0, inside - 2)
        pos = int(bounds[keep])
        head = [a[:keep] for a in self.leaves[first]]
        # Split anew: in this view the text is old before the edit, new from it on.
        offset = shift  # place in the final text = place in the view + offset, from the edit on
        view = old[pos:start] + self.text[start + offset : start + offset + len(new)]
        grow, tail_at = 64, start + offset + len(new)
        last, after, split = first, base + int(self.leaves[first][0].sum()), []
        target = end
        while True:
            region = view + self.text[tail_at : tail_at + grow]
            complete = tail_at + grow >= len(self.text)
            split, found, p = [], None, pos
            old_bounds = self._bounds_from(first, base, target + grow)
            moved = len(new) - (end - start)
            for m in (PATTERN if _NOT_LATIN.search(region) else LATIN_PATTERN).finditer(region):
                if p >= start + len(new) and p - moved in old_bounds:
                    found = p
                    break
                if not complete and pos + m.end() + 1 >= pos + len(region):
                    break  # may look beyond what is in view
                split.append(m[0])
                p = pos + m.end()
            else:
                if complete:
                    found = p
            if found is not None:
                break
            grow *= 4
        stop = found - moved  # in the old text
        while after < stop and last + 1 < len(self.leaves):
            last += 1
            after += int(self.leaves[last][0].sum())
        lengths = np.concatenate([self.leaves[k][0] for k in range(first, last + 1)])
        numbers = np.concatenate([self.leaves[k][1] for k in range(first, last + 1)])
        rest = int(np.searchsorted(base + np.r_[0, np.cumsum(lengths)], stop))
        self.encoded += len(split)
        fresh = np.fromiter(map(self.counts.__getitem__, split), np.int64, len(split))
        sized = np.fromiter(map(len, split), np.int64, len(split))
        self._set(first, np.concatenate([head[0], sized, lengths[rest:]]), np.concatenate([head[1], fresh, numbers[rest:]]))
        for k in range(first + 1, last + 1):
            self._set(k, lengths[:0], numbers[:0])

    def _bounds_from(self, leaf: int, base: int, to: int) -> set[int]:
        out, at = {base}, base
        while leaf < len(self.leaves) and at <= to:
            for b in (at + np.cumsum(self.leaves[leaf][0])).tolist():
                out.add(b)
                at = b
            leaf += 1
        return out


#: The edits that the query counts: every run of four or more digits is masked, every run of three or more line ends shortened.
EDITS = regex.compile(r"[0-9]{4,}|\n{3,}")


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "#" if m[0][0] != "\n" else "\n\n") for m in EDITS.finditer(text)]


def edited_counts(docs: DataFrame, edits_of=standard_edits, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Tokens of every text before and after its edits, and how many pre-tokens were encoded again.

    Null counts as an empty text. Special-token strings in a text count as the
    ordinary text they are. ``edits_of`` gives disjoint ascending edits of a text.
    """
    short_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]

    def run(batches):
        counts = pretoken_counts(json_path or public_path(BYTE_BPE), ranks_path or public_path(BYTE_RANKS))
        for batch in batches:
            rows = []
            for text in _strings(batch):
                tree = CountTree(text, counts)
                before, edits = tree.total, edits_of(text)
                if edits:
                    tree.apply(edits)
                rows.append((before, len(edits), tree.total, tree.n_pretokens, tree.encoded))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(documents(spark, sf_dir))
