"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Two windows of ``length`` bytes are equal only if they hold the same anchor at
the same place: the smallest hashed gram among their first places. So every
window belongs to one anchor, the windows of an anchor are a run of
consecutive places, and equal windows have anchors with equal content. That
content names the suffix bucket. Buckets travel as packed binary records (36
bytes for about 120 windows). In a bucket,

* an anchor without a second one of equal content repeats nothing;
* anchors whose whole strips (all their windows) are equal repeat in full; the
  records of equal strips are combined map-side, only one of them goes on;
* what remains, strips of equal anchors that differ somewhere, is fetched as
  bytes and sorted, one block of buckets at a time: samples at the places of a
  difference cover get ranks by doubling, windows are sorted by the ranks of
  the samples that the cover guarantees in them, and only ties are compared at
  the few bytes before the first sample and behind the last.

A bucket with more than ``WIDE`` different strips is not sorted in one task: its
windows are dealt out by their own hash, combined map-side.

``passages`` applies the same steps to words: a text becomes the sequence of
its words' 32-bit hashes, in which a window of 4 * n bytes is one of n words.

Null counts as an empty text. Texts shorter than the window repeat nothing.
Equal rows count as each other's copies and give equal results; rows that
share an id but not the text are kept apart. Extra columns are ignored; an
empty table gives an empty result. Very long texts are cut into overlapping
pieces that cover every window once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, mix, n_buckets, packed_rows, prefix_hash, short_batches, stash, texts_of, window_hash

LENGTH, GRAM = 400, 24
#: Words of a passage whose repetition ``op8_repeats`` reports besides the contract's bytes.
PASSAGE_WORDS = 50
PIECE = 1 << 19
BUCKET_BYTES, STRIP_BYTES, WIDE = 16 << 20, 8 << 20, 4096
#: A perfect difference set (Singer): every residue mod 57 is a difference of two of its members.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)

ANCHORED = np.dtype([("key", "<u8"), ("strip", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("lo", "<u4"), ("n", "<u2"), ("rel", "<u2")])
MULTI = 1 << 15
SPAN = np.dtype([("doc", "<i8"), ("th", "<u4"), ("lo", "<u4"), ("n", "<u4")])
WINDOW = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("lo", "<u4"), ("n", "<u4")])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(pieces: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> np.ndarray:
    """Records of the anchors of (doc, text hash, place, bytes) pieces, all together shorter than 2 ** 20 bytes.

    An anchor is two fifths of a window long: longer ones name smaller buckets, shorter ones are fewer.
    """
    anchor = 2 * length // 5
    pieces = [p for p in pieces if len(p[3]) >= length]
    if not pieces:
        return np.empty(0, ANCHORED)
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[3]) for p in pieces])
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = window_hash(prefix, at, at + GRAM)
    place = np.uint64((1 << 20) - 1)
    least = sliding_least(grams & ~place | at.astype(np.uint64), length - anchor + 1)
    piece = np.searchsorted(ends, np.arange(len(data)), "right")
    start = np.flatnonzero(np.arange(len(data)) + length <= ends[piece])
    where = (least[start] & place).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(where) != 0) | (np.diff(start) != 1)])
    lo, n, where = start[new], np.diff(np.r_[new, len(start)]), where[new]
    out = np.empty(len(new), ANCHORED)
    rel = where - lo
    out["key"] = window_hash(prefix, where, where + anchor)
    out["strip"] = mix(window_hash(prefix, lo, lo + n - 1 + length) ^ mix((rel * 512 + n).astype(np.uint64)))
    own = piece[lo]
    begin = np.r_[0, ends[:-1]]
    for k, name in ((0, "doc"), (1, "th")):
        out[name] = np.array([p[k] for p in pieces], out.dtype[name])[own]
    out["lo"] = lo - begin[own] + np.array([p[2] for p in pieces])[own]
    out["n"], out["rel"] = n, rel
    return out


def _equal_runs(records: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted records, run of each, whether it begins a run) by the fields named."""
    records = records[np.lexsort((records["lo"], records["doc"], *(records[n] for n in reversed(names))))]
    first = np.ones(len(records), bool)
    if len(records) > 1:
        first[1:] = False
        for n in names:
            first[1:] |= records[n][1:] != records[n][:-1]
    return records, np.cumsum(first) - 1, first


def _spans(records: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    for n in ("doc", "th", "lo"):
        out[n] = records[n]
    out["n"] = (records["n"] & (MULTI - 1)).astype(np.uint32) - 1 + length
    return out


def _combine(records: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(one record of each run of equal strips, marked if it has more, spans of the others)."""
    records, run, first = _equal_runs(records, "key", "strip")
    lead = records[first].copy()
    lead["n"] |= np.where(np.bincount(run) > 1, MULTI, 0).astype(np.uint16)
    return lead, _spans(records[~first], length)


def _packed(buckets: dict[int, list[bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(buckets), pa.int64()), *(pa.array([v[k] for v in buckets.values()], pa.binary()) for k in range(len(names)))], ["bucket", *names])


def _blob(table: pa.Table, name: str, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype)


#: What a pass looks for: (bytes of a window, whether the bytes are word hashes).
Plan = tuple[int, bool]
FOUND = "doc long, th long, lo long, n long, rel int, key long, wanted boolean, wide boolean"


def _found(spans: np.ndarray, asked: np.ndarray | None = None, wanted: np.ndarray | None = None, wide: np.ndarray | None = None) -> pa.Table:
    k = len(spans)
    asked = np.empty(0, ANCHORED) if asked is None else asked
    j = len(asked)
    blank = lambda kind: pa.array([None] * k, kind)
    return pa.table({
        "doc": pa.array(np.r_[spans["doc"], asked["doc"]], pa.int64()),
        "th": pa.array(np.r_[spans["th"], asked["th"]].astype(np.int64), pa.int64()),
        "lo": pa.array(np.r_[spans["lo"], asked["lo"]].astype(np.int64), pa.int64()),
        "n": pa.array(np.r_[spans["n"], (asked["n"] & (MULTI - 1)).astype(np.uint32)].astype(np.int64), pa.int64()),
        "rel": pa.concat_arrays([blank(pa.int32()), pa.array(asked["rel"].astype(np.int32), pa.int32())]),
        "key": pa.concat_arrays([blank(pa.int64()), pa.array(asked["key"].view(np.int64) if j else [], pa.int64())]),
        "wanted": pa.concat_arrays([blank(pa.bool_()), pa.array(wanted if j else [], pa.bool_())]),
        "wide": pa.concat_arrays([blank(pa.bool_()), pa.array(wide if j else [], pa.bool_())]),
    })


def _first_pass(rows: DataFrame, plan: Plan, n: int, wide_from: int) -> DataFrame:
    length, by_words = plan

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush():
            if not held:
                return
            lead, spans = _combine(np.concatenate(held), length)
            held.clear()
            buckets: dict[int, list[bytes]] = {}
            for b, r in packed_rows((lead["key"] % np.uint64(n)).astype(np.int64), lead):
                buckets.setdefault(b, [b"", b""])[0] = r.tobytes()
            for b, r in packed_rows((mix(spans["doc"].astype(np.uint64)) % np.uint64(n)).astype(np.int64), spans):
                buckets.setdefault(b, [b"", b""])[1] = r.tobytes()
            yield _packed(buckets, ["anchors", "spans"])

        for batch in batches:
            for doc, th, text in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), _streams(texts_of(batch), by_words), strict=True):
                for at in range(0, max(1, len(text) - length + 1), PIECE):
                    piece = text[at : at + PIECE + length - 1]
                    if size + len(piece) >= 1 << 20:
                        held.append(anchors(part, length))
                        part, size = [], 0
                        if sum(map(len, held)) > 300_000:
                            yield from flush()
                    part.append((doc, th, at, piece))
                    size += len(piece)
        held.append(anchors(part, length))
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        records, spans = _blob(table, "anchors", ANCHORED), _blob(table, "spans", SPAN)
        if not len(records):
            return _found(spans)
        records, run, first = _equal_runs(records, "key", "strip")
        many = np.bincount(run) > 1
        np.logical_or.at(many, run, records["n"] >= MULTI)
        spans = np.concatenate([spans, _spans(records[many[run]], length)])
        lead = records[first]
        strips = np.r_[True, lead["key"][1:] != lead["key"][:-1]]
        bucket = np.cumsum(strips) - 1
        kinds = np.bincount(bucket)[bucket]
        return _found(spans, lead[kinds > 1], ~many[kinds > 1], kinds[kinds > 1] > wide_from)

    packed = rows.mapInArrow(cut, "bucket long, anchors binary, spans binary")
    return packed.groupBy("bucket").applyInArrow(meet, FOUND)


# ---- sorting with the difference cover

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: From a residue: steps forward to the next sample, steps back to the last one.
_AHEAD = np.array([next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD]) for r in range(PERIOD)])
_BACK = np.array([next(d for d in range(PERIOD) if _IN_COVER[(r - d) % PERIOD]) for r in range(PERIOD)])
_ORDER = np.cumsum(_IN_COVER) - 1


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples: equal tuples, equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _bytes_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[at]).view(f"V{width}").ravel()


def repeated_windows(strips: list[bytes], rel: np.ndarray, bucket: np.ndarray, length: int = LENGTH, block: int = 200_000) -> list[np.ndarray]:
    """For each strip, which of its windows occur elsewhere among the strips of its bucket.

    ``rel``: place of the anchor in its strip; strips stand such that anchors fall on residue 0, so that windows at
    the same distance from their anchors, the only ones that can be equal, meet the same samples.
    """
    ranked, rest = (length - PERIOD) // PERIOD * PERIOD, length % PERIOD
    base, at = [], 0
    for s, r in zip(strips, rel.tolist(), strict=True):
        at += -(at + r) % PERIOD
        base.append(at)
        at += len(s)
    data = np.zeros(at + length + 2 * PERIOD, np.uint8)
    for s, b in zip(strips, base, strict=True):
        data[b : b + len(s)] = np.frombuffer(s, np.uint8)
    periods = (at + length) // PERIOD
    samples = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
    each = len(COVER)
    # Ranks of samples by doubling, up to the largest multiple of the period that leaves room for a sample's step.
    by_length = {PERIOD: np.unique(_bytes_at(data, samples, PERIOD), return_inverse=True)[1]}

    def pair(x: int, y: int) -> np.ndarray:
        moved = np.full(len(samples), -1, np.int64)
        shift = x // PERIOD * each
        moved[: max(0, len(samples) - shift)] = by_length[y][shift:]
        return _ranked(by_length[x], moved)

    have = PERIOD
    while have * 2 <= ranked:
        by_length[have * 2] = pair(have, have)
        have *= 2
    while have < ranked:
        step = max(x for x in by_length if x <= ranked - have)
        by_length[have + step] = pair(have, step)
        have += step
    ranks = by_length[ranked]

    out: list[np.ndarray] = [np.zeros(0, bool)] * len(strips)
    order = np.argsort(bucket, kind="stable")
    counts = np.array([len(s) - length + 1 for s in strips])
    lo = 0
    while lo < len(order):  # one block of whole buckets at a time
        hi, total = lo, 0
        while hi < len(order) and (hi == lo or total < block or bucket[order[hi]] == bucket[order[hi - 1]]):
            total += counts[order[hi]]
            hi += 1
        part = order[lo:hi]
        own = np.repeat(np.arange(len(part)), counts[part])
        inner = np.arange(len(own)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        place = np.array(base)[part][own] + inner
        head = place + _AHEAD[place % PERIOD]
        tail = place + length - ranked
        tail = tail - _BACK[tail % PERIOD]
        index = lambda p: p // PERIOD * each + _ORDER[p % PERIOD]
        run = _ranked(bucket[part][own], inner - rel[part][own], ranks[index(head)], ranks[index(tail)])
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        ends = np.concatenate([_bytes_at(data, place[tied], PERIOD).view(np.uint8).reshape(-1, PERIOD), _bytes_at(data, place[tied] + length - PERIOD, PERIOD).view(np.uint8).reshape(-1, PERIOD)], 1)
        if len(tied):
            rim = np.unique(np.ascontiguousarray(ends).view(f"V{2 * PERIOD}").ravel(), return_inverse=True)[1]
            same = _ranked(run[tied], rim)
            again = np.zeros(len(own), bool)
            again[tied] = np.bincount(same)[same] > 1
        else:
            again = np.zeros(len(own), bool)
        for k, s in enumerate(np.split(again, np.cumsum(counts[part])[:-1])):
            out[part[k]] = s
        lo = hi
    return out


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


ASKED = np.dtype([("lo", "<u4"), ("n", "<u2"), ("rel", "<u2"), ("key", "<i8"), ("wanted", "u1"), ("wide", "u1")])


def _per_document(rows: DataFrame, pack, n: int) -> DataFrame:
    """One row (doc, th, packed binary) for each document of ``rows``, by ``pack`` (records of a document to bytes)."""

    def run(table: pa.Table) -> pa.Table:
        frame = {c: table.column(c).to_numpy() for c in table.column_names if c != "bucket"}
        order = np.lexsort((frame["lo"], frame["th"], frame["doc"]))
        frame = {c: v[order] for c, v in frame.items()}
        new = np.flatnonzero(np.r_[True, (np.diff(frame["doc"]) != 0) | (np.diff(frame["th"]) != 0)])
        blobs = [pack({c: v[a:b] for c, v in frame.items()}) for a, b in zip(new, np.r_[new[1:], len(order)], strict=True)]
        return pa.table({"doc": pa.array(frame["doc"][new], pa.int64()), "th": pa.array(frame["th"][new], pa.int64()), "packed": pa.array(blobs, pa.binary())})

    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc", "th"), F.lit(n))).groupBy("bucket").applyInArrow(run, "doc long, th long, packed binary")


def _pack_asked(f: dict[str, np.ndarray]) -> bytes:
    out = np.empty(len(f["lo"]), ASKED)
    for c in ASKED.names:
        out[c] = f[c]
    return out.tobytes()


def _pack_spans(f: dict[str, np.ndarray]) -> bytes:
    """Maximal runs of covered bytes as (start, end)."""
    lo, hi = f["lo"], f["lo"] + f["n"]
    reach = np.maximum.accumulate(hi)
    new = np.r_[True, lo[1:] > reach[:-1]]
    return np.stack([lo[new], np.r_[reach[:-1][new[1:]], reach[-1]]], 1).astype("<i8").tobytes()


def _second_pass(rows: DataFrame, found: list[DataFrame], plans: list[Plan], n: int) -> list[DataFrame]:
    """For each plan the spans of strips that differ from the others of their bucket somewhere; texts are fetched once for all."""
    sizes, asked = [], None
    for k, each in enumerate(found):
        each = each.filter("key IS NOT NULL")
        sizes.append([int(x or 0) for x in each.agg(F.count(F.lit(1)), F.sum(F.col("wide").cast("long"))).first()])
        packed = _per_document(each.select("doc", "th", "lo", "n", "rel", "key", "wanted", "wide"), _pack_asked, n).withColumnRenamed("packed", f"packed{k}")
        asked = packed if asked is None else asked.join(packed, ["doc", "th"], "full")
    if not any(x for x, _ in sizes):
        return [each.filter("key IS NULL").select("doc", "th", "lo", "n").limit(0) for each in found]
    # Buckets of strips to sort, and behind them buckets of windows of crowded anchors.
    buckets = [(max(1, -(-x * 600 // STRIP_BYTES)), max(1, -(-wide * 120 * WINDOW.itemsize // STRIP_BYTES))) for x, wide in sizes]
    texts = rows.select("doc", "th", "text").join(stash(asked), ["doc", "th"])

    def fetch(batches):
        for batch in batches:
            out = []
            docs, ths, texts_ = batch.column("doc").to_pylist(), batch.column("th").to_pylist(), texts_of(batch)
            for plan, ((length, by_words), (narrow, wide_n)) in enumerate(zip(plans, buckets, strict=True)):
                wanted_here = batch.column(f"packed{plan}").to_pylist()
                windows: list[np.ndarray] = []
                for doc, th, raw, text in zip(docs, ths, wanted_here, _streams([t if r else b"" for t, r in zip(texts_, wanted_here, strict=True)], by_words), strict=True):
                    records = np.frombuffer(raw or b"", ASKED)
                    for lo, k, rel, key, wanted, wide in records.tolist():
                        if not wide:
                            out.append((plan, (key & 0xFFFFFFFFFFFFFFFF) // 0x9E3779B1 % narrow, doc, th, lo, rel, key, bool(wanted), text[lo : lo + k - 1 + length], None, None))
                    if records["wide"].any():
                        windows += _windows_of(doc, th, text, records[records["wide"] > 0], length)
                if windows:
                    for b, (lead, spans) in _dealt_windows(np.concatenate(windows), length, wide_n).items():
                        out.append((plan, narrow + b, *[None] * 7, lead, spans))
            columns = list(zip(*out, strict=True)) or [()] * 11
            kinds = (pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["plan", "bucket", "doc", "th", "lo", "rel", "key", "wanted", "strip", "windows", "spans"])

    def decide(table: pa.Table) -> pa.Table:
        plan = table.column("plan")[0].as_py()
        length, (narrow, _) = plans[plan][0], buckets[plan]
        if table.column("bucket")[0].as_py() >= narrow:
            spans = _met_windows(_blob(table, "windows", WINDOW), _blob(table, "spans", SPAN), length)
            return pa.table({"plan": pa.array(np.full(len(spans), plan), pa.int64()), **{c: pa.array(spans[c].astype(np.int64), pa.int64()) for c in ("doc", "th", "lo", "n")}})
        pieces = table.column("strip").to_pylist()
        again = repeated_windows(pieces, table.column("rel").to_numpy().astype(np.int64), np.unique(table.column("key").to_numpy(), return_inverse=True)[1], length)
        out = []
        for doc, th, lo, wanted, flags in zip(*(table.column(c).to_pylist() for c in ("doc", "th", "lo", "wanted")), again, strict=True):
            if wanted:
                out += [(plan, doc, th, lo + a, b - a - 1 + length) for a, b in zip(*(x.tolist() for x in _runs_of(flags)), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("plan", "doc", "th", "lo", "n"), columns, strict=True)})

    fetched = texts.mapInArrow(fetch, "plan int, bucket long, doc long, th long, lo long, rel int, key long, wanted boolean, strip binary, windows binary, spans binary")
    decided = stash(fetched.groupBy("plan", "bucket").applyInArrow(decide, "plan long, doc long, th long, lo long, n long"))
    return [decided.filter(F.col("plan") == k).select("doc", "th", "lo", "n") for k in range(len(plans))]


def _windows_of(doc: int, th: int, text: bytes, asked: np.ndarray, length: int) -> list[np.ndarray]:
    """Records of all windows of the strips asked for."""
    prefix, out = prefix_hash(np.frombuffer(text, np.uint8)), []
    for lo, k, _, key, *_ in asked.tolist():
        at = np.arange(lo, lo + k)
        w = np.empty(k, WINDOW)
        w["key"], w["hash"], w["doc"], w["th"], w["lo"], w["n"] = key & 0xFFFFFFFFFFFFFFFF, window_hash(prefix, at, at + length), doc, th, at, 1
        out.append(w)
    return out


def _dealt_windows(windows: np.ndarray, length: int, n: int) -> dict[int, list[bytes]]:
    """Windows dealt out by content: [one of each run of equal ones with their number, spans of the others] by bucket."""
    windows, run, first = _equal_runs(windows, "key", "hash")
    lead, others = windows[first].copy(), windows[~first]
    lead["n"] = np.bincount(run)
    spans = np.empty(len(others), SPAN)
    for c in ("doc", "th", "lo"):
        spans[c] = others[c]
    spans["n"] = length
    buckets: dict[int, list[bytes]] = {}
    for b, r in packed_rows((lead["hash"] % np.uint64(n)).astype(np.int64), lead):
        buckets.setdefault(b, [b"", b""])[0] = r.tobytes()
    for b, r in packed_rows((mix(spans["doc"].astype(np.uint64)) % np.uint64(n)).astype(np.int64), spans):
        buckets.setdefault(b, [b"", b""])[1] = r.tobytes()
    return buckets


def _met_windows(windows: np.ndarray, spans: np.ndarray, length: int) -> np.ndarray:
    """Spans of windows that occur twice, with those found before."""
    if not len(windows):
        return spans
    windows, run, _ = _equal_runs(windows, "key", "hash")
    again = windows[np.bincount(run, weights=windows["n"])[run] > 1]
    more = np.empty(len(again), SPAN)
    for c in ("doc", "th", "lo"):
        more[c] = again[c]
    more["n"] = length
    return np.concatenate([spans, more])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, th, text): ``doc`` and ``th``, a hash of the text, name a row's text also where ids are null or repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("th"), text.alias("text"))


def _packed_spans(rows: DataFrame, plans: list[Plan], wide_from: int = WIDE) -> list[DataFrame]:
    """For each plan (doc, th, packed) of the texts of ``rows`` (doc, th, text) that hold a repeated window."""
    n = n_buckets(rows, "text", BUCKET_BYTES)
    found = [stash(_first_pass(rows, plan, n, wide_from)) for plan in plans]
    more = _second_pass(rows, found, plans, n)
    return [stash(_per_document(f.filter("key IS NULL").select("doc", "th", "lo", "n").union(m), _pack_spans, n)) for f, m in zip(found, more, strict=True)]


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", wide_from: int = WIDE) -> DataFrame:
    """(doc_id, text, packed): ``packed`` has the maximal repeated runs of a document as little-endian (start, end) pairs, or is null."""
    short_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    return rows.join(_packed_spans(rows, [(length, False)], wide_from)[0], ["doc", "th"], "left").select("doc_id", "text", "packed")


def word_stream(texts: list[bytes]) -> list[bytes]:
    """The 32-bit hashes of each text's words (runs without ASCII white space), little-endian."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = (data == 0x20) | (data >= 0x09) & (data <= 0x0D)
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = window_hash(prefix_hash(data), starts, ends).astype("<u4")
    limits = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    return [words[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]


def _streams(texts: list[bytes], by_words: bool) -> list[bytes]:
    """The texts, or their word streams, made of about a MB of text at a time."""
    if not by_words:
        return texts
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > 1 << 20:
            out += word_stream(part)
            part, size = [], 0
    return out + word_stream(part) if part else out


def passages(docs: DataFrame, words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, repeats_passage) of every row: whether ``words`` words in a row occur anywhere else, white space aside."""
    short_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    marked = _packed_spans(rows, [(4 * words, True)])[0].select("doc", "th", F.lit(True).alias("repeats_passage"))
    return rows.select("doc_id", "doc", "th").join(marked, ["doc", "th"], "left").select("doc_id", F.coalesce("repeats_passage", F.lit(False)).alias("repeats_passage"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, spans array of (start, end)) of every row."""

    def cut(batches):
        for batch in batches:
            kept, spans = [], []
            for text, raw in zip(texts_of(batch), batch.column("packed").to_pylist(), strict=True):
                own = np.frombuffer(raw or b"", "<i8").reshape(-1, 2).tolist()
                kept.append(_rest(text, own))
                spans.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "spans"])

    return repeated_spans(docs, length, id_col, text_col).mapInArrow(cut, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def _rest(text: bytes, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what is left of every text, and whether it holds a repeated passage of PASSAGE_WORDS words or more."""
    short_batches(spark)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage"]

    def digest(batches):
        for batch in batches:
            out = []
            for text, raw, marked in zip(texts_of(batch), batch.column("packed").to_pylist(), batch.column("marked").to_pylist(), strict=True):
                spans = np.frombuffer(raw or b"", "<i8").reshape(-1, 2).tolist()
                out.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_rest(text, spans)).hexdigest(), bool(marked)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = _rows(documents(spark, sf_dir), "doc_id", "text")
    spans, passages_ = _packed_spans(rows, [(LENGTH, False), (4 * PASSAGE_WORDS, True)])
    side = stash(spans.join(passages_.select("doc", "th", F.lit(True).alias("marked")), ["doc", "th"], "full"))
    return rows.join(side, ["doc", "th"], "left").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats_passage boolean")
