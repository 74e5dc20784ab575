"""TIFF as a media column: a directory walker and decoder, and a writer to store payloads with.

``decode_tiff`` walks the chain of image directories (both byte orders, loops
in the chain end it), undoes PackBits, LZW or deflate of strips or tiles, undoes
the horizontal predictor (2) and the floating-point predictor (3), and yields
one page per directory. ``tiff_pages`` does so for a binary column and emits one
row per page; bytes that are no TIFF, or a directory that cannot be read, give
one row with ``error`` set, a page that cannot be decoded gives one in its
place and the pages behind it follow, never a crash. Null media count as empty
bytes. Equal bytes give equal rows; every row of the table is kept, repeated
and null ids too; other columns are ignored; an empty table gives an empty
result. Texts are stored over as many pages as they need.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import documents, short_batches, texts_of

# Fixed values of the TIFF 6.0 format: tags and field sizes by type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class Page:
    page: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def packbits_encode(data: bytes) -> bytes:
    """PackBits: runs of three or more as runs, the rest as literals of at most 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    out = bytearray()

    def literals(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = data[i : min(i + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    if len(a) == 0:
        return b""
    ends = np.r_[np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)]
    starts = np.r_[0, ends[:-1]]
    done = 0
    for k in np.flatnonzero(ends - starts >= 3).tolist():
        lo, hi = int(starts[k]), int(ends[k])
        literals(done, lo)
        while hi - lo >= 2:
            n = min(128, hi - lo)
            out.append(257 - n)
            out.append(data[lo])
            lo += n
        done = lo
    literals(done, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes most significant bit first, 9 to 12 bits, widened one code early."""
    singles = [bytes([i]) for i in range(256)]
    table = {s: i for i, s in enumerate(singles)}
    bits, n_bits, out, width, following = 256, 9, bytearray(), 9, 258
    w = b""
    for c in data:
        wc = w + singles[c]
        if wc in table:
            w = wc
            continue
        bits = bits << width | table[w]
        n_bits += width
        table[wc] = following
        following += 1
        w = singles[c]
        if following == 512 or following == 1024 or following == 2048:
            width += 1
        elif following == 4094:
            bits = bits << width | 256
            n_bits += width
            table = {s: i for i, s in enumerate(singles)}
            width, following = 9, 258
        if n_bits > 512:
            left = n_bits & 7
            out += (bits >> left).to_bytes(n_bits >> 3, "big")
            bits &= (1 << left) - 1
            n_bits = left
    if w:
        bits = bits << width | table[w]
        n_bits += width
        following += 1
        if following == 512 or following == 1024 or following == 2048:
            width += 1
    bits = bits << width | 257
    n_bits += width
    pad = -n_bits % 8
    return bytes(out) + (bits << pad).to_bytes((n_bits + pad) >> 3, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out, total = [], 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, buffer, n_bits, last = first[:], 9, 0, 0, None
    for i in range(0, len(data), 8):
        part = data[i : i + 8]
        buffer = (buffer & ((1 << n_bits) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
        n_bits += 8 * len(part)
        while n_bits >= width:
            n_bits -= width
            code = buffer >> n_bits & ((1 << width) - 1)
            if code == 257 or total >= size:
                return b"".join(out)
            if code == 256:
                table, width, last = first[:], 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code beyond its table")
                table.append(last + entry[:1])
                n = len(table)
                if n == 511 or n == 1023 or n == 2047:
                    width += 1
            out.append(entry)
            total += len(entry)
            last = entry
    return b"".join(out)


def _compress(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_encode(data)
    if kind == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def _decompress(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        out = data
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (ADOBE_DEFLATE, DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {kind} is not supported")
    if len(out) < size:
        raise ValueError("a strip or tile ends early")
    return out[:size]


def _undo_predictor(kind: int, block: np.ndarray, bits: int, order: str) -> np.ndarray:
    """``block``: rows x columns x samples of raw bytes, last axis the bytes of a sample."""
    if kind == 1:
        return block
    rows, cols, samples, width = block.shape
    if kind == 2:
        if bits not in (8, 16, 32):
            raise ValueError("predictor 2 needs 8, 16 or 32 bits")
        kind_of = np.dtype(f"{order}u{width}")
        return np.cumsum(block.copy().view(kind_of)[..., 0], axis=1, dtype=kind_of.newbyteorder("=")).astype(kind_of)[..., None].view(np.uint8)
    if kind == 3:
        planes = np.cumsum(block.reshape(rows, cols * width, samples) if samples > 1 else block.reshape(rows, -1, 1), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, width, cols * samples).swapaxes(1, 2)
        return (planes if order == ">" else planes[..., ::-1]).reshape(rows, cols, samples, width)
    raise ValueError(f"predictor {kind} is not supported")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        code = FIELD.get(kind)
        if code is None:
            continue
        where = at + 10 + 12 * k
        if struct.calcsize(code) * count > 4:
            (where,) = struct.unpack_from(f"{order}I", data, where)
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, number: int, tags: dict[int, tuple], order: str) -> Page:
    def get(tag, default=None):
        got = tags.get(tag, (default,))[0]
        if got is None:
            raise ValueError(f"tag {tag} is missing")
        return got

    width, height, samples, bits = get(WIDTH), get(HEIGHT), get(SAMPLES, 1), get(BITS, 1)
    packing, predictor, planar = get(COMPRESSION, NONE), get(PREDICTOR, 1), get(PLANAR, 1)
    tiled = TILE_OFFSETS in tags
    if tiled:
        cell_w, cell_h, offsets, counts = get(TILE_WIDTH), get(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        cell_w, cell_h, offsets, counts = width, min(get(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    planes, per_cell = (samples, 1) if planar == 2 else (1, samples)
    if bits % 8:
        if predictor != 1 or tiled or planes > 1:
            raise ValueError("bits below 8 are read from plain strips only")
        row = (width * samples * bits + 7) // 8
        parts = [_decompress(packing, data[o : o + c], row * min(cell_h, height - k * cell_h)) for k, (o, c) in enumerate(zip(offsets, counts, strict=True))]
        return Page(number, width, height, bits, samples, packing, predictor, tiled, b"".join(parts))
    size, across = bits // 8, -(-width // cell_w)
    down = -(-height // cell_h)
    out = np.zeros((height, width, samples, size), np.uint8)
    for k, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * cell_h, cell % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - y)
        raw = _decompress(packing, data[o : o + c], rows * cell_w * per_cell * size)
        block = _undo_predictor(predictor, np.frombuffer(raw, np.uint8).reshape(rows, cell_w, per_cell, size), bits, order)
        h, w = min(rows, height - y), min(cell_w, width - x)
        out[y : y + h, x : x + w, plane : plane + per_cell if planes > 1 else samples] = block[:h, :w]
    return Page(number, width, height, bits, samples, packing, predictor, tiled, out.tobytes())


#: What reading bytes that are no valid TIFF, or no supported one, may raise.
UNREADABLE = (ValueError, TypeError, struct.error, zlib.error, KeyError, IndexError, OverflowError, MemoryError)


def walk_tiff(data: bytes) -> Iterator[Page | Exception]:
    """One page per image directory, in the order of their chain; an error in place of a page that cannot be decoded."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen, number = set(), 0
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        try:
            page = _page(data, number, tags, order)
        except UNREADABLE as e:
            page = e
        yield page
        number += 1


def decode_tiff(data: bytes) -> Iterator[Page]:
    """The pages of ``walk_tiff``; the first error is raised."""
    for page in walk_tiff(data):
        if isinstance(page, Exception):
            raise page
        yield page


def encode_tiff(images: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 512) -> bytes:
    """8-bit grey images (rows x columns), little-endian; ``tile``: side of the tiles (a multiple of 16), 0 for strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        cells = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    part = image[y : y + tile, x : x + tile]
                    cells.append(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]))))
        else:
            cells = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.diff(cell, axis=1, prepend=np.uint8(0))
            packed = _compress(compression, cell.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        tags.sort()
        fields = bytearray(struct.pack("<H", len(tags)))
        for tag, kind, values in tags:
            raw = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                out += b"\0" * (len(out) % 2)
                raw = struct.pack("<I", where)
            fields += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(fields)
        out += fields + b"\0\0\0\0"
    return bytes(out)


def page_feature(pixels: bytes) -> str:
    """Mean, deviation, share of distinct values and a 64-bit difference hash of the samples."""
    a = np.frombuffer(pixels, np.uint8)
    if not len(a):
        return "empty"
    cells = np.add.reduceat(a.astype(np.int64), np.linspace(0, len(a) - 1, 65).astype(np.int64))
    bits = int("".join("1" if d > 0 else "0" for d in np.diff(cells).tolist()), 2)
    return f"mean={a.mean():.4f};std={a.std():.4f};distinct={len(np.flatnonzero(np.bincount(a, minlength=256)))};dhash={bits:016x}"


PAGES = "doc_id long, page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of the TIFF files in ``media_col``; pixels are row by row, samples interleaved."""
    short_batches(df.sparkSession)

    def decode(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column("id").to_pylist(), texts_of(batch, "media"), strict=True):
                try:
                    for k, p in enumerate(walk_tiff(data)):
                        rows.append((i, k, *[None] * 8, f"{type(p).__name__}: {p}") if isinstance(p, Exception) else (i, k, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.tiled, p.pixels, None))
                except UNREADABLE as e:
                    rows.append((i, *[None] * 9, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
            names = ["doc_id", "page", "width", "height", "bits", "samples", "compression", "predictor", "tiled", "pixels", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return df.select(df[id_col].cast("long").alias("id"), df[media_col].cast("binary").alias("media")).mapInArrow(decode, PAGES)


#: How payloads are stored: the SHA-256 picks one of these (compression, predictor, tile side), so equal texts are stored equally.
LAYOUTS = ((LZW, 1, 0), (ADOBE_DEFLATE, 2, 64), (PACKBITS, 1, 0), (DEFLATE, 2, 0), (LZW, 2, 64), (ADOBE_DEFLATE, 1, 0), (PACKBITS, 2, 64), (DEFLATE, 1, 16))
#: Samples of a row and rows of a page of stored payloads.
ROW, PAGE_ROWS = 64, 512


def store_payload(text: bytes) -> bytes:
    """The text, padded with zero bytes to a positive multiple of 64, as grey images of 64 columns, one page after another."""
    payload = text + b"\0" * (-len(text) % ROW or (0 if text else ROW))
    compression, predictor, tile = LAYOUTS[hashlib.sha256(payload).digest()[0] % len(LAYOUTS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode_tiff([image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)], compression, predictor, tile, rows_per_strip=128)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a TIFF, reads the stored bytes back and digests them."""
    short_batches(spark)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                media = store_payload(text)
                read = b"".join(p.pixels for p in decode_tiff(media))
                rows.append((i, len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), page_feature(read)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(digest, schema)
