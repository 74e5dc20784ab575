"""Tokens, TIFF and packing against the library, exact round trips and plain recomputation."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from symloom.llm import media, packing, tokens


def test_chunk_encoder_equals_the_library(rows):
    library, encoder, decoder = tokens.tokenizer(tokens.public_path(tokens.BYTE_BPE)), tokens.ChunkEncoder(), tokens.Decoder()
    rng = random.Random(1)
    odd = ["".join(rng.choices("ab 1'\n.,é  sltrevmd²\x1c\xa0 ", k=rng.randint(1, 600))) for _ in range(200)]
    for text in [*(t or "" for _, t in rows), *odd, " " * 900, "'s" * 300]:
        want = library.encode(text, add_special_tokens=False).ids
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert encoder.chunks.missed > 0


def test_encode_documents_keeps_every_row(docs, rows, nothing):
    got = tokens.encode_documents(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert tokens.encode_documents(nothing).count() == 0


def test_shared_chunks_are_encoded_once_for_all(spark, docs, rows, tmp_path):
    """Digests of the query are those of the library, and chunks that tasks share come from the exchange."""
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    library = tokens.tokenizer(tokens.public_path(tokens.BYTE_BPE))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.op9_bpe(spark, str(tmp_path)).collect())
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    table = tokens._rows(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", "text")
    shared = tokens._shared_table(table, None, None).value
    assert shared and len(tokens._shared_table(table, None, None, most=2).value) == 2
    encoder = tokens.ChunkEncoder()
    encoder.shared = shared
    base = dict(rows)[7]
    assert np.frombuffer(encoder.encode(base), "<u4").tolist() == library.encode(base, add_special_tokens=False).ids and encoder.encoded == 0


def test_count_tree_follows_edits(rows):
    counts = tokens.pretoken_counts(tokens.public_path(tokens.BYTE_BPE), tokens.public_path(tokens.BYTE_RANKS))
    library = tokens.byte_encoder(tokens.public_path(tokens.BYTE_BPE), tokens.public_path(tokens.BYTE_RANKS))[1]
    rng = random.Random(2)
    for text in [t or "" for _, t in rows if len(t or "") < 4000]:
        tree = tokens.CountTree(text, counts)
        for _ in range(3):
            n = len(tree.text)
            places = sorted(rng.sample(range(n + 1), min(n + 1, 4) // 2 * 2)) if n > 2 else [0, n]
            tree.apply([(a, b, "".join(rng.choices("ab 1'\n", k=rng.randint(0, 4)))) for a, b in zip(places[::2], places[1::2], strict=True)])
            assert tree.total == len(library.encode(tree.text, add_special_tokens=False).ids)
    long = tokens.CountTree("word " * 5000, counts)
    long.edit(12000, 12004, "other")
    assert long.encoded < 30


def test_edited_counts_over_a_table(docs, rows, nothing):
    got = tokens.edited_counts(docs).collect()
    assert len(got) == len(rows) and all(r.n_reencoded <= r.n_pretokens + 50 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert tokens.edited_counts(nothing).count() == 0


def images(rng):
    for n in (1, 63, 64, 65, 700, 9000):
        data = np.frombuffer(bytes(rng.choices(b"abcd  the\n", k=n)), np.uint8)
        yield np.pad(data, (0, -n % 64)).reshape(-1, 64)


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.ADOBE_DEFLATE, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize(("predictor", "tile"), [(1, 0), (2, 0), (1, 16), (2, 64)])
def test_tiff_round_trip(compression, predictor, tile):
    for image in images(random.Random(3)):
        pages = list(media.decode_tiff(media.encode_tiff([image, image[:1]], compression, predictor, tile, rows_per_strip=7)))
        assert [p.pixels for p in pages] == [image.tobytes(), image[:1].tobytes()]
        assert pages[0].tiled == bool(tile) and pages[0].predictor == predictor


def test_big_endian_and_float_predictor():
    values = np.array([[1.5, 2.25, -3.0, 7.0]], ">f4")
    planes = values.view(np.uint8).reshape(1, 4, 4).swapaxes(1, 2).reshape(1, 16)
    strip = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
    tags = [(256, 4), (257, 1), (258, 32), (259, 1), (262, 1), (273, 8), (277, 1), (278, 1), (279, 16), (317, 3), (339, 3)]
    body = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0"
    (page,) = media.decode_tiff(b"MM\0*" + struct.pack(">I", 24) + strip + body)
    assert np.frombuffer(page.pixels, ">f4").tolist() == values[0].tolist()


def test_tiff_column(spark):
    good = media.encode_tiff([np.zeros((2, 64), np.uint8)] * 3)
    df = spark.createDataFrame([(1, good), (2, b"not"), (3, None), (4, good[:40]), (1, good)], "doc_id long, media binary")
    got = media.tiff_pages(df).collect()
    assert sorted((r.doc_id, r.page) for r in got if r.error is None) == sorted([(1, 0), (1, 1), (1, 2)] * 2)
    assert {r.doc_id for r in got if r.error} == {2, 3, 4}


def test_payload_is_lossless(rows):
    for _, text in rows:
        raw = (text or "").encode()
        stored = media.store_payload(raw)
        payload = b"".join(p.pixels for p in media.decode_tiff(stored))
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(raw)] == raw and not payload[len(raw) :].strip(b"\0")
        assert stored == media.store_payload(raw)


def test_word_ids_equal_the_library(rows):
    library, encoder = tokens.tokenizer(tokens.public_path(tokens.WORD_BPE)), packing.word_encoder(tokens.public_path(tokens.WORD_BPE))
    for text in [*(t or "" for _, t in rows), "I'LL don't '''s", "İ Σας ΟΔΟΣ éÉ", "１2 ²½ ﬁ", "a\xa0b\x85c"]:
        assert np.frombuffer(packing.word_ids(text, encoder), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_gapless_and_dense(docs, rows, nothing):
    library = tokens.tokenizer(tokens.public_path(tokens.WORD_BPE))
    got = packing.pack_documents(docs).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID])
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.start == r.piece * 4096
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in rows)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack_documents(nothing).count() == 0


def test_shards_meet_again(spark):
    rng = random.Random(4)
    parts = spark.createDataFrame([(k, 0, rng.randint(1, 60)) for k in range(500)], "doc_id long, piece int, length long")
    got = packing.pack_pieces(parts, capacity=64, shard_size=50, full=0.98).collect()
    assert len(got) == 500 and len({r.sequence_id for r in got}) < 1.12 * sum(r.length for r in got) / 64
    fills: dict = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 64


def test_exchange_empties_bins():
    bins = packing.Bins([6, 6, 6, 3, 3, 3, 2, 2, 2], 10)
    bins.items, bins.fill = [[0, 3], [1, 4], [2, 5], [6, 7, 8]], [9, 9, 9, 6]
    before = sum(f * f for f in bins.fill)
    bins.exchange()
    assert sum(f * f for f in bins.fill) >= before and sum(bins.fill) == 33 and sorted(i for b in bins.items for i in b) == list(range(9))


def test_op_digests(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = media.op2_media(spark, str(tmp_path)).collect()
    assert all(r.payload_bytes % 64 == 0 for r in out) and len({r.feature for r in out if r.doc_id in (1, 2)}) == 1
    one = tokens.op9_bpe(spark, str(tmp_path)).filter("doc_id = 2").first()
    assert (one.n_tokens, one.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
