"""Every query and every stage on null ids, large ids, long texts, repeated ids and rows, clashing columns and nothing."""

from __future__ import annotations

import hashlib
import zlib

import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from symloom.llm import exact_dedup, language, ngram_join, packing, privacy, repeats
from symloom.llm.queries import QUERIES

BIG = 2**53 + 1
#: Names that operators use inside.
CLASHING = ["key", "label", "group", "block", "doc", "th", "row", "id", "sha", "host", "class", "symloom", "n", "term", "sequence_id"]
PROSE = "the cat sat on the mat and looked at the other cat which did not sit on any mat at all"


def edge_rows():
    long_word, digits, address = "w" * 300_000, "1" * 300_000, "a@b" + ".c" * 20_000
    texts = [PROSE, None, "", long_word, digits, address, PROSE + " again", PROSE.upper()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, PROSE), (None, "a text under no id"), (BIG, "one text of an id"), (BIG, "another text of that id"), (BIG, "another text of that id"), (BIG + 2, PROSE), (-5, "ends with one\n\n\nof +49 30 1234567 and 4111 1111 1111 1111")]
    return rows


def table(spark, rows):
    more = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *CLASHING) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    table(spark, edge_rows()).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, 1), (2, 0), (None, 1), (6, 1), (7, 0)], "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    table(spark, []).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    return str(path)


NAMES = [n for n in QUERIES if n != "op6_pages"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, folder, name):
    got = QUERIES[name](spark, folder).collect()
    ids = sorted((r.doc_id for r in got if name != "op4_packing" or r.piece == 0), key=lambda i: (i is None, i or 0))
    assert ids == sorted((i for i, _ in edge_rows()), key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("name", NAMES)
def test_nothing_gives_nothing(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_media_digests_are_those_of_the_texts(spark, folder):
    got = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in QUERIES["op2_media"](spark, folder).collect())
    want = []
    for _, text in edge_rows():
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == sorted(want)


def test_components_of_rows_without_usable_ids(spark):
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.components(table(spark, edge_rows())).collect()), key=str)
    prose = {0, None, 7, BIG + 2}
    assert [c for i, c in got if i in prose - {None}] == [0] * 3 and sorted(str(c) for i, c in got if i is None) == ["0", "None"]
    assert [c for i, c in got if i == BIG] == [BIG] * 3


def stage_rows(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text", *CLASHING).collect() if [r[c] for c in CLASHING] == CLASHING), key=str)


def test_exact_stage_drops_rows_not_ids(spark):
    kept = stage_rows(exact_dedup.kept_documents(table(spark, [*edge_rows(), (1_000, "A"), (5_000, "A"), (1_000, "B"), (7_000, "same"), (7_000, "same")])))
    texts = [t or "" for _, t in kept]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in edge_rows()} | {"A", "B", "same"})
    assert {(5_000, "A"), (1_000, "B"), (7_000, "same"), (BIG, "one text of an id"), (BIG + 2, PROSE), (None, "a text under no id")} <= set(kept)


def test_near_stage_drops_rows_not_ids(spark):
    kept = stage_rows(ngram_join.one_of_each(table(spark, edge_rows()), 8, 10, 5))
    assert [i for i, t in kept if (t or "").lower().startswith(PROSE[:30])] == [0]
    assert (BIG, "one text of an id") in kept and kept.count((BIG, "another text of that id")) == 1 and (None, "a text under no id") in kept
    assert (1, None) in kept and (2, "") in kept


def test_language_stage_judges_rows(spark):
    rows = [(k, PROSE + f" {k}") for k in range(20)] + [(3, ""), (4, None), (5, "☃" * 90), (None, PROSE), (None, "")]
    df = table(spark, rows)
    kept = stage_rows(language.in_a_language(df, language.fit(table(spark, rows[:20]))))
    assert kept == sorted([*rows[:20], (None, PROSE)], key=str)


def test_privacy_and_packing_stages_keep_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = stage_rows(pipeline.without_personal_data(spark, table(spark, edge_rows()), ""))
    assert len(out) == len(edge_rows()) and not any("@b.c" in (t or "") for _, t in out) and any("[CARD]" in (t or "") for _, t in out)
    assert packing.pack_documents(table(spark, edge_rows())).filter("piece = 0").count() == len(edge_rows())


def test_repeated_base_spans_in_long_texts(spark):
    many = "x 1.2.3.4 é +49 30 1234567, " * 700
    (row,) = privacy.with_base_spans(table(spark, [(1, many)])).collect()
    assert [len(row[k]) for k in privacy.KINDS] == [0, 700, 0, 700]
    assert all(many[s.start : s.end] == "1.2.3.4" == s.value for s in row.ip) and row.ip[-1].start == 699 * 28 + 2


def test_passages_by_words(spark):
    run = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "start " + run + " end"), (2, run.replace(" ", "\n\t")), (3, " ".join(run.split()[:49])), (4, " ".join(run.split()[10:60]) + " x"), (5, None), (6, "short")]
    got = {r.doc_id: r.repeats_passage for r in repeats.passages(table(spark, rows)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}
