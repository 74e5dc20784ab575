"""Quality, language and personal data: held-out accuracy, enumeration, plain patterns, edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import exact_dedup, language, privacy, quality

from .conftest import frame, words


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([1, 4, 2])
    unary, ties = rng.normal(size=7), rng.normal(size=(2, 2))
    good, _, log_z = quality.forward_backward(unary, ties, counts)
    at = 0
    for k, n in enumerate(counts):
        total, by_line = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(unary[at + j] * y for j, y in enumerate(labels)) + sum(ties[a, b] for a, b in itertools.pairwise(labels)))
            total += w
            by_line += w * np.array(labels)
        assert np.allclose(good[at : at + n], by_line / total) and math.isclose(log_z[k], math.log(total))
        at += n


def test_quality_held_out(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, "\n".join(words(rng, 9) + "." if k % 3 else words(rng, 9).upper().replace(" ", "!! ") + " ###" for _ in range(rng.randint(1, 6)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "\n\n")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op1_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95


def test_quality_without_labels_and_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


LETTERS = {"en": "etaoinshr", "de": "enisratüß", "fr": "esaitnrué"}


def language_rows(n=90):
    rng = random.Random(3)
    langs = list(LETTERS)
    return [(k, " ".join("".join(rng.choices(LETTERS[langs[k % 3]], weights=range(9, 0, -1), k=rng.randint(2, 8))) for _ in range(30)), langs[k % 3], f"h{k % 3}") for k in range(n)]


def test_language_accuracy_and_rejection(spark):
    rows = language_rows()
    df = spark.createDataFrame([*rows, (200, None, "en", None), (201, "", "en", "h0"), (202, "☃" * 90, "en", "h0"), (203, rows[0][1], "en", "h0"), (203, rows[0][1], "en", "h0")], "doc_id long, text string, lang string, source string")
    model = language.fit(df.filter("doc_id < 45"))
    got = language.identify(df, model).collect()
    assert len(got) == 95
    by_id = {r.doc_id: r for r in got}
    right = [by_id[i].lang == lang for i, _, lang, _ in rows if i >= 45]
    assert sum(right) / len(right) > 0.95 and not any(by_id[i].rejected for i, *_ in rows)
    assert all(by_id[i].rejected for i in (200, 201, 202))
    assert {r.doc_id for r in language.in_a_language(df, model).collect()} == {i for i, *_ in rows} | {203}
    assert language.identify(df.limit(0), model).count() == 0


def test_evidence_decides_where_text_does_not(spark):
    model = language.fit(spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, source string"))
    pages = spark.createDataFrame([(1, "http://x.example.de/a", "<html lang='de'><p>en</p>"), (2, "http://y.example.fr/a", "<html lang=\"fr\"><p>en</p>"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.page_languages(pages, model).collect()}
    assert (got[1].lang, got[1].declared, got[1].suffix) == ("de", "de", "de") and got[2].lang == "fr" and got[3].rejected


def test_op6_pages_judges_the_whole_table_by_markup_and_address(spark, tmp_path):
    from symloom.llm.queries import QUERIES

    spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(k, f"http://h{k % 3}.example.{'de' if k % 2 else 'fr'}/{k}", f"<html lang='{'de' if k % 2 else 'fr'}'><p>en</p>") for k in range(40)] + [(40, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in QUERIES["op6_pages"](spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(41)) and not got[40].kept
    assert all((got[k].lang, got[k].declared, got[k].suffix) == (("de" if k % 2 else "fr"),) * 3 for k in range(40))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if holds(k, m[0])]


def test_base_spans_equal_the_plain_patterns(spark, rows):
    rng = random.Random(9)
    odd = [(1000 + k, "".join(rng.choices(["a", "@", ".", "-", "_", "b.c", "1", "255", "256", " ", "+1", "4111111111111111", "(", ")", "é😀"], k=rng.randint(1, 40)))) for k in range(300)]
    found = privacy.with_base_spans(frame(spark, [*rows, *odd])).collect()
    for r in found:
        got = [f"{k}:{s.start}:{s.end}" for k in privacy.KINDS for s in r[k]]
        assert got == plain_spans(r.text), r.text[:200]


def brute_terms(texts):
    """Places of disclosing terms by document, from the definition: co-occurrence counts over all documents."""
    word = re.compile(r"[^\W_]{3,}")
    found = {i: plain_spans(t) for i, t in texts.items()}
    near = []
    for i, t in texts.items():
        for span in found[i]:
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            entity = f"{kind}:{t[a:b].lower()}"
            lo = max(0, a - privacy.CONTEXT)
            near += [(i, entity, m[0].lower(), lo + m.start(), lo + m.end()) for m in word.finditer(t[lo:a]) if m.start() > 0 or lo == 0]
            near += [(i, entity, m[0].lower(), b + m.start(), b + m.end()) for m in word.finditer(t[b : b + privacy.CONTEXT]) if m.end() < privacy.CONTEXT]
    near = [x for x in near if not re.fullmatch("[0-9]+", x[2])]
    n = len(texts)
    n_entity, n_both, n_term = {}, {}, {}
    for e in {x[1] for x in near}:
        n_entity[e] = len({x[0] for x in near if x[1] == e})
    for e, t in {(x[1], x[2]) for x in near}:
        n_both[e, t] = len({x[0] for x in near if (x[1], x[2]) == (e, t)})
        n_term[t] = sum(t in re.split(r"[\W_]+", u.lower()) for u in texts.values())
    out = {i: set() for i in texts}
    for i, e, t, a, b in near:
        ic, pmi = math.log2(n / n_entity[e]), math.log2(n * n_both[e, t] / (max(n_term[t], n_both[e, t]) * n_entity[e]))
        if n_term[t] and ic > 0 and pmi >= privacy.DISCLOSURE * ic - 1e-12:
            out[i].add((a, b))
    return out


def test_term_spans_equal_the_definition(spark):
    rng = random.Random(12)
    vocabulary = [words(rng, 1) for _ in range(400)]
    mails = [f"u{k}@host{k}.example.org" for k in range(5)] + ["10.0.0.7", "+49 30 1234567"]
    texts = {}
    for k in range(60):
        parts = rng.choices(vocabulary, k=rng.randint(0, 14))
        for _ in range(rng.choice((0, 0, 1, 2))):
            parts.insert(rng.randint(0, len(parts)), rng.choice(mails))
        texts[k] = " ".join(parts)
    got = {r.doc_id: {(s.start, s.end) for s in r.term} for r in privacy.personal_data(frame(spark, list(texts.items()))).collect()}
    assert got == brute_terms(texts) and sum(map(bool, got.values())) > 10


def test_terms_that_reveal_an_entity(spark, docs, rows, nothing):
    found = privacy.personal_data(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert len(found.collect()) == len(rows)
    named = {i: {got[i].text[s.start : s.end] for s in got[i].term} for i in (18, 19, 20, 21)}
    assert "zorblatt" in named[19] and "zorblatt" in named[20] and not named[21]
    text = {r.doc_id: r.t for r in found.select("doc_id", privacy.sanitised(found).alias("t")).collect()}
    assert "zorblatt" not in text[19] and "a.b@c" not in text[18] and "[EMAIL]" in text[18] and text[21] == got[21].text and text[1] == ""
    assert privacy.personal_data(nothing).count() == 0


def test_terms_of_an_entity_in_one_document_of_deduplicated_ones(spark):
    texts = [f"common words number{k} stand here" for k in range(40)] + ["common words quuxberg j.d@h.example.org stand here"] * 2 + ["common words stand here again"]
    docs = exact_dedup.kept_documents(frame(spark, list(enumerate(texts))))
    found = privacy.personal_data(docs)
    got = {r.doc_id: r for r in found.select("*", privacy.sanitised(found).alias("new")).collect()}
    assert len(got) == 42 and [(got[41].text[s.start : s.end], s.removed) for s in got[41].term] == [("quuxberg", True)]
    assert got[41].new == "common words  [EMAIL] stand here" and all(r.new == r.text for k, r in got.items() if k != 41)


def test_op5_digest(spark, tmp_path, docs, rows):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone, r.has_personal_data) for r in privacy.op5_pii(spark, str(tmp_path)).collect())
    want = []
    for i, text in rows:
        spans = plain_spans(text or "")
        want.append((i, hashlib.sha256(",".join(spans).encode()).hexdigest(), *(sum(s.startswith(k) for s in spans) for k in privacy.KINDS), bool(spans)))
    assert got == sorted(want)
    listed = {r.doc_id: r.spans.split(",") for r in privacy.op5_pii(spark, str(tmp_path)).collect()}
    assert [s for s in listed[18] if not s.startswith("term")] == plain_spans(dict(rows)[18])


def test_pipeline_on_a_small_folder(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    rows = [(k, words(rng, 40), "en", "s", 0) for k in range(20)]
    rows += [(50, rows[0][1], "en", "s", 0), (51, rows[1][1] + " tail", "en", "s", 0), (52, None, "en", None, None), (53, "write to q.r@s.example.com now please " + words(rng, 20), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == ({k for k in range(20)} - {0} | {50, 53}) and "[EMAIL]" in kept[53]
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(kept) and out.filter(F.col("length") > 4096).count() == 0
