"""N-gram join, exact dedup and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from symloom.llm import exact_dedup, ngram_join, repeats
from symloom.llm.components import connected_components

from .conftest import frame, words


def sets_of(rows, width=3):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        out[i] = s
    return out


def brute_components(rows, num, den, width=3):
    sets = sets_of(rows, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("num", "den", "width", "chunk"), [(9, 10, 3, 512), (8, 10, 5, 3)])
def test_components_equal_brute_force(docs, rows, num, den, width, chunk):
    got = ngram_join.components(docs, num, den, width, chunk).collect()
    want = brute_components(rows, num, den, width)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *v) for i, v in want.items()}


def test_chains_and_hot_groups(spark):
    """A chain whose ends do not link, and one group much larger than a chunk."""
    rng = random.Random(8)
    base = words(rng, 60).split()
    rows = []
    for k in range(30):
        base = [*base]
        base[(k * 7) % 60] = f"w{k}"
        rows.append((k, " ".join(base)))
    copy = words(rng, 100).split()
    rows += [(100 + k, " ".join([*copy[:-1], f"end{k}"])) for k in range(40)]
    got = ngram_join.components(frame(spark, rows), 8, 10, 3, chunk=6).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, c) for i, (_, c) in brute_components(rows, 8, 10).items()}


def test_segment_keys_meet_for_every_linked_pair():
    """Whatever the sizes and empty segments: linked sets share a key."""
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10), (7, 10)):
        classes = ngram_join.SizeClasses(num, den)
        for n in [*range(1, 40), 90, 333]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                drop = rng.integers(0, max(1, n // 9) + 1)
                b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**64, drop, dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                if len(b) and both and classes.links(both, len(a), len(b)):
                    assert np.intersect1d(ngram_join.segment_keys(a, classes), ngram_join.segment_keys(b, classes)).size


def test_tree_prunes_without_losing_links():
    rng = np.random.default_rng(4)
    classes = ngram_join.SizeClasses(8, 10)
    sets = [np.unique(rng.integers(0, 2**64, rng.integers(20, 90), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[s[2:], rng.integers(0, 2**64, 1, dtype=np.uint64)]) for s in sets[:20]]
    tree = ngram_join.SignatureTree(sets, classes, list(range(len(sets))))
    root = tree.build(list(range(len(sets))))
    tree.join(root, root)
    assert all(tree.find(k) == tree.find(60 + k) for k in range(20)) and tree.compared < 80 * 79 / 2 / 4


def test_one_of_each(docs, rows):
    kept = {r.doc_id for r in ngram_join.one_of_each(docs, 9, 10).collect()}
    assert kept == {c for _, c in brute_components(rows, 9, 10).values()}


def test_empty_tables(nothing):
    assert ngram_join.components(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert repeats.without_repeats(nothing).count() == 0


def test_connected_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_exact_dedup(docs, rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {r.doc_id for r in exact_dedup.kept_documents(docs).collect()} == {w[1] for w in want}


def test_prefixes_alone_do_not_make_copies(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(1, "a" * 300 + "x"), (2, "a" * 300 + "y"), (3, "a" * 300 + "x")])).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(1, 3), (2, 2), (3, 3)}


def brute_repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        covered = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k] += 1
                covered[k + length] -= 1
        hit = np.cumsum(covered)[:-1] > 0
        out.append((i, np.frombuffer(b, np.uint8)[~hit].tobytes(), int((np.diff(np.r_[False, hit].astype(int)) == 1).sum())))
    return sorted(out)


@pytest.mark.parametrize("wide_from", [repeats.WIDE, 0])
def test_repeated_strings_equal_brute_force(docs, rows, monkeypatch, wide_from):
    got = repeats.repeated_spans(docs, wide_from=wide_from).collect()
    cut = [(r.doc_id, repeats._rest(r.text.encode(), s := np.frombuffer(r.packed or b"", "<i8").reshape(-1, 2).tolist()), len(s)) for r in got]
    assert sorted(cut) == brute_repeats(rows, repeats.LENGTH)


def test_repeats_across_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(6)
    shared = words(rng, 150)
    rows = [(1, words(rng, 200) + shared + words(rng, 300)), (2, shared), (3, words(rng, 90) + shared[:420] + words(rng, 40)), (4, "ab" * 900)]
    got = repeats.without_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, bytes(r.kept), len(r.spans)) for r in got) == brute_repeats(rows, repeats.LENGTH)


def test_cover_is_a_difference_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_linked_pairs_equal_brute_force(docs, rows):
    """Every link between different sets, also within a component, each set under one id."""
    unique = {i: t for i, t in rows}
    sets = sets_of(unique.items())
    leader: dict = {}
    for i in sorted(sets):
        if sets[i]:
            leader.setdefault(frozenset(sets[i]), i)
    lead = sorted(leader.values())
    want = {(a, b, both) for k, a in enumerate(lead) for b in lead[k + 1 :] if (both := len(sets[a] & sets[b])) and 10 * both >= 8 * len(sets[a] | sets[b])}
    df = docs.groupBy("doc_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")
    assert {r.doc_id: r.text for r in df.collect()} == unique
    for chunk in (512, 4):
        assert {tuple(r) for r in ngram_join.linked_pairs(df, 8, 10, 3, chunk).collect()} == want and len(want) > 20


def test_groups_held_together_by_common_lines(spark):
    """Many documents share lines and little else; near copies among them are found, others stay alone, whatever the chunk."""
    rng = random.Random(21)
    lines = [words(rng, 6) for _ in range(4)]
    rows = [(k, "\n".join([*rng.sample(lines, 2), words(rng, rng.randint(3, 40)), rng.choice(lines)])) for k in range(120)]
    rows += [(500 + k, rows[k][1] + " more") for k in range(0, 40, 4)]
    rows += [(700 + k, "\n".join(rng.sample(lines, 3))) for k in range(30)]
    want = {(i, c) for i, (_, c) in brute_components(rows, 8, 10).items()}
    for chunk in (512, 8):
        assert {(r.doc_id, r.component_id) for r in ngram_join.components(frame(spark, rows), 8, 10, 3, chunk).collect()} == want


def test_blocks_of_parts_find_all(spark, monkeypatch):
    """A group whose components meet in many small parts of either side."""
    monkeypatch.setattr(ngram_join, "PART", 400)
    rng = random.Random(22)
    base = words(rng, 50).split()
    rows = []
    for k in range(60):
        changed = [w if rng.random() > 0.09 else f"x{rng.randint(0, 9)}" for w in base]
        rows.append((k, " ".join(changed)))
    want = {(i, c) for i, (_, c) in brute_components(rows, 8, 10).items()}
    assert 2 < len({c for _, c in want}) < 60
    assert {(r.doc_id, r.component_id) for r in ngram_join.components(frame(spark, rows), 8, 10, 3, 5).collect()} == want
