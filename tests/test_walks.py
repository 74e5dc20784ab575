"""Walks by pairs of entry and node against walks by bits of rows."""

import numpy as np
import pytest

from symloom.operators import walks
from symloom.operators.numbered import squeezed


@pytest.mark.parametrize("pairs", [4_000_000, 30])
@pytest.mark.parametrize("max_depth", [1, 2, 10])
def test_blast_flow_scores_depth2_walks_by_pairs(monkeypatch, pairs, max_depth):
    """Halves of a batch, and edges in memory or in the file, give the same counts."""
    monkeypatch.setattr(walks, "PAIRS", pairs)
    monkeypatch.setattr(walks, "HELD", 200)
    r = np.random.default_rng(4)
    ni, nl, n = 50, 12, 70
    inner, last, calls = walks.Into(ni), walks.Into(nl), walks.From(ni)
    for kind, (into, size) in enumerate(((inner, ni), (last, nl))):
        for part in np.array_split(np.arange(size), 3):
            key = np.unique(r.choice(part, 40) * ni + r.integers(0, ni, 40))
            to, counts = np.unique(key // ni, return_counts=True)
            into.add(to, counts, key % ni)
            calls.add(ni * kind, *(squeezed(x.astype(np.int32)) for x in (to, counts, walks.steps(key % ni))))
    for edges in (inner, last, calls):
        edges.close()
    assert inner.size > 0 and inner.held > 0
    own = np.r_[np.full(20, -1), r.permutation(ni + nl)[:50]]
    links = np.sort(r.integers(0, 20, 60)), r.integers(0, ni + nl, 60)
    file, own_file = r.integers(-1, 9, ni + nl), r.integers(-1, 11, n)
    own_file[20:] = file[own[20:]]
    got = walks.reach_few(calls, own, links, file, own_file, max_depth)
    assert [x.tolist() for x in got] == [x.tolist() for x in walks.reach_counts(inner, last, own, links, file, own_file, max_depth)]


def test_flow_summary_sorts_distinct_numbers():
    from symloom.operators.numbered import distinct

    for x in ([], [3], [5, -2, 5, 2**62, -2, 5]):
        assert distinct(np.array(x, np.int64)).tolist() == sorted(set(x))
