from itertools import combinations_with_replacement

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import packing


def test_three_items_fill_exactly():
    """Exact fills are found whichever lengths they need and however large the gap is against the mean."""
    counts = np.zeros(1001, int)
    for n in (500, *range(460, 500), 200, 150, 150):
        counts[n] += 1
    first, times = packing.plan(counts)[0]
    assert sorted(first.elements()) == [150, 150, 200, 500] and times == 1


def by_hand(left, gap):
    """Whether one, two or three available items sum to ``gap``, by trying all."""
    lengths = [n for n in range(1, gap + 1) if left[n]]
    return any(sum(c) == gap and all(c.count(n) <= left[n] for n in c) for k in (1, 2, 3) for c in combinations_with_replacement(lengths, k))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=30), st.lists(st.tuples(st.integers(1, 11), st.integers(-2, 2)), max_size=12))
def test_index_of_sums_under_changes(counts, changes):
    """After any changes of the counts the index finds a complement exactly where there is one, and only of available items."""
    counts[0] = 0
    sums = packing.Sums(np.array(counts))
    for n, by in changes:
        sums.change(n, max(by, -int(sums.left[n])))
    fresh = packing.Sums(sums.left)
    assert (fresh.pairs == sums.pairs).all()
    for gap in range(1, len(counts)):
        got = sums.complement(gap)
        assert bool(got) == by_hand(sums.left.tolist(), gap)
        assert not got or (sum(got) == gap and all(got.count(n) <= sums.left[n] for n in got))
