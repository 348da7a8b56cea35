"""The search of the packing plan is the same at every size."""

import random

from netsleuth.llm.packing import completions, pack_histogram


def _bins(plan):
    return sum(t for _, t in plan)


def _hard(rng):
    n = rng.randint(9, 15)
    counts = {}
    for _ in range(n):
        x = rng.randint(20, 70)
        counts[x] = counts.get(x, 0) + 1
    return counts


def test_full_pieces_beside_a_small_set_change_nothing():
    rng = random.Random(5)
    for _ in range(150):
        small = _hard(rng)
        alone, beside = pack_histogram(small, 100), pack_histogram(small | {100: 500}, 100)
        assert _bins(beside) == _bins(alone) + 500


def test_completed_search_finds_what_dives_miss_among_many_pieces():
    small = {66: 1, 40: 1, 41: 1, 30: 1, 14: 2, 13: 1, 37: 2, 47: 1, 52: 1, 56: 1, 28: 1, 36: 1, 35: 1, 67: 1, 15: 1, 59: 1}
    plan = pack_histogram(small | {100: 500}, 100)
    used = {}
    for parts, times in plan:
        assert sum(parts) <= 100
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == small | {100: 500}
    assert _bins(plan) == 7 + 500


def test_completions_leave_the_counts_as_they_were():
    counts = {5: 3, 7: 2, 11: 1}
    seen = list(completions(sorted(counts), counts, 20))
    assert counts == {5: 3, 7: 2, 11: 1} and len(seen) == len(set(seen))
    assert all(sum(s) <= 20 for s in seen) and (11, 7) in seen and (7, 7, 5) in seen
