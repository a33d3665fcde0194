"""How many sequences packing needs, against plain best-fit decreasing and the room that the plans tell."""

from collections import Counter

import numpy as np
import pytest

from quire.llm import packing


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - n)
        else:
            rooms[k] -= n
    return len(rooms)


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


CASES = {"even": lambda rng: rng.integers(1, 1025, 3000), "short": lambda rng: rng.integers(1, 60, 2000), "thirds": lambda rng: rng.integers(300, 400, 1500),
         "skewed": lambda rng: np.minimum(1024, rng.geometric(0.004, 3000)), "few": lambda rng: rng.integers(1, 1025, 7), "full": lambda rng: np.full(20, 1024),
         "one": lambda rng: np.array([5]), "none": lambda rng: np.zeros(0, np.int64), "halves": lambda rng: np.repeat([512, 513], 300)}


@pytest.mark.parametrize("name", CASES)
def test_as_few_sequences_as_best_fit_decreasing(name):
    lengths = CASES[name](np.random.default_rng(7))
    counts = counts_of(lengths, 1024)
    small, plan, bins = packing.best_plan(counts, 1024, packing.THRESHOLDS, packing.GROUPS)
    _, fresh = packing.plan_small(counts, packing.rooms_left(counts, plan, 1024, small), 1024, small)
    assert bins + fresh <= best_fit_decreasing(lengths.tolist(), 1024) * 1.002 + 1


@pytest.mark.parametrize("small, groups", [(96, 64), (200, 5), (448, 16), (512, 1)])
def test_rooms_are_those_of_the_placed_pieces(small, groups):
    lengths = np.random.default_rng(3).integers(1, 1025, 2000)
    counts = counts_of(lengths, 1024)
    plan, bins = packing.plan_large(counts, 1024, small, groups)
    ranked = np.sort(lengths[lengths > small])[::-1]
    used = np.zeros(bins, np.int64)
    for (first, at, _), end in zip(plan.tolist(), [*plan[1:, 0].tolist(), len(ranked)]):
        used[at:at + end - first] += ranked[first:end]
    assert {r: n for r, n in packing.rooms_left(counts, plan, 1024, small).items() if n} == Counter((1024 - used).tolist())
