"""Length-limited codes against the best of all lengths that a prefix code can have."""

import itertools
import random

import numpy as np
import pytest

from emberflow.llm import packed


def least_cost(counts, limit):
    """Over every choice of lengths: those that Kraft's inequality allows."""
    choices = itertools.product(range(1, limit + 1), repeat=len(counts))
    return min(sum(n * bits for n, bits in zip(counts, lengths, strict=True)) for lengths in choices if sum(2.0**-bits for bits in lengths) <= 1)


@pytest.mark.parametrize("limit", [3, 4])
def test_lengths_cost_the_least(limit):
    rng = random.Random(limit)
    for size in (2, 3, 5, 6):
        for skew in (1, 3, 9):
            counts = [1 + int(rng.random() ** skew * 1000) for _ in range(size)]
            lengths = packed.code_lengths(np.array(counts + [0]), limit)
            assert lengths[-1] == 0 and lengths.max() <= limit and sum(2.0 ** -int(b) for b in lengths[:-1]) <= 1
            assert sum(n * int(b) for n, b in zip(counts, lengths, strict=False)) == least_cost(counts, limit)
