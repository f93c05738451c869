"""Alignment in bounded memory against a whole table filled cell by cell."""

import random
import tracemalloc

import numpy as np
import pytest

from tessela.operators import judge

NONE = float("-inf")


def table_path(e, h, bounds):
    """Steps by a table; of equal scores paired first, then a gap in the heard words."""
    m, n = len(e), len(h)
    score, came = {(0, 0): (0.0, NONE, NONE)}, {}
    best = lambda options: next(k for k, x in enumerate(options) if x >= max(options) - 1e-9)
    for i in range(m + 1):
        for j in range(n + 1):
            if i == j == 0:
                continue
            pair = drop = extra = NONE
            if i and j:
                before = score[i - 1, j - 1]
                pair = max(before) + judge.word_score(e[i - 1], h[j - 1])
                came[i, j, 0] = best(before)
            if i:
                above = score[i - 1, j]
                options = (above[1] - 0.5, above[0] + (-1.5 if i in bounds and not (i == 1 and j == 0) else -3.0))
                drop = max(options)
                came[i, j, 1] = 1 if best(options) == 0 else 0
            if j:
                left = score[i, j - 1]
                options = (left[2] - 0.5, left[0] - 3.0)
                extra = max(options)
                came[i, j, 2] = 2 if left[2] > NONE and best(options) == 0 else 0
            score[i, j] = (pair, drop, extra)
    i, j, state, steps = m, n, best(score[m, n]), []
    while i or j:
        before = came[i, j, state]
        steps.append((i - 1 if state != 2 else None, j - 1 if state != 1 else None))
        i, j, state = i - (state != 2), j - (state != 1), before
    return steps[::-1]


@pytest.mark.parametrize(("leaf", "parts", "cells"), [(256, 16, 4_000_000), (1, 2, 0), (3, 3, 0), (5, 16, 30)])
def test_every_cut_gives_the_table_path(monkeypatch, leaf, parts, cells):
    monkeypatch.setattr(judge, "LEAF", leaf)
    monkeypatch.setattr(judge, "PARTS", parts)
    monkeypatch.setattr(judge, "TABLE_CELLS", cells)
    rng = random.Random(leaf)
    for _ in range(120):
        e, h = ([rng.choice(["aaaa", "aaab", "aabb", "xyz", "q", ""]) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        bounds = {rng.randrange(1, 30) for _ in range(rng.randrange(3))}
        assert judge.align(e, h, bounds) == table_path(e, h, bounds)


def test_similar_words_equal_the_table():
    rng = random.Random(4)
    e, h = (["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(60)] for _ in range(2))
    row, table = judge.similar_words(e, h), judge.score_table(e, h)
    assert all(np.array_equal(row(i), table[i]) for i in range(60))


def test_long_attempts_take_little_memory():
    """9000 words: a table of origins alone would have 243 MB."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    e = [rng.choice(vocabulary) for _ in range(9000)]
    h = [w if rng.random() < 0.9 else rng.choice(vocabulary) for w in e if rng.random() < 0.97]
    tracemalloc.start()
    steps = judge.align(e, h, {4000})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert [a for a, _ in steps if a is not None] == list(range(len(e))) and [b for _, b in steps if b is not None] == list(range(len(h)))
    assert sum(a is not None and b is not None and e[a] == h[b] for a, b in steps) > 0.85 * len(e)
