"""Forced alignment of long clips: bounded memory, the path of the whole table."""

import tracemalloc

import numpy as np
import pytest

from tessela.operators import sequences


def test_long_clips_are_aligned_in_bounded_memory():
    rng = np.random.default_rng(1)
    lp = rng.normal(size=(3000, 16))
    best = lp.argmax(1)
    target = [int(b) for a, b in zip(np.append(-1, best[:-1]), best, strict=True) if b not in (a, 15)]
    tracemalloc.start()
    first, last, _ = sequences.forced_alignment(lp, target, 15)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40 << 20  # the table of frames and states has 134 MB
    assert (first <= last).all() and (last[:-1] < first[1:]).all()


@pytest.mark.parametrize("n, share", [(200, 0.1), (200, 0.5), (200, 0.9), (60, 1.0)])
def test_paths_made_part_by_part_are_the_same(monkeypatch, n, share):
    rng = np.random.default_rng(n)
    lp = np.round(rng.normal(size=(n, 5)), 1)
    target = [int(i) for i in rng.integers(0, 4, int(n * share))]
    whole = sequences.forced_alignment(lp, target, 4)
    monkeypatch.setattr(sequences, "BACK_BYTES", 1)
    parts = sequences.forced_alignment(lp, target, 4)
    assert (whole is None) == (parts is None)
    if whole:
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_ids_of_a_clip_travel_once(spark):
    frames = spark.createDataFrame([(c, t, [0.0, -1.0, -2.0]) for c in (1, 2, None) for t in range(4)], "clip_id long, t long, lp array<double>")
    targets = spark.createDataFrame([(1, [0, 1]), (3, [1])], "clip_id long, ids array<int>")
    made = sequences.align_tokens(frames, targets, 2).orderBy("k").collect()
    assert [(r.clip_id, r.k, r.id) for r in made] == [(1, 0, 0), (1, 1, 1)]


def test_targets_may_come_from_the_frames(spark):
    frames = spark.createDataFrame([(1, t, [float(t == 0), float(t == 1), -2.0]) for t in range(2)], "clip_id long, t long, lp array<double>")
    made = sequences.align_tokens(frames, sequences.greedy_ids(frames, 2), 2).orderBy("k").collect()
    assert [(r.id, r.first, r.last) for r in made] == [(0, 0, 0), (1, 1, 1)]
