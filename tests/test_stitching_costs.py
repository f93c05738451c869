"""Stitching compares few pairs of words by distance, with the same result."""

import random

from tessela.operators import sequences


def test_few_distances_and_the_same_agreement(monkeypatch):
    rng, calls = random.Random(2), []
    base = ["".join(rng.choice("abcdefghijklé") for _ in range(rng.randint(2, 9))) for _ in range(20)]
    words = base + [w[:-1] + "z" for w in base]
    before, after = [rng.choice(words) for _ in range(30)], [rng.choice(words) for _ in range(30)]
    true = [[a == b or (len(a) + len(b) - sequences.edit_distance(a, b)) / (len(a) + len(b)) >= 0.8 for b in after] for a in before]
    distance = sequences.edit_distance
    monkeypatch.setattr(sequences, "edit_distance", lambda a, b: calls.append(1) or distance(a, b))
    sequences.close.cache_clear()
    sequences.overlap_of(before, after)
    assert len(calls) < 300
    assert sequences.agreement(before, after).tolist() == true
