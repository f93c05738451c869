"""Batched decoding with caches against each row alone without any."""

import numpy as np
import pytest

from tessela.operators import decoding

END, PROMPT = 2, [3, 5]


def attention_weights(rng, v=9, h=6, d=4):
    shapes = {"token/table": (v, h), "position/table": (300, h), "features/kernel": (d, h), **{f"{n}/kernel": (h, h) for n in ("key", "value", "query")}}
    return {k: rng.normal(size=s) for k, s in shapes.items()}


def attention_alone(w, x, most, not_first):
    """All tokens are computed again at each step."""
    ids = list(PROMPT)
    while len(ids) - len(PROMPT) < most:
        rows = [x @ w["features/kernel"], *(w["token/table"][t] + w["position/table"][min(p, 299)] for p, t in enumerate(ids))]
        keys, values = ([r @ w[f"{n}/kernel"] for r in rows] for n in ("key", "value"))
        fit = np.array([rows[-1] @ w["query/kernel"] @ k for k in keys]) / np.sqrt(len(rows[-1]))
        share = np.exp(fit - fit.max())
        hidden = rows[-1] + sum(s * v for s, v in zip(share / share.sum(), values, strict=True))
        scores = w["token/table"] @ hidden
        if len(ids) == len(PROMPT):
            scores[list(not_first)] = -np.inf
        if (best := int(scores.argmax())) == END:
            break
        ids.append(best)
    return ids[len(PROMPT) :]


@pytest.mark.parametrize(("most", "not_first"), [(224, ()), (7, (0, 1, END)), (1, (4,)), (0, ())])
def test_cached_batches_equal_rows_alone(most, not_first):
    rng = np.random.default_rng(most)
    w = attention_weights(rng)
    w["token/table"][END] *= 0.7
    x = rng.normal(size=(40, 4)) * 2
    got = decoding.greedy(decoding.AttentionModel(w), x, PROMPT, END, most, not_first)
    assert got == [attention_alone(w, r, most, not_first) for r in x]
    if most == 224:
        assert len({len(g) for g in got}) > 1 and max(map(len, got)) == 224
    assert decoding.greedy(decoding.AttentionModel(w), x[:0], PROMPT, END) == []


def test_decode_a_table(spark):
    rng = np.random.default_rng(5)
    w = attention_weights(rng)
    table = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in w.items()], "name string, shape array<int>, values array<double>")
    rows = [(i, rng.normal(size=4).tolist() if i % 7 else None) for i in range(30)]
    frame = spark.createDataFrame(rows, "clip_id int, features array<double>")
    got = {r.clip_id: r.ids for r in decoding.decode(frame, table, decoding.AttentionModel, PROMPT, END, 20).collect()}
    assert got == {i: None if x is None else attention_alone(w, np.array(x), 20, ()) for i, x in rows}
