"""Greedy decoding step by step: a batch of rows advances together, each with its own cache,
and rows that reach the end token leave it.

A model is an object with ``begin(features, prompt)`` and ``advance(ids, cache)``, which
give (scores of the next token, cache) for a batch, and ``keep(cache, rows)``.  Two are
given: scores by tables, and attention over the tokens so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .network import gathered

#: Fixed value: most tokens of a chunk.
MOST_TOKENS = 224
BATCH = 256


def greedy(model, features: np.ndarray, prompt: list[int], end: int, most: int = MOST_TOKENS, not_first: tuple[int, ...] = ()) -> list[list[int]]:
    """Tokens of every row after the prompt: the best at each step, the lowest id of equals, at
    most ``most``, up to and without ``end``.  ``not_first`` are ids that cannot come first."""
    out: list[list[int]] = [[] for _ in features]
    rows = np.arange(len(features))
    if not len(rows) or most < 1:
        return out
    scores, cache = model.begin(features, prompt)
    scores = scores.copy()
    scores[:, list(not_first)] = -np.inf
    for step in range(most):
        best = scores.argmax(1)
        going = best != end
        rows, best = rows[going], best[going]
        for r, b in zip(rows, best, strict=True):
            out[r].append(int(b))
        if not len(rows) or step + 1 == most:
            break
        if not going.all():
            cache = model.keep(cache, going)
        scores, cache = model.advance(best, cache)
    return out


class TableModel:
    """Scores of the next token by the last one (``next/table``) and by the step (``step/table``),
    with a row's features added; the cache is (features, step)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.after, self.by_step = weights["next/table"], weights["step/table"]

    def begin(self, features: np.ndarray, prompt: list[int]):
        return self.advance(np.full(len(features), prompt[-1]), (features, 0))

    def advance(self, ids: np.ndarray, cache):
        features, step = cache
        return self.after[ids] + self.by_step[min(step, len(self.by_step) - 1)] + features, (features, step + 1)

    def keep(self, cache, rows: np.ndarray):
        return cache[0][rows], cache[1]


class AttentionModel:
    """One head of attention over the tokens so far.  The cache holds the keys and values of
    earlier tokens, so that a step computes one token only; features are a first token."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def entered(self, x: np.ndarray, cache):
        """(hidden, cache) after tokens x (rows, width) came in at the next place."""
        key, value = x @ self.w["key/kernel"], x @ self.w["value/kernel"]
        keys = key[:, None] if cache is None else np.concatenate([cache[0], key[:, None]], 1)
        values = value[:, None] if cache is None else np.concatenate([cache[1], value[:, None]], 1)
        fit = np.einsum("rh,rth->rt", x @ self.w["query/kernel"], keys) / np.sqrt(x.shape[1])
        share = np.exp(fit - fit.max(1, keepdims=True))
        return x + np.einsum("rt,rth->rh", share / share.sum(1, keepdims=True), values), (keys, values)

    def embedded(self, ids: np.ndarray, place: int) -> np.ndarray:
        positions = self.w["position/table"]
        return self.w["token/table"][ids] + positions[min(place, len(positions) - 1)]

    def begin(self, features: np.ndarray, prompt: list[int]):
        _, cache = self.entered(features @ self.w["features/kernel"], None)
        for i in prompt[:-1]:
            _, cache = self.entered(self.embedded(np.full(len(features), i), cache[0].shape[1] - 1), cache)
        return self.advance(np.full(len(features), prompt[-1]), cache)

    def advance(self, ids: np.ndarray, cache):
        hidden, cache = self.entered(self.embedded(ids, cache[0].shape[1] - 1), cache)
        return hidden @ self.w["token/table"].T, cache

    def keep(self, cache, rows: np.ndarray):
        return cache[0][rows], cache[1][rows]


def decode(
    rows: DataFrame, weights: DataFrame, model: Callable, prompt: list[int], end: int, most: int = MOST_TOKENS, not_first: tuple[int, ...] = ()
) -> DataFrame:
    """(key columns, ids) of ``rows`` (key columns, features), decoded by ``model`` over the weights'
    arrays.  Rows with null features have null ids."""
    held = rows.sparkSession.sparkContext.broadcast(gathered(weights))
    keys = [c for c in rows.columns if c != "features"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != "features"), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                features = part.column(part.num_columns - 1)
                there = np.flatnonzero(features.is_valid().to_numpy(zero_copy_only=False))
                out: list = [None] * part.num_rows
                if len(there):
                    x = np.stack([np.asarray(features[int(k)].values.to_numpy(zero_copy_only=False), np.float64) for k in there])
                    for k, ids in zip(there, greedy(own, x, prompt, end, most, not_first), strict=True):
                        out[k] = ids
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.list_(pa.int32()))], [*keys, "ids"])

    return rows.select(*keys, "features").mapInArrow(run, schema)
