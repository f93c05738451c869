"""The pitch network: convolutions over a frame of samples, and a dense layer of activations.

Weights are a table, (name, shape, values) with names layer/kernel, layer/bias,
layer/gamma, layer/beta, layer/moving_mean, layer/moving_variance; they are sent to the
workers after their number was counted (``MOST_WEIGHTS``).  A convolution is one matrix product over
all windows of a batch of frames; batch normalisation, which follows the rectifier, is one
scale and shift made when the weights arrive; frames of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WEIGHTS = 50_000_000
#: Fixed value: added to the variance in batch normalisation.
EPSILON = 1e-3
#: Frames that are computed at once.
BATCH = 24


class Conv(NamedTuple):
    """A convolution of any width, rectified, normalised and pooled in pairs."""

    name: str
    stride: int = 1


class Dense(NamedTuple):
    """A dense layer with a logistic output."""

    name: str


#: Fixed value: the layers of the pitch network, for frames of 1024 samples.
PITCH_LAYERS = [Conv("conv1", 4), Conv("conv2"), Conv("conv3"), Conv("conv4"), Conv("conv5"), Conv("conv6"), Dense("classifier")]


def windows(x: np.ndarray, width: int, stride: int) -> np.ndarray:
    """(rows, outputs, width * channels) windows of x (rows, length, channels), padded so that
    there are ceil(length / stride), the odd zero behind."""
    n = -(-x.shape[1] // stride)
    missing = max(0, (n - 1) * stride + width - x.shape[1])
    padded = np.pad(x, ((0, 0), (missing // 2, missing - missing // 2), (0, 0)))
    seen = sliding_window_view(padded, width, axis=1)[:, ::stride][:, :n]
    return seen.transpose(0, 1, 3, 2).reshape(len(x), n, -1)


class Network:
    def __init__(self, weights: dict[str, np.ndarray], layers: list[Conv | Dense]):
        self.steps = []
        for layer in layers:
            get = lambda part, name=layer.name: weights[f"{name}/{part}"]
            kernel = get("kernel")
            if isinstance(layer, Dense):
                self.steps.append((layer, kernel, get("bias"), None, None, 0))
            else:  # (width, 1, channels, filters)
                scale = get("gamma") / np.sqrt(get("moving_variance") + kernel.dtype.type(EPSILON))
                flat = kernel.reshape(-1, kernel.shape[-1])
                self.steps.append((layer, flat, get("bias"), scale, get("beta") - get("moving_mean") * scale, kernel.shape[0]))
        self.kind = self.steps[0][1].dtype

    def activations(self, frames: np.ndarray) -> np.ndarray:
        """(rows, units) for frames (rows, samples)."""
        x = frames.astype(self.kind)[:, :, None]
        for layer, kernel, bias, scale, shift, width in self.steps:
            if isinstance(layer, Dense):
                x = np.exp(-np.logaddexp(0, -(x.reshape(len(x), -1) @ kernel + bias)))
            else:
                y = np.maximum(windows(x, width, layer.stride) @ kernel + bias, 0) * scale + shift
                half = y.shape[1] // 2
                x = y[:, : 2 * half].reshape(len(y), half, 2, -1).max(2)
        return x


def gathered(weights: DataFrame) -> dict[str, np.ndarray]:
    """The weights as arrays, on the driver, if there are not too many."""
    total = weights.agg(F.sum(F.size("values"))).first()[0] or 0
    if total > MOST_WEIGHTS:
        raise ValueError(f"{total} weights; at most {MOST_WEIGHTS} are sent to the workers")
    kind = np.float64 if dict(weights.dtypes)["values"] == "array<double>" else np.float32
    return {r.name: np.array(r["values"], kind).reshape(tuple(r["shape"])) for r in weights.collect()}


def activations(frames: DataFrame, weights: DataFrame, layers: list[Conv | Dense] | None = None) -> DataFrame:
    """(key columns, a) of ``frames`` (key columns, samples): frames of one length each, already
    normalised.  Null frames have null activations."""
    layers = layers or PITCH_LAYERS
    held = frames.sparkSession.sparkContext.broadcast(gathered(weights))
    keys = [c for c in frames.columns if c != "samples"]
    element = dict(weights.dtypes)["values"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in frames.dtypes if c != "samples"), f"a {element}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(held.value, layers)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                samples = part.column(part.num_columns - 1)
                there = np.flatnonzero(samples.is_valid().to_numpy(zero_copy_only=False))
                out: list = [None] * part.num_rows
                if len(there):
                    made = net.activations(np.stack([np.asarray(samples[int(k)].values.to_numpy(zero_copy_only=False), np.float64) for k in there]))
                    for k, a in zip(there, made, strict=True):
                        out[k] = a
                a_type = pa.list_(pa.float64() if element == "array<double>" else pa.float32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, a_type)], [*keys, "a"])

    return frames.select(*keys, "samples").mapInArrow(run, schema)
