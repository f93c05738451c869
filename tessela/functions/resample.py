"""Band-limited resampling: a windowed sinc filter in polyphase form.

With up / down the reduced ratio of the rates, output m stands at input position
m * down / up, so there are only ``up`` different filters; each is one row of taps,
normalised to a gain of 1 at frequency 0.  Long clips are resampled block by block: a block
gets the edges of its neighbours by a join on (clip, seq) and gives the outputs that stand
inside it, so that blocks of one clip are work for many tasks and equal the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side.
CROSSINGS = 32
OUT = "clip_id {key}, seq long, first long, sr int, samples array<double>"


def reach(rate: int, to: int) -> int:
    """Input samples that an output needs on each side."""
    return math.ceil(CROSSINGS * max(1.0, rate / to))


@lru_cache(maxsize=32)
def phases(rate: int, to: int) -> np.ndarray:
    """(up, 2 * reach) taps: row f is for outputs f / up behind an input sample, its first
    column reach - 1 samples before that."""
    up = to // math.gcd(rate, to)
    cut, wide = min(1.0, to / rate), CROSSINGS * max(1.0, rate / to)
    r = reach(rate, to)
    d = np.arange(up)[:, None] / up - np.arange(1 - r, r + 1)[None, :]
    window = 0.42 + 0.5 * np.cos(np.pi * d / wide) + 0.08 * np.cos(2 * np.pi * d / wide)
    taps = np.where(np.abs(d) < wide, np.sinc(cut * d) * window, 0.0)
    return taps / taps.sum(1, keepdims=True)


def outputs(n: int, rate: int, to: int) -> int:
    """How many outputs stand before input position ``n``."""
    g = math.gcd(rate, to)
    return -(-n * (to // g) // (rate // g))


def stretch(x: np.ndarray, at: int, rate: int, to: int, first: int, end: int, rows: int = 8192) -> np.ndarray:
    """Outputs first..end - 1, where ``x[0]`` is input sample ``at`` and what lies outside of
    ``x`` is 0."""
    g, r = math.gcd(rate, to), reach(rate, to)
    up, down, taps = to // g, rate // g, phases(rate, to)
    padded = np.concatenate([np.zeros(2 * r), x, np.zeros(2 * r)])
    out = np.empty(end - first)
    for i in range(first, end, rows):
        m = np.arange(i, min(i + rows, end))
        base = m * down // up - at + 2 * r - (r - 1)
        out[m - first] = np.einsum("ij,ij->i", padded[base[:, None] + np.arange(2 * r)], taps[m * down % up])
    return out


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A whole clip: ceil(n * to / rate) samples."""
    x = np.asarray(x, np.float64)
    return x if rate == to else stretch(x, 0, rate, to, 0, outputs(len(x), rate, to))


def resample_blocks(blocks: DataFrame, block: int, to: int) -> DataFrame:
    """OUT rows of (clip_id, seq, sr, samples): block ``seq`` starts at sample seq * ``block``,
    all but a clip's last one are full; ``first`` is the number of the first output.

    A block must be as long as the filter reaches, or the task fails."""
    key = dict(blocks.dtypes)["clip_id"]
    far = F.ceil(F.lit(float(CROSSINGS)) * F.greatest(F.lit(1.0), F.col("sr") / to)).cast("int")
    own = blocks.select("clip_id", "seq", "sr", "samples")
    n = F.size("samples")
    tail = own.select("clip_id", (F.col("seq") + 1).alias("seq"), F.slice("samples", F.greatest(n - far, F.lit(0)) + 1, far).alias("before"))
    head = own.select("clip_id", (F.col("seq") - 1).alias("seq"), F.slice("samples", F.lit(1), far).alias("after"))
    rows = own.join(tail, ["clip_id", "seq"], "left").join(head, ["clip_id", "seq"], "left")
    schema = OUT.format(key=key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clip, made = batch.column(0), []
            for seq, rate, x, before, after in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                seq, rate = seq.as_py(), rate.as_py()
                parts = [np.asarray(p.values.to_numpy(zero_copy_only=False) if p.is_valid else [], np.float64) for p in (before, x, after)]
                if after.is_valid and block < reach(rate, to):
                    raise ValueError(f"blocks of {block} samples are shorter than the filter's {reach(rate, to)}")
                start = seq * block
                first, end = outputs(start, rate, to), outputs(start + len(parts[1]), rate, to)
                y = parts[1] if rate == to else stretch(np.concatenate(parts), start - len(parts[0]), rate, to, first, end)
                made.append((seq, first, y))
            cuts = np.cumsum([0, *(len(y) for _, _, y in made)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.empty(0), *(y for _, _, y in made)])))
            columns = [clip, pa.array([s for s, _, _ in made], pa.int64()), pa.array([f for _, f, _ in made], pa.int64()), pa.array([to] * len(made), pa.int32()), values]
            yield pa.RecordBatch.from_arrays(columns, ["clip_id", "seq", "first", "sr", "samples"])

    return rows.select("clip_id", "seq", "sr", "samples", "before", "after").mapInArrow(run, schema)
